"""Trees of files: inventory, comparison, fingerprints of paired trees, and the checks of a translated Markdown document."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and files that belong to no inventory; what a translation may not lose.
IGNORED_DIRS, IGNORED_FILES = ("__pycache__", ".subtitle_cache", ".subtitle_tasks", ".git"), r"(^|/)\.DS_Store$|\.py[co]$"
FLAGS = r"(?<![\w-])--[a-z][a-z0-9-]*|\bSUBTITLE_[A-Z_]+\b"


def wanted(path: Column, archives: bool = False) -> Column:
    """Whether a relative path belongs to an inventory; ZIP archives at the root do only with ``archives``."""
    dirs = "|".join(re.escape(d) for d in IGNORED_DIRS)
    keep = ~path.rlike(f"(^|/)(?:{dirs})(/|$)") & ~path.rlike(IGNORED_FILES)
    return keep if archives else keep & ~path.rlike(r"(?i)^[^/]+\.zip$")


def inventory(spark: SparkSession, path: str, archives: bool = False) -> DataFrame:
    """Relative path, digest and group of every file; symbolic links are refused (on file systems that have them)."""
    root = path.rstrip("/")
    if os.path.isdir(root):
        for at, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d not in IGNORED_DIRS]
            for link in (os.path.join(at, x) for x in [*dirs, *files] if os.path.islink(os.path.join(at, x))):
                raise ValueError(f"symbolic links are not supported: {link}")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", f"^.*?{re.escape(root)}/", "")
    return f.select(rel.alias("path"), F.sha2("content", 256).alias("digest"), "content").where(wanted(F.col("path"), archives)).withColumn("group", group_of(F.col("path")))


def group_of(path: Column) -> Column:
    """The first folder of a path, ``@root`` for files at the root."""
    return F.when(path.contains("/"), F.element_at(F.split(path, "/"), 1)).otherwise("@root")


def tree_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """State of every path of either tree."""
    a, b = source.select("path", F.col("digest").alias("a")), target.select("path", F.col("digest").alias("b"))
    return a.join(b, "path", "full").select("path", F.expr("CASE WHEN a IS NULL THEN 'extra' WHEN b IS NULL THEN 'missing' WHEN a <> b THEN 'changed' ELSE 'same' END").alias("state"))


def unexpected_changes(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """Paths that came, went or changed without being allowed to."""
    return tree_diff(before, after).where("state <> 'same'").join(allowed.select("path").distinct(), "path", "left_anti")


def fingerprints(files: DataFrame, prompt_digest: str) -> DataFrame:
    """One digest per group of its paths, their digests and the prompt's, whatever their order."""
    rows = F.array_sort(F.collect_list(F.struct("path", "digest")))
    body = F.array_join(F.transform(rows, lambda x: F.concat(x["path"], F.lit("\x1f"), x["digest"])), "\x1e")
    return files.groupBy("group").agg(F.sha2(F.concat(body, F.lit("\x1e" + prompt_digest)), 256).alias("fingerprint"))


def sync_plan(source: DataFrame, target: DataFrame, state: DataFrame, prompt_digest: str, force: bool = False) -> DataFrame:
    """Per group of ``path, digest, group`` trees what a synchronisation has to do, given the state ``group, source, target`` of fingerprints.

    ``extra``: files only the target has (nothing may be done before somebody looked); ``copy``: shared files that differ;
    ``stale``: whether its documents (``*.md``) must be translated again: one is missing, or a fingerprint has changed.
    """
    doc = F.lower("path").endswith(".md")
    d = tree_diff(source, target).withColumn("group", group_of(F.col("path"))).withColumn("doc", doc)
    per = d.groupBy("group").agg(F.sum((F.col("state") == "extra").cast("int")).alias("extra"), F.sum((~F.col("doc") & F.col("state").isin("missing", "changed")).cast("int")).alias("copy"), F.sum((F.col("doc") & (F.col("state") == "missing")).cast("int")).alias("untranslated"))
    now = fingerprints(source, prompt_digest).withColumnRenamed("fingerprint", "s").join(fingerprints(target, prompt_digest).withColumnRenamed("fingerprint", "t"), "group", "full")
    j = per.join(now, "group", "left").join(state.select("group", F.col("source").alias("ws"), F.col("target").alias("wt")), "group", "left")
    return j.select("group", "extra", "copy", F.expr(f"{str(force).lower()} OR untranslated > 0 OR NOT (s <=> ws) OR NOT (t <=> wt)").alias("stale"))


def unchanged_since(before: DataFrame, now: DataFrame) -> DataFrame:
    """E13, optimistic concurrency: paths that somebody changed while the work was done; only if there are none may results be published."""
    return tree_diff(before, now).where("state <> 'same'")


def structure(text: str) -> list[str]:
    """F16: heading levels and fence languages in order; an unclosed fence raises."""
    out, fence = [], None
    for line in text.splitlines():
        m = re.match(r"\s*(`{3,}|~{3,})(.*)$", line)
        if m:
            if fence is None:
                fence = m[1][0]
                out.append("fence:" + m[2].strip())
            elif m[1][0] == fence:
                fence = None
        elif fence is None and (h := re.match(r"(#{1,6}) ", line)):
            out.append(f"h{len(h[1])}")
    if fence is not None:
        raise ValueError("a fence is not closed")
    return out


def structure_column(c: Column) -> Column:
    """F16 as a column: headings and fences apart, as an array each; null where a fence is not closed."""

    def one(t):
        try:
            s = structure(t)
        except (ValueError, AttributeError):
            return None
        return {"headings": [int(x[1]) for x in s if x[0] == "h"], "fences": [x[6:] for x in s if x.startswith("fence:")]}

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [one(t) for t in s]
        return pd.DataFrame({"headings": [r and r["headings"] for r in rows], "fences": [r and r["fences"] for r in rows]})

    return F.pandas_udf(run, "struct<headings:array<int>,fences:array<string>>")(c)


def lost_flags(source: Column, target: Column) -> Column:
    """Command options and variables of the source that the translation lacks, in order."""
    find = lambda c: F.regexp_extract_all(c, F.lit(f"({FLAGS})"), F.lit(1))
    return F.array_sort(F.array_except(find(source), find(target)))


def validate_translations(pairs: DataFrame) -> DataFrame:
    """F17 on ``path, source, target`` (texts): why a translated document is refused, null if it is not.

    It must say something else than its source, have the same headings and fences, and keep options and variables; a
    document called SKILL.md also needs front matter with its folder's name and a description, on both sides.
    """
    front = lambda c: F.regexp_extract(c, r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    name = lambda c: F.regexp_extract(front(c), r"(?m)^name:\s*['\"]?([^\s'\"]+)", 1)
    folder = F.element_at(F.split("path", "/"), -2)
    p = pairs.withColumns({"a": structure_column(F.col("source")), "b": structure_column(F.col("target")), "lost": lost_flags(F.col("source"), F.col("target"))})
    bad = lambda c: (front(F.col(c)) == "") | (name(F.col(c)) != folder) | ~front(F.col(c)).rlike(r"(?m)^description:\s*\S")
    return p.select(
        "path",
        F.when((F.coalesce(F.trim("target"), F.lit("")) == "") | (F.col("source") == F.col("target")), "untranslated")
        .when(F.col("a.headings").isNull() | F.col("b.headings").isNull(), "unclosed fence")
        .when((F.col("a") != F.col("b")), "structure")
        .when(F.size("lost") > 0, "lost options")
        .when(F.col("path").endswith("/SKILL.md") & (bad("source") | bad("target")), "front matter").alias("defect"),
    )
