"""Glossaries: lines of ``wrong → right`` or single terms, from files and lists."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuegrid.functions.segmenting import Terms


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` of a text file, trimmed, without blank lines and comments (``#``), in the file's order."""
    f = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("line_no", "line"))
    return clean_lines(f)


def clean_lines(lines: DataFrame) -> DataFrame:
    t = lines.withColumn("line", F.regexp_replace("line", "(?U)^[\\s\ufeff]+|\\s+$", ""))
    return t.where("line <> '' AND NOT startswith(line, '#')")


def listed(value: str | None) -> list[str]:
    """Terms of a list parted by commas, enumeration commas or line breaks."""
    return [t.strip() for t in re.split(r"[,，、\n]", value or "") if t.strip()]


def merged(*parts: DataFrame) -> DataFrame:
    """The union of ``line_no, line`` tables, every line once, in the order of first appearance."""
    every = None
    for i, p in enumerate(parts):
        q = p.select(F.lit(i).alias("part"), "line_no", "line")
        every = q if every is None else every.union(q)
    first = every.groupBy("line").agg(F.min(F.struct("part", "line_no")).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at")).alias("line_no"), "line")  # a glossary is a short list


def parse(lines: DataFrame) -> DataFrame:
    """``line_no, wrong array, right``: both sides of a line; a line without an arrow has no wrong forms."""
    side = F.split("line", "→")
    wrong = F.expr("filter(transform(split(element_at(split(line, '→'), 1), '[,，、]'), x -> trim(x)), x -> x <> '')")
    return lines.select("line_no", F.when(F.size(side) > 1, wrong).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)")).alias("wrong"), F.trim(F.element_at(side, -1)).alias("right"))


def terms_of(lines: DataFrame | Iterable[str]) -> Terms:
    """The protected terms of a glossary; it is small by nature and travels with the tasks."""
    return Terms([r.line for r in lines.orderBy("line_no").collect()] if isinstance(lines, DataFrame) else lines)
