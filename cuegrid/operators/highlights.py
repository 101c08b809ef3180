"""Highlights and chapters: budgets, answers, thinning and their place on the timeline."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.rules import chinese
from cuegrid.operators.fold import fold
from cuegrid.operators.timeline import neighbours

SINGLE_CUES, SINGLE_CHARS, BATCH_CUES = 4000, 60_000, 200
CHAPTER_MS, HIGHLIGHT_MS, LEAST_MS, BEFORE_NEXT_MS, MIN_GAP_MS = 3500, 2600, 1200, 100, 8000


def single_pass(cues: DataFrame, most_cues: int = SINGLE_CUES, most_chars: int = SINGLE_CHARS) -> DataFrame:
    """Whether a recording goes in one task: neither too many cues nor too many characters."""
    g = cues.groupBy("rec_id").agg(F.count("*").alias("cues"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return g.withColumn("single", (F.col("cues") <= most_cues) & (F.col("chars") <= most_chars))


def plan_batches(cues: DataFrame, size: int = BATCH_CUES, most_cues: int = SINGLE_CUES, most_chars: int = SINGLE_CHARS) -> DataFrame:
    """Batch 0 for recordings of a single pass, fixed batches in order for all others."""
    w = Window.partitionBy("rec_id").orderBy("start_ms", "cue_id")
    c = cues.withColumn("ordinal", F.row_number().over(w) - 1).join(single_pass(cues, most_cues, most_chars).select("rec_id", "single"), "rec_id")
    return c.withColumn("batch", F.when(F.col("single"), 0).otherwise(F.expr(f"CAST(ordinal DIV {size} AS INT)"))).drop("single")


def budgets(batches: DataFrame, per_minute: float = 1.2) -> DataFrame:
    """A12 on cues with ``batch``: minutes of each batch and how many highlights and chapters it may have; rounded half to even."""
    whole = F.count("*").over(Window.partitionBy("rec_id"))
    b = batches.withColumn("all_n", whole).groupBy("rec_id", "batch", "all_n").agg(F.min_by("start_ms", "ordinal").alias("a"), F.max_by("end_ms", "ordinal").alias("b"), F.count("*").alias("n"))
    b = b.withColumn("minutes", F.greatest((F.col("b") - F.col("a")) / 60_000, F.lit(0.1)))
    chapters = F.when(F.col("n") == F.col("all_n"), F.least(F.lit(8), F.greatest(F.lit(3), F.bround(F.col("minutes") / 8, 0).cast("int")))).otherwise(3)
    return b.select("rec_id", "batch", "minutes", F.greatest(F.bround(F.col("minutes") * per_minute, 0).cast("int"), F.lit(1)).alias("budget"), chapters.alias("chapters"))


def clean_label(text: Column, language: Column) -> Column:
    """without chapter numbers, brackets and marks at the end, Han and Latin set apart; Chinese only, else only trimmed."""
    trim = lambda c: F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")
    t = F.regexp_replace(trim(text), "(?U)^\\s*[【\\[（(]?第?\\s*[0-9一二三四五六七八九十]+\\s*(?:章|节|部分|段)[】\\])）]?[：:、.\\s-]*", "")
    t = F.regexp_replace(trim(t), "^[【\\[]|[】\\]]$", "")
    t = trim(F.regexp_replace(trim(t), "[。，、；：,.;:]+$", ""))
    t = F.regexp_replace(t, "([\\x{4e00}-\\x{9fff}])([A-Za-z0-9])", "$1 $2")
    t = F.regexp_replace(t, "([A-Za-z0-9])([\\x{4e00}-\\x{9fff}])", "$1 $2")
    return F.when(chinese(text, language), trim(t)).otherwise(trim(text))


def answer_items(answers: DataFrame, batches: DataFrame) -> DataFrame:
    """E6 on answers ``rec_id, item_no, cue, type, text`` (strings) and ``rec_id, first, last``: chapters and highlights on cues of their batch.

    Items without text, with a cue that is no number or of another batch are left out; any type but a chapter is a highlight.
    """
    j = answers.withColumn("cue", F.col("cue").try_cast("bigint")).join(batches, "rec_id").where("cue BETWEEN first AND last")
    t = clean_label(F.coalesce("text", F.lit("")), F.lit("auto"))
    return j.select("rec_id", "item_no", "cue", F.when(F.trim("type") == "chapter", "chapter").otherwise("highlight").alias("kind"), t.alias("text")).where("text <> ''")


class _Thin:
    """Keeps one pending item, as a chapter may still replace it."""

    def __init__(self, gap: float):
        self.gap, self.last, self.seen = gap, None, set()

    def row(self, r: dict) -> list[tuple]:
        key = r["key"] or ""
        if key and key in self.seen:
            return []
        near = self.last is not None and r["start_ms"] - self.last["start_ms"] < self.gap
        if near and not (r["kind"] == "chapter" and self.last["kind"] != "chapter"):
            return []
        out = []
        if near:
            self.seen.discard(self.last["key"] or "")
        else:
            out = self.end()
        self.last = r
        self.seen.add(key)
        return out

    def end(self) -> list[tuple]:
        return [(self.last["rec_id"], self.last["cue_id"], self.last["kind"])] if self.last else []


def label_key(text: Column) -> Column:
    """What labels are told apart by: letters and digits only."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)[\\s\\W_]+", "")


def dedupe(items: DataFrame, gap_ms: float = MIN_GAP_MS) -> DataFrame:
    """T6 on ``rec_id, cue_id, start_ms, kind, key``: repeated labels and items too near the last kept one go; a chapter replaces a highlight.

    Items without a label (null or empty key) are never repeats.
    """
    schema = pa.schema([("rec_id", pa.string()), ("cue_id", pa.int64()), ("kind", pa.string())])
    return fold(items.select("rec_id", "cue_id", "start_ms", "kind", "key"), ["rec_id"], ["start_ms", "cue_id"], lambda: _Thin(gap_ms), "rec_id string, cue_id bigint, kind string", schema)


def assign_timeline(items: DataFrame) -> DataFrame:
    """T7 on ``rec_id, cue_id, start_ms, kind, text, last_end``: time, running chapter number and label of each item."""
    w = Window.partitionBy("rec_id").orderBy("start_ms", "cue_id")
    i = items.withColumns({"ns": F.lead("start_ms").over(w), "chapter_no": F.sum(F.expr("CAST(kind = 'chapter' AS INT)")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    length = f"CASE WHEN kind = 'chapter' THEN {CHAPTER_MS} ELSE {HIGHLIGHT_MS} END"
    end = f"greatest(least(start_ms + {length}, coalesce(ns - {BEFORE_NEXT_MS}, last_end), last_end), start_ms + {LEAST_MS})"
    label = "CASE WHEN kind = 'chapter' THEN concat('【', chapter_no, '】', coalesce(text, '')) ELSE coalesce(text, '') END"
    return i.select("rec_id", "cue_id", "kind", "start_ms", F.expr(end).alias("end_ms"), "chapter_no", F.expr(label).alias("label"))


def rule_chapters(cues: DataFrame, gap_ms: float = 20_000) -> DataFrame:
    """A chapter begins where a cue starts at least ``gap_ms`` after the one before ends."""
    return neighbours(cues, {"p": "end_ms"}, back=True).where(f"start_ms - p >= {gap_ms}").drop("p")
