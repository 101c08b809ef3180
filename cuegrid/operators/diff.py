"""Comparing two versions of a cue table by their verbatim stamps, and what became of edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most growth of a cue and of the whole, density from which a weak tail counts and how weak it is.
GROW_CHARS, GROW_TOTAL, DENSE, TAIL = 12, 0.08, 0.15, 0.35


def squeeze(c: Column) -> Column:
    """F12, of the validator: text without any blank."""
    return F.regexp_replace(c, "(?U)[\\s\\x1c-\\x1f]+", "")


def backfill(before: DataFrame, after: DataFrame) -> DataFrame:
    """``before`` (``rec_id, pos, stamp, text``) with the texts of ``after``; of repeated stamps the last one's counts, a missing one keeps the text."""
    last = after.groupBy("rec_id", "stamp").agg(F.max_by("text", "pos").alias("new_text"))
    return before.join(last, ["rec_id", "stamp"], "left").select("rec_id", "pos", "stamp", F.coalesce("new_text", "text").alias("text"))


def key_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per stamp whether it was kept, deleted or fabricated."""
    a, b = before.select("rec_id", "stamp").distinct().withColumn("a", F.lit(True)), after.select("rec_id", "stamp").distinct().withColumn("b", F.lit(True))
    return a.join(b, ["rec_id", "stamp"], "full").select("rec_id", "stamp", F.expr("CASE WHEN a AND b THEN 'kept' WHEN a THEN 'deleted' ELSE 'fabricated' END").alias("state"))


def structure_check(before: DataFrame, after: DataFrame, grow_chars: int = GROW_CHARS, grow_total: float = GROW_TOTAL) -> DataFrame:
    """A8 on ``rec_id, pos, stamp, text``: counts, growth, order, density of edits by tenths and the verdict ``ok``, per recording of ``before``.

    Of a stamp that ``before`` has twice, the last row's text and place count.  Texts are compared without blanks.  A row
    that was deleted counts as touched; a tenth without rows has density 0.
    """
    known = before.groupBy("rec_id", "stamp").agg(F.max_by("text", "pos").alias("src"), F.max("pos").alias("rank"))
    j = after.join(known, ["rec_id", "stamp"], "left").withColumn("hit", F.col("rank").isNotNull())
    j = j.withColumns({"a": F.length(squeeze(F.coalesce("src", F.lit("")))), "b": F.length(squeeze(F.coalesce("text", F.lit(""))))})
    j = j.withColumn("changed", F.col("hit") & (squeeze(F.coalesce("src", F.lit(""))) != squeeze(F.coalesce("text", F.lit("")))))
    prev = F.last(F.when(F.col("hit"), F.col("rank")), ignorenulls=True).over(Window.partitionBy("rec_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    j = j.withColumn("back", F.col("hit") & (F.col("rank") <= prev))
    n = lambda c: F.sum(F.coalesce(F.expr(f"CAST({c} AS BIGINT)"), F.lit(0)))
    seen = j.groupBy("rec_id").agg(
        n("hit").alias("kept"), n("NOT hit").alias("fabricated"), n("changed").alias("changed"), n(f"changed AND b - a > {grow_chars}").alias("bloated"), n("back").alias("back"),
        F.sum(F.expr("CASE WHEN hit THEN a ELSE 0 END")).alias("chars_before"), F.sum(F.expr("CASE WHEN hit THEN b ELSE 0 END")).alias("chars_after"),
    )
    state = j.groupBy("rec_id", "stamp").agg(F.max(F.col("changed").cast("int")).alias("edited"))
    w = Window.partitionBy("rec_id")
    o = before.join(state, ["rec_id", "stamp"], "left").withColumns({"i": F.row_number().over(w.orderBy("pos")) - 1, "n": F.count("*").over(w)})
    o = o.withColumn("tenth", F.expr("CAST(ceil(10.0 * (i + 1) / n) AS INT) - 1"))
    per = o.groupBy("rec_id", "tenth").agg(F.avg(F.expr("CAST(coalesce(edited, 1) AS DOUBLE)")).alias("density"), F.count("*").alias("rows"), F.sum(F.expr("CAST(edited IS NULL AS BIGINT)")).alias("deleted"))
    d = per.groupBy("rec_id").agg(F.sum("rows").alias("rows"), F.sum("deleted").alias("deleted"), (F.sum("density") / 10).alias("mean_density"), (F.sum(F.expr("CASE WHEN tenth >= 7 THEN density ELSE 0 END")) / 3).alias("tail_density"))
    r = d.join(seen, "rec_id", "left").fillna(0, ["kept", "fabricated", "changed", "bloated", "back", "chars_before", "chars_after"])
    r = r.withColumns({"growth": F.expr("(chars_after - chars_before) / greatest(chars_before, 1)"), "ordered": F.col("back") == 0, "lazy_tail": F.expr(f"mean_density > {DENSE} AND tail_density < {TAIL} * mean_density")})
    ok = f"fabricated = 0 AND bloated = 0 AND growth <= {grow_total} AND ordered AND NOT lazy_tail"
    return r.select("rec_id", "rows", "kept", "deleted", "fabricated", "changed", "bloated", "chars_before", "chars_after", "growth", "ordered", "mean_density", "tail_density", "lazy_tail", F.expr(ok).alias("ok"))


def accept_whole(before: DataFrame, after: DataFrame, doubts: DataFrame) -> DataFrame:
    """The edited texts of recordings whose edit is sound and came with a list of doubts, the texts as they were of all others.

    ``doubts``: ``rec_id, items`` (an array, null where the list could not be read); result ``rec_id, pos, stamp, text, state``.
    """
    ok = structure_check(before, after).select("rec_id", "ok")
    listed = doubts.where("items IS NOT NULL").select("rec_id").distinct().withColumn("listed", F.lit(True))
    any_answer = after.select("rec_id").distinct().withColumn("answered", F.lit(True))
    j = before.select("rec_id").distinct().join(any_answer, "rec_id", "left").join(ok, "rec_id", "left").join(listed, "rec_id", "left")
    j = j.select("rec_id", F.expr("CASE WHEN answered IS NULL THEN 'pending' WHEN listed IS NULL THEN 'no list' WHEN ok THEN 'taken' ELSE 'rejected' END").alias("state"))
    new = backfill(before, after).select("rec_id", "pos", F.col("text").alias("new_text"))
    return before.join(new, ["rec_id", "pos"]).join(j, "rec_id").select("rec_id", "pos", "stamp", F.when(F.col("state") == "taken", F.col("new_text")).otherwise(F.col("text")).alias("text"), "state")


def captured_edits(cues: DataFrame, rewrite: Callable[[Column, Column], Column]) -> DataFrame:
    """E9 on ``rec_id, cue_id, start_ms, text, language``: ``rec_id, ordinal, before, after`` of every text that a rule changes; ordinals count from 1."""
    w = Window.partitionBy("rec_id").orderBy("start_ms", "cue_id")
    c = cues.withColumn("ordinal", F.row_number().over(w)).withColumn("after", rewrite(F.col("text"), F.col("language")))
    return c.where("text <> after").select("rec_id", "ordinal", F.col("text").alias("before"), "after")


def edit_lines(edits: DataFrame) -> DataFrame:
    """The read-only table ``ordinal <TAB> before <TAB> after`` that goes with a task, one line per edit."""
    return edits.select("rec_id", "ordinal", F.concat_ws("\t", F.col("ordinal").cast("string"), "before", "after").alias("line"))


def edit_report(edits: DataFrame, final: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """J11 + S14: what became of each edit ``rec_id, pos, before, after``, given the final texts ``rec_id, pos, text``.

    A missing final leaves the edit kept.  ``rows``: ``rec_id, n`` of the table the positions count; where the final has
    another number of rows they no longer fit, so that no final is looked at.
    """
    f = final.select("rec_id", "pos", F.col("text").alias("final"))
    if rows is not None:
        fits = final.groupBy("rec_id").agg(F.count("*").alias("_n")).join(rows, "rec_id").where("_n = n").select("rec_id")
        f = f.join(fits, "rec_id", "left_semi")
    j = edits.join(f, ["rec_id", "pos"], "left")
    status = "CASE WHEN final = before THEN 'rolled back' WHEN final IS NOT NULL AND final <> before AND final <> after THEN 'edited later' ELSE 'kept' END"
    j = j.select("rec_id", "pos", "before", "after", F.expr(status).alias("status"), "final")
    w = Window.partitionBy("rec_id")
    line = "concat('- **', pos, '** [', CASE status WHEN 'rolled back' THEN '已回滚' WHEN 'kept' THEN '保留' ELSE '纠错后又改过' END, '] `', before, '` → `', after, '`', CASE WHEN status = 'edited later' THEN concat('　最终：`', final, '`') ELSE '' END)"
    return j.select("rec_id", "pos", "status", F.expr(line).alias("line"), F.count("*").over(w).alias("edits"), F.sum(F.expr("CAST(status = 'rolled back' AS BIGINT)")).over(w).alias("rolled_back"))
