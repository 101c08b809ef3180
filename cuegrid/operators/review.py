"""Review of cues for publication: answers, coverage, ranges, entries and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories, severities from worst, defaults, share of marked cues from which a review is suspicious.
CATEGORIES, SEVERITIES = ("敏感信息", "人身攻击", "引起不适", "冒犯性"), ("高", "中", "低")
DEFAULT_CATEGORY, DEFAULT_SEVERITY, DEFAULT_ACTION = "冒犯性", "中", "自行判断"
SUSPICIOUS = 0.3


def severity_rank(c: Column) -> Column:
    """0 for the worst; a severity that is none of the three is 9."""
    return F.coalesce(F.when(c == SEVERITIES[0], 0).when(c == SEVERITIES[1], 1).when(c == SEVERITIES[2], 2), F.lit(9))


def answer_items(answers: DataFrame, batches: DataFrame) -> DataFrame:
    """E7 on answers ``batch, item_no, cue, cue_end, category, severity, reason, action`` (strings) and ``batch, first, last``.

    An item whose cue is no number or outside its batch is left out (J3); the end is kept within cue and batch end; unknown
    categories, severities and empty actions take their defaults.
    """
    s = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    j = answers.withColumns({"cue": F.col("cue").try_cast("bigint"), "cue_end": F.col("cue_end").try_cast("bigint")}).join(batches, "batch").where("cue BETWEEN first AND last")
    return j.select(
        "batch", "item_no", "cue", F.expr("greatest(cue, least(coalesce(cue_end, cue), last))").alias("cue_end"),
        F.when(s("category").isin(*CATEGORIES), s("category")).otherwise(DEFAULT_CATEGORY).alias("category"),
        F.when(s("severity").isin(*SEVERITIES), s("severity")).otherwise(DEFAULT_SEVERITY).alias("severity"),
        s("reason").alias("reason"), F.when(s("action") == "", DEFAULT_ACTION).otherwise(s("action")).alias("action"),
    )


def next_round(progress: DataFrame, most_rounds: int = 12, size: int = 200, single_cues: int = 4000, single_chars: int = 60_000) -> DataFrame:
    """T19, one step of the coverage loop on ``rec_id, cursor, last, scanned_to, round, cues, chars``: where the next part begins and ends.

    ``cues`` and ``chars`` are those of the rest.  What an answer says it scanned is kept within its part, a missing value
    means all of it; the loop is over at the end of the recording or after ``most_rounds``.
    """
    done = F.expr("greatest(cursor, least(coalesce(scanned_to, last), last)) + 1")
    p = progress.withColumn("next", done)
    part = f"CASE WHEN cues <= {single_cues} AND chars <= {single_chars} THEN cues ELSE {size} END"
    return p.select("rec_id", F.col("next").alias("cursor"), F.expr(f"least(next + {part}, next + cues) - 1").alias("last"), (F.col("round") + 1).alias("round"), F.expr(f"cues > 0 AND round < {most_rounds}").alias("goes_on"))


def merge_ranges(items: DataFrame) -> DataFrame:
    """T4 on ``rec_id, item_no, cue, cue_end, category, severity, reason, action``: ranges that overlap or adjoin become one.

    Of each category the worst severity stays, in the place where the category came first; reasons and actions are kept
    once each, in the order of the items; empty ones are left out.
    """
    w = Window.partitionBy("rec_id").orderBy("cue", "cue_end", "item_no")
    i = items.withColumn("rank", severity_rank(F.col("severity"))).withColumn("reach", F.max("cue_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    i = i.withColumn("g", F.sum(F.expr("CASE WHEN reach IS NULL OR cue > reach + 1 THEN 1 ELSE 0 END")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = i.groupBy("rec_id", "g").agg(F.min("cue").alias("cue"), F.max("cue_end").alias("cue_end"), F.sort_array(F.collect_list(F.struct("cue", "cue_end", "item_no", "category", "severity", "rank", "reason", "action"))).alias("xs"))
    tag = """transform(array_distinct(xs.category), c -> (SELECT_WORST))""".replace(
        "(SELECT_WORST)", "aggregate(filter(xs, x -> x.category = c), named_struct('category', c, 'severity', CAST(NULL AS STRING), 'rank', 10), (s, x) -> CASE WHEN x.rank < s.rank THEN named_struct('category', c, 'severity', x.severity, 'rank', x.rank) ELSE s END)"
    )
    once = lambda c: F.expr(f"array_distinct(filter(xs.{c}, x -> x IS NOT NULL AND x <> ''))")
    return e.select("rec_id", "cue", "cue_end", F.expr(tag).alias("tags"), once("reason").alias("reasons"), once("action").alias("actions"))


def build_entries(merged: DataFrame, cues: DataFrame, tagged: bool = True) -> DataFrame:
    """Entries with time, text, label, worst severity, categories, reason and action; ``cues``: ``rec_id, ordinal, start_ms, end_ms, text``.

    Tags go from worst to mildest, equal ones in their order.  A range is joined to its cues by exploding the range, which
    no entry does beyond its own cues.
    """
    m = merged.withColumn("tags", F.expr("array_sort(transform(tags, (t, i) -> named_struct('rank', t.rank, 'i', i, 'category', t.category, 'severity', t.severity)))"))
    x = m.withColumn("ordinal", F.explode(F.expr("sequence(cue, cue_end)"))).join(cues.select("rec_id", "ordinal", "start_ms", "end_ms", "text"), ["rec_id", "ordinal"])
    g = x.groupBy("rec_id", "cue", "cue_end", "tags", "reasons", "actions").agg(F.min_by("start_ms", "ordinal").alias("start_ms"), F.max_by("end_ms", "ordinal").alias("end_ms"), F.expr("trim(array_join(transform(array_sort(collect_list(struct(ordinal, text))), x -> coalesce(x.text, '')), ' '))").alias("body"))
    label = F.expr("array_join(transform(tags, t -> concat(t.category, '·', t.severity)), '｜')")
    e = g.withColumn("label", label)
    return e.select(
        "rec_id", "cue", "cue_end", "start_ms", "end_ms", (F.concat(F.lit("【"), "label", F.lit("】"), "body") if tagged else F.col("body")).alias("text"), "body", "label",
        F.expr("tags[0].severity").alias("top_severity"), F.expr("array_sort(array_distinct(tags.category))").alias("categories"),
        F.expr("CASE WHEN size(reasons) = 0 THEN '-' ELSE array_join(reasons, '；') END").alias("reason"), F.expr(f"CASE WHEN size(actions) = 0 THEN '{DEFAULT_ACTION}' ELSE array_join(actions, ' / ') END").alias("action"),
    )


def hit_ratio(merged: DataFrame, cues: DataFrame) -> DataFrame:
    """Share of the recording's cues within marked ranges and whether it is suspiciously high."""
    n = cues.groupBy("rec_id").agg(F.count("*").alias("n"))
    m = merged.groupBy("rec_id").agg(F.sum(F.expr("cue_end - cue + 1")).alias("flagged"))
    return n.join(m, "rec_id", "left").select("rec_id", F.coalesce("flagged", F.lit(0)).alias("flagged"), F.expr("coalesce(flagged, 0) / n").alias("ratio"), F.expr(f"coalesce(flagged, 0) / n > {SUSPICIOUS}").alias("suspicious"))


def short_stamp(ms: Column) -> Column:
    """``MM:SS``, cut to the second; minutes go beyond 59."""
    s = F.floor(ms / 1000)
    pad = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat(pad(F.floor(s / 60)), F.lit(":"), pad(s % 60))


def review_report(entries: DataFrame, cues: DataFrame) -> DataFrame:
    """Per recording the counts by worst severity and the report's table rows in order; one placeholder row where nothing was found."""
    bar = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("/"))
    row = F.concat(F.lit("| "), short_stamp(F.col("start_ms")), F.lit(" - "), short_stamp(F.col("end_ms")), F.lit(" | "), "label", F.lit(" | "), bar("body"), F.lit(" | "), bar("reason"), F.lit(" | "), "action", F.lit(" |"))
    count = lambda s: F.sum((F.col("top_severity") == s).cast("bigint"))
    g = entries.withColumn("row", row).groupBy("rec_id").agg(F.count("*").alias("hits"), *[count(s).alias(k) for s, k in zip(SEVERITIES, ("high", "medium", "low"))], F.expr("array_join(transform(array_sort(collect_list(struct(cue, row))), x -> x.row), '\\n')").alias("table"))
    n = cues.groupBy("rec_id").agg(F.count("*").alias("total"))
    return n.join(g, "rec_id", "left").fillna(0, ["hits", "high", "medium", "low"]).select("rec_id", "total", "hits", "high", "medium", "low", F.coalesce("table", F.lit("| - | - | 未发现风险片段 | - | - |")).alias("table"))
