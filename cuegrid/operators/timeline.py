"""Timeline operators on cues ``rec_id, cue_id, start_ms, end_ms, speaker, text``: all windows are per recording.

Ties on times are broken by ``cue_id``, so results do not depend on the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values (milliseconds): guard between cues, least overlap of cross-talk.
GUARD_MS, CROSS_TALK_MS = 40, 200


def _w(*order: str):
    return Window.partitionBy("rec_id").orderBy(*(order or ("start_ms", "end_ms", "cue_id")))


#: Length of the time slabs into which a recording is cut where only neighbours are looked at.
SLAB_MS = 3_600_000


def neighbours(cues: DataFrame, columns: dict[str, str], back: bool = False, order: tuple[str, ...] = ("start_ms", "end_ms", "cue_id"), slab_ms: int = SLAB_MS) -> DataFrame:
    """The next row's (``back``: the last row's) values of ``columns`` (new name to old), in the order of a recording.

    The window is keyed by recording and time slab, so a hot recording is many keys.  Only the edge of each slab is seen
    by its neighbour: one row per slab, over which a second window goes.  Rows without a start are a slab of their own,
    before all others.
    """
    s = cues.withColumn("_slab", F.coalesce(F.expr(f"CAST(floor(start_ms / {slab_ms}) AS BIGINT)"), F.lit(-(2**62))))
    w = Window.partitionBy("rec_id", "_slab").orderBy(*order)
    whole = F.struct(*[F.col(c).alias(k) for k, c in columns.items()])
    move = F.lag if back else F.lead
    s = s.withColumn("_near", move(whole).over(w)).withColumn("_edge", (F.row_number().over(w.orderBy(*[F.desc(c) for c in order]) if not back else w) == 1))
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    ends = s.groupBy("rec_id", "_slab").agg((F.max_by if back else F.min_by)(whole, key).alias("_end"))
    ends = ends.withColumn("_beyond", move("_end").over(Window.partitionBy("rec_id").orderBy("_slab"))).select(F.col("rec_id").alias("_r"), F.col("_slab").alias("_s"), "_beyond")
    # Only edge rows look beyond their slab: the join key of all others is null and goes nowhere.
    inner, edge = s.where("NOT _edge").withColumn("_at", F.col("_near")), s.where("_edge")
    edge = edge.join(ends, (edge.rec_id == ends._r) & (edge._slab == ends._s), "left").withColumn("_at", F.col("_beyond")).drop("_r", "_s", "_beyond")
    out = inner.unionByName(edge)
    return out.select(*cues.columns, *[F.col(f"_at.{k}").alias(k) for k in columns])


def cross_talk(end: str, nstart: str, nend: str, speaker: str = "speaker", nspeaker: str = "nspeaker", start: str = "start_ms") -> str:
    """P4 as SQL: two named, different speakers overlap by at least ``CROSS_TALK_MS``."""
    return f"coalesce({speaker} <> '' AND {nspeaker} <> '' AND {speaker} <> {nspeaker} AND least({end}, {nend}) - greatest({start}, {nstart}) >= {CROSS_TALK_MS}, false)"


def normalize_timeline(cues: DataFrame, min_ms: int = 1000, max_ms: int = 6000) -> DataFrame:
    """Durations brought between the limits without running into the next cue; cross-talk keeps its overlap."""
    c = neighbours(cues, {"ns": "start_ms", "ne": "end_ms", "nspeaker": "speaker"})
    c = c.withColumn("e1", F.expr(f"least(end_ms, start_ms + {max_ms})"))
    new = f"""CASE WHEN ns IS NULL THEN greatest(e1, start_ms + {min_ms}) WHEN {cross_talk("e1", "ns", "ne")} THEN e1
        ELSE least(greatest(e1, least(start_ms + {min_ms}, ns - {GUARD_MS})), greatest(ns - {GUARD_MS}, start_ms + 1)) END"""
    return c.withColumn("end_ms", F.expr(new)).drop("ns", "ne", "nspeaker", "e1")


def merge_speaker_overlaps(cues: DataFrame, max_ms: int = 6000) -> DataFrame:
    """Left-to-right pairs of overlapping speakers become one two-line cue; then ends are trimmed to the next start."""
    w = _w()
    c = cues.withColumns({"ns": F.lead("start_ms").over(w), "ne": F.lead("end_ms").over(w), "nspeaker": F.lead("speaker").over(w), "ntext": F.lead("text").over(w), "rn": F.row_number().over(w)})
    c = c.withColumn("m", F.expr(f"{cross_talk('end_ms', 'ns', 'ne')} AND greatest(end_ms, ne) - start_ms <= {max_ms}"))
    # In a run of true flags the odd positions open a pair, the cue behind each is absorbed.
    c = c.withColumn("last_false", F.max(F.expr("CASE WHEN NOT m THEN rn END")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("opens", F.expr("m AND (rn - coalesce(last_false, 0)) % 2 = 1")).withColumn("gone", F.coalesce(F.lag("opens").over(w), F.lit(False)))
    c = c.where("NOT gone").withColumns(
        {
            "end_ms": F.expr("CASE WHEN opens THEN greatest(end_ms, ne) ELSE end_ms END"),
            "text": F.expr("CASE WHEN opens THEN concat(speaker, ': ', coalesce(text, ''), '\\n', nspeaker, ': ', coalesce(ntext, '')) ELSE text END"),
            "speaker": F.expr("CASE WHEN opens THEN NULL ELSE speaker END"),
            "merged": F.col("opens"),
        }
    )
    v = _w("start_ms", "rn")
    c = c.withColumn("n2", F.lead("start_ms").over(v))
    return c.withColumn("end_ms", F.expr(f"CASE WHEN n2 IS NULL THEN end_ms ELSE least(end_ms, greatest(n2 - {GUARD_MS}, start_ms + 1)) END")).drop("ns", "ne", "nspeaker", "ntext", "rn", "m", "last_false", "opens", "gone", "n2")


def shift(cues: DataFrame, speed: float, offset_ms: float) -> DataFrame:
    """Local times onto the shared timeline, with those of ``words`` and ``stamps`` where there are such columns."""
    at = lambda c: c * speed + offset_ms
    out = cues.withColumns({"start_ms": at(F.col("start_ms")), "end_ms": at(F.col("end_ms"))})
    if "words" in cues.columns:
        out = out.withColumn("words", F.transform("words", lambda w: F.struct(w["word"].alias("word"), at(w["start"]).alias("start"), at(w["end"]).alias("end"))))
    if "stamps" in cues.columns:
        out = out.withColumn("stamps", F.transform("stamps", lambda x: F.struct(at(x["s"]).alias("s"), at(x["e"]).alias("e"))))
    return out


def layout_offsets(media: DataFrame) -> DataFrame:
    """Offset of each file = durations of the files before it."""
    w = Window.partitionBy("rec_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return media.withColumn("offset_ms", F.coalesce(F.sum("duration_ms").over(w), F.lit(0.0)))


def chunks(cues: DataFrame, size: int = 100) -> DataFrame:
    """Fixed batches in order."""
    return cues.withColumn("batch", F.expr(f"CAST((row_number() OVER (PARTITION BY rec_id ORDER BY cue_id) - 1) DIV {size} AS INT)"))


def sort_media(media: DataFrame) -> DataFrame:
    """O1: by creation time if every file of the folder has one, else all by birth time."""
    w = Window.partitionBy("folder")
    m = media.withColumn("clock", F.when(F.count("created").over(w) == F.count("*").over(w), F.col("created")).otherwise(F.col("birth")))
    return m.withColumn("position", F.row_number().over(Window.partitionBy("folder").orderBy("clock", "path")))


def context(cues: DataFrame, reach: int = 2) -> DataFrame:
    """Each cue with the texts of up to ``reach`` neighbours on either side."""
    w = _w("start_ms", "cue_id")
    return cues.withColumns({"before": F.collect_list("text").over(w.rowsBetween(-reach, -1)), "after": F.collect_list("text").over(w.rowsBetween(1, reach))})


def relabel(tracks: DataFrame) -> DataFrame:
    """Tracks that were merged into another go, the others are numbered densely."""
    w = Window.partitionBy("rec_id").orderBy("track_no")
    return tracks.distinct().where("merged_into IS NULL").withColumn("new_speaker", F.dense_rank().over(w) - 1)


def top_speakers(cues: DataFrame, n: int) -> DataFrame:
    """The ``n`` speakers of a recording that speak longest; ties by name."""
    g = cues.groupBy("rec_id", "speaker").agg(F.sum(F.expr("greatest(0.0, end_ms - start_ms)")).alias("total_ms"))
    w = Window.partitionBy("rec_id").orderBy(F.desc("total_ms"), "speaker")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def bystanders(cues: DataFrame, share: float = 0.03, least_ms: float = 20_000, most: int | None = None) -> DataFrame:
    """A1: speakers by time; with ``most`` the others are bystanders, else those under ``share`` of the time and under ``least_ms``.

    Cues of nobody count for nothing; the one who speaks longest never is a bystander.  Seconds and shares are rounded half to even.
    """
    g = cues.where("speaker IS NOT NULL").groupBy("rec_id", "speaker").agg(F.sum(F.expr("greatest(0.0, coalesce(end_ms, 0) - coalesce(start_ms, 0))")).alias("total_ms"))
    w = Window.partitionBy("rec_id")
    g = g.withColumn("all_ms", F.sum("total_ms").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("total_ms"), "speaker")))
    g = g.withColumn("share", F.expr("total_ms / CASE WHEN all_ms = 0 THEN 1.0 ELSE all_ms END"))
    kept = f"rank <= {int(most)}" if most else f"share >= {share} OR total_ms >= {least_ms} OR rank = 1"
    if not most:  # the first is kept only where nobody else would be, which is the same: who is first has most of both
        kept = f"({kept})"
    return g.select("rec_id", "speaker", "total_ms", "rank", F.bround(F.col("total_ms") / 1000, 1).alias("seconds"), F.bround("share", 3).alias("share"), F.expr(f"NOT ({kept})").alias("bystander"))


def speaker_summary(stats: DataFrame) -> DataFrame:
    """one line per recording: speakers with their share in percent, doubtful ones marked."""
    one = F.concat("speaker", F.lit(" "), F.bround(F.col("share") * 100, 0).cast("int").cast("string"), F.lit("%"), F.when(F.col("bystander"), "（疑似旁人）").otherwise(""))
    g = stats.withColumn("line", one).groupBy("rec_id")
    return g.agg(F.expr("array_join(transform(array_sort(collect_list(struct(rank, line))), x -> x.line), '、')").alias("line"))


def distinct_speakers(cues: DataFrame) -> DataFrame:
    """The speakers of a recording, sorted; nobody is no speaker."""
    return cues.where("speaker IS NOT NULL").groupBy("rec_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))


def drop_empty(cues: DataFrame) -> DataFrame:
    """Cues with something in them; ``dropped`` of the recording goes along as a column."""
    full = F.coalesce(F.regexp_replace("text", "(?U)\\s+", "") != "", F.lit(False))
    n = F.sum((~full).cast("int")).over(Window.partitionBy("rec_id"))
    return cues.withColumn("dropped", n).where(full)


def stage_shares(stages: DataFrame) -> DataFrame:
    """A11 on ``run_id, stage, seconds``: each stage's share of its run."""
    return stages.withColumn("share", F.expr("seconds / nullif(sum(seconds) OVER (PARTITION BY run_id), 0)"))


def union_tracks(*parts: DataFrame) -> DataFrame:
    """The cues of several files or tracks one below the other; a column that one lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
