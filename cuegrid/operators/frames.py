"""Loudness frames ``group_id, track_id, frame_no, db``: smoothing, gates, separation, pooling and levels as windows and aggregates.

Tracks of a group share one timeline.  A window is keyed by a track or by a frame of a group, never by a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Floor of a level, how far over the noise floor somebody speaks, and never below.
FLOOR_DB, ABOVE_DB, LEAST_DB = -90.0, 8.0, -55.0
#: Fixed values of two-channel material: dominance, least share and seconds of the weaker side, most correlation.
DOMINANCE_DB, SIDE_SHARE, SIDE_SECONDS, MAX_CORR = 6.0, 0.05, 5.0, 0.5
SMOOTH_MS, HOLD_MS, KEEP_DB = 100, 120, -2.0


def _w(a: int, b: int):
    return Window.partitionBy("track_id").orderBy("frame_no").rowsBetween(a, b)


def levels(samples: DataFrame, frame_len: int, value: str = "x") -> DataFrame:
    """A7 on ``track_id, sample_no, <value>``: mean power of each full frame in dB, not below the floor."""
    g = samples.groupBy("track_id", F.expr(f"CAST(sample_no DIV {frame_len} AS INT)").alias("frame_no")).agg(F.avg(F.col(value) * F.col(value)).alias("p"), F.count("*").alias("n"))
    return g.where(f"n = {frame_len}").select("track_id", "frame_no", to_db(F.col("p")).alias("db"))


def to_db(power: Column) -> Column:
    return F.greatest(10 * F.log10(power + 1e-12), F.lit(FLOOR_DB))


def moving_average(frames: DataFrame, k: int, column: str = "db") -> DataFrame:
    """Centred mean over ``k`` frames, zero beyond the edges (always divided by ``k``); a shorter track stays as it is."""
    n = F.count("*").over(Window.partitionBy("track_id"))
    mean = F.sum(column).over(_w(-(k // 2), k - 1 - k // 2)) / F.lit(float(k))
    return frames.withColumn("smooth", F.when((n < k) | F.lit(k <= 1), F.col(column)).otherwise(mean))


def dilate(frames: DataFrame, k: int, mask: str = "mask") -> DataFrame:
    """A frame is on if any within ``k`` frames is."""
    return frames.withColumn("dilated", F.max(mask).over(_w(-k, k)))


def active(frames: DataFrame, above_db: float = ABOVE_DB, floor_db: float = LEAST_DB) -> DataFrame:
    """P10: frames over the track's 20th percentile by ``above_db`` and over ``floor_db``."""
    p = frames.groupBy("track_id").agg(F.expr("percentile(db, 0.2)").alias("p20"))
    return frames.join(p, "track_id").withColumn("active", (F.col("db") > F.col("p20") + above_db) & (F.col("db") > floor_db))


def best_other(frames: DataFrame, column: str = "db") -> DataFrame:
    """``other``: the loudest of the group's other tracks in the same frame, null where the track is alone."""
    w = Window.partitionBy("group_id", "frame_no")
    top = F.slice(F.sort_array(F.collect_list(F.struct(F.col(column).alias("v"), F.col("track_id").alias("t"))).over(w), asc=False), 1, 2)
    return frames.withColumn("_top", top).withColumn("other", F.expr("CASE WHEN _top[0].t = track_id THEN get(_top, 1).v ELSE _top[0].v END")).drop("_top")


def gate(frames: DataFrame, margin_db: float = KEEP_DB, frame_ms: int = 10) -> DataFrame:
    """Smoothed over 100 ms, a track is kept where it is not ``-margin_db`` below the best other, and held for 120 ms on either side."""
    s = best_other(moving_average(frames, max(1, SMOOTH_MS // frame_ms)), "smooth")
    s = s.withColumn("mask", (F.col("smooth") - F.coalesce("other", F.lit(FLOOR_DB)) > margin_db).cast("int"))
    return dilate(s, max(1, HOLD_MS // frame_ms)).select("group_id", "track_id", "frame_no", "mask", "dilated")


def separate(power: DataFrame, margin_db: float = KEEP_DB, frame_ms: int = 20) -> DataFrame:
    """T14, two channels, on ``group_id, track_id, frame_no, p``: as ``gate``, but it is the power that is smoothed; with the gain of each frame."""
    s = moving_average(power, max(1, SMOOTH_MS // frame_ms), "p").withColumn("db", to_db(F.col("smooth")))
    s = best_other(s).withColumn("mask", F.coalesce((F.col("db") - F.col("other") > margin_db).cast("int"), F.lit(1)))
    d = dilate(s, max(1, HOLD_MS // frame_ms)).withColumn("on", F.col("dilated").cast("double")).drop("smooth")
    return moving_average(d, 3, "on").select("group_id", "track_id", "frame_no", "dilated", F.col("smooth").alias("gain"))


def apply_gate(samples: DataFrame, mask: DataFrame, offsets: DataFrame, frame_len: int, frame_ms: int = 10) -> DataFrame:
    """T15 on ``track_id, sample_no, x``, masks ``track_id, frame_no, dilated`` on the shared timeline and ``track_id, offset_ms``.

    The mask goes to the file's own time, fades over three frames and multiplies the samples; outside the mask all is silent.
    """
    shift = offsets.select("track_id", F.expr(f"CAST(bround(offset_ms / {frame_ms}, 0) AS INT)").alias("shift"))
    local = samples.groupBy("track_id").agg(F.count("*").alias("n")).join(shift, "track_id")
    grid = local.select("track_id", "shift", F.explode(F.expr(f"sequence(0, CAST(n DIV {frame_len} AS INT))")).alias("frame_no"))
    on = mask.select(F.col("track_id").alias("_t"), F.col("frame_no").alias("_f"), F.col("dilated").cast("double").alias("on"))
    g = grid.join(on, (grid.track_id == on._t) & (grid.frame_no + grid.shift == on._f), "left").select("track_id", "frame_no", F.coalesce("on", F.lit(0.0)).alias("on"))
    gain = moving_average(g, 3, "on").select("track_id", "frame_no", F.col("smooth").alias("gain"))
    return samples.withColumn("frame_no", F.expr(f"CAST(sample_no DIV {frame_len} AS INT)")).join(gain, ["track_id", "frame_no"]).select("track_id", "sample_no", (F.col("x") * F.col("gain")).alias("x"))


def place_on_timeline(frames: DataFrame, offsets: DataFrame, total: int, frame_ms: int = 10) -> DataFrame:
    """T16 on ``track_id, frame_no, db`` and ``track_id, offset_ms``: frames on the shared timeline of ``total`` frames, the floor where there are none."""
    shift = offsets.select("track_id", F.expr(f"CAST(bround(offset_ms / {frame_ms}, 0) AS INT)").alias("shift"))
    moved = frames.join(shift, "track_id").select("track_id", (F.col("frame_no") + F.col("shift")).alias("frame_no"), "db")
    grid = offsets.select("track_id", F.explode(F.expr(f"sequence(0, {int(total) - 1})")).alias("frame_no"))
    return grid.join(moved, ["track_id", "frame_no"], "left").select("track_id", "frame_no", F.coalesce("db", F.lit(FLOOR_DB)).alias("db"))


def _shortest(frames: DataFrame) -> DataFrame:
    """Frames up to the end of the group's shortest track; groups of one track have none."""
    ends = frames.groupBy("group_id", "track_id").agg(F.max("frame_no").alias("end")).groupBy("group_id").agg(F.min("end").alias("end"), F.count("*").alias("tracks"))
    return frames.join(ends, "group_id").where("frame_no <= end AND tracks > 1").drop("end", "tracks")


def separation(frames: DataFrame, frame_ms: int = 20) -> DataFrame:
    """A2 (D3 for two channels): median distance of every active track to the best other, pooled over a group's tracks.

    Active is a frame over the 20th percentile of the loudest track by 8 dB, over -55 dB, and with another track on record.
    Nothing to measure gives infinity.
    """
    s = best_other(moving_average(_shortest(frames), max(1, SMOOTH_MS // frame_ms)), "smooth")
    loud = s.groupBy("group_id", "frame_no").agg(F.max("smooth").alias("m")).groupBy("group_id").agg(F.expr("percentile(m, 0.2)").alias("p20"))
    ok = s.join(loud, "group_id").where(f"smooth > p20 + {ABOVE_DB} AND smooth > {LEAST_DB} AND other > {FLOOR_DB + 10}")
    m = ok.groupBy("group_id").agg(F.expr("percentile(abs(smooth - other), 0.5)").alias("separation_db"))
    return frames.select("group_id").distinct().join(m, "group_id", "left").withColumn("separation_db", F.coalesce("separation_db", F.lit(float("inf"))))


def device_gain(frames: DataFrame) -> DataFrame:
    """A4: 90th percentile of the active frames, else the median of all."""
    a = active(frames)
    return a.groupBy("track_id").agg(F.expr("coalesce(percentile(CASE WHEN active THEN db END, 0.9), percentile(db, 0.5))").alias("gain_db"))


def pool_max(frames: DataFrame, step: int = 5) -> DataFrame:
    """Maximum of each full block of ``step`` frames, rounded half to even."""
    g = frames.groupBy("track_id", F.expr(f"CAST(frame_no DIV {step} AS INT)").alias("block")).agg(F.max("db").alias("m"), F.count("*").alias("n"))
    return g.where(f"n = {step}").select("track_id", "block", F.expr("CAST(bround(m, 0) AS INT)").alias("db"))


def same_source(frames: DataFrame, least: int = 1000, corr: float = 0.9) -> DataFrame:
    """J9 on ``group_id, file_idx, track_id, frame_no, db``: tracks of different files of a group that recorded one source.

    Compared are the frames in which the louder of the two is active; there must be ``least`` of them.
    """
    cols = lambda p: [F.col("track_id").alias(p), F.col("file_idx").alias(f"f{p}"), F.col("db").alias(f"x{p}")]
    j = frames.select("group_id", "frame_no", *cols("a")).join(frames.select("group_id", "frame_no", *cols("b")), ["group_id", "frame_no"]).where("a < b AND fa <> fb")
    j = j.withColumn("loud", F.greatest("xa", "xb"))
    p = j.groupBy("group_id", "a", "b").agg(F.expr("percentile(loud, 0.2)").alias("p20"))
    ok = j.join(p, ["group_id", "a", "b"]).where(f"loud > p20 + {ABOVE_DB} AND loud > {LEAST_DB}")
    g = ok.groupBy("group_id", "a", "b").agg(F.corr("xa", "xb").alias("r"), F.count("*").alias("n"))
    return g.where(f"n >= {least} AND r >= {corr}").select("group_id", "a", "b", "n")


#: Frames a cue may span; what is longer (a wild end stamp) is cut into parts of this length, so no row explodes without bound.
_PART = 10_000


def _cue_frames(cues: DataFrame, step_ms: int) -> DataFrame:
    """One row per cue and frame from ``floor(start)`` to ``floor(end)``; none before 0, long cues part by part."""
    c = cues.withColumn("lo", F.expr(f"greatest(0L, CAST(floor(start_ms / {step_ms}) AS BIGINT))")).withColumn("hi", F.expr(f"CAST(floor(end_ms / {step_ms}) AS BIGINT)")).where("hi >= lo")
    c = c.withColumn("part", F.explode(F.expr(f"sequence(lo DIV {_PART}, hi DIV {_PART})")))
    return c.withColumn("frame_no", F.explode(F.expr(f"transform(sequence(greatest(lo, part * {_PART}), least(hi, part * {_PART} + {_PART - 1})), x -> CAST(x AS INT))"))).drop("lo", "hi", "part")


def interval_levels(cues: DataFrame, frames: DataFrame, step_ms: int = 100) -> DataFrame:
    """J6, own level: mean of each cue's track over its frames; the floor where there is none."""
    c = _cue_frames(_bounded(cues, frames, step_ms), step_ms).select("rec_id", "cue_id", "track_id", "frame_no")
    j = c.join(frames.select("track_id", "frame_no", "db"), ["track_id", "frame_no"])
    g = j.groupBy("rec_id", "cue_id", "track_id").agg(F.avg("db").alias("mean_db"), F.count("db").alias("frames"))
    return cues.select("rec_id", "cue_id", "track_id").join(g, ["rec_id", "cue_id", "track_id"], "left").select("rec_id", "cue_id", "track_id", F.coalesce("mean_db", F.lit(FLOOR_DB)).alias("mean_db"), F.coalesce("frames", F.lit(0)).alias("frames"))


def _bounded(cues: DataFrame, frames: DataFrame, step_ms: int) -> DataFrame:
    """Cue ends cut to the end of their track."""
    last = frames.groupBy("track_id").agg(((F.max("frame_no") + 1) * step_ms - 1).cast("double").alias("_last"))
    return cues.where("start_ms IS NOT NULL AND end_ms IS NOT NULL").join(last, "track_id").withColumn("end_ms", F.least("end_ms", "_last")).drop("_last")


def own_minus_others(cues: DataFrame, frames: DataFrame, step_ms: int = 100) -> DataFrame:
    """Per cue ``diffs``, its own track minus the loudest other of the group, frame by frame up to the shortest track's end."""
    o = best_other(_shortest(frames)).where("other IS NOT NULL").select("track_id", "frame_no", (F.col("db") - F.col("other")).alias("d"))
    c = _cue_frames(_bounded(cues, frames, step_ms), step_ms).select("rec_id", "cue_id", "track_id", "frame_no")
    g = c.join(o, ["track_id", "frame_no"]).groupBy("rec_id", "cue_id", "track_id").agg(F.sort_array(F.collect_list("d")).alias("diffs"))
    return cues.select("rec_id", "cue_id", "track_id").join(g, ["rec_id", "cue_id", "track_id"], "left").withColumn("diffs", F.coalesce("diffs", F.expr("CAST(array() AS ARRAY<DOUBLE>)")))


def mark_bleed(cues: DataFrame, frames: DataFrame, margin_db: float = 0.0, step_ms: int = 100) -> DataFrame:
    """A5: a cue is bleed if the nearest-rank 75th percentile of its differences is under ``margin_db``; without frames it is kept."""
    d = own_minus_others(cues, frames, step_ms)
    p75 = F.expr("diffs[least(size(diffs) - 1, CAST(floor(size(diffs) * 0.75) AS INT))]")
    return d.select("rec_id", "cue_id", "track_id", F.when(F.size("diffs") > 0, p75).alias("p75"), F.coalesce(F.when(F.size("diffs") > 0, p75 < margin_db), F.lit(False)).alias("bleed"))


def dual_channel(samples: DataFrame, rate: int = 16_000, frame_ms: int = 20) -> DataFrame:
    """A3 on ``rec_id, sample_no, l, r``: whether the two channels are the microphones of two people, with the reason.

    Cosine of the samples as they are; shares of dominance over the active frames; separation cut at 99.
    """
    n = rate * frame_ms // 1000
    whole = samples.groupBy("rec_id").agg(F.expr("sum(l * r) / nullif(sqrt(sum(l * l) * sum(r * r)), 0)").alias("c"), F.count("*").alias("n"))
    sides = [samples.select(F.concat("rec_id", F.lit(f"\x1f{s}")).alias("track_id"), "sample_no", F.col(s).alias("x")) for s in "lr"]
    db = levels(sides[0].union(sides[1]), n).withColumn("rec_id", F.split("track_id", "\x1f")[0])
    side = lambda s: F.max(F.when(F.col("track_id").endswith(s), F.col("db")))
    f = db.groupBy("rec_id", "frame_no").agg(side("l").alias("l"), side("r").alias("r")).withColumn("loud", F.greatest("l", "r"))
    p = f.groupBy("rec_id").agg(F.expr("percentile(loud, 0.2)").alias("p20"))
    act = f.join(p, "rec_id").where(f"loud > p20 + {ABOVE_DB} AND loud > {LEAST_DB}")
    g = act.groupBy("rec_id").agg(F.count("*").alias("active"), F.avg(F.expr(f"CAST(l - r >= {DOMINANCE_DB} AS DOUBLE)")).alias("left_share"), F.avg(F.expr(f"CAST(l - r <= -{DOMINANCE_DB} AS DOUBLE)")).alias("right_share"))
    sep = separation(db.withColumn("group_id", F.col("rec_id")), frame_ms).select(F.col("group_id").alias("rec_id"), F.least("separation_db", F.lit(99.0)).alias("separation_db"))
    j = whole.join(g, "rec_id", "left").join(sep, "rec_id", "left").withColumn("corr", F.coalesce("c", F.lit(1.0))).withColumn("active_s", F.coalesce("active", F.lit(0)) * frame_ms / 1000.0)
    least = f"greatest({SIDE_SHARE}, {SIDE_SECONDS} / greatest(active_s, 1e-6))"
    verdict = f"CASE WHEN n < {rate} THEN 'too short' WHEN active_s = 0 THEN 'no speech' WHEN corr > {MAX_CORR} THEN 'same' WHEN least(left_share, right_share) < {least} THEN 'one side' ELSE 'dual' END"
    return j.select("rec_id", "corr", "active_s", F.coalesce("left_share", F.lit(0.0)).alias("left_share"), F.coalesce("right_share", F.lit(0.0)).alias("right_share"), F.expr("CASE WHEN active_s > 0 THEN separation_db END").alias("separation_db"), F.expr(verdict).alias("verdict"))
