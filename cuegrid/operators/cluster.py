"""Clusters and batches: what needs memory of the rows before is a streamed fold, all else windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.operators.fold import fold


class _Cluster:
    """State of one open cluster; it closes on a pause after its own last end, then on its span."""

    def __init__(self, gap: float, span: float):
        self.gap, self.span, self.rec = gap, span, None

    def row(self, r: dict) -> list[tuple]:
        full = self.rec is not None and (r["start_ms"] - self.end_ms > self.gap or r["end_ms"] - self.first > self.span)
        out = self.end() if full else []
        if self.rec is None:
            self.rec, self.first, self.seen, self.n, self.least, self.end_ms = r["rec_id"], r["start_ms"], set(), 0, r["cue_id"], r["end_ms"]
        self.seen.add(r["speaker"])
        self.n += 1
        self.end_ms = max(self.end_ms, r["end_ms"])
        return out

    def end(self) -> list[tuple]:
        rec, self.rec = self.rec, None
        return [(rec, self.least, self.first, self.end_ms, self.n, len(self.seen))] if rec is not None and len(self.seen) > 1 else []


_CLUSTERS = pa.schema([("rec_id", pa.string()), ("first_cue", pa.int64()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("n", pa.int64()), ("speakers", pa.int64())])


def _islands(cues: DataFrame, gap_ms: float) -> DataFrame:
    """``island``: a pause after all that came before closes every cluster, so a hot recording is many keys."""
    w = Window.partitionBy("rec_id").orderBy("start_ms", "end_ms", "cue_id")
    c = cues.where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND rec_id IS NOT NULL")
    c = c.withColumn("fresh", F.coalesce((F.col("start_ms") - F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)) > gap_ms).cast("int"), F.lit(1)))
    return c.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def crosstalk_clusters(cues: DataFrame, gap_ms: float = 800, span_ms: float = 40_000) -> DataFrame:
    """Groups of cues without a pause over ``gap_ms`` and no longer than ``span_ms``, with at least two speakers.

    Both limits are told by the group's own cues: behind a span cut, what lasted longer before counts no more.  A null
    speaker counts as one; cues without times are left out.
    """
    c = _islands(cues.select("rec_id", "cue_id", "start_ms", "end_ms", "speaker"), gap_ms)
    return fold(c, ["rec_id", "island"], ["start_ms", "end_ms", "cue_id"], lambda: _Cluster(gap_ms, span_ms), "rec_id string, first_cue bigint, start_ms double, end_ms double, n bigint, speakers bigint", _CLUSTERS)


class _Member(_Cluster):
    """The same clusters, but each cue is given the first cue of its own; the speakers are counted afterwards."""

    def row(self, r: dict) -> list[tuple]:
        super().row(r)
        return [(r["rec_id"], r["cue_id"], self.least)]

    def end(self) -> list[tuple]:
        self.rec = None
        return []


_MEMBERS = pa.schema([("rec_id", pa.string()), ("cue_id", pa.int64()), ("first_cue", pa.int64())])


def cluster_members(cues: DataFrame, gap_ms: float = 800, span_ms: float = 40_000) -> DataFrame:
    """T3 by cue: ``rec_id, cue_id, first_cue`` of the cues in clusters of at least two speakers."""
    c = _islands(cues.select("rec_id", "cue_id", "start_ms", "end_ms", "speaker"), gap_ms)
    m = fold(c, ["rec_id", "island"], ["start_ms", "end_ms", "cue_id"], lambda: _Member(gap_ms, span_ms), "rec_id string, cue_id bigint, first_cue bigint", _MEMBERS)
    several = crosstalk_clusters(cues, gap_ms, span_ms).select("rec_id", "first_cue")
    return m.join(several, ["rec_id", "first_cue"], "left_semi").select("rec_id", "cue_id", "first_cue")


class _Batch:
    def __init__(self, cues: int, chars: int):
        self.most, self.chars, self.n, self.size, self.no = cues, chars, 0, 0, 0

    def row(self, r: dict) -> list[tuple]:
        k = r["chars"]
        if self.n and (self.n >= self.most or self.size + k > self.chars):
            self.no, self.n, self.size = self.no + 1, 0, 0
        self.n += 1
        self.size += k
        return [(r["rec_id"], r["cue_id"], self.no)]

    def end(self) -> list[tuple]:
        return []


def batches(cues: DataFrame, most_cues: int = 100, most_chars: int = 4000) -> DataFrame:
    """T5: greedy batches in order; a cue over the limit is a batch of its own; null text counts no characters."""
    c = cues.select("rec_id", "cue_id", "start_ms", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    schema = pa.schema([("rec_id", pa.string()), ("cue_id", pa.int64()), ("batch", pa.int64())])
    return fold(c, ["rec_id"], ["start_ms", "cue_id"], lambda: _Batch(most_cues, most_chars), "rec_id string, cue_id bigint, batch bigint", schema)


