"""Problem 6: overlapping and gapped time intervals.

An ordered disjoint-interval map per entity is the keyed state; every insertion finds its overlaps by binary search,
merges them and thereby updates the gaps.  In batch the key is *(entity, time slab)*, so that an entity with a third of
all rows is many keys; a second, tiny step stitches what touches the slab borders.  ``streaming.intervals`` keeps the
same map as Structured Streaming state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.lines import read_lines
from cuegrid.operators.voices import alias_key, speaker_of, with_voices

SLAB_MS = 3_600_000
MAX_GAP_MS = 600_000


class IntervalMap:
    """Disjoint closed intervals in order; overlapping and touching ones are one."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts = starts if starts is not None else []
        self.ends = ends if ends is not None else []

    def insert(self, a: int, b: int) -> None:
        """Add ``[a, b]``; nothing happens unless ``a < b``."""
        if not a < b:
            return
        starts, ends = self.starts, self.ends
        i = bisect_left(ends, a)  # the first interval that ends at or after a
        j = bisect_right(starts, b)  # behind the last that starts at or before b
        if i < j:
            a, b = min(a, starts[i]), max(b, ends[j - 1])
        starts[i:j] = [a]
        ends[i:j] = [b]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self, longest: int | None = None) -> list[tuple[int, int]]:
        g = zip(self.ends, self.starts[1:])
        return [(a, b) for a, b in g if longest is None or b - a <= longest]


_SLAB_OUT = pa.schema([("rec_id", pa.string()), ("speaker", pa.int32()), ("slab", pa.int64()), ("kind", pa.string()), ("from_ms", pa.int64()), ("to_ms", pa.int64()), ("edge", pa.bool_())])


def _fold(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Rows come grouped by key (sorted within the partition); the state of one key at a time is held."""
    key, state = None, IntervalMap()
    out: list[tuple] = []

    def close() -> None:
        if key is None or not state.starts:
            return
        p, last = state.periods(), len(state.starts) - 1
        out.extend((*key, "period", a, b, i in (0, last)) for i, (a, b) in enumerate(p))
        out.extend((*key, "gap", a, b, False) for a, b in state.gaps(longest))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * len(_SLAB_OUT)
        out.clear()
        return pa.record_batch([pa.array(list(c), t.type) for c, t in zip(cols, _SLAB_OUT)], schema=_SLAB_OUT)

    for b in batches:
        for r, s, k, x, y in zip(*(b.column(n).to_pylist() for n in ("rec_id", "speaker", "slab", "a", "b"))):
            if (r, s, k) != key:
                close()
                key, state = (r, s, k), IntervalMap()
                if len(out) > 20000:
                    yield flush()
            state.insert(x, y)
    close()
    yield flush()


def merge_intervals(rows: DataFrame, longest_gap: int = MAX_GAP_MS, slab_ms: int = SLAB_MS) -> DataFrame:
    """``rec_id, speaker, kind, from_ms, to_ms`` of rows ``rec_id, speaker, a, b`` (bigint milliseconds).

    Rows with a null or with ``b <= a`` count for nothing; repeated rows change nothing; an empty table gives an empty
    result.  ``slab_ms`` must be at least ``longest_gap`` (then neighbours across slabs are seen by the stitching).
    """
    if slab_ms < longest_gap:
        raise ValueError("slab_ms must be at least longest_gap")
    w = rows.where("rec_id IS NOT NULL AND speaker IS NOT NULL AND b > a").select("rec_id", "speaker", "a", "b")
    cut = w.withColumn("slab", F.explode(F.expr(f"sequence(floor(a / {slab_ms}), floor((b - 1) / {slab_ms}))"))).select(
        "rec_id", F.col("speaker").cast("int").alias("speaker"), "slab",
        F.expr(f"greatest(a, slab * {slab_ms})").alias("a"), F.expr(f"least(b, (slab + 1) * {slab_ms})").alias("b"),
    )
    by = ["rec_id", "speaker", "slab"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut.repartition(n, *by).sortWithinPartitions(*by)
    folded = ordered.mapInArrow(lambda it: _fold(it, longest_gap), "rec_id string, speaker int, slab bigint, kind string, from_ms bigint, to_ms bigint, edge boolean")
    # Both uses read one shuffle's output: the periods at a slab's ends go on to the stitching, all else is final.
    cols = ["rec_id", "speaker", "kind", "from_ms", "to_ms"]
    inner = folded.where("NOT edge").select(*cols)
    e = Window.partitionBy("rec_id", "speaker").orderBy("from_ms", "to_ms")
    edges = folded.where("edge").select("rec_id", "speaker", "slab", "from_ms", "to_ms")
    edges = edges.withColumn("before", F.lag("to_ms").over(e)).withColumn("slab_before", F.lag("slab").over(e))
    edges = edges.withColumn("new", F.expr("before IS NULL OR from_ms > before"))
    edges = edges.withColumn("run", F.sum(F.col("new").cast("int")).over(e.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumn("run_to", F.max("to_ms").over(Window.partitionBy("rec_id", "speaker", "run"))).where("new")
    seen = f"before IS NOT NULL AND slab <> slab_before AND from_ms - before <= {longest_gap}"
    stitched = edges.select(
        "rec_id", "speaker",
        F.expr(f"inline(filter(array(struct('period' AS kind, from_ms AS from_ms, run_to AS to_ms), CASE WHEN {seen} THEN struct('gap' AS kind, before AS from_ms, from_ms AS to_ms) END), x -> x IS NOT NULL))"),
    )
    return inner.unionByName(stitched)


_LABELLED = pa.schema([("rec_id", pa.string()), ("cue_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("speaker", pa.string()), ("keys", pa.list_(pa.string()))])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = []
        for t in b.column("text").to_pylist():
            keys.append(list(dict.fromkeys(k for k, _, _ in read_lines(t)[1])) if t else [None])
        yield pa.record_batch([b.column("rec_id"), b.column("cue_id"), b.column("a"), b.column("b"), b.column("speaker"), pa.array(keys, pa.list_(pa.string()))], schema=_LABELLED)


def speaker_periods(cues: DataFrame, tracks: DataFrame, longest_gap: int = MAX_GAP_MS) -> DataFrame:
    """Continuous periods per speaker of a recording and the gaps of at most ``longest_gap`` ms between them.

    Cues without both bounds or with ``end_ms <= start_ms`` are left out, whatever the text; one with the lines of two
    speakers counts for both; one whose speaker is unknown counts for nobody.
    """
    c = cues.where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND end_ms > start_ms AND rec_id IS NOT NULL").select(
        "rec_id", "cue_id", F.col("start_ms").cast("bigint").alias("a"), F.col("end_ms").cast("bigint").alias("b"), alias_key(F.col("speaker")).alias("speaker"), "text"
    )
    labelled = c.mapInArrow(_labels, "rec_id string, cue_id bigint, a bigint, b bigint, speaker string, keys array<string>")
    named = with_voices(labelled, tracks)
    who = named.withColumn("who", F.explode(F.array_distinct(F.transform("keys", lambda k: speaker_of(k, F.col("speaker"))))))
    return merge_intervals(who.select("rec_id", F.col("who").alias("speaker"), "a", "b"), longest_gap)
