"""Streaming forms: the interval map as keyed state, and late-data-aware speaking time per window."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.operators.cluster import _Cluster
from cuegrid.operators.intervals import MAX_GAP_MS, SLAB_MS, IntervalMap

OUT = "rec_id string, speaker int, slab bigint, kind string, from_ms bigint, to_ms bigint"
STATE = "starts array<bigint>, ends array<bigint>"


def _update(longest: int):
    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        m = IntervalMap(*(list(map(int, x)) for x in state.get)) if state.exists else IntervalMap()
        for pdf in pdfs:
            for a, b in zip(pdf["a"], pdf["b"]):
                m.insert(int(a), int(b))
        state.update((m.starts, m.ends))
        rows = [(*key, "period", a, b) for a, b in m.periods()] + [(*key, "gap", a, b) for a, b in m.gaps(longest)]
        yield pd.DataFrame(rows, columns=["rec_id", "speaker", "slab", "kind", "from_ms", "to_ms"])

    return update


def stream_intervals(rows: DataFrame, longest_gap: int = MAX_GAP_MS, slab_ms: int = SLAB_MS) -> DataFrame:
    """Periods and gaps per (recording, speaker, slab), brought up to date with every batch (update mode).

    The state of a key is the interval map of one slab, so it is bounded by the slab, and a hot speaker is many keys; a
    sink keeps the newest rows of each key and stitches slabs as the batch form does.  Late and repeated rows are harmless.
    """
    cut = rows.where("rec_id IS NOT NULL AND speaker IS NOT NULL AND b > a").withColumn("slab", F.explode(F.expr(f"sequence(CAST(floor(a / {slab_ms}) AS BIGINT), CAST(floor((b - 1) / {slab_ms}) AS BIGINT))")))
    cut = cut.select("rec_id", F.col("speaker").cast("int").alias("speaker"), "slab", F.expr(f"greatest(a, slab * {slab_ms})").alias("a"), F.expr(f"least(b, (slab + 1) * {slab_ms})").alias("b"))
    return cut.groupBy("rec_id", "speaker", "slab").applyInPandasWithState(_update(longest_gap), OUT, STATE, "update", "NoTimeout")


def speaking_time(cues: DataFrame, window: str = "1 hour", lateness: str = "3 days") -> DataFrame:
    """Cues and speaking time per recording and arrival window, with a watermark for rows that come late."""
    c = cues.withWatermark("ingested_at", lateness)
    return c.groupBy(F.window("ingested_at", window), "rec_id").agg(F.count("*").alias("cues"), F.sum(F.expr("greatest(0.0, coalesce(end_ms - start_ms, 0.0))")).alias("spoken_ms"))


CLUSTER = "rec_id string, first_cue bigint, start_ms double, end_ms double, n bigint, speakers bigint"
CLUSTER_STATE = "first double, last double, least bigint, n bigint, seen array<string>, held array<struct<start_ms:double,end_ms:double,cue_id:bigint,speaker:string>>"


def _clusters(gap_ms: float, span_ms: float):
    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        c, held = _Cluster(gap_ms, span_ms), []
        if state.exists:
            first, last, least, n, seen, kept = state.get
            held = [tuple(r) for r in kept]
            if n:
                c.rec, c.first, c.end_ms, c.least, c.n, c.seen = key[0], first, last, least, n, set(seen)
        for pdf in pdfs:
            held += [(float(r.start_ms), float(r.end_ms), int(r.cue_id), r.speaker) for r in pdf.itertuples()]
        held.sort(key=lambda r: r[:3])
        # Rows that earlier ones may still come before are held back until the watermark has passed them.
        until = state.getCurrentWatermarkMs()
        out: list[tuple] = []
        ready = [r for r in held if r[0] <= until]
        for s, e, i, who in ready:
            out += c.row({"rec_id": key[0], "start_ms": s, "end_ms": e, "cue_id": i, "speaker": who})
        held = held[len(ready) :]
        if c.rec is not None and not held and until > c.end_ms + gap_ms:
            out += c.end()
        if c.rec is None and not held:
            if state.exists:
                state.remove()
        else:
            if c.rec is None:
                c.first = c.end_ms = 0.0
                c.least = c.n = 0
                c.seen = set()
            state.update((c.first, c.end_ms, c.least, c.n, list(c.seen), held))
            state.setTimeoutTimestamp(max(int(held[0][0] if held else c.end_ms + gap_ms), until) + 1)
        yield pd.DataFrame(out, columns=["rec_id", "first_cue", "start_ms", "end_ms", "n", "speakers"])

    return update


def stream_clusters(cues: DataFrame, gap_ms: float = 800, span_ms: float = 40_000, lateness_ms: int = 5_000) -> DataFrame:
    """The clusters of T3 over a stream of ``rec_id, cue_id, start_ms, end_ms, speaker, at`` (``at``: the start as a timestamp).

    A recording's state is its open cluster and the rows that the watermark has not passed; a cluster comes out when a later
    cue closes it, or when the watermark has gone past the pause.
    """
    c = cues.where("rec_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL").withWatermark("at", f"{lateness_ms} milliseconds")
    return c.groupBy("rec_id").applyInPandasWithState(_clusters(gap_ms, span_ms), CLUSTER, CLUSTER_STATE, "append", "EventTimeTimeout")
