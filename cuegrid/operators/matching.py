"""Fuzzy interval joins: duplicates across channels and re-anchoring of quoted lines."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.operators.fold import fold
from cuegrid.session import staged

#: What the two normalisers leave out (cross-channel duplicates; anchoring of quotes).
_MARKS = r"[\s，。！？；：、,.!?;:…—～~“”\"'‘’()（）《》]+"
_QUOTE_MARKS = r"[\s，。、；：,.;:！？!?]+"


def normal(c: Column, marks: str = _MARKS) -> Column:
    """a text without marks and blanks; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)" + marks, "")


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio, ``a`` sought in ``b``; not symmetric.  Two empty texts are alike."""
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the ratio of two texts can be ``least``: no more characters match than the shorter text has."""
    x, y = F.length(a), F.length(b)
    return 2 * F.least(x, y) >= least * (x + y) - 1e-9


def _letters(texts: np.ndarray) -> np.ndarray:
    """Counts of letters by their code, 128 of them, one row per text."""
    return np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 128, minlength=128) for t in texts]).astype(np.int32)


def _ratio(least: float):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        """The ratio, or -1 where the letters two texts share already show that it is under ``least``; the matcher keeps its second text."""
        out = np.full(len(a), -1.0)
        if not len(a):
            return pd.Series(out)
        (xi, xs), (yi, ys) = pd.factorize(a), pd.factorize(b)
        hx, hy = _letters(xs), _letters(ys)
        nx, ny = hx.sum(1), hy.sum(1)
        may = np.zeros(len(out), bool)
        for i in range(0, len(out), 8192):
            p, q = xi[i : i + 8192], yi[i : i + 8192]
            may[i : i + 8192] = 2 * np.minimum(hx[p], hy[q]).sum(1) >= least * (nx[p] + ny[q]) - 1e-9
        m, of, seen = difflib.SequenceMatcher(None), -1, {}
        at = may.nonzero()[0]
        for k in at[np.argsort(yi[at], kind="stable")]:
            key = (xi[k], yi[k])
            if key not in seen:
                if xs[xi[k]] == ys[yi[k]]:
                    seen[key] = 1.0
                else:
                    if yi[k] != of:
                        of = yi[k]
                        m.set_seq2(ys[of])
                    m.set_seq1(xs[xi[k]])
                    seen[key] = m.ratio() if m.quick_ratio() >= least - 1e-9 else -1.0
            out[k] = seen[key]
        return pd.Series(out)

    return run


def ratio(a: str, b: str, least: float = 0.0) -> Column:
    """``similarity`` in Arrow batches; below ``least`` it may come out as -1."""
    return F.pandas_udf(_ratio(least), "double")(a, b)


def overlapping_pairs(cues: DataFrame, bucket_ms: int = 10_000, longest_ms: int = 3_600_000) -> DataFrame:
    """Pairs of a recording's cues of different speakers that overlap in time, each once.

    Rows are put into the time buckets they touch and joined on (recording, bucket), so a hot recording is many keys; a
    pair is kept in the bucket in which its later start lies.  Cues longer than ``longest_ms`` (wild stamps) go into
    buckets of that length instead, so that no row explodes without bound: they meet all others there.
    """
    c = cues.where("end_ms > start_ms")

    def bucketed(rows: DataFrame, size: int) -> DataFrame:
        span = f"sequence(CAST(floor(start_ms / {size}) AS BIGINT), CAST(floor(least(end_ms, start_ms + 4096.0D * {size}) / {size}) AS BIGINT))"
        return rows.withColumn("bucket", F.explode(F.expr(span)))

    cols = ["cue_id", "start_ms", "end_ms", "speaker", "norm", "level"]
    first = "(a_start_ms < b_start_ms OR (a_start_ms = b_start_ms AND a_cue_id < b_cue_id))"

    def joined(x: DataFrame, y: DataFrame, size: int) -> DataFrame:
        x = bucketed(x, size).select("rec_id", "bucket", *[F.col(k).alias(f"a_{k}") for k in cols])
        y = bucketed(y, size).select("rec_id", "bucket", *[F.col(k).alias(f"b_{k}") for k in cols])
        near = f"a_start_ms < b_end_ms AND b_start_ms < a_end_ms AND NOT (a_speaker <=> b_speaker) AND {first} AND bucket = CAST(floor(b_start_ms / {size}) AS BIGINT)"
        return x.join(y, ["rec_id", "bucket"]).where(near).drop("bucket")

    short, long = c.where(f"end_ms - start_ms <= {longest_ms}"), c.where(f"end_ms - start_ms > {longest_ms}")
    return joined(short, short, bucket_ms).union(joined(short, long, longest_ms)).union(joined(long, c, longest_ms))


class _Greedy:
    def __init__(self) -> None:
        self.dropped: set[int] = set()

    def row(self, r: dict) -> list[tuple]:
        if r["a_cue_id"] in self.dropped or r["b_cue_id"] in self.dropped:
            return []
        a, b = (-90.0 if r[k] is None else r[k] for k in ("a_level", "b_level"))
        lose = r["a_cue_id"] if a < b else r["b_cue_id"]
        self.dropped.add(lose)
        return [(r["rec_id"], lose, r["b_cue_id"] if lose == r["a_cue_id"] else r["a_cue_id"])]

    def end(self) -> list[tuple]:
        return []


def dedupe_cross_channel(cues: DataFrame, similar: float = 0.55, overlap: float = 0.5) -> DataFrame:
    """J5 on ``rec_id, cue_id, start_ms, end_ms, speaker, text, level``: ``rec_id, cue_id`` (dropped), ``kept_id``.

    Candidates come from the bucketed join; the greedy resolution walks a connected stretch of time in order, so it is
    keyed by islands of overlapping pairs.
    """
    share = f"(least(a_end_ms, b_end_ms) - greatest(a_start_ms, b_start_ms)) >= {overlap} * least(a_end_ms - a_start_ms, b_end_ms - b_start_ms)"
    c = cues.withColumn("norm", normal(F.col("text"))).where("norm <> ''")  # nothing said is no repetition
    p = overlapping_pairs(c).where(share).where(may_reach(F.col("a_norm"), F.col("b_norm"), similar))
    p = p.withColumn("sim", ratio("a_norm", "b_norm", similar)).where(f"sim >= {similar}")
    w = Window.partitionBy("rec_id").orderBy("a_start_ms", "a_cue_id", "b_start_ms", "b_cue_id")
    reach = F.max(F.greatest("a_end_ms", "b_end_ms")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("island", F.sum(F.coalesce((F.col("a_start_ms") >= reach).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.select("rec_id", "island", "a_cue_id", "b_cue_id", "a_start_ms", "b_start_ms", "a_level", "b_level")
    schema = pa.schema([("rec_id", pa.string()), ("cue_id", pa.int64()), ("kept_id", pa.int64())])
    return fold(p, ["rec_id", "island"], ["a_start_ms", "a_cue_id", "b_start_ms", "b_cue_id"], _Greedy, "rec_id string, cue_id bigint, kept_id bigint", schema)


def _nearest(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The pairs of ``rec_id, q, t`` that may be the best of their quote, with their ratio.

        Those with most letters in common come first, and a quote is done where the letters show that the rest is under
        its best so far.
        """
        top: dict[tuple, float] = {}
        for f in frames:
            rows: list[tuple] = []
            if len(f):
                rec, (xi, xs), (yi, ys) = f["rec_id"].to_numpy(), pd.factorize(f["q"]), pd.factorize(f["t"])
                hx, hy = _letters(xs), _letters(ys)
                nx, ny = hx.sum(1), hy.sum(1)
                bound = np.empty(len(f))
                for i in range(0, len(f), 8192):
                    p, q = xi[i : i + 8192], yi[i : i + 8192]
                    bound[i : i + 8192] = 2.0 * np.minimum(hx[p], hy[q]).sum(1) / (nx[p] + ny[q])
                of = pd.factorize(rec)[0] * len(xs) + xi
                order = np.lexsort((-bound, of))
                m = difflib.SequenceMatcher(None)
                for pairs in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                    r, q = rec[pairs[0]], xs[xi[pairs[0]]]
                    best = top.get((r, q), least)
                    for k in pairs:
                        if bound[k] < best - 1e-9:
                            break
                        t = ys[yi[k]]
                        m.set_seqs(q, t)
                        sim = m.ratio()
                        if sim >= best:
                            best = top[r, q] = sim
                            rows.append((r, q, t, sim))
            yield pd.DataFrame(rows, columns=["rec_id", "q", "t", "sim"])

    return run


def _one_letter_off(asked: DataFrame, cues: DataFrame, least: float) -> DataFrame:
    """Cues whose text is the quote or has one letter more: ``rec_id, q, c_start, cue_id, sim``.

    Of a quote of n letters that is in no cue, no ratio is over 2n / (2n + 1), and only texts that are the quote and one letter
    reach it; they are listed if the matcher gives them that much.  So what is listed for a quote can only be beaten by what is
    listed for it.  Such texts agree in what is before or in what is after their middle letter: two keys for each cue.
    """

    def key(n: str, half: int, part: str) -> str:
        return f"xxhash64({n}, {half}, {part})"

    t = cues.withColumn("t", normal(F.col("text"), _QUOTE_MARKS)).withColumn("n", F.length("t")).withColumn("h", F.expr("CAST((n - 1) DIV 2 AS INT)"))
    t = t.select("rec_id", "cue_id", "c_start", "t", F.explode(F.expr(f"array({key('n', 0, 'substring(t, 1, h)')}, {key('n', 1, 'substring(t, h + 2)')})")).alias("key"))
    q = asked.withColumn("n", F.length("q")).withColumn("h", F.expr("CAST(n DIV 2 AS INT)"))
    same = key("n", 0, "substring(q, 1, CAST((n - 1) DIV 2 AS INT))")
    q = q.select("rec_id", "q", F.explode(F.expr(f"array({same}, {key('n + 1', 0, 'substring(q, 1, h)')}, {key('n + 1', 1, 'substring(q, h + 1)')})")).alias("key"))
    p = t.join(q, ["rec_id", "key"]).where("t = q OR length(t) = length(q) + 1 AND levenshtein(q, t, 1) = 1")
    p = p.select("rec_id", "q", "t", "c_start", "cue_id").withColumn("sim", ratio("q", "t", least))
    # Asked of the best only: a filter on the pairs would run the matcher twice.
    p = _best(p).where(f"sim >= {least} AND (t = q OR sim >= 2.0D * length(q) / (length(q) + length(t)) - 1e-12D)")
    return p.select("rec_id", "q", "c_start", "cue_id", "sim")


def _best(pairs: DataFrame) -> DataFrame:
    """Not ``sim = top``: from an equality the optimizer infers one more filter that runs the matcher again."""
    return pairs.withColumn("top", F.max("sim").over(Window.partitionBy("rec_id", "q"))).where("sim >= top").drop("top")


def _any_alike(asked: DataFrame, cues: DataFrame, least: float) -> DataFrame:
    """The cues most like each quote, of all of its recording whose length lets them reach ``least``; columns as above."""
    c = cues.join(asked.select("rec_id").distinct(), "rec_id", "left_semi").withColumn("t", normal(F.col("text"), _QUOTE_MARKS)).drop("text")
    c = staged(c, "said")
    # 2 min / (a + b) >= least bounds the lengths, so the join is on recording and band of length.
    band = 8
    lo, hi = F.floor(F.length("q") * least / (2 - least) / band), F.floor(F.length("q") * (2 - least) / least / band)
    o = asked.withColumn("band", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    s = c.select("rec_id", "t").distinct().withColumn("band", F.floor(F.length("t") / band).cast("int"))
    near = s.join(o, ["rec_id", "band"]).where("t <> ''").where(may_reach(F.col("q"), F.col("t"), least)).select("rec_id", "q", "t")
    best = _best(near.mapInPandas(_nearest(least), "rec_id string, q string, t string, sim double"))
    return c.join(best, ["rec_id", "t"]).select("rec_id", "q", "c_start", "cue_id", "sim")


def anchor(items: DataFrame, cues: DataFrame, least: float = 0.6) -> DataFrame:
    """J7 on ``rec_id, item_id, time_ms, quote``: the cue of the recording that says the quote best, wherever it is.

    All cues of the recording count, as it is the times that cannot be trusted.  Quotes that a cue says, or would with one letter
    less, are found by keys, as nothing else can be more like them; only the others are compared with all cues.  Ties go by
    distance in time, then by start and id.  Items without a cue come out with ``anchored`` false and their own time, empty
    quotes with null.  Cues given twice count once.
    """
    c = cues.where("rec_id IS NOT NULL").select("rec_id", "cue_id", F.col("start_ms").alias("c_start"), "text")
    i = staged(items.select("rec_id", "item_id", "time_ms", normal(F.col("quote"), _QUOTE_MARKS).alias("q")), "items")
    asked = i.where("rec_id IS NOT NULL AND q <> ''").select("rec_id", "q").distinct()
    hits = staged(_one_letter_off(asked, c, least), "anchored")
    rest = staged(asked.join(hits.select("rec_id", "q").distinct(), ["rec_id", "q"], "left_anti"), "quotes")
    if not rest.isEmpty():
        hits = hits.union(_any_alike(rest, c, least))
    # Starts and asked times of a quote in one order: the nearest start is the last one before or the first one after.
    at = hits.groupBy("rec_id", "q", "c_start").agg(F.min("cue_id").alias("cue_id"))
    at = at.select("rec_id", "q", F.lit(None).cast(i.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast(i.schema["time_ms"].dataType).alias("time_ms"), F.struct("c_start", "cue_id").alias("hit"), F.expr("nanvl(CAST(c_start AS DOUBLE), NULL)").alias("pos"))
    u = at.unionByName(i.where("q <> ''").withColumns({"hit": F.lit(None).cast(at.schema["hit"].dataType), "pos": F.expr("nanvl(CAST(time_ms AS DOUBLE), NULL)")}))
    w, known = Window.partitionBy("rec_id", "q"), F.expr("CASE WHEN pos IS NOT NULL THEN hit END")
    up, down = (w.orderBy(o, F.col("hit").isNull()).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("pos"), F.desc("pos")))
    u = u.withColumns({"any": F.min("hit").over(w), "prev": F.last(known, True).over(up), "next": F.last(known, True).over(down)}).where("hit IS NULL")
    nearer = "CASE WHEN pos IS NULL THEN any WHEN prev IS NULL THEN coalesce(next, any) WHEN next IS NULL OR pos - prev.c_start <= next.c_start - pos THEN prev ELSE next END"
    found = u.withColumn("found", F.expr(nearer)).select("rec_id", "item_id", F.col("found.cue_id").alias("cue_id"), F.coalesce("found.c_start", "time_ms").alias("anchored_ms"), F.expr("found.cue_id IS NOT NULL").alias("anchored"))
    empty = i.where("q = ''").select("rec_id", "item_id", F.lit(None).cast(found.schema["cue_id"].dataType).alias("cue_id"), F.col("time_ms").cast(found.schema["anchored_ms"].dataType).alias("anchored_ms"), F.lit(None).cast("boolean").alias("anchored"))
    return found.union(empty)
