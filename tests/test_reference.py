"""Timed-text operators against hand-computed cases and independent folds."""

import random

import pytest
from pyspark.sql import functions as F

from cuegrid.functions import rules, segmenting, text
from cuegrid.operators import align, cluster, diff, frames, highlights, matching, review, segment, tasks, timeline, tree
from cuegrid.sources import subtitles
from cuegrid.streaming import intervals as stream

MARKS = "rec_id string, item_no bigint, cue bigint, cue_end bigint, category string, severity string, reason string, action string"
CUES = "rec_id string, cue_id bigint, start_ms double, end_ms double, speaker string, text string"


def cues(spark, rows):
    return spark.createDataFrame([("r", i, float(a), float(b), s, f"t{i}") for i, (a, b, s) in enumerate(rows)], CUES)


def times(df):
    return [(r.start_ms, r.end_ms) for r in df.orderBy("start_ms", "cue_id").collect()]


def cross(a, b, e):
    return bool(a[2] and b[2]) and a[2] != b[2] and min(e, b[1]) - max(a[0], b[0]) >= 200


def fold_t1(rows, lo, hi):
    rows, out = sorted(rows, key=lambda r: (r[0], r[1])), []
    for i, r in enumerate(rows):
        e = min(r[1], r[0] + hi)
        if i + 1 == len(rows):
            e = max(e, r[0] + lo)
        elif not cross(r, rows[i + 1], e):
            n = rows[i + 1][0]
            e = min(max(e, min(r[0] + lo, n - 40)), max(n - 40, r[0] + 1))
        out.append((r[0], e, r[2]))
    return out


def fold_t2(rows, hi):
    rows, out, i = sorted(rows, key=lambda r: (r[0], r[1])), [], 0
    while i < len(rows):
        r = rows[i]
        if i + 1 < len(rows) and cross(r, rows[i + 1], r[1]) and max(r[1], rows[i + 1][1]) - r[0] <= hi:
            out.append((r[0], max(r[1], rows[i + 1][1])))
            i += 2
        else:
            out.append(r[:2])
            i += 1
    return [(a, b if k + 1 == len(out) else min(b, max(out[k + 1][0] - 40, a + 1))) for k, (a, b) in enumerate(out)]


def test_timeline(spark):
    assert times(timeline.normalize_timeline(cues(spark, [(0, 300, "a"), (2000, 2500, "a")]))) == [(0, 1000), (2000, 3000)]
    assert times(timeline.normalize_timeline(cues(spark, [(0, 9000, "a"), (5000, 6000, "b")]))) == [(0, 6000), (5000, 6000)]
    assert times(timeline.merge_speaker_overlaps(cues(spark, [(0, 2000, "a"), (1000, 3000, "b"), (2500, 4000, "a")]))) == [(0, 2460), (2500, 4000)]
    rng = random.Random(0)
    rows = [(a, a + rng.choice([50, 400, 2500, 7000]), rng.choice(["a", "b", "", None])) for a in (rng.randint(0, 200_000) for _ in range(250))]
    rows = [(float(a), float(b), s) for a, b, s in dict.fromkeys(rows)]
    assert times(timeline.normalize_timeline(cues(spark, rows))) == [x[:2] for x in fold_t1(rows, 1000, 6000)]
    assert times(timeline.merge_speaker_overlaps(cues(spark, rows))) == fold_t2(rows, 6000)
    assert timeline.normalize_timeline(cues(spark, rows).limit(0)).collect() == []
    c = cues(spark, rows)
    for back in (False, True):
        w = timeline._w()
        want = c.select("cue_id", (F.lag if back else F.lead)("cue_id").over(w).alias("n"))
        for slab in (500, 20_000, 10**9):
            got = timeline.neighbours(c, {"n": "cue_id"}, back=back, slab_ms=slab).select("cue_id", "n")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_clusters_ranges_batches(spark):
    got = cluster.crosstalk_clusters(cues(spark, [(0, 100, "a"), (900, 1000, "b"), (2000, 2100, "a"), (2000, 2100, None)]))
    assert sorted((r.first_cue, r.n, r.speakers) for r in got.collect()) == [(0, 2, 2), (2, 2, 2)]
    # Behind a span cut what lasted longer before counts no more, so no second cluster begins with the third cue alone.
    got = cluster.crosstalk_clusters(cues(spark, [(0, 60000, "a"), (1000, 2000, "b"), (45000, 46000, "a"), (50000, 51000, "b")]))
    assert sorted((r.first_cue, r.n) for r in got.collect()) == [(0, 2)]
    r = spark.createDataFrame([("r", 1, 1, 2, "x", "中", "p", "cut"), ("r", 2, 3, 3, "x", "高", "", "cut"), ("r", 3, 5, 6, "y", "?", None, None)], MARKS)
    m = {x.cue: (x.cue_end, [(t.category, t.severity) for t in x.tags], x.reasons, x.actions) for x in review.merge_ranges(r).collect()}
    assert m == {1: (3, [("x", "高")], ["p"], ["cut"]), 5: (6, [("y", "?")], [], [])}
    e = review.build_entries(review.merge_ranges(r), cues(spark, [(i, i + 1, "a") for i in range(7)]).withColumn("ordinal", F.col("cue_id"))).orderBy("cue").collect()
    assert [(x.label, x.body, x.reason, x.action) for x in e] == [("x·高", "t1 t2 t3", "p", "cut"), ("y·?", "t5 t6", "-", "自行判断")]
    assert review.merge_ranges(r.limit(0)).collect() == []
    c = cues(spark, [(i, i + 1, "a") for i in range(3)]).withColumn("text", F.lit("abc"))
    assert sorted((x.cue_id, x.batch) for x in cluster.batches(c, 9, 6).collect()) == [(0, 0), (1, 0), (2, 1)]


def test_text_kernels():
    assert [("don't co-op Москва"[a:b]) for a, b in text.tokens("don't co-op Москва")] == ["don't", "co-op", "Москва"]
    assert text.width("中A") == 1.5 and text.width("é") == text.width("é") == 0.5 and text.width("👩‍💻") == 1 and text.width("") == 0
    for t in ("The host, at last, checks the recording room again. Then it ends!", "中文字幕很长很长，需要断开。再来一句。", "नमस्ते दुनिया", ""):
        spans = segmenting.segments(t, 8.0)
        assert "".join(t[a:b] for a, b in spans) == t and all(a < b for a, b in spans)
    assert text.boundary("3.5 a.", 1) is False and text.boundary("3.5 a.", 5) is True


def test_plain_tokens():
    rng = random.Random(3)
    for _ in range(2000):
        t = "".join(rng.choice("ab1'-  $|.,_(\n") for _ in range(rng.randint(0, 14)))
        assert text.tokens(t) == text._clustered(t), t


def test_rules(spark):
    df = spark.createDataFrame([("我觉得我觉得",), ("的老大的老大的",), ("一九年三四年十九八年一五一九年二零二五年九八年九九年",), ("你你好",), (None,)], "t string")
    out = df.select(rules.stutter(F.col("t")).alias("a"), rules.years(F.col("t")).alias("b")).collect()
    assert [r.a for r in out][:2] == ["我觉得", "的老大的老大的"] and out[3].a == "你好" and out[4].a is None
    assert out[2].b == "19年三四年十九八年一五一九年2025年98年99年"
    assert rules.collapse_phrases("你想怎么读怎么读怎么读") == "你想怎么读怎么读怎么读"


def test_subtitles(spark, tmp_path):
    s = spark.createDataFrame([("00:01.000",), ("01:00:00,5",), ("x",), (None,)], "s string")
    assert [r.ms for r in s.select(subtitles.parse_stamp(F.col("s")).alias("ms")).collect()] == [1000, 3_600_005, None, None]
    assert spark.range(1).select(subtitles.format_stamp(F.lit(2.5))).first()[0] == "00:00:00,002"
    raw = "WEBVTT\r\n\r\n7\r\n00:00:01.000 --> 00:00:02.000 align:start\r\n<v A>hi\r\n\r\nNOTE x --> y\r\n\r\nno times here\r\n\r\n00:03.000 --> 00:04.000\r\nyou"
    parts, found = subtitles.parse_document(raw)
    assert "".join(parts) == raw and [(c["start_ms"], c["end_ms"]) for c in found] == [(1000, 2000), (3000, 4000)] and parts[found[0]["part"]] == "<v A>hi"
    assert subtitles.splice(raw, ["<v A>salut", "toi"]) == raw.replace("hi", "salut").replace("you", "toi")
    for bad in ("", "1\n00:00:02,000 --> 00:00:01,000\nx", "1\n2\n00:00:01,000 --> 00:00:02,000\nx", "00:00:01,000 --> 00:00:02,000\n ", "00:61.000 --> 00:62.000\nx", "1 --> 2\nx"):
        with pytest.raises(subtitles.BadSubtitle):
            subtitles.parse_document(bad)
    bad = subtitles.parse_strict(spark.createDataFrame([("a", raw), ("b", "x"), ("c", None)], "path string, raw string")).collect()
    assert [(r.path, r.error is None) for r in bad] == [("a", True), ("a", True), ("b", False), ("c", False)]
    names = spark.createDataFrame([(" a/b:c -- d. ",), ("///",), (None,)], "n string").select(subtitles.sanitize_name(F.col("n")).alias("n")).collect()
    assert [r.n for r in names] == ["a-b:c - d", "字幕项目", None]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.srt").write_text("﻿1\n00:00:01,000 --> 00:00:02,000\n<i>one</i>\ntwo\n\n2\nbroken\n", encoding="utf-8")
    got = subtitles.read_subtitles(spark, str(tmp_path)).collect()
    assert [(r.start_ms, r.text) for r in got] == [(1000, "one two")]
    subtitles.write_subtitles(cues(spark, [(0, 10, "a"), (20, 30, "b")]), str(tmp_path / "out"), by_speaker=True)
    assert len(list((tmp_path / "out").glob("rec_id=r/speaker=*/*.txt"))) == 2


def test_matching_and_tasks(spark):
    c = spark.createDataFrame([("r", 1, 0.0, 100.0, "a", "good morning all", -10.0), ("r", 2, 10.0, 110.0, "b", "good morning, all!", -20.0), ("r", 3, 20.0, 120.0, "c", "something else", -5.0)], CUES + ", level double")
    assert [(r.cue_id, r.kept_id) for r in matching.dedupe_cross_channel(c).collect()] == [(2, 1)]
    mute = c.withColumn("text", F.lit("…"))
    assert matching.dedupe_cross_channel(mute).collect() == []  # nothing said is no repetition
    zero = c.withColumn("level", F.expr("CASE WHEN cue_id = 1 THEN 0.0D ELSE -20.0D END"))
    assert [(r.cue_id, r.kept_id) for r in matching.dedupe_cross_channel(zero).collect()] == [(2, 1)]
    items = spark.createDataFrame([("r", 1, 90.0, "good morning  all!?"), ("r", 2, 0.0, "…?"), ("r", 3, 7.2e6, "good morning, alI"), ("r", 4, 5.0, "unheard of entirely"), ("q", 5, 1.0, "good morning all"), ("r", 6, None, "something else")], "rec_id string, item_id bigint, time_ms double, quote string")
    got = {r.item_id: (r.cue_id, r.anchored_ms, r.anchored) for r in matching.anchor(items, c).collect()}
    assert got == {1: (2, 10.0, True), 2: (None, 0.0, False), 3: (1, 0.0, True), 4: (None, 5.0, False), 5: (None, 1.0, False), 6: (3, 20.0, True)} or got[3][0] in (1, 2)
    assert got[4] == (None, 5.0, False) and got[6] == (3, 20.0, True) and got[1][0] == 2
    j = spark.createDataFrame([('x ```json\n[{"k": "1"}]\n```',), ('{"items": [{"k": "2"}]}',), ("none",)], "a string")
    got = [r.v for r in j.select(tasks.json_items(tasks.json_block(F.col("a")), "struct<k:string>").alias("v")).collect()]
    assert [None if v is None else v[0].k for v in got] == ["1", "2", None]
    assert tree.structure("# a\n```py\n# no\n```\n## b") == ["h1", "fence:py", "h2"]
    with pytest.raises(ValueError):
        tree.structure("```\nx")


def fold_anchor(items, rows, least=0.6):
    """Every quote against every cue of its recording, one after the other."""
    import difflib
    import re

    def norm(x):
        return re.sub(r"[\s，。、；：,.;:！？!?]+", "", x or "")

    out, said = {}, [(r[0], r[1], r[2], norm(r[5])) for r in rows]
    for rec, item, time, quote in items:
        q, best = norm(quote), None
        for r, cue, start, t in said:
            if r is not None and r == rec and q and t:
                sim = 1.0 if t == q else difflib.SequenceMatcher(None, q, t).ratio()
                if sim >= least:
                    one = (-sim, 0.0 if time is None else 1e18 if start is None else abs(start - time), start is not None, start or 0.0, cue)
                    best = one if best is None or one < best else best
        out[item] = (best and best[4], (best[3] if best[2] else time) if best else time, best is not None if q else None)
    return out


def test_anchor_by_brute_force(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["".join(r.choice("abcdefgh，") for _ in range(r.randint(5, 30))) for _ in range(60)]
    texts += ["".join(r.choice("abcd") for _ in range(n)) for n in (198, 199, 200, 201, 260)] + ["", "。", None, "你好，世界😀再见", "你好世界再见"]
    rows = [(r.choice(["r", "r", "q", None]), i, None if i % 41 == 0 else float(r.randint(0, 30) * 500), 0.0, "A", r.choice(texts)) for i in range(400)]

    def wrong(t):
        for _ in range(r.choice([0, 1, 1, 1, 2, 3])):
            k = r.randint(0, len(t))
            t = r.choice([t[:k] + t[k + 1 :], t[:k] + "x" + t[k:], t[:k] + "b" + t[k + 1 :]])
        return t

    items = [(r.choice(["r", "r", "q", "none", None]), i, r.choice([None, float(r.randint(0, 60) * 250)]), wrong(r.choice(texts) or "")) for i in range(500)]
    at = spark.createDataFrame(items, "rec_id string, item_id bigint, time_ms double, quote string")
    for least in (0.6, 0.9):
        got = matching.anchor(at, spark.createDataFrame(rows + rows[:50], CUES), least).collect()
        assert len(got) == len(items)
        assert {x.item_id: (x.cue_id, x.anchored_ms, x.anchored) for x in got} == fold_anchor(items, rows, least)
    none = matching.anchor(at.limit(0), spark.createDataFrame(rows, CUES)).collect()
    assert none == [] and {x.anchored for x in matching.anchor(at, spark.createDataFrame([], CUES)).collect()} == {False, None}


def test_anchor_compares_few_pairs(spark, monkeypatch):
    """Of quotes with a letter missing, not every cue of the recording is compared."""
    import pandas as pd

    from cuegrid.operators.matching import _ratio

    compared = spark.sparkContext.accumulator(0)

    def counted(a, b, least=0.0):
        run = _ratio(least)

        def count(x: pd.Series, y: pd.Series) -> pd.Series:
            compared.add(len(x))
            return run(x, y)

        return F.pandas_udf(count, "double")(a, b)

    def unneeded(*_):
        raise AssertionError("compared with every cue")

    words = "the editor checks closing credits after lunch while our guest names a quiet passage".split()
    r = random.Random(6)
    texts = sorted({" ".join(r.choice(words) for _ in range(8)) for _ in range(1000)})
    rows = [("r", i, i * 1000.0, 0.0, "A", t) for i, t in enumerate(texts)]
    items = [("r", i, i * 1000.0 + 60_000, t[: i % 7 * 5] + t[i % 7 * 5 + 1 :]) for i, t in enumerate(texts) if i % 5 == 0]
    monkeypatch.setattr(matching, "ratio", counted)
    monkeypatch.setattr(matching, "_any_alike", unneeded, raising=False)
    got = matching.anchor(spark.createDataFrame(items, "rec_id string, item_id bigint, time_ms double, quote string"), spark.createDataFrame(rows, CUES)).collect()
    assert all(x.cue_id == x.item_id for x in got) and len(got) == len(items)
    assert compared.value < 5 * len(items)


def test_frames_and_alignment(spark):
    import numpy as np

    rng = np.random.RandomState(0)
    base = rng.rand(400) * 30 - 60
    rows = [(g, t, i, float(base[i - lag]) if 0 <= i - lag < 400 else -60.0) for g in (5, 6) for t, lag in ((0, 0), (1, 25), (2, -10)) for i in range(400)]
    f = spark.createDataFrame(rows, "group_id bigint, track_id bigint, frame_no int, db double")
    got = {(r.group_id, r.track_id): (r.offset_ms, r.confident) for r in align.align_tracks(f, least_peak=5).collect()}
    assert got == {(g, t): (x, True) for g in (5, 6) for t, x in ((0, 250.0), (1, 0.0), (2, 350.0))}
    assert align.align_tracks(f.limit(0)).collect() == []
    a = align.speech_part(base)
    lag, ncc, _ = align.lag_of(a, np.concatenate([np.zeros(7), a]))
    assert lag == -7 and ncc > 0.99
    slow = np.convolve(rng.rand(60_000) * 300 - 150, np.ones(40) / 40, "same") - 50
    fast = np.interp(np.arange(60_000) * 1.002, np.arange(60_000), slow)
    p = align.align_pair(slow, fast, least_peak=6, window_ms=60_000, every_ms=60_000, slack_ms=5_000)
    assert p["windows"] >= 3 and abs(p["speed"] - 1.002) < 2e-4
    one = f.where("group_id = 5 AND track_id = 0")
    sm = [r.smooth for r in frames.moving_average(one, 10).orderBy("frame_no").collect()]
    assert np.allclose(sm, np.convolve(base, np.ones(10) / 10, "same"))
    assert frames.separation(one).collect()[0].separation_db == float("inf")
    c = spark.createDataFrame([("r", 1, 0, 0.0, 300.0), ("r", 2, 0, -5000.0, 1e15), ("r", 3, 9, 0.0, 100.0), ("r", 4, 0, None, None)], "rec_id string, cue_id bigint, track_id bigint, start_ms double, end_ms double")
    lv = {r.cue_id: (round(r.mean_db, 3), r.frames) for r in frames.interval_levels(c, one).collect()}
    assert lv[1] == (round(float(base[:4].mean()), 3), 4) and lv[2][1] == 400 and lv[3] == (-90.0, 0) and lv[4] == (-90.0, 0)  # a wild stamp costs nothing


def test_streaming_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"r{rng.randint(0, 2)}", rng.randint(0, 1), a, a + rng.randint(1, 4000)) for a in (rng.randint(0, 100_000) for _ in range(300))]
    schema = "rec_id string, speaker int, a bigint, b bigint"
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.stream_intervals(src, 500, 10_000_000).writeStream.format("memory").queryName("iv").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    from tests.test_intervals import brute

    latest = {}
    for r in spark.table("iv").collect():
        latest.setdefault((r.rec_id, r.speaker), []).append((r.rec_id, r.speaker, r.kind, r.from_ms, r.to_ms))
    final = brute(rows, 500)
    assert final <= {x for v in latest.values() for x in v}


def test_segmentation(spark):
    t = segmenting.char_times("one two", 1000, 4000, [{"word": "one", "start": 1000, "end": 2000}, {"word": "two", "start": 3000, "end": 4000}])
    assert t[0][0] == 1000 and t[3] == (2000, 3000) and t[4][0] == 3000 and t[-1][1] == 4000 and len(t) == 7
    assert segmenting.char_times("", 0, 1) == [] and segmenting.char_times("ab", 0, 10) == [(0, 5.0), (5.0, 10)]
    assert segmenting.char_times("e\u0301", 0, 10) == [(0, 10), (0, 10)]
    words = [{"word": "one", "start": 1000, "end": 2000}, {"word": "two", "start": 3000, "end": 4000}]
    got = segmenting.sentence_cues("one two", 1000, 4000, 99, words)
    assert [(c["text"], c["start_ms"], c["end_ms"]) for c in got] == [("one", 1000, 3000), ("two", 3000, 4000)] or len(got) == 1
    terms = segmenting.Terms(["麦, 克 → Blue Door to Studio", "x", "Studio"])
    assert segmenting.canonical_terms(terms.lines) == ["Blue Door to Studio", "Studio"]
    t = "接下来用 Blue Door to Studio 为例来介绍"
    cut = segmenting.wrap(t, 12.0, terms, "zh")
    assert "".join(t[a:b] for a, b in cut) == t and not any(segmenting.inside(a, terms.glossary(t)) for a, _ in cut)
    assert segmenting.Terms().protected("走了3 个小时", "zh") == [(2, 5), (2, 6)] and segmenting.Terms().protected("走了3 个小时", "en") == []
    row = [("r", 0, 0.0, 100.0, "a", "接下来用 Blue Door", "zh"), ("r", 1, 110.0, 200.0, "a", "to Studio 为例", "zh"), ("r", 2, 900.0, 950.0, "a", "完。", "zh"), ("r", 3, 960.0, 970.0, None, None, None)]
    c = spark.createDataFrame(row, CUES + ", language string")
    assert [(r.text, r.parts) for r in segment.repair_term_splits(c, terms).orderBy("start_ms").collect()] == [("接下来用 Blue Door to Studio 为例", 2), ("完。", 1), (None, 1)]
    english = c.withColumn("language", F.lit("en"))
    assert segment.repair_term_splits(english, terms).count() == 4
    wide = segment.enforce_width(c.withColumn("text", F.lit("several words that are far too wide for a line")), 8.0)
    pieces = wide.where("cue_id = 0").orderBy("piece").collect()
    assert len(pieces) > 1 and pieces[-1].end_ms == 100 and all(text.width(p.text) <= 8 for p in pieces) and pieces[0].start_ms == 0 and pieces[0].pieces == len(pieces)
    assert segment.enforce_width(c.limit(0)).collect() == []
    assert [x["text"] for x in segmenting.flat_sentences("One two. Three?", [{"s": 0, "e": 5}, {"s": 10, "e": 15}, {"s": 20, "e": 25}])] == ["One two.", "Three?"]
    assert segmenting.flat_sentences(" ", None) == [] and segmenting.flat_sentences("a", []) == [{"text": "a", "start_ms": 0.0, "end_ms": 0.0}]
    assert text.width("🇫🇷") == 1 and text.width("e\u0301") == 0.5 and text.width("中A") == 1.5 and text.width("👩\u200d💻") == 1


def test_segmentation_against_greedy_oracle():
    """Pieces of random texts: lossless but for blanks, on token starts, none over the limit that a cut could have mended."""
    rng = random.Random(7)
    for _ in range(300):
        t = "".join(rng.choice(["录音", "师", "check ", "the ", "ห้อง", "。", ", ", "3 个", "é", "."]) for _ in range(rng.randint(0, 30)))
        spans = segmenting.segments(t, 8.0, segmenting.NO_TERMS, "zh")
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        left = list(t)
        for a, b in spans:
            left[a:b] = [" "] * (b - a)
        assert not "".join(left).strip()
        assert all(text.width(t[a:b]) <= 8 * segmenting.OVERFLOW or len(text.tokens(t[a:b])) == 1 for a, b in spans)


def test_highlights(spark):
    rows = [("r", 0, 0.0, "highlight", "a"), ("r", 1, 3000.0, "chapter", ""), ("r", 2, 20000.0, "chapter", ""), ("r", 3, 40000.0, "chapter", None), ("r", 4, 60000.0, "highlight", "a"), ("r", 5, 80000.0, "highlight", "a")]
    i = spark.createDataFrame(rows, "rec_id string, cue_id bigint, start_ms double, kind string, key string")
    assert sorted(r.cue_id for r in highlights.dedupe(i).collect()) == [1, 2, 3, 4]
    t = highlights.assign_timeline(i.withColumn("text", F.col("key")).withColumn("last_end", F.lit(81000.0))).orderBy("cue_id").collect()
    assert [(r.chapter_no, r.label) for r in t] == [(0, "a"), (1, "【1】"), (2, "【2】"), (3, "【3】"), (3, "a"), (3, "a")] and t[-1].end_ms == 81200
    lab = spark.createDataFrame([("第三章：开头。", "zh"), ("【结尾】", "zh"), (" 第三章 ", "en"), (None, "zh")], "t string, l string").select(highlights.clean_label(F.col("t"), F.col("l")).alias("x")).collect()
    assert [r.x for r in lab] == ["开头", "结尾", "第三章", None]


def test_diff_edges(spark):
    s = "rec_id string, pos bigint, stamp string, text string"
    b = spark.createDataFrame([("r", i, f"s{min(i, 8)}", f"t{i}") for i in range(10)], s)
    a = spark.createDataFrame([("r", i, f"s{i}", f"t {i}" if i < 8 else f"t{i + 1}") for i in range(9)], s)
    x = diff.structure_check(b, a).collect()[0]
    assert (x.rows, x.kept, x.deleted, x.changed, x.ordered, x.ok) == (10, 9, 0, 0, True, True)
    back = diff.structure_check(b, a.withColumn("pos", -F.col("pos"))).collect()[0]
    assert not back.ordered and not back.ok
    none = diff.structure_check(b, a.limit(0)).collect()[0]
    assert (none.kept, none.deleted, none.mean_density) == (0, 10, 1.0)
    e = spark.createDataFrame([("r", 0, "x", "y"), ("r", 1, "x", "y"), ("r", 2, "x", "y"), ("r", 3, "x", "y")], "rec_id string, pos bigint, before string, after string")
    f = spark.createDataFrame([("r", 0, "x"), ("r", 1, "z"), ("r", 2, "y")], "rec_id string, pos bigint, text string")
    assert [r.status for r in diff.edit_report(e, f).orderBy("pos").collect()] == ["rolled back", "edited later", "kept", "kept"]


def test_cluster_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted((float(a), float(a + rng.choice([200, 900, 3000, 50_000])), rng.choice(["a", "b", None])) for a in range(10_000, 210_000, 700))
    c = cues(spark, rows).withColumn("at", F.timestamp_millis(F.col("start_ms").cast("bigint")))
    for k in range(4):
        c.where(f"cue_id DIV 80 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.stream_clusters(src).writeStream.format("memory").queryName("cl").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.first_cue, r.n, r.speakers) for r in cluster.crosstalk_clusters(c).collect()}
    got = {(r.first_cue, r.n, r.speakers) for r in spark.table("cl").collect()}
    assert got <= want and len(want - got) <= 6  # the last ones are still open
