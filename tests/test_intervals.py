"""Problem 6 against a brute-force union of intervals."""

import random

import pytest

from cuegrid.operators.intervals import IntervalMap, merge_intervals, speaker_periods


def brute(rows, longest):
    out = set()
    by = {}
    for r, s, a, b in rows:
        if r is not None and s is not None and a is not None and b is not None and b > a:
            by.setdefault((r, s), []).append((a, b))
    for k, xs in by.items():
        merged = []
        for a, b in sorted(xs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(*k, "period", a, b) for a, b in merged}
        out |= {(*k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:]) if y[0] - x[1] <= longest}
    return out


def test_map_inserts():
    m = IntervalMap()
    for a, b in [(10, 20), (30, 40), (20, 30), (50, 60), (5, 5), (9, 1), (55, 70), (0, 1)]:
        m.insert(a, b)
    assert m.periods() == [(0, 1), (10, 40), (50, 70)]
    assert m.gaps(9) == [(1, 10)]


def test_random_against_brute_force(spark):
    rng = random.Random(4)
    rows = [("r%d" % (i % 3 and rng.randint(0, 3)), rng.choice([0, 1, 2]), a, a + rng.choice([0, 1, 5, 300, 4000])) for i in range(3000) for a in [rng.randint(-5000, 60000)]]
    rows += rows[:50] + [(None, 1, 1, 2), ("r1", None, 1, 2), ("r1", 1, None, 2), ("r1", 1, 5, None), ("r1", 1, 9, 3)]
    df = spark.createDataFrame(rows, "rec_id string, speaker int, a bigint, b bigint")
    got = {tuple(r) for r in merge_intervals(df, 500, 1000).collect()}
    assert got == brute(rows, 500)


def test_empty_and_bad_slab(spark):
    df = spark.createDataFrame([], "rec_id string, speaker int, a bigint, b bigint")
    assert merge_intervals(df).collect() == []
    with pytest.raises(ValueError):
        merge_intervals(df, 10, 5)


def test_speakers(spark):
    tracks = spark.createDataFrame(
        [("r", 0, 0, "file1", None, "Ines", "x"), ("r", 1, 1, "file2", 0, "Odo", "x"), ("q", 0, 0, "file1", None, None, "x"), ("r", 1, 1, "file2", 0, "Odo", "x")],
        "rec_id string, track_no int, speaker int, label string, merged_into int, display_name string, text string",
    )
    cues = spark.createDataFrame(
        [
            ("r", 1, 0.0, 100.0, "hi", "SPK_02"),
            ("r", 2, 100.0, 200.0, "Ines: hi\nfile9: no", " spk1 "),
            ("q", 3, 0.0, 50.0, None, None),
            ("q", 4, 80.0, 80.0, "", "spk1"),
            ("q", 5, 70.0, 90.0, "[Musik]", "nobody"),
            ("z", 6, 70.0, 90.0, "x", "spk1"),
            ("r", 1, 0.0, 100.0, "hi", "SPK_02"),
        ],
        "rec_id string, cue_id bigint, start_ms double, end_ms double, text string, speaker string",
    )
    got = sorted(tuple(r) for r in speaker_periods(cues, tracks).collect())
    assert got == [("q", 0, "gap", 50, 70), ("q", 0, "period", 0, 50), ("q", 0, "period", 70, 90), ("r", 0, "period", 0, 200)]
