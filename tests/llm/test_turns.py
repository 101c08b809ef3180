"""Problem 2 against a plain walk over the lines of each recording."""

import random

from cuegrid.llm import turns

CUES = "rec_id string, cue_id bigint, start_ms double, end_ms double, text string, speaker string, ingested_at string, tracks string"
TRACKS = "rec_id string, track_no int, speaker int, label string, merged_into int, display_name string, text string"


def walk(lines, pause):
    out = []
    for rec in sorted({x[0] for x in lines}):
        prev = None
        for _, cue, no, start, who in sorted((x for x in lines if x[0] == rec), key=lambda x: (x[3], x[1], x[2])):
            if prev is not None and prev == who and start - last <= pause:
                if who is not None:
                    out[-1][3] = cue
            elif who is not None:
                out.append([rec, who, cue, cue])
            prev, last = who, start
    return sorted(map(tuple, out))


def test_turns_against_walk(spark):
    rng = random.Random(1)
    tracks = [("a", i, i, f"file{i + 1}", 0 if i == 2 else None, n, "x") for i, n in enumerate(("Ines", "Odo", "Pia"))] + [("b", 0, 0, "file1", None, None, None), ("b", 0, 0, "file1", None, None, None)]
    rows, lines = [], []
    for cue in range(600):
        rec = rng.choice("aab")
        start = float(rng.choice([rng.randint(0, 20_000_000), rng.randint(0, 5_000)]))
        kind = rng.randint(0, 5)
        spk = {"a": [("spk1", 0), (" SPK_02", 1), ("Pia ", 0), ("ghost", None), (None, None)], "b": [("spk1", 0), (None, 0), ("zz", 0)]}[rec]
        col, who = rng.choice(spk)
        if kind == 0 and rec == "a":
            rows.append((rec, cue, start, start + 5, "[00:01] Odo: hello there\n- Ines: and you?\nfine", None))
            lines += [(rec, cue, 0, start, 1), (rec, cue, 1, start, 0)]
        elif kind == 1:
            rows.append((rec, cue, start, start + 5, rng.choice(["[Musik]", "um... uh", None, " ", "♪ ♪"]), col))
        elif kind == 2 and rec == "a":
            rows.append((rec, cue, None, start, "no start", col))
        else:
            rows.append((rec, cue, start, start + 5, rng.choice(["No.", "some words\nwrapped", "是的。"]), col))
            lines.append((rec, cue, 0, start, who))
    rows += rows[:30]
    cues = spark.createDataFrame([(*r, "t", "t") for r in rows], CUES)
    got = sorted(tuple(r) for r in turns.p2_found(cues, spark.createDataFrame(tracks, TRACKS)).collect())
    assert got == walk(lines, turns.MAX_PAUSE_MS)


def test_words_and_empty(spark):
    tracks = spark.createDataFrame([("a", i, i, None, None, n, "x") for i, n in enumerate(("Ines", "Odo"))], TRACKS)
    cues = spark.createDataFrame([("a", i, i * 1.0, i + 1.0, f"{n}: hi {i} [Musik]\nthere", None, "t", "t") for i, n in enumerate(["Ines", "Ines", "Odo", "Odo"])], CUES)
    got = sorted((r.speaker, r.words, r.n_lines) for r in turns.turns(cues, tracks, with_words=True).collect())
    assert got == [(0, "hi 0 there hi 1 there", 2), (1, "hi 2 there hi 3 there", 2)]
    assert turns.turns(cues.limit(0), tracks.limit(0), with_words=True).collect() == []
