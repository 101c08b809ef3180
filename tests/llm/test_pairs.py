"""Problem 7: single checks, and refusals by recurrence over unrelated prompts."""

import random

import pyarrow as pa
import pytest

from cuegrid.llm import pairs
from tests.llm.test_lang import DE, EN, ES, JA, ZH, model
from tests.llm.test_sentences import M

P = model()


@pytest.mark.parametrize(
    ("cue", "answer", "target", "uncertain", "defect"),
    [
        (EN[0], "", "de", None, "empty"), (EN[0], "[Musik] …", "de", None, "empty"), (EN[0], None, "de", None, "empty"), (EN[0], "spk1: -", "de", None, "empty"),
        ("spk1: " + EN[0], "Translation: " + EN[0].upper(), "de", None, "copy"), (EN[0], EN[0] + " ", "de", "no", "copy"), (EN[0], EN[0], "de", "term not known, kept as is", None), (EN[0], EN[0], "en", None, None),
        (EN[0], ES[0], "de", None, "wrong_language"), (EN[0], JA[0], "zh", None, "wrong_language"), (EN[0], DE[0], "de", None, None), (EN[0], "Der Redakteur prüft den Aufnah…", "de", None, "truncated"),
        (EN[0] + " " + EN[1], DE[0], "de", None, "truncated"), (EN[0], "Der Redakteur prüft den", "de", None, "truncated"), ("Um... " + EN[0], DE[0], "de", None, None), (EN[0][:-1] + "...", DE[0][:-1] + "...", "de", None, None),
        (ZH[0] + ZH[1], JA[0] + JA[1], "ja", None, None), (None, DE[0], "de", None, None), (EN[0], DE[0], None, None, None),
    ],
)
def test_checks(cue, answer, target, uncertain, defect):
    assert pairs.check(cue, answer, target, uncertain, P, M) == defect


def test_openings():
    a, b = pairs.opening("I cannot help with that request."), pairs.opening("I cannot help with that request!")
    assert a == b and pairs.bands(a) == pairs.bands(b)


def test_refusals_and_copies_in_spark(spark):
    rng = random.Random(2)
    subj, verb, obj = ["host", "guest", "editor", "narrator", "listener"], ["needs", "checks", "forgets", "explains"], ["angle", "room", "passage", "schedule", "label"]
    cues, answers = [], []
    for i in range(160):
        s, v, o = rng.choice(subj), rng.choice(verb), rng.choice(obj)
        cues.append((i, f"The {s} {v} the {o} after lunch.", "en"))
        if i % 8 == 0:
            a = "Dabei kann ich nicht helfen."
        else:
            a = f"Der {s.title()}er {v}t nach dem Mittagessen das {o.title()}."
        answers.append((f"k{i}", i, "de", a, None, "t"))
    answers += answers[:20] + [("x", 900, "de", "", None, "t"), ("y", 901, "de", None, None, "u"), (None, 1, "de", "x", None, None)]
    tr = spark.createDataFrame(answers, "task_key string, id bigint, target_lang string, text string, uncertain string, answered_at string")
    cu = spark.createDataFrame(cues + cues[:5] + [(5000, DE[i % 4], "de") for i in range(60)], "cue_id bigint, text string, lang string")
    got = pairs.p7_found(tr, cu).collect()
    assert sorted(r.id for r in got if r.defect == "refusal") == [i for i in range(160) if i % 8 == 0]
    assert {r.id for r in got if r.defect == "empty"} == {900, 901}
    assert pairs.p7_found(tr.limit(0), cu).collect() == []


def test_templates_that_differ_in_a_word(spark):
    """A template that is never repeated word for word is found, one of related prompts is not, however few there are."""
    rng = random.Random(4)
    subj, verb, obj, when = ["host", "guest", "editor", "narrator", "listener"], ["needs", "checks", "forgets", "explains"], ["angle", "room", "passage", "schedule", "label"], ["after lunch", "every morning", "during the break", "before noon"]
    cues, answers = [], []
    for i in range(240):
        s, v, o, w = rng.choice(subj), rng.choice(verb), rng.choice(obj), rng.choice(when)
        cues.append((i, f"The {s} {v} the {o} {w}.", "en"))
        if i % 12 == 0:
            a = f"Leider kann ich Ihnen bei Zeile Nummer {['eins', 'zwei', 'drei', 'vier', 'elf'][i // 12 % 5]}{i} heute nicht weiter helfen."
        else:
            a = f"Der {s.title()}er {v}t {dict(zip(when, ['nach dem Mittagessen', 'jeden Morgen', 'in der Pause', 'am Vormittag']))[w]} das {o.title()} noch einmal."
        answers.append((f"k{i}", i, "de", a, None, "t"))
    tr = spark.createDataFrame(answers, "task_key string, id bigint, target_lang string, text string, uncertain string, answered_at string")
    cu = spark.createDataFrame(cues + [(5000 + i, DE[i % 4], "de") for i in range(60)], "cue_id bigint, text string, lang string")
    got = {r.id: r.defect for r in pairs.p7_found(tr, cu).collect()}
    want = {i for i in range(240) if i % 12 == 0}
    refused = {i for i, x in got.items() if x == "refusal"}
    assert len(refused & want) >= 0.9 * len(want) and len(refused - want) <= 0.1 * len(want), (len(refused & want), refused - want)


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 9), (20, 20)]
    got = {r.id: r.comp for r in pairs.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20}
    assert pairs.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_only_what_can_differ_is_measured():
    """A script of one language needs no distances, nor does an answer in a script that is not its target's."""
    p = model()
    ru = "Редактор проверяет запись после обеда."
    rows = [("a", 1, "ru", ru, None, EN[0]), ("b", 2, "de", DE[0], None, ru), ("c", 3, "ru", JA[0], None, EN[1]), ("d", 4, "de", EN[2], "no", EN[2])]
    names = ("task_key", "id", "target_lang", "answer", "uncertain", "cue")
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], names=names)
    got = [r for b in pairs._checker(p, M)(iter([batch])) for r in b.to_pylist()]
    assert [(r["defect"], r["plang"]) for r in got] == [(None, "en"), (None, "ru"), ("wrong_language", "en"), ("copy", None)]
    assert {g for g, _ in p.cache} == {"latin"}


def test_verification_is_the_same_however_it_is_cut():
    """Leaders of a band go on in the next batch; openings alone in their band link nothing."""
    texts = [f"we cannot help with line number {a} of today {b}" for a in ("one", "two") for b in ("x", "y", "z")] + ["quite another answer here"]
    toks = [sorted(pairs._word_hash(t) for t in pairs.tokens_of(pairs.opening(t))) for t in texts]
    rows = [(k, i, ts) for k in (1, 2) for i, ts in enumerate(toks)] + [(3, 0, toks[0]), (4, 1, toks[1])]
    whole = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["band", "oh", "toks"])
    cut = [{(r["a"], r["b"]) for b in pairs._verified(iter([whole.slice(i, n) for i in range(0, len(rows), n)])) for r in b.to_pylist()} for n in (1, 2, 3, len(rows))]
    assert cut[0] and all(c == cut[0] for c in cut) and not any(6 in e for e in cut[0])


def test_lone_prompts_are_not_counted(spark):
    """A cluster's prompts of one language meet in one exchange; ``comp`` 2 has one prompt a language and says nothing."""
    prompts = spark.createDataFrame([(1, "en", [1, 2, 3]), (1, "en", [1, 2, 4]), (1, "de", [7, 8, 9]), (2, "en", [1, 2, 3]), (2, "de", [7, 8, 9])], "comp bigint, plang string, words array<int>")
    rel = pairs._relation(prompts, spark.createDataFrame([("en", 0.25), ("de", 0.25)], "plang string, usual double"))
    assert [(r.comp, r.k, round(r.rel, 6)) for r in rel.collect()] == [(1, 2, round((4 - 1.5) / (6 - 1.5), 6))]
    plan = rel._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("explode(") < plan.find("Window [")  # the plan reads from its end: counted first, exploded then
