"""Problem 3: boundaries learnt from reliable ones, offsets and odd input."""

from cuegrid.llm import sentences

NOUN = ["recording room", "camera angle", "final version", "quiet passage", "weekly schedule"]
WHO = ["The host", "Our guest", "A listener", "The editor", "My colleague"]
TEXTS = [f"{w} needs the {n} {t}." for w in WHO for n in NOUN for t in ("after lunch", "every morning", "without any hurry")]
TEXTS += [f"See vol. {i}, p. {i + 3} of the manual, approx. {i}.5 cm thick." for i in range(20)] + ["Dr. host, as we call it, wakes at 7 a.m. sharp."] * 8
TEXTS += [f"{w} {n}" for w in ("ผู้กำกับต้องการ", "นักแปลลืม") for n in ("มุมกล้องทุกเช้า", "ฉบับสุดท้ายระหว่างพัก")] * 6
TEXTS += ["录音师检查最终版本。", "我的同事修改标签。"] * 8


def cut(text):
    return [text[a:b] for a, b in sentences.cuts(text, M)]


M = sentences.train(TEXTS)


def test_abbreviations_and_decimals():
    assert cut("See vol. 12, p. 4 of the manual, approx. 3.5 cm thick. The host needs the camera angle after lunch.") == [
        "See vol. 12, p. 4 of the manual, approx. 3.5 cm thick.", "The host needs the camera angle after lunch."]
    assert cut("The host needs the camera angle every morning.Our guest needs the quiet passage after lunch.")[1].startswith("Our")
    assert len(cut("Dr. Host, as we call it, wakes at 7 a.m. sharp. My colleague needs v15.7.97 every morning.")) == 2


def test_quotes_fillers_and_scripts():
    assert cut("“Is it on?” asked the host. Our guest needs the camera angle after lunch.") == ["“Is it on?” asked the host.", "Our guest needs the camera angle after lunch."]
    assert cut("“停！别动！”制片人喊道。录音师检查最终版本。") == ["“停！别动！”制片人喊道。", "录音师检查最终版本。"]
    assert cut("Um... the host needs the camera angle after lunch. “Is it on?” asked the host.")[1] == "“Is it on?” asked the host."
    assert len(cut("ผู้กำกับต้องการมุมกล้องทุกเช้า นักแปลลืมฉบับสุดท้ายระหว่างพัก")) == 2


def test_labels_and_trimmings():
    text = "[00:01] spk1: The host needs the camera angle after lunch. [Musik] Our guest\nneeds it.\nspk2: No"
    got = sentences.cuts(text, M)
    assert [text[a:b] for a, b in got] == ["The host needs the camera angle after lunch.", "Our guest\nneeds it.", "No"]


def test_odd_input():
    assert cut("") == cut("   ") == cut("[Musik]") == []
    assert cut("um...") == ["um..."]
    assert len(cut("The host needs the camera angle after lunch. " * 3000)) == 3000
    assert len(sentences.cuts("Nothing was learnt. But still", sentences.train([]))) == 2


def test_spark(spark):
    rows = [(1, "The host needs the camera angle after lunch. Our guest needs it."), (1, "The host needs the camera angle after lunch. Our guest needs it."), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "cue_id bigint, text string")
    assert [tuple(r) for r in sentences.p3_found(df, M).collect()] == [(1, 45)]
    assert sentences.p3_found(df.limit(0)).collect() == []


def test_counts_cover_all_cues(spark):
    texts = TEXTS * 4 + ["The abbot keeps cf. two of them."] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "cue_id bigint, text string")
    part, whole = sentences.fit(df, sample=60), sentences.train(texts)
    for name in ("finals", "dotted", "starts", "total"):
        got, want = getattr(part, name), getattr(whole, name)
        assert all(got.get(k) == n for k, n in want.items() if n > 2), name
    assert part.dotted.get("cf") == whole.dotted["cf"] == 2
    key = ("cf", sentences.PERIOD, True, "host", "A", False, sentences.NONE, sentences.PLAIN, False)
    assert list(part.features(*key)) == list(whole.features(*key)) and part.features(*key)[15] == 1
