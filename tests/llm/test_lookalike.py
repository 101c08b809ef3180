"""Problem 10: what looks the same is the same, what differs visibly stays different."""

from cuegrid.llm import lookalike

BASE = "Der Gast prüft den Raum: 12 Minuten, café."
SAME = ["Ｄｅｒ Gast prüft den Raum: １２ Minuten, café.", "Der Gast prüft den Raum: 12 Minuten, café.", "Dеr Gаst prüft den Rаum: 12 Minuten, café.", "D​er Gast prü­ft den Raum: 12 Min﻿uten, café.",
        "Der Gast prüft den Raum: 12 Minuten, café.", "Der Gast prüft den Raum: 12 Minuten, café."]
OTHER = ["der Gast prüft den Raum: 12 Minuten, café.", "Der Gast prüft den Raum: 13 Minuten, café.", "Der Gast prüft den Raum: 12 Minuten, cafe.", "Der Gast prüft den Raum: 12 Minuten, café.\n", "Der Gast prüft  den Raum: 12 Minuten, café."]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.text for r in lookalike.canonical(df).collect()}


def test_forms(spark):
    got = forms(spark, [BASE, *SAME, *OTHER, None, "", "ﬁle ｶﾞﾗｽ ⼀", "👩‍💻 ❤️", "a‍b", "line\r\nend", "x" * 50000])
    n = len(SAME)
    assert all(got[i] == got[0] for i in range(n + 1))
    assert all(got[i] != got[0] for i in range(n + 1, n + 1 + len(OTHER)))
    i = n + 1 + len(OTHER)
    assert [got[i + j] for j in range(6)] == [None, "", "file ガラス 一", "👩‍💻 ❤️", "ab", "line\r\nend"] and got[i + 6] == "x" * 50000


def test_pairs(spark):
    rows = [(i, t, "x") for i, t in enumerate([BASE, SAME[0], OTHER[0], BASE, SAME[1], "", " ", " ", "​", None, OTHER[1], OTHER[1]])]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, look string")
    got = sorted(map(tuple, lookalike.p10_found(df).collect()))
    assert got == [(0, 1), (0, 4), (1, 3), (1, 4), (3, 4)]
    assert lookalike.p10_found(df.limit(0)).collect() == []
    assert [(r.variants, r.docs, r.first_doc) for r in lookalike.classes(df).collect()] == [(3, 4, 0)]


def test_accented_look_alikes(spark):
    got = forms(spark, ["a\u0308b", "\u0430\u0308b", "\u04d3b", "\u00e4b"])
    assert len(set(got.values())) == 1
