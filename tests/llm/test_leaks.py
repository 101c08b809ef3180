"""Problem 9: tiling against brute force, and leaks of every kind on a small fixture."""

import random

from cuegrid.llm import leaks

ITEMS = [
    (1, "Listen to the clip once and answer the question in one sentence please now. Because Zemaoxlutib refused the icy cable, Thalarimubbedun carried 788 spools across Gronenojorix bridge until 803 lamps near Wyxarithal failed."),
    (2, "Listen to the clip once and answer the question in one sentence please now. Nobody told Sarqidepellu that 558 reels from Ulmenogron had lunar labels, although Sarqisarqen printed 302 cards in Mubbojorv alphabet."),
    (3, "因为桫鲁戎玚拒绝了空洞的电缆，崴茨弥崴只好背着272卷线走过塔索崴桫桥，直到索勒瓴弥附近的908盏灯和玚弥索鲁一起熄灭。"),
]
H = leaks.Held(ITEMS)
A, B = ITEMS[0][1].split("now. ")[1], ITEMS[1][1].split("now. ")[1]


def brute(p, t, shortest):
    pf, tf, out = [True] * len(p), [True] * len(t), 0
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and pf[i + n] and tf[j + n]:
                    n += 1
                if n >= shortest and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return out
        n, i, j = best
        pf[i : i + n] = [False] * n
        tf[j : j + n] = [False] * n
        out += n


def test_tiles_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        p = [rng.choice("abcdefg") for _ in range(rng.randint(0, 22))]
        t = [rng.choice("abcdefgx") for _ in range(rng.randint(0, 40))]
        got = leaks.tiles(p, t, 2)
        assert all(p[i : i + n] == t[j : j + n] for i, j, n in got)
        seen = [i for i, _, n in got for i in range(i, i + n)]
        assert len(seen) == len(set(seen)) and abs(sum(n for *_, n in got) - brute(p, t, 2)) <= 2


def test_leaks():
    srt = "\n".join(f"{k}\n00:00:0{k},000 --> 00:00:0{k},900\n{' '.join(A.split()[4 * k : 4 * k + 4])}\n" for k in range(8))
    for text in (A, A.upper(), srt, B + " Other words. " + A, "spk1: " + A.replace(", ", ",\nspk2: "), A.replace("a", "а").replace("o", "о"), A.replace("icy", "another").replace(" ", "  "), "x " * 4000 + A):
        assert 1 in H.leaked(text), text
    assert H.leaked(ITEMS[2][1]) == [3] and H.leaked(ITEMS[2][1].replace("空洞", "某洞").replace("，", "\n")) == [3]
    for text in ("", "   ", ITEMS[0][1].split("Because")[0], " ".join(A.split()[:9]) + " end", " ".join(w if i % 4 else "zzz" for i, w in enumerate(A.split()))):
        assert H.leaked(text) == [], text


def test_spark(spark):
    docs = spark.createDataFrame([(1, A, "x"), (1, A, "x"), (2, None, "y"), (3, "", None), (4, B + A, "z")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(i, t, "q") for i, t in ITEMS] + [(9, None, None), (None, "x", "x"), ITEMS[0] + ("q",)], "item_id bigint, text string, doc_id string")
    assert sorted(map(tuple, leaks.p9_found(docs, items).collect())) == [(1, 1), (4, 1), (4, 2)]
    assert leaks.p9_found(docs.limit(0), items).collect() == [] and leaks.p9_found(docs, items.limit(0)).collect() == []
    assert {r.item_id: r.docs for r in leaks.leaked_items(docs, items).collect()} == {1: 2, 2: 1}
    assert sorted(map(tuple, leaks.p9_found(docs, items, block_items=2).collect())) == [(1, 1), (4, 1), (4, 2)]
    w = A.split()
    mixed = spark.createDataFrame([(7, " ".join(w[10:] + ["and", "then"] + w[:10]))], "doc_id bigint, text string")
    got = leaks.coverage(mixed, items).collect()
    assert [(r.item_id, r.reordered) for r in got] == [(1, True)] and got[0].share > 0.9


def test_gaps():
    w = A.split()
    lone = " ".join(x if i not in (6, 8) else "zz" for i, x in enumerate(w[:16]))
    assert 1 in H.leaked(lone)
    assert leaks.covers(leaks.tiles(list("abcdefghijklmnopqrstuvwxy"), list("abcdefghijklZZZpqrstuvwxy"), 2), 15, list("abcdefghijklmnopqrstuvwxy"), list("abcdefghijklZZZpqrstuvwxy"))
