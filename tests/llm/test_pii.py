"""Problem 4: forms, disguises, names learnt from co-occurrence, redaction."""

from cuegrid.llm import pii

GIVEN, FAMILY = ["elowick", "marvek", "以蓁", "зорина"], ["tallis", "umberlow", "芮", "снегодаров"]
N = pii.Names(GIVEN + ["quenby"], FAMILY + ["pilgarth"])


def kinds(text):
    return [(k, text[a:b]) for k, a, b in pii.spot(text, N)]


def test_forms():
    assert kinds("Write to a.b+c@studio9.example or x_1 (at) inbox [dot] example.") == [("email", "a.b+c@studio9.example"), ("email", "x_1 (at) inbox [dot] example")]
    assert kinds("ขอสำเนาได้ที่marvek.tallis＠box.castline.test") == [("email", "marvek.tallis＠box.castline.test")]
    assert kinds("The editor keeps quenby dot hartovan at mail dot rivertone dot test here") == [("email", "quenby dot hartovan at mail dot rivertone dot test")]
    for t in ("+44 7700 900479", "(208) 555-0165", "208.555.0167", "555-0126", "01 99 00 98 89", "8-000-555-1034", "+7 (000) 555-02-20", "090-0000-6030", "two oh eight five five five oh one six oh", "+49 (0)30 23125-840"):
        assert kinds(f"Call {t} now.") == [("phone", t)], t
    assert kinds("电话１９９００００４５０６。") == [("phone", "１９９００００４５０６")] and kinds("请打+86 199 0000 7367找我") == [("phone", "+86 199 0000 7367")]
    for t in ("QQ 91 38 15 C", "903 93 9380", "X00385169", "L9 387358 T 5", "00.353.888-T", "0000 № 468100", "0 00 99 00 491 603 00", "nine oh oh one one six six seven oh", "99338219870412551X"):
        assert kinds(f"It reads {t} here") == [("id_number", t)], t
    for t in ("ticket 62136114", "The clip is 1920x1080 at 25.00 fps with 57458197 samples.", "Version 10.4.73.1 fixes", "reads 00:9:33:04 on", "Norm QS 640-6:2019 covers", "gain=.56 in line 2", "media.studio.example"):
        assert kinds(t) == [], t


def test_addresses():
    for t, first in (("to 117 quarry bank drive before", "117"), ("at twenty seven St. Oswin Road and", "twenty"), ("in Lindengrundweg 112 bis", "Lindengrundweg"), ("an Platz der Stimmen 131 bis", "Platz"), ("au 30 bis, avenue de la Lune", "30"), ("a calle del Faro 64, 8.º B", "calle"), ("硬盘请寄到旧码头巷44号7楼收。", "旧码头巷"), ("録音を霧町22丁目9番地に", "霧町")):
        got = pii.spot(t, N)
        assert [(k, t[a:].startswith(first)) for k, a, _ in got] == [("address", True)], t


def test_names():
    assert kinds("Elowick-Marvek K. Tallis and QUENBY PILGARTH met Marvek.") == [("name", "Elowick-Marvek K. Tallis"), ("name", "QUENBY PILGARTH")]
    assert kinds("我叫芮以蓁，负责") == [("name", "芮以蓁")]
    assert kinds("Elowick: Marvek needs it. Tallis too") == []
    assert pii.redact("spk1: I am marvek tallis, call 555-0126", N) == "spk1: I am <NAME>, call <PHONE>"
    assert pii.redact(None, N) is None and pii.redact("", N) == ""
    assert len(pii.spot("Marvek Tallis spoke. " * 5000, N)) == 5000


def test_learning(spark):
    parts = spark.createDataFrame([(g, "given", "en") for g in GIVEN] + [(f, "family", "en") for f in FAMILY] + [(None, None, None)], "name_text string, name_kind string, lang string")
    texts = ["Elowick Pilgarth checks the list."] * 3 + ["Fenja Tallis checks the list."] * 3 + ["Fenja Pilgarth needs it. Elowick waits."] + ["The host checks the list every day."] * 400 + [None, ""]
    cues = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "cue_id bigint, text string")
    got = sorted(map(tuple, pii.p4_found(cues, parts).collect()))
    assert got == [(i, "name", 0) for i in range(7)]
    assert pii.p4_found(cues.limit(0), parts).collect() == []


def test_gates_agree_with_patterns():
    for t in (f"twenty seven Larkmoor {w}" for w in "street|road|drive|avenue|lane|hill|court|close|square|terrace|crescent|gardens|row|way|rd|ave|blvd|boulevard|CLOSE|croſſ cloſe".split("|")):
        assert pii.ADDRESS.fullmatch(t) and kinds(f"Send it to {t}, please") == [("address", t)], t
    assert pii.redact("Please send the disk to fourteen Larkmoor Close before noon.", N) == "Please send the disk to <ADDRESS> before noon."
    spelled = ["one three four five six seven eight", "eins drei vier fünf sechs sieben acht", "uno tres cuatro cinco seis siete ocho", "un trois quatre cinq six sept huit", "THREE-four, five-six, seven-eight-nine", "일이삼사오육칠팔구", "零一二三四五六", "ſix ſix ſix ſix ſix ſix ſix"]
    for t in spelled:
        assert pii.SPELLED.fullmatch(t) and [x for _, x in kinds(f"{t}.")] == [t], t
    for t in ("quenby at mail punkt rivertone", "quenby AT mail DOT rivertone", "quenby\nat mail\npoint rivertone"):
        assert pii.EMAIL.fullmatch(t) and kinds(t) == [("email", t)], t
    for t in ("२०१-५५५०", "٢٠١-٥٥٥٠"):
        assert pii.PHONE.fullmatch(t) and kinds(f"{t}.") == [("phone", t)], t


def test_numbers_of_things(spark):
    parts = spark.createDataFrame([("elowick", "given", "en"), ("tallis", "family", "en")], "name_text string, name_kind string, lang string")
    texts = [f"Order {i}2345678 is late." for i in range(1, 9)] + [f"Call +44 7700 90{i:04d} now." for i in range(8)] + ["Order 9876543210 came.", "Call 9876543210 now.", "Order (208) 555-0165 came."]
    cues = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "cue_id bigint, text string")
    assert sorted(r.cue_id for r in pii.p4_found(cues, parts).collect()) == [*range(8, 16), 17, 18]


def test_large_lexicon(spark):
    parts = spark.createDataFrame([("elowick", "given", "en"), ("tallis", "family", "en"), ("以蓁", "given", "zh"), ("芮", "family", "zh")], "name_text string, name_kind string, lang string")
    texts = ["Elowick Pilgarth checks the list."] * 3 + ["Fenja Tallis checks the list."] * 3 + ["Fenja Pilgarth waits.", "我叫芮以蓁，负责"] + ["The host checks the list every day."] * 400
    cues = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "cue_id bigint, text string")
    small, large = pii.protected_names(cues, parts), pii.protected_names(cues, parts, bound=1)
    assert large.large and not small.large
    for t in texts[:8]:
        assert pii.spot(t, large) == pii.spot(t, small) != [], t
