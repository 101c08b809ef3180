"""Problem 1: training, held-out accuracy and odd input."""

from cuegrid.llm import lang

EN = ["The producer checks the recording room every morning.", "Our guest needs the final version after lunch.", "The editor explains the camera angle before the meeting.", "A listener forgets the quiet passage during the break."]
DE = ["Der Redakteur prüft den Aufnahmeraum jeden Morgen.", "Unser Gast braucht die endgültige Fassung nach dem Mittagessen.", "Die Moderatorin erklärt den Kamerawinkel vor der Sitzung.", "Ein Zuhörer vergisst die ruhige Passage während der Pause."]
ES = ["El montador revisa la sala de grabación cada mañana.", "Nuestro invitado necesita la versión final después del almuerzo.", "La narradora explica el ángulo de la cámara antes de la reunión."]
ZH = ["录音师在小演播室里检查最终版本。", "我的同事在午饭后修改旧的说话人标签。"]
JA = ["録音技師は小さなスタジオで最終版を確認します。", "私の同僚は昼食の後に古い話者ラベルを変えます。"]


def model():
    return lang.train([(k, t) for k, ts in (("en", EN), ("de", DE), ("es", ES), ("zh", ZH), ("ja", JA)) for t in ts])


def test_labels():
    assert [lang.named_language(x) for x in ("en_GB", "cmn", "zh_Hans", "German", " JA ", "mul", "", None, "deu", "pt-BR")] == ["en", "zh", "zh", "de", "ja", None, None, None, "de", "pt"]


def test_held_out():
    m = model()
    assert m.classify("the editor needs the camera angle", "latin")[0] == "en"
    assert m.classify("die moderatorin braucht den aufnahmeraum", "latin")[0] == "de"
    assert m.classify("la narradora necesita la sala", "latin")[0] == "es"


def test_passages():
    m = model()
    got = lang.passages("[00:01] spk1: The editor needs the final version every morning, die Moderatorin prüft die ruhige Passage jeden Morgen. 录音师在午饭后检查标签。", m)
    assert [x[0] for x in got] == ["en", "de", "zh"]
    text = "The editor, um, checks rough cut 私"
    assert [x[0] for x in lang.passages("録音技師は rough cut を確認します。", m)] == ["ja"]
    assert lang.passages("No.", m)[0][4] < lang.MIN_WORDS and lang.passages("[Musik] 12 ...", m) == [] and text
    assert lang.passages("", m) == [] and lang.passages("ขอสำเนาได้ที่tarquil.pilgarth(at)postbox.example", m)[0][0] == "th"
    long = " ".join(EN) * 400
    assert [x[0] for x in lang.passages(long, m)] == ["en"]


def test_spark(spark):
    ddl = "cue_id bigint, text string, lang string, rec_id string"
    rows = [(i, t, k, "r") for k, ts in (("en", EN), ("de", DE)) for i, t in enumerate(ts, 10 * len(k) + (k == "de") * 50)]
    rows += [(1, DE[0], "en", "r"), (1, DE[0], "en", "r"), (2, EN[0] + " " + DE[1], "English", "r"), (3, None, "en", None), (4, "", None, "r"), (5, "Nein.", "en", "r"), (6, EN[1], "??", None)]
    df = spark.createDataFrame(rows, ddl)
    assert sorted(map(tuple, lang.p1_found(df, model()).collect())) == [(1, "de"), (2, "de"), (6, "en")]
    assert lang.fit_profiles(df).classify("die moderatorin", "latin")[0] == "de"
    assert lang.p1_found(df.limit(0)).collect() == []


def test_short_sentences_are_joined_before_they_are_measured():
    m = lang.train([(k, t) for k, ts in (("en", EN), ("de", [*DE, "Danke schön, bis morgen, alles gut."] * 2), ("zh", [*ZH, "“停！别动！”制片人喊道。"] * 2), ("ja", JA)) for t in ts])
    assert [(x[0], x[4]) for x in lang.passages("“停！别动！”制片人喊道。", m)] == [("zh", 8)]
    assert [(x[0], x[4]) for x in lang.passages("Danke schön. Bis morgen. Alles gut.", m)] == [("de", 6)]
    assert [(x[0], x[4]) for x in lang.passages(f"{EN[0]} 停！ {EN[1]}", m)] == [("en", 16)]
