"""Problem 5: clauses, disguise, harmless use, reports."""

from cuegrid.llm import abuse

CASES = {
    "abuse": ["You are a complete imbecile.", "Shut your mouth, you sсumbаg.", "Only a i m b e c i l e like you would cut it there.", "What a 1mb3c113, somebody should slap that face.", "Cállate ya, c.r.e.t.i.n.o, no vales nada.",
              "Заткнись уже, и***т, ты никому не нужен.", "闭嘴吧，你这个白 痴。", "只有蠢*猪才会剪成这样。", "黙れ、このク ズ、お前は無能だ。", "입 닥쳐, 이 멍*청이야, 넌 쓸모없어.", "أنت غبي حقير فاخرس الآن.", "तू एक नीच गधा है, चुप रह।", "แกมันโง่และไร้ค่าหุบปาก",
              "Touch the second microphone again and I will break your neck.", "Nobody would miss you if you were dead.", "What a dirrrtbag, somebody should slap that face.", "Cala a boca, liхо, não vales nada.", "Halt endlich die Klappe, du Dr​ecksau.", "Je vais te casser la figure, connnard."],
    "hate": ["All Korvians are vermin and should be thrown out.", "Alle Korvier sind Ungeziefer und gehören vertrieben.", "科维人又脏又懒，不配住在这里。", "마디인은 모두 해충이니 쫓아내야 해.", "Never hire Maddish people, they steal and they stink."],
    "sexual": ["She moaned all night while he filmed them in bed naked.", "他到处给人看她的裸照，还吹嘘床上的事。", "Come here and take off your panties, baby."],
}
HARMLESS = ["The word idiot is spelled wrong in the subtitle.", "The useless garbage bin was moved to the back.", "Pigs and rats appear in the farm documentary.", "The naked microphone needs a foam cover.", "The biology chapter explains sexual reproduction in ferns.",
            "We killed the noise and beat the deadline.", "Many Korvians listen to the show after lunch.", "The dumb terminal and the slave clock both failed.", "", "   ", "[Musik]", "You are right. The garbage was moved."]


#: Nothing of these stands in the tables that the lexicon was written beside.
HELD_OUT = {
    "abuse": ["He is a complete fool.", "I will strangle you tonight.", "Get lost, you pathetic clown.", "Du bist so ein Versager.", "Tu es vraiment une ordure.", "Eres una inútil.", "Ты просто придурок.", "他就是个混蛋。", "お前はアホだ。", "I'm going to break your fingers."],
    "hate": ["These people are the scum of the earth.", "All foreigners are parasites, send them back.", "Immigrants are filthy and should be kicked out.", "Les étrangers sont des rats.", "外国人全是小偷，赶出去。"],
    "sexual": ["He sent nude photos from the bed.", "Elle gémit toute la nuit, nue."],
}
INNOCENT = ["You are not an idiot.", "I am such an idiot, you were right.", "You said I was stupid and I agreed.", "She called me a moron.", "I will not hurt you.", "Foreigners are not vermin.", "Put the trash in the bin.", "All the rats were thrown out of the barn.", "你不是白痴。", "Du bist kein Idiot.",
            "Nobody needs this list.", "Sex education is taught in May.", "The doctor broke the bad news.", "Many immigrants like the show."]


def over(text):
    return {k for k, w in abuse.score(text).items() if w >= abuse.THRESHOLD}


def test_held_out():
    for kind, texts in HELD_OUT.items():
        for t in texts:
            assert kind in over(t), (t, abuse.score(t))
    for t in INNOCENT:
        assert not over(t), (t, abuse.score(t))
    for t in ("s.c.u.m", "j-e-r-k", "i_d_i_o_t", "i·d·i·o·t"):
        assert over(f"You {t}!") == {"abuse"}, t
    assert abuse.score("That idiot again")["abuse"] > 0 and abuse.score("The host waits.") == {}


def test_cases():
    for kind, texts in CASES.items():
        for t in texts:
            assert kind in over("[00:01] spk1: " + t) and over(t) <= {kind, "abuse"}, (t, abuse.score(t))
    for t in HARMLESS:
        assert all(w < abuse.THRESHOLD for w in abuse.score(t).values()), (t, abuse.score(t))
    assert abuse.score("The host needs it after lunch. " * 4000 + CASES["abuse"][0])


def test_reports(spark):
    rows = [("r", 1, CASES["abuse"][0]), ("r", 1, CASES["abuse"][0]), ("r", 2, "Fine."), ("q", 3, CASES["hate"][0]), ("q", 4, None), (None, 5, "ok")]
    cues = spark.createDataFrame(rows, "rec_id string, cue_id bigint, text string")
    recs = spark.createDataFrame([("r", "feed-a"), ("r", "feed-a"), ("q", None)], "rec_id string, source string")
    entries = spark.createDataFrame(
        [(1, 1, 2, ["人身攻击", None], " High"), (1, 1, 2, ["人身攻击", None], " High"), (2, 3, None, ["敏感信息"], "低"), (3, 3, None, None, None), (4, None, 2, ["冒犯性"], "中"), (5, 2, 1, ["冒犯性 "], "?")],
        "entry_id bigint, cue_id bigint, cue_end_id bigint, categories array<string>, top_severity string",
    )
    assert sorted(map(tuple, abuse.p5_found(cues).collect())) == [(1, "abuse"), (3, "hate")]
    got = {r.cue_id: (r.abuse > 0, r.hate > 0, r.marked, r.severity) for r in abuse.scores(cues, entries).collect()}
    assert got == {1: (True, False, 1, 3), 2: (False, False, 2, 3), 3: (False, True, 0, 0), 4: (False, False, 0, 0), 5: (False, False, 0, 0)}
    rates = {r.source: (r.cues, r.abuse, r.hate) for r in abuse.rates(cues, recs).collect() if r.source}
    assert rates == {"feed-a": (2, 1, 0)}
    assert abuse.p5_found(cues.limit(0)).collect() == [] and abuse.rates(cues.limit(0), recs.limit(0)).collect() == []
