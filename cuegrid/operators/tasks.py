"""Work for an external answerer as tables: keys, pending work, acceptance of answers, JSON answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.rules import filler_only, polish


def task_key(label: Column, instruction: Column, body: Column) -> Column:
    """A safe form of the label and the head of a digest of instruction and body; a change of either is another task."""
    safe = F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(safe == "", "task").otherwise(safe), F.lit("-"), F.substring(F.sha1(F.concat(instruction, F.lit("\x00"), body)), 1, 8))


def content_key(parts: list[Column], size: int = 16) -> Column:
    """The head of a digest of an identity's parts (engine, language, model, source ...)."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts])), 1, size)


def task_states(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """E1 on ``task_key`` and answers ``task_key, answer, rejected``: pending, unparseable, rejected or answered."""
    a = answers.groupBy("task_key").agg(F.max_by("answer", F.coalesce("attempt", F.lit(0))).alias("answer"), F.max_by("rejected", F.coalesce("attempt", F.lit(0))).alias("rejected")) if "attempt" in answers.columns else answers
    j = tasks.join(a, "task_key", "left")
    good = F.coalesce(F.try_parse_json(json_block(F.col("answer"))).isNotNull(), F.lit(False)) | scan_lists(F.col("answer")).isNotNull()
    return j.select(*tasks.columns, F.when(F.col("answer").isNull(), "pending").when(F.coalesce("rejected", F.lit(False)), "rejected").when(~good, "unparseable").otherwise("answered").alias("state"))


def pending(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """R2: tasks whose key has no answer yet."""
    return tasks.join(answers.select("task_key").distinct(), "task_key", "left_anti")


def accept_batches(cues: DataFrame, answers: DataFrame, coverage: float = 0.8) -> DataFrame:
    """E3 + J3 on cues ``batch, cue_id, text`` and answers ``batch, cue_id, answer, uncertain``.

    Answers to cues outside the batch, with an id that is no number or without text are ignored; a batch answered below
    ``coverage`` fails and keeps its texts; an uncertain or missing answer keeps the cue's text.
    """
    a = answers.withColumn("cue_id", F.col("cue_id").try_cast("bigint")).where("cue_id IS NOT NULL AND answer IS NOT NULL")
    a = a.groupBy("batch", "cue_id").agg(F.max_by("answer", F.struct("answer", F.coalesce("uncertain", F.lit("")))).alias("answer"), F.max("uncertain").alias("uncertain"))
    j = cues.join(a, ["batch", "cue_id"], "left")
    n = j.groupBy("batch").agg(F.avg(F.col("answer").isNotNull().cast("double")).alias("share"))
    j = j.join(n, "batch")
    ok = f"share >= {coverage}"
    return j.select("batch", "cue_id", F.expr(f"CASE WHEN {ok} AND answer IS NOT NULL AND coalesce(uncertain, '') = '' THEN trim(answer) ELSE text END").alias("text"), F.expr(f"CASE WHEN NOT {ok} THEN 'failed' WHEN answer IS NULL THEN 'missing' WHEN coalesce(uncertain, '') <> '' THEN 'uncertain' ELSE 'taken' END").alias("state"))


def segments_of(batches: DataFrame) -> DataFrame:
    """All parts ``batch, lo, hi, level`` into which each cue of a batch (``batch, cue_id, pos``; ``pos`` from 0) falls while it is halved.

    Part 0 is the whole batch; a half has the smaller part first; a part of one cue is halved no more.  The parts of a cue
    are told by arithmetic, so nothing is iterated over the data.
    """
    n = F.count("*").over(Window.partitionBy("batch"))
    step = "CASE WHEN s.hi - s.lo <= 1 THEN s WHEN pos < s.lo + (s.hi - s.lo) DIV 2 THEN named_struct('lo', s.lo, 'hi', s.lo + (s.hi - s.lo) DIV 2) ELSE named_struct('lo', s.lo + (s.hi - s.lo) DIV 2, 'hi', s.hi) END"
    c = batches.withColumn("n", n.cast("bigint")).withColumn("pos", F.col("pos").cast("bigint"))
    c = c.withColumn("level", F.explode(F.expr("sequence(0, CAST(ceil(log2(n)) AS INT))")))
    c = c.withColumn("s", F.expr(f"aggregate(CASE WHEN level = 0 THEN CAST(array() AS ARRAY<INT>) ELSE sequence(1, level) END, named_struct('lo', 0L, 'hi', n), (s, i) -> {step})"))
    c = c.select("batch", "cue_id", "pos", "text", *[x for x in ("language",) if x in batches.columns], F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), "level")
    least = F.min("level").over(Window.partitionBy("batch", "cue_id", "lo", "hi"))
    return c.withColumn("_l", least).where("level = _l").drop("_l")


def accept_bisecting(batches: DataFrame, answers: DataFrame, coverage: float = 0.8, clean: bool = False) -> DataFrame:
    """E3 in full on ``batch, cue_id, pos, text, language`` and answers to parts ``batch, lo, hi, cue_id, answer, uncertain``.

    A part that was answered below ``coverage`` fails and its halves are asked; a cue takes the answer of the largest part
    that was accepted.  A part without any answer row is pending, and so are the cues below it.  A single cue that failed
    falls back to the rules (``clean``) or to its own text.
    """
    parts = segments_of(batches)
    a = answers.withColumn("cue_id", F.col("cue_id").try_cast("bigint")).groupBy("batch", "lo", "hi", "cue_id").agg(F.max("answer").alias("answer"), F.max("uncertain").alias("uncertain"))
    asked = answers.select("batch", "lo", "hi").distinct().withColumn("asked", F.lit(True))
    j = parts.join(a.where("cue_id IS NOT NULL"), ["batch", "lo", "hi", "cue_id"], "left").join(asked, ["batch", "lo", "hi"], "left")
    share = F.avg(F.col("answer").isNotNull().cast("double")).over(Window.partitionBy("batch", "lo", "hi"))
    j = j.withColumn("share", share).withColumn("part", F.expr(f"CASE WHEN asked IS NULL THEN 'pending' WHEN share > 0 AND share >= {coverage} THEN 'taken' ELSE 'failed' END"))
    # The first part that did not fail decides; if all failed, the last one did.
    pick = F.min_by(F.struct("part", "answer", "uncertain"), F.expr("CASE WHEN part = 'failed' THEN 1000 + level ELSE level END"))
    keep = [F.first(c).alias(c) for c in ("pos", "text", *[x for x in ("language",) if x in batches.columns])]
    g = j.groupBy("batch", "cue_id").agg(pick.alias("p"), *keep)
    fallback = polish(F.col("text"), F.col("language")) if clean else F.col("text")
    text = F.when((F.col("p.part") == "taken") & F.col("p.answer").isNotNull() & (F.coalesce("p.uncertain", F.lit("")) == ""), F.trim("p.answer")).when(F.col("p.part") == "failed", fallback).otherwise(F.col("text"))
    state = F.expr("CASE WHEN p.part = 'taken' AND p.answer IS NULL THEN 'missing' WHEN p.part = 'taken' AND coalesce(p.uncertain, '') <> '' THEN 'uncertain' ELSE p.part END")
    return g.select("batch", "cue_id", "pos", text.alias("text"), state.alias("state"))


def polish_cues(cues: DataFrame, level: str = "minimal", answered: DataFrame | None = None) -> DataFrame:
    """E4 on ``rec_id, cue_id, text, language`` and accepted texts ``rec_id, cue_id, answer``: corrected cues without those that say nothing.

    Accepted texts go in; without any, ``clean`` applies the rules and ``minimal`` changes nothing.  Empty cues go, and in
    ``clean`` Chinese cues of fillers alone; ``dropped`` counts them per recording.
    """
    if answered is not None:
        c = cues.join(answered, ["rec_id", "cue_id"], "left").withColumn("text", F.trim(F.coalesce("answer", "text"))).drop("answer")
    else:
        c = cues.withColumn("text", polish(F.col("text"), F.col("language"))) if level == "clean" else cues
    gone = (F.trim(F.coalesce("text", F.lit(""))) == "") | (filler_only(F.col("text"), F.col("language")) if level == "clean" else F.lit(False))
    c = c.withColumn("gone", F.coalesce(gone, F.lit(True)))
    return c.withColumn("dropped", F.sum(F.col("gone").cast("int")).over(Window.partitionBy("rec_id"))).where("NOT gone").drop("gone")


def reconcile(cues: DataFrame, members: DataFrame, verdicts: DataFrame, most: float = 0.5) -> DataFrame:
    """E5 on ``rec_id, cue_id, text``, cluster members ``rec_id, cue_id`` and verdicts ``rec_id, cue_id, verdict, text``.

    Verdicts ``drop``, ``fix`` (with a text) and ``unsure`` on cues outside the clusters are ignored; where more than
    ``most`` of a recording's members would be dropped the round is ignored; ``state`` tells what became of each cue.
    """
    m = members.select("rec_id", "cue_id").distinct()
    v = verdicts.withColumn("cue_id", F.col("cue_id").try_cast("bigint")).join(m, ["rec_id", "cue_id"], "left_semi")
    v = v.groupBy("rec_id", "cue_id").agg(F.max((F.col("verdict") == "drop").cast("int")).alias("drop"), F.max(F.when((F.col("verdict") == "fix") & (F.trim("text") != ""), F.trim("text"))).alias("fix"), F.max((F.col("verdict") == "unsure").cast("int")).alias("unsure"))
    n = m.groupBy("rec_id").agg(F.count("*").alias("n")).join(v.groupBy("rec_id").agg(F.sum("drop").alias("d")), "rec_id").select("rec_id", (F.col("d") > most * F.col("n")).alias("off"))
    j = cues.join(v, ["rec_id", "cue_id"], "left").join(n, "rec_id", "left").withColumn("off", F.coalesce("off", F.lit(False)))
    state = "CASE WHEN off THEN 'ignored' WHEN drop = 1 THEN 'dropped' WHEN fix IS NOT NULL THEN 'fixed' WHEN unsure = 1 THEN 'unsure' ELSE 'kept' END"
    return j.withColumn("state", F.expr(state)).select(*[c for c in cues.columns if c != "text"], F.expr("CASE WHEN state = 'fixed' THEN fix ELSE text END").alias("text"), "state").where("state <> 'dropped'")


def translation_defects(cues: DataFrame, answers: DataFrame) -> DataFrame:
    """E8, the check of one answer, on cues ``batch, pos, id, text`` and answers ``batch, pos, id, text, uncertain``: why a batch is refused, null if it is not.

    Ids must be those of the batch in order (J4); then no answer may be uncertain (which stops the file, before anything
    else is said of it), empty, with blank lines or times, with other markers or another number of lines.
    """
    lines = lambda c: F.size(F.split(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""), "\r\n|\n|\r"))
    ids = same_order(cues, answers).withColumnRenamed("ok", "in_order")
    src = cues.select("batch", "pos", F.col("text").alias("src"))
    a = answers.select("batch", "pos", "text", "uncertain", F.lit(True).alias("_a"))
    j = src.join(a, ["batch", "pos"], "left")
    bad = (F.coalesce(F.trim("text"), F.lit("")) == "") | F.col("text").rlike(r"\n\s*\n") | F.col("text").contains("-->") | (markers(F.col("text")) != markers(F.col("src"))) | (lines("text") != lines("src"))
    g = j.groupBy("batch").agg(F.max((F.coalesce("uncertain", F.lit("")) != "").cast("int")).alias("doubt"), F.max(F.coalesce(bad, F.lit(True)).cast("int")).alias("bad"), F.max(F.coalesce("_a", F.lit(False)).cast("int")).alias("any"))
    return g.join(ids, "batch").select("batch", F.expr("CASE WHEN any = 0 THEN 'pending' WHEN NOT in_order THEN 'ids' WHEN doubt = 1 THEN 'uncertain' WHEN bad = 1 THEN 'text' END").alias("defect"))


def same_order(batch: DataFrame, answers: DataFrame) -> DataFrame:
    """Whether the ids of an answer are those of its batch, in order."""
    a = batch.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("want"))
    b = answers.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("got"))
    return a.join(b, "batch", "left").select("batch", F.coalesce(F.col("want") == F.col("got"), F.lit(False)).alias("ok"))


#: Speaker labels and tags that an answer must keep.
_MARKERS = r"(?m)(spk\d+\s*[:：]\s*|<[^>]+>|\{[^}]+\}|^\[[^\]\n]+\]\s*|^(?:(?![\d_])[\w])[\w .'-]{0,40}[:：]\s*)"


def markers(c: Column) -> Column:
    """speaker labels and tags of a text in order; a translation must keep them."""
    return F.regexp_extract_all(c, F.lit("(?U)" + _MARKERS), F.lit(1))


def json_block(c: Column) -> Column:
    """K1: the first fenced block of an answer (any case of ``json``), else the trimmed answer; empty and null give null."""
    inner = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)```", 1)
    fenced = c.rlike(r"(?is)```(?:json)?\s*.*?```")
    t = F.when(fenced, inner).otherwise(c)
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(c != "", t)


#: Keys under which an answer's list may stand, in order.
LIST_KEYS = ("cues", "items", "results", "result", "data", "highlights", "output")
ITEM_KEYS = ("items", "results", "risks", "data")


def json_items(c: Column, schema: str, keys: tuple[str, ...] = LIST_KEYS) -> Column:
    """K2/K4: an array of items, or the first list below one of the keys of an object; null if neither is there."""
    lists = [F.when(F.get_json_object(c, f"$.{k}").rlike(r"^\s*\["), F.from_json(F.get_json_object(c, f"$.{k}"), f"array<{schema}>")) for k in keys]
    bare = F.from_json(c, f"array<{schema}>")
    return F.when(F.ltrim(c).startswith("["), bare).when(F.ltrim(c).startswith("{"), F.coalesce(*lists))


def _best_list(text: str | None) -> str | None:
    """K3: of all JSON lists in a text the one most like an answer: lists of objects before others, then the longest, then the first."""
    if not isinstance(text, str):
        return None
    read = json.JSONDecoder().raw_decode
    found = []
    at = text.find("[")
    while at >= 0:
        try:
            value, _ = read(text, at)
            if isinstance(value, list):
                found.append((bool(value) and all(isinstance(x, dict) for x in value), len(value), -at, value))
        except (ValueError, RecursionError):
            pass
        at = text.find("[", at + 1)
    return json.dumps(max(found, key=lambda x: x[:3])[3], ensure_ascii=False, separators=(",", ":")) if found else None


def scan_lists(c: Column) -> Column:
    """K3 as a column: the list as JSON text, null where there is none."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(_best_list)

    return F.pandas_udf(run, "string")(c)


def answer_list(c: Column, schema: str) -> Column:
    """K1 to K3: the items of an answer, by its block, its keys, or whatever list it holds."""
    return F.coalesce(json_items(json_block(c), schema), F.from_json(scan_lists(json_block(c)), f"array<{schema}>"))


def decide_gate(separation_db: Column, mode: Column, least_db: float = 6.0) -> Column:
    """Forced on or off, else on from ``least_db``; an unknown (infinite) separation is on."""
    return F.when(mode == "on", True).when(mode == "off", False).otherwise(F.coalesce(separation_db >= least_db, F.lit(False)))


#: Other spellings of languages.
ALIASES = {"english": "en", "英文": "en", "chinese": "zh", "中文": "zh", "japanese": "ja"}


def target_language(c: Column) -> Column:
    """P13 + P14: the code of a target language, null where it names none (``auto`` is none)."""
    t = F.lower(F.trim(c))
    for k, v in ALIASES.items():
        t = F.when(t == k, v).otherwise(t)
    return F.when((t != "auto") & t.rlike("^[a-z]{2,3}(?:-[a-z0-9]{2,8})*$"), t)


def language_vote(samples: DataFrame) -> DataFrame:
    """A14 on detection windows ``rec_id, lang, p``: Chinese only if every window says so with 0.7 or more, else the surest window's language."""
    g = samples.groupBy("rec_id").agg(F.expr("bool_and(lang = 'zh' AND p >= 0.7)").alias("chinese"), F.expr("max_by(lang, struct(p, lang))").alias("surest"))
    return g.select("rec_id", F.expr("CASE WHEN chinese THEN 'zh' ELSE surest END").alias("language"), F.coalesce("chinese", F.lit(False)).alias("chinese"))


def route(votes: DataFrame) -> DataFrame:
    """E12 on ``rec_id, chinese, engine, diarize``: the engine to run, or the error that forbids it.

    What is not Chinese goes to the general engine and cannot be diarised; Chinese goes to the engine asked for (``auto``
    to the one for voices), of which only that one tells voices apart.
    """
    engine = "CASE WHEN NOT chinese THEN 'whisper' WHEN engine = 'auto' THEN 'funasr' ELSE engine END"
    e = votes.withColumn("used", F.expr(engine))
    return e.select("rec_id", F.expr("CASE WHEN diarize AND used <> 'funasr' THEN NULL ELSE used END").alias("engine"), F.expr("CASE WHEN diarize AND NOT chinese THEN 'voices need Chinese' WHEN diarize AND used <> 'funasr' THEN 'engine tells no voices' END").alias("error"))


def probe(stats: DataFrame, dual: DataFrame) -> DataFrame:
    """E11 on A1's ``rec_id, speaker, bystander`` and A3's ``rec_id, verdict``: what a recording should be transcribed as."""
    n = stats.groupBy("rec_id").agg(F.sum((~F.col("bystander")).cast("int")).alias("speakers"))
    j = n.join(dual.select("rec_id", "verdict"), "rec_id", "full")
    return j.select("rec_id", F.coalesce("speakers", F.lit(0)).alias("speakers"), F.expr("CASE WHEN verdict = 'dual' THEN 'by channel' WHEN coalesce(speakers, 0) > 1 THEN 'by voice' ELSE 'single' END").alias("advice"))


def keep_model(rows: DataFrame, load, answer, schema: str) -> DataFrame:
    """A worker that loads its model once per Python process and answers batch after batch; ``load()`` makes it, ``answer(model, pdf)`` uses it."""

    def run(pdfs):
        model = load()
        for pdf in pdfs:
            yield answer(model, pdf)

    return rows.mapInPandas(run, schema)
