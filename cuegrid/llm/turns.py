"""Problem 2: speech transcripts into clean speaker turns.

1. *Mining.*  The head of every line walks a token tree of fixed depth (first the delimiter that ends the head, then up
   to ``DEPTH`` tokens); tokens with digits and words become wildcards, so the tree is bounded.  Its leaves are the line
   templates, counted over the whole corpus by partition and then by shuffle.
2. *Inference.*  Each template's wildcard is a speaker slot if its values name voices of their own recordings
   (``voice_map``) often enough; templates that name nobody are no layout.  The result is a short list of layouts.  Time
   stamps and sound annotations are told by form before a line walks the tree: their spellings are few and fixed.
3. *Extraction and merging.*  Lines are read with the layouts, ordered by start, cue and place, and runs of one speaker
   become turns.  Ordering and runs are found per (recording, time slab); what touches slab borders is stitched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.lines import LABEL_WORD, label_key, mask, plain, trimmings
from cuegrid.llm.fillers import is_speech
from cuegrid.operators.voices import alias_key, voice_map, with_voices

DEPTH = 4
MIN_SUPPORT = 3
MIN_SHARE = 0.3
MAX_PAUSE_MS = 600_000
SLAB_MS = 3_600_000

_BLANK = r"[\s​‎‏﻿⁠]*"
_HEAD_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|[ ]")
#: A head is what stands before the first delimiter; delimiters are a colon, a closing bracket or a spaced dash.
_HEAD = re.compile(r"(?P<open>(?:<v[ .]+|\[|>>[ ]*|-[ ]+)?)(?P<slot>[^\W_][^\n:：\[\]<>“”\"«»()（）【】{}*♪♫,.!?。！？]{0,23}?)(?P<close>\][ ]*[:：]|\]|>|[ ]*[:：]|[ ]+-(?=[ ]|$))")


def template_of(open_: str, slot: str, close: str) -> str:
    """The leaf of the tree for one line head: wildcards for words (by case) and numbers, all else literal."""
    path = [open_.strip() or "^"]
    for tok in _HEAD_TOKEN.findall(slot.strip())[:DEPTH]:
        if tok.isdigit():
            path.append("<#>")
        elif tok.lower() in _KEYWORDS:
            path.append(tok.lower())
        elif tok.isalpha():
            path.append("<W>" if tok.isupper() and len(tok) > 1 else "<Ww>" if tok[0].isupper() else "<w>")
        else:
            path.append(tok if tok != " " else "_")
    path.append(close.strip())
    return " ".join(path)


#: Words the tree keeps as they are (fixed values).
_KEYWORDS = {"spk", "speaker", "说话人", "話者", "화자", "спикер", "locuteur", "sprecher", "file"}


def heads(text: str) -> Iterator[tuple[str, str, int, int]]:
    """``(template, slot, first, end)`` of each physical line with a head; stamps and annotations may come first."""
    masked = mask(text, trimmings(text))
    at = 0
    for part in masked.split("\n"):
        m = _HEAD.match(part, len(part) - len(part.lstrip("  \t​‎‏﻿⁠　")))
        if m:
            end = m.end() + (part[m.end() : m.end() + 1] == " ")
            yield template_of(m["open"], m["slot"], m["close"]), m["slot"], at + m.start(), at + end
        at += len(part) + 1


_COLONISH = re.compile(r"[:：\]>]|\d -")
_MINED = pa.schema([("template", pa.string()), ("rec_id", pa.string()), ("alias", pa.string()), ("n", pa.int64())])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in seen.items()]
        seen.clear()
        cols = list(zip(*rows)) or [[]] * 4
        return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, _MINED)], schema=_MINED)

    for b in batches:
        for rec, text in zip(b.column("rec_id").to_pylist(), b.column("text").to_pylist()):
            for template, slot, _, _ in heads(text):
                seen[template, rec, label_key(slot)] += 1
        if len(seen) > 200_000:
            yield flush()
    yield flush()


def mine_layouts(cues: DataFrame, tracks: DataFrame, min_support: int = MIN_SUPPORT, min_share: float = MIN_SHARE) -> DataFrame:
    """``template, n, share``: line templates whose slot names a voice of the recording in at least ``min_share`` lines."""
    t = cues.where("text IS NOT NULL AND rec_id IS NOT NULL").where(F.col("text").rlike(r"[:：\]>]|\d -")).select("rec_id", "text")
    mined = t.mapInArrow(_mine, "template string, rec_id string, alias string, n bigint").groupBy("template", "rec_id", "alias").agg(F.sum("n").alias("n"))
    v = voice_map(tracks).select(F.col("rec_id").alias("_rec"), "voices")
    hit = mined.join(v.hint("merge"), mined.rec_id == v._rec, "left").withColumn("hit", F.expr("coalesce(map_contains_key(voices, alias), false)"))
    per = hit.groupBy("template").agg(F.sum("n").alias("n"), F.sum(F.expr("if(hit, n, 0)")).alias("hits"))
    return per.where(f"n >= {min_support} AND hits >= {min_share} * n").select("template", "n", F.expr("hits / n").alias("share"))


def line_list(text: str, layouts: frozenset[str]) -> tuple[list[tuple[str | None, int, int]], str]:
    """Lines ``(label key, first, end)`` by the inferred layouts and the text with all slots blanked."""
    if plain(text):
        return [(None, 0, len(text))], text
    spans = trimmings(text)
    masked = mask(text, spans) if spans else text
    if not _COLONISH.search(text):
        return [(None, 0, len(text))], masked
    found = [(label_key(slot), a, b) for t, slot, a, b in heads(text) if t in layouts]
    if not found:
        return [(None, 0, len(text))], masked
    lines: list[tuple[str | None, int, int]] = []
    if any(ch.isalnum() for ch in masked[: found[0][1]]):
        lines.append((None, 0, found[0][1]))
    lines += [(k, b, found[i + 1][1] if i + 1 < len(found) else len(text)) for i, (k, _, b) in enumerate(found)]
    return lines, mask(masked, [(a, b) for _, a, b in found])


_WORDS = re.compile(r"\s+")
_LINES = pa.schema([("rec_id", pa.string()), ("cue_id", pa.int64()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("speaker", pa.string()), ("line_no", pa.int32()), ("label", pa.string()), ("words", pa.string())])


def _reader(layouts: frozenset[str], with_words: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, label, words = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                lines, masked = line_list(text, layouts)
                if not is_speech(masked):
                    continue
                for j, (key, a, z) in enumerate(lines):
                    at.append(i)
                    no.append(j)
                    label.append(key)
                    words.append(_WORDS.sub(" ", masked[a:z]).strip() if with_words else None)
            picked = b.select(["rec_id", "cue_id", "start_ms", "end_ms", "speaker"]).take(pa.array(at, pa.int64()))
            yield pa.record_batch([*picked.columns, pa.array(no, pa.int32()), pa.array(label, pa.string()), pa.array(words, pa.string())], schema=_LINES)

    return read


def speech_lines(cues: DataFrame, tracks: DataFrame, with_words: bool = False) -> DataFrame:
    """Each line of speech with the speaker it leads to; redelivered cues count once."""
    layouts = frozenset(r.template for r in mine_layouts(cues, tracks).collect())  # bounded by the tree: no values in it
    c = cues.where("start_ms IS NOT NULL AND text IS NOT NULL AND rec_id IS NOT NULL AND cue_id IS NOT NULL")
    c = c.select("rec_id", "cue_id", "start_ms", "end_ms", alias_key(F.col("speaker")).alias("speaker"), "text")
    lines = c.mapInArrow(_reader(layouts, with_words), "rec_id string, cue_id bigint, start_ms double, end_ms double, speaker string, line_no int, label string, words string")
    named = with_voices(lines, tracks)
    named = named.withColumn("who", F.expr("coalesce(voices[label], voices[speaker], sole)"))
    return named.select("rec_id", "cue_id", "line_no", "start_ms", "end_ms", "who", "words").dropDuplicates(["rec_id", "cue_id", "line_no", "start_ms"])


def turns(cues: DataFrame, tracks: DataFrame, pause_ms: int = MAX_PAUSE_MS, with_words: bool = False) -> DataFrame:
    """``rec_id, speaker, first_cue_id, last_cue_id, start_ms, end_ms, n_lines[, words]``, one row per turn.

    Lines are ordered by start, cue and place.  A turn is a longest run of lines of one speaker in which no line starts
    more than ``pause_ms`` after the one before.  A line of nobody known ends a run and makes none.  Cues without start,
    text or anything said are left out; an empty table gives an empty result.
    """
    lines = speech_lines(cues, tracks, with_words).withColumn("slab", F.expr(f"cast(floor(start_ms / {SLAB_MS}) AS bigint)")).withColumn("p", F.expr("coalesce(who, -1)"))
    w = Window.partitionBy("rec_id", "slab").orderBy("start_ms", "cue_id", "line_no")
    fresh = F.expr(f"lag_p IS NULL OR lag_p <> p OR start_ms - lag_s > {pause_ms}")
    r = lines.withColumn("lag_p", F.lag("p").over(w)).withColumn("lag_s", F.lag("start_ms").over(w)).withColumn("new", fresh)
    r = r.withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.struct("start_ms", "cue_id", "line_no"), F.struct("start_ms", "cue_id", "line_no")
    said = [F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "cue_id", "line_no", "words"))), lambda x: x["words"]).alias("said")] if with_words else []
    runs = r.groupBy("rec_id", "slab", "run", "p").agg(F.min(first).alias("f"), F.max(last).alias("l"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"), *said)
    # Per slab only its first and last run can go on in a neighbour; all runs are few, the lines are not seen again.
    s = Window.partitionBy("rec_id").orderBy("slab", "run")
    joined = F.expr(f"lag_p IS NULL OR lag_p <> p OR f.start_ms - lag_s > {pause_ms}")
    edge = Window.partitionBy("rec_id", "slab")
    marked = runs.withColumn("is_edge", (F.col("run") == F.min("run").over(edge)) | (F.col("run") == F.max("run").over(edge)))
    edges = marked.where("is_edge").withColumn("lag_p", F.lag("p").over(s)).withColumn("lag_s", F.lag("l.start_ms").over(s)).withColumn("lag_r", F.lag("run").over(s)).withColumn("lag_b", F.lag("slab").over(s))
    edges = edges.withColumn("new", joined | (F.col("lag_b") == F.col("slab")))
    edges = edges.withColumn("g", F.sum(F.col("new").cast("int")).over(s.rowsBetween(Window.unboundedPreceding, 0)))
    more = [F.expr("flatten(transform(array_sort(collect_list(struct(slab, run, said))), x -> x.said)) AS said")] if with_words else []
    stitched = edges.groupBy("rec_id", "p", "g").agg(F.min("f").alias("f"), F.max("l").alias("l"), F.max("end_ms").alias("end_ms"), F.sum("n").alias("n"), *more)
    cols = ["rec_id", "p", "f", "l", "end_ms", "n"] + (["said"] if with_words else [])
    both = marked.where("NOT is_edge").select(*cols).unionByName(stitched.select(*cols)).where("p >= 0")
    out = [F.col("rec_id"), F.col("p").cast("int").alias("speaker"), F.col("f.cue_id").alias("first_cue_id"), F.col("l.cue_id").alias("last_cue_id"), F.col("f.start_ms").alias("start_ms"), "end_ms", F.col("n").alias("n_lines")]
    if with_words:
        out.append(F.expr("array_join(filter(said, x -> x <> ''), ' ')").alias("words"))
    return both.select(*out)


def p2_found(cues: DataFrame, tracks: DataFrame) -> DataFrame:
    return turns(cues, tracks).select("rec_id", "speaker", "first_cue_id", "last_cue_id")


__all__ = ["LABEL_WORD", "heads", "line_list", "mine_layouts", "p2_found", "speech_lines", "template_of", "turns"]
