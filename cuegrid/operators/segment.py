"""From sentences to cues and back: segmentation as one Arrow operator, seams inside terms, line width, lists for people."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.functions.segmenting import NO_TERMS, PAUSE_MS, Line, Terms, flat_sentences, inside, segments, sentence_cues
from cuegrid.functions.text import TAILS, chinese_rules, display_width, width
from cuegrid.operators.fold import fold
from cuegrid.sources.subtitles import format_stamp, parse_stamp_strict

JOIN_GAP_MS, JOIN_WIDTH = 500.0, 3.0
_FLAT = pa.schema([("cue_id", pa.int64()), ("piece", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])


def segment_texts(cues: DataFrame, most: float = 16.0, terms: Terms = NO_TERMS) -> DataFrame:
    """G1 on ``cue_id, text, language``: ``cue_id, piece, a, b`` of every piece; redelivered cues are made distinct before, null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, no, xs, ys = [], [], [], []
            for c, t, lang in zip(*(b.column(k).to_pylist() for k in ("cue_id", "text", "language"))):
                for i, (x, y) in enumerate(segments(t, most, terms, lang)):
                    ids.append(c)
                    no.append(i)
                    xs.append(x)
                    ys.append(y)
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip((ids, no, xs, ys), _FLAT)], schema=_FLAT)

    return cues.where("text IS NOT NULL").select("cue_id", "text", "language").distinct().mapInArrow(run, "cue_id bigint, piece int, a int, b int")


_CUE = pa.schema([("rec_id", pa.string()), ("sent_id", pa.int64()), ("piece", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("text", pa.string()), ("speaker", pa.string()), ("language", pa.string())])
_CUE_DDL = "rec_id string, sent_id bigint, piece int, start_ms double, end_ms double, text string, speaker string, language string"


def cues_of_sentences(sentences: DataFrame, most: float = 16.0, pause_ms: float = PAUSE_MS, offset_ms: float = 0.0, diarize: bool = True, terms: Terms = NO_TERMS) -> DataFrame:
    """G8 on ``rec_id, sent_id, start_ms, end_ms, text`` and, where there are such columns, ``spk, language, words, stamps, bystander``.

    One row per cue; null and blank texts have none, a missing start is 0, a missing end the start.  Bystanders get no speaker.
    """
    extra = {"spk": "int", "language": "string", "words": "array<struct<word:string,start:double,end:double>>", "stamps": "array<struct<s:double,e:double>>", "bystander": "boolean"}
    cols = [F.col(c) if c in sentences.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, i, s, e, t, spk, lang, words, stamps, by in zip(*(c.to_pylist() for c in b.columns)):
                who = f"spk{spk + 1}" if diarize and spk is not None and not by else None
                for k, c in enumerate(sentence_cues(t, s, e, most, words, stamps, pause_ms, terms, lang or "auto")):
                    rows.append((r, i, k, c["start_ms"] + offset_ms, c["end_ms"] + offset_ms, c["text"], who, lang or "auto"))
            out = list(zip(*rows)) or [[]] * len(_CUE)
            yield pa.record_batch([pa.array(list(v), f.type) for v, f in zip(out, _CUE)], schema=_CUE)

    return sentences.select("rec_id", "sent_id", "start_ms", "end_ms", "text", *cols).mapInArrow(run, _CUE_DDL)


def sentences_of_flat(texts: DataFrame) -> DataFrame:
    """F4 on ``rec_id, text, stamps``: ``rec_id, sent_no, text, start_ms, end_ms``."""
    cut = lambda t, s: pd.Series([flat_sentences(x, None if y is None else list(y)) for x, y in zip(t, s)])

    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        return cut(t, s)

    u = F.pandas_udf(run, "array<struct<text:string,start_ms:double,end_ms:double>>")
    return texts.select("rec_id", F.posexplode(u("text", "stamps")).alias("sent_no", "x")).select("rec_id", "sent_no", "x.text", "x.start_ms", "x.end_ms")


_WIDE = pa.schema([("rec_id", pa.string()), ("cue_id", pa.int64()), ("piece", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("speaker", pa.string()), ("text", pa.string()), ("pieces", pa.int32())])


def enforce_width(cues: DataFrame, most: float = 16.0, terms: Terms = NO_TERMS) -> DataFrame:
    """An over-wide one-line cue becomes several; its time is shared by width, the last piece ends where the cue does.

    ``pieces`` tells into how many a cue went (1: as it was); null texts and times stay null.
    """

    def cut(x: str | None, lang: str | None) -> list[tuple[str | None, float]]:
        if x is None or "\n" in x or len(x) <= most / 2 or width(x) <= most:
            return [(x, 1.0)]
        line = Line(x, terms.protected(x, lang))
        spans = line.wrap(0, len(x), most)
        return [(x[a:b].strip(), line.width(a, b)) for a, b in spans] if len(spans) > 1 else [(x, 1.0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for rec, cue, start, end, who, x, lang in zip(*(c.to_pylist() for c in b.columns)):
                ps = cut(x, lang)
                n, total, done = len(ps), sum(w for _, w in ps) or 1.0, 0.0
                span = max(end - start, 1.0) if start is not None and end is not None else None
                for i, (t, w) in enumerate(ps):
                    at = start if n == 1 or span is None else start + span * done / total
                    done += w
                    rows.append((rec, cue, i, at, end if i == n - 1 or span is None else start + span * done / total, who, t, n))
            cols = list(zip(*rows)) or [[]] * len(_WIDE)
            yield pa.record_batch([pa.array(list(v), f.type) for v, f in zip(cols, _WIDE)], schema=_WIDE)

    lang = F.col("language") if "language" in cues.columns else F.lit("auto").alias("language")
    ddl = "rec_id string, cue_id bigint, piece int, start_ms double, end_ms double, speaker string, text string, pieces int"
    return cues.select("rec_id", "cue_id", "start_ms", "end_ms", "speaker", "text", lang).mapInArrow(run, ddl)


class _Seams:
    def __init__(self, terms: Terms, most: float):
        self.terms, self.most, self.cur, self.n = terms, most, None, 0

    def _joined(self, c: dict, r: dict) -> str | None:
        """The two texts as one, if their seam parts a term or a count and nothing speaks against it."""
        head, tail = c["text"] or "", r["text"] or ""
        if c["language"] != r["language"] or not chinese_rules(head + tail, r["language"]) or "\n" in head + tail or c["speaker"] != r["speaker"]:
            return None
        if c["end_ms"] is None or r["start_ms"] is None or r["start_ms"] - c["end_ms"] > JOIN_GAP_MS:
            return None
        latin = [x[-1:].isascii() and x[-1:].isalnum() for x in (head, tail[:1])]
        glue = " " if all(latin) else ""
        text, seam = head + glue + tail, len(head) + len(glue)
        if width(text) > JOIN_WIDTH * self.most:
            return None
        if inside(seam, self.terms.glossary(text)):
            return text
        ended = c["sentence_end"] if c["sentence_end"] is not None else head.rstrip()[-1:] != "" and head.rstrip()[-1:] in TAILS
        return None if ended or not inside(seam, self.terms.protected(text, r["language"])) else text

    def row(self, r: dict) -> list[tuple]:
        c = self.cur
        text = self._joined(c, r) if c is not None else None
        if text is not None:
            c["text"], c["end_ms"] = text, r["end_ms"]
            self.n += 1
            return []
        out = self.end()
        self.cur, self.n = dict(r), 1
        return out

    def end(self) -> list[tuple]:
        c = self.cur
        return [(c["rec_id"], c["cue_id"], c["start_ms"], c["end_ms"], c["speaker"], c["text"], self.n)] if c else []


def repair_term_splits(cues: DataFrame, terms: Terms, most: float = 16.0) -> DataFrame:
    """T9 on ``rec_id, cue_id, start_ms, end_ms, speaker, text, language`` and, if there, ``sentence_end``: cues whose seam parts a term become one.

    Only Chinese single-line cues of one speaker, with a pause of at most 500 ms and no more than three lines of width;
    a seam inside a glossary term is mended even behind a full stop.  ``parts`` counts the cues in a row.
    """
    schema = pa.schema([("rec_id", pa.string()), ("cue_id", pa.int64()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("speaker", pa.string()), ("text", pa.string()), ("parts", pa.int64())])
    ddl = "rec_id string, cue_id bigint, start_ms double, end_ms double, speaker string, text string, parts bigint"
    se = F.col("sentence_end") if "sentence_end" in cues.columns else F.lit(None).cast("boolean").alias("sentence_end")
    return fold(cues.select("rec_id", "cue_id", "start_ms", "end_ms", "speaker", "text", "language", se), ["rec_id"], ["start_ms", "end_ms", "cue_id"], lambda: _Seams(terms, most), ddl, schema)


def width_audit(cues: DataFrame, most: float = 16.0) -> DataFrame:
    """A10: widest line and lines over ``most`` per recording, speaker prefixes (``spkN: ``) left out; null texts have none."""
    lines = cues.where("text IS NOT NULL").select("rec_id", F.explode(F.split("text", "\n")).alias("line"))
    w = lines.select("rec_id", display_width(F.regexp_replace("line", r"^spk\d+: ", "")).alias("w"))
    return w.groupBy("rec_id").agg(F.max("w").alias("widest"), F.sum((F.col("w") > most).cast("int")).alias("over"))


def uncertain_list(items: DataFrame, vtt: bool = False) -> DataFrame:
    """S13 on ``rec_id, item_id, time, text, candidates, anchored``: three-second cues of doubtful lines; a bad time counts as 0, a place not found is said."""
    start = F.coalesce(parse_stamp_strict(F.col("time")).cast("double"), F.lit(0.0))
    other = F.when(F.size(F.coalesce("candidates", F.expr("CAST(array() AS ARRAY<STRING>)"))) > 0, F.array_join("candidates", " ／ ")).otherwise("-")
    other = F.concat(other, F.when(~F.coalesce("anchored", F.lit(True)), "　【时间未校准】").otherwise(""))
    return items.select("rec_id", "item_id", format_stamp(start, vtt).alias("start"), format_stamp(start + 3000, vtt).alias("end"), F.concat(F.lit("【存疑】"), F.coalesce("text", F.lit("")), F.lit("　→？"), other).alias("text"))
