"""Subtitle text in and out: stamps, lenient, numeric and strict parsing, rendering, and files of cues."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STAMP = r"(?:(\d{1,3}):)?(\d{1,2}):(\d{2})[,.](\d{1,3})"


def parse_stamp(c: Column) -> Column:
    """S7, lenient: milliseconds of ``[HH:]MM:SS,mmm``, null for anything else; the fraction is read as it stands."""
    p = f"^\\s*{_STAMP}\\s*$"
    part = lambda i: F.coalesce(F.regexp_extract(c, p, i).try_cast("bigint"), F.lit(0))
    return F.when(c.rlike(p), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4))


def parse_stamp_strict(c: Column) -> Column:
    """S7, of doubtful lists: ``HH:MM:SS,mmm`` with any digits, null for anything else."""
    p = r"^\s*(\d+):\s*(\d+)\s*:\s*(\d+)[,.](\d+)\s*$"
    part = lambda i: F.regexp_extract(c, p, i).try_cast("bigint")
    return F.when(c.rlike(p), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def format_stamp(ms: Column, vtt: bool = False) -> Column:
    """``HH:MM:SS,mmm``, rounded half to even, never below zero."""
    t = F.greatest(F.bround(ms, 0).cast("bigint"), F.lit(0))
    sep = "." if vtt else ","
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, t % 1000)


def parse_text(files: DataFrame, numeric: bool = False) -> DataFrame:
    """Blocks of ``path, raw`` with their stamp line and text; ``numeric`` adds times and leaves empty texts and markup out."""
    raw = F.regexp_replace(F.regexp_replace("raw", "\r\n?", "\n"), "^﻿", "")
    b = files.select("path", F.posexplode(F.split(raw, "\n[ \t]*\n")).alias("block_no", "block"))
    one = r"\d{1,2}:\d{2}:\d{2}[,.]\d{1,3}"
    stamp = rf"({one}\s*-->\s*{one})"
    b = b.withColumn("stamp", F.regexp_extract("block", stamp, 1)).where("stamp <> ''")
    body = F.expr("substring(block, instr(block, stamp) + length(stamp))")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, "^[^\n]*\n?", ""), "\n+", " "))
    b = b.withColumn("text", text)
    if not numeric:
        return b.select("path", "block_no", "stamp", "text")
    ends = F.split("stamp", r"\s*-->\s*")
    b = b.withColumn("text", F.trim(F.regexp_replace("text", "<[^>]+>", ""))).where("text <> ''")
    return b.select("path", "block_no", parse_stamp(ends[0]).alias("start_ms"), parse_stamp(ends[1]).alias("end_ms"), "text")


class BadSubtitle(ValueError):
    """Why a document is refused by the strict parser."""


_ARROW = re.compile(r"((?:\d{2,}:)?\d{2}:\d{2}[,.]\d{3}) --> ((?:\d{2,}:)?\d{2}:\d{2}[,.]\d{3})[^\r\n]*")
_KEPT = ("NOTE", "STYLE", "REGION", "WEBVTT")


def _ms(stamp: str) -> int:
    *hours, m, s, f = (int(x) for x in re.split("[:,.]", stamp))
    if m > 59 or s > 59:
        raise BadSubtitle(f"minutes or seconds over 59: {stamp}")
    return ((hours[0] if hours else 0) * 3600 + m * 60 + s) * 1000 + f


def parse_document(raw: str) -> tuple[list[str], list[dict]]:
    """S6, strict and lossless: ``parts`` joined are the document; each cue names the part that holds its text.

    Headers, notes, styles, regions and blocks without times are kept as they are.  A stamp line that cannot be read,
    more than one of them or of lines before it, minutes or seconds over 59, a cue without duration or text, and a
    document without cues raise ``BadSubtitle``.
    """
    out: list[str] = []
    cues: list[dict] = []
    for n, part in enumerate(re.split(r"(\r?\n[ \t]*\r?\n)", raw)):
        lines = part.splitlines(keepends=True)
        stamps = [(i, m) for i, x in enumerate(lines) if (m := _ARROW.fullmatch(x.rstrip("\r\n")))]
        if n % 2 or not lines or lines[0].lstrip("\ufeff").startswith(_KEPT) or not (stamps or "-->" in part):
            out.append(part)
            continue
        if not stamps:
            raise BadSubtitle(f"bad stamp line: {part[:60]!r}")
        if len(stamps) > 1 or stamps[0][0] > 1:
            raise BadSubtitle(f"more than one stamp or id line: {part[:60]!r}")
        at, m = stamps[0]
        start, end = _ms(m[1]), _ms(m[2])
        head, text = "".join(lines[: at + 1]), "".join(lines[at + 1 :])
        if end <= start or not text.strip():
            raise BadSubtitle("cue without duration or text")
        out += [head, text]
        cues.append({"part": len(out) - 1, "start_ms": start, "end_ms": end, "header": head, "text": text})
    if not cues:
        raise BadSubtitle("no cues")
    return out, cues


_STRICT = pa.schema([("path", pa.string()), ("cue_no", pa.int32()), ("part_no", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("header", pa.string()), ("text", pa.string()), ("error", pa.string())])


def parse_strict(files: DataFrame) -> DataFrame:
    """S6 on ``path, raw``: one row per cue; a refused document has one row that holds nothing but its ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("raw").to_pylist()):
                try:
                    rows += [(path, i, c["part"], c["start_ms"], c["end_ms"], c["header"], c["text"], None) for i, c in enumerate(parse_document(raw or "")[1])]
                except BadSubtitle as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            cols = list(zip(*rows)) or [[]] * len(_STRICT)
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, _STRICT)], schema=_STRICT)

    return files.select("path", "raw").mapInArrow(run, "path string, cue_no int, part_no int, start_ms bigint, end_ms bigint, header string, text string, error string")


def splice(raw: str, texts: list[str]) -> str:
    """The document with its cues' texts replaced, all else untouched; line ends are those of the cue's header."""
    parts, cues = parse_document(raw)
    if len(texts) != len(cues):
        raise BadSubtitle("number of texts")
    for c, t in zip(cues, texts):
        nl = "\r\n" if "\r\n" in c["header"] else "\n"
        parts[c["part"]] = nl.join(t.strip().splitlines()) + (nl if c["text"].endswith(("\n", "\r")) else "")
    out = "".join(parts)
    if [c["header"] for c in parse_document(out)[1]] != [c["header"] for c in cues]:
        raise BadSubtitle("the translation changed the structure")
    return out


def assemble(files: DataFrame, answers: DataFrame) -> DataFrame:
    """E8 on ``path, raw`` and accepted answers ``path, cue_no, text``: ``path, document, error``; a document of which an answer is missing has none."""
    a = answers.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", "text"))), lambda x: x["text"]).alias("texts"))

    def run(raws: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, ts in zip(raws, texts):
            try:
                rows.append((splice(raw or "", [] if ts is None else [x or "" for x in ts]), None))
            except BadSubtitle as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["document", "error"])

    u = F.pandas_udf(run, "struct<document:string,error:string>")
    return files.join(a, "path", "left").withColumn("r", u("raw", "texts")).select("path", "r.document", "r.error")


def render(cues: DataFrame, vtt: bool = False, speaker_tags: bool = False) -> DataFrame:
    """One document per recording, cues renumbered in time order."""
    text = F.coalesce("text", F.lit(""))
    if speaker_tags:
        text = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat("speaker", F.lit(": "), text)).otherwise(text)
    row = F.struct("start_ms", "end_ms", "cue_id", text.alias("t"))
    d = cues.groupBy("rec_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    block = F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit("\n"), format_stamp(r["start_ms"], vtt), F.lit(" --> "), format_stamp(r["end_ms"], vtt), F.lit("\n"), r["t"], F.lit("\n")))
    body = F.array_join(block, "\n")
    return d.select("rec_id", (F.concat(F.lit("WEBVTT\n\n"), body) if vtt else body).alias("document"))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` (``*.srt``, ``*.vtt``) as cues; whole files are read as one row each."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{srt,vtt}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return parse_text(files, numeric=True)


def write_subtitles(cues: DataFrame, path: str, vtt: bool = False, by_speaker: bool = False) -> None:
    """Rendered documents, partitioned by recording (and speaker); the commit is the file format's own."""
    if by_speaker:
        docs = render(cues.where("speaker IS NOT NULL").withColumn("rec_id", F.concat_ws("\x1f", "rec_id", "speaker")), vtt)
        docs = docs.select(F.split("rec_id", "\x1f")[0].alias("rec_id"), F.split("rec_id", "\x1f")[1].alias("speaker"), "document")
        docs.write.partitionBy("rec_id", "speaker").mode("overwrite").text(path)
    else:
        render(cues, vtt).write.partitionBy("rec_id").mode("overwrite").text(path)


def sanitize_name(c: Column) -> Column:
    """A file name without control characters and slashes, runs of blanks or dashes, and edge marks; nothing left gives the default."""
    c = F.regexp_replace(F.regexp_replace(c, "(?U)^\\s+|\\s+$", ""), r"[\x00-\x1f\x7f/\\]+", "-")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"-{2,}", "-")
    c = F.regexp_replace(c, r"^[ .\-]+|[ .\-]+$", "")
    return F.when(c == "", "字幕项目").otherwise(c)


_YEAR, _MONTH, _DAY = r"(?:19|20)\d{2}", "(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
_DATE = rf"(?:{_YEAR}[-._]{_MONTH}[-._]{_DAY}|{_YEAR}年{_MONTH}月{_DAY}日?|{_YEAR}(?:1[0-2]|0[1-9])(?:3[01]|[12]\d|0[1-9]))"
_CLOCK = r"(?:[T\s_-]+(?:2[0-3]|[01]?\d)(?:(?::|[._-])?[0-5]\d(?:(?::|[._-])?[0-5]\d)?)?)?"


def strip_date(c: Column) -> Column:
    """A name without the recording date and time it begins with."""
    return F.regexp_replace(c, rf"^\s*{_DATE}{_CLOCK}(?=$|[\s._-])[\s._-]*", "")


def project_key(c: Column) -> Column:
    """What project names are matched by."""
    return F.lower(sanitize_name(strip_date(c)))


def resolve_projects(media: DataFrame, projects: DataFrame) -> DataFrame:
    """S17 on ``path, name`` and project names ``project``: the project a file belongs to if exactly one matches (those that begin with ``_`` never do)."""
    p = projects.where("NOT startswith(project, '_')").select("project", project_key(F.col("project")).alias("key"))
    one = p.groupBy("key").agg(F.count("*").alias("n"), F.first("project").alias("project")).where("n = 1").drop("n")
    return media.withColumn("key", project_key(F.col("name"))).join(one, "key", "left").select("path", "name", "project")


def track_document(cues: DataFrame, vtt: bool = False) -> DataFrame:
    """S12 on ``rec_id, cue_id, start_ms, end_ms, speaker, text, language, bleed``: per speaker the raw subtitles, bleed marked, empty cues left out."""
    from cuegrid.functions.rules import finalize
    from cuegrid.operators.timeline import normalize_timeline

    c = normalize_timeline(cues.where("speaker IS NOT NULL").withColumn("rec_id", F.concat_ws("\x1f", "rec_id", "speaker")))
    t = finalize(F.coalesce("text", F.lit("")), F.col("language"))
    c = c.withColumn("text", t).where("text <> ''").withColumn("text", F.when(F.coalesce("bleed", F.lit(False)), F.concat(F.lit("【串音】"), "text")).otherwise(F.col("text")))
    n = c.groupBy("rec_id").agg(F.count("*").alias("cues"), F.sum(F.coalesce("bleed", F.lit(False)).cast("int")).alias("bleed"))
    key = F.split("rec_id", "\x1f")
    return render(c, vtt).join(n, "rec_id").select(key[0].alias("rec_id"), key[1].alias("speaker"), "document", "cues", "bleed")


def manifest(cues: DataFrame, recordings: DataFrame) -> DataFrame:
    """One JSON document per recording: cues, speakers, total time and what is known of its file."""
    g = cues.groupBy("rec_id").agg(F.count("*").alias("cue_count"), F.max("end_ms").alias("total_ms"), F.array_sort(F.collect_set("speaker")).alias("speakers"))
    r = recordings.groupBy("rec_id").agg(F.min("source").alias("source"), F.min("path").alias("path"))
    j = g.join(r, "rec_id", "left")
    return j.select("rec_id", F.to_json(F.struct("rec_id", "source", "path", "cue_count", "total_ms", "speakers")).alias("manifest"))


def transcript(cues: DataFrame) -> DataFrame:
    """One JSON line per cue, the form other tools read."""
    return cues.select("rec_id", "cue_id", F.to_json(F.struct("cue_id", "start_ms", "end_ms", "speaker", "text")).alias("line"))


#: Media by extension, and folders that hold none.
VIDEO, AUDIO = "mp4 mov mkv avi wmv webm m4v 3gp mpeg mpg flv ts".split(), "m4a mp3 wav ogg flac aac wma opus".split()
SKIP_DIRS = (".subtitle_cache", ".subtitle_tasks", ".transcribe_tmp", ".polish_tmp", "__pycache__")


def is_media(path: Column) -> Column:
    """A relative path that names a media file, outside hidden folders and those of the tools, and not hidden itself."""
    skip = "|".join(re.escape(d) for d in SKIP_DIRS)
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*VIDEO, *AUDIO) & ~path.rlike(r"(^|/)\.") & ~path.rlike(f"(^|/)(?:{skip})/")


def discover_media(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Media files below a folder; contents are never read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "modificationTime", "length")
    return f.where(is_media(F.regexp_replace("path", f"^.*?{re.escape(path.rstrip('/'))}/", "")))
