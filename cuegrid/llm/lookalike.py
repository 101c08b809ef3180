"""Problem 10: one form for texts that look the same.

DuckDB runs inside the Arrow partitions: every batch is a relation, and embedded SQL brings its texts to the common form
with ``nfc_normalize``, ``translate`` and regular expressions.  Only what cannot be seen is changed: full- and half-width
forms, ligatures and radicals (compatibility forms with the look of their usual forms), kinds of blanks, invisible
characters, and letters of other scripts with the shape of Latin ones.  Case, digits, accents and line ends stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Look-alike letters and the Latin letters they look like.
LOOK_ALIKES = "аеорсухіјѕԁԛԝһАВЕКМНОРСТХІЈЅԌ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ" "‐‑"
LATIN = "aeopcyxijsdqwhABEKMHOPCTXIJSG" "ABEZHIKMNOPTYXoj" "--"
#: Blanks that are no ordinary blank, and characters nobody sees.
BLANKS = "               　"
INVISIBLE = "­͏؜᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ǆ": "dž", "ĳ": "ij", "Ĳ": "IJ", "ŉ": "ʼn"}


def _compatibility() -> tuple[str, str]:
    """One-to-one compatibility forms by rule: width forms and CJK radicals, as far as they have one usual character."""
    src, dst = [], []
    for cp in [*range(0xFF01, 0xFFEF), *range(0x2F00, 0x2FE0), 0x2E9F, 0x2EF3, *range(0xF900, 0xFB00)]:
        ch = chr(cp)
        usual = unicodedata.normalize("NFKC", ch)
        if ch in "ﾞﾟ":  # voicing marks compose with the letter before them
            usual = "゙" if ch == "ﾞ" else "゚"
        if len(usual) == 1 and usual != ch and unicodedata.category(ch) != "Cn" and ch not in "￣":
            src.append(ch)
            dst.append(usual)
    return "".join(src), "".join(dst)


def _composed() -> tuple[str, str]:
    """Look-alike letters under an accent, which normalisation has made one character, and the Latin ones under the same."""
    base = dict(zip(LOOK_ALIKES, LATIN))
    src, dst = [], []
    for cp in range(0x370, 0x530):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) == 2 and d[0] in base and len(usual := unicodedata.normalize("NFC", base[d[0]] + d[1])) == 1:
            src.append(chr(cp))
            dst.append(usual)
    return "".join(src), "".join(dst)


_FROM, _TO = map("".join, zip(_compatibility(), _composed()))
#: Joiners shape letters and emoji sequences; elsewhere nobody sees them.
_JOINERS = r"(^|[\p{Latin}\p{Cyrillic}\p{Greek}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{N}\p{P}\s])[\x{200c}\x{200d}]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(column: str = "text") -> str:
    """The SQL expression of the common form."""
    e = f"nfc_normalize({column})"
    e = f"regexp_replace({e}, '[{INVISIBLE}]', '', 'g')"
    e = f"regexp_replace({e}, {_quoted(_JOINERS)}, '\\1', 'g')"
    for k, v in LIGATURES.items():
        e = f"replace({e}, {_quoted(k)}, {_quoted(v)})"
    e = f"translate({e}, {_quoted(_FROM + BLANKS + LOOK_ALIKES)}, {_quoted(_TO + ' ' * len(BLANKS) + LATIN)})"
    return f"nfc_normalize({e})"


_KEYS = pa.schema([("doc_id", pa.int64()), ("look", pa.string()), ("raw", pa.string())])


def _query(select: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                docs = pa.Table.from_batches([b.slice(at, 2000)])
                con.register("docs", docs)
                out = con.sql(select).to_arrow_table().cast(schema)
                con.unregister("docs")
                yield from out.to_batches()

    return run


def canonical(documents: DataFrame) -> DataFrame:
    """``doc_id, text``: every document in the common form; null stays null, empty stays empty."""
    q = f"SELECT doc_id, {canonical_sql()} AS text FROM docs"
    return documents.select("doc_id", "text").mapInArrow(_query(q, pa.schema([("doc_id", pa.int64()), ("text", pa.string())])), "doc_id bigint, text string")


def keys(documents: DataFrame) -> DataFrame:
    """``doc_id, look, raw``: digests of the common form and of the text itself, for texts with something to see."""
    q = f"SELECT doc_id, md5(form) AS look, md5(text) AS raw FROM (SELECT doc_id, text, {canonical_sql()} AS form FROM docs) WHERE regexp_matches(form, '[^\\s\\p{{C}}\\p{{Z}}\\x{{fe00}}-\\x{{fe0f}}]')"
    return documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_query(q, _KEYS), "doc_id bigint, look string, raw string")


def _kept(documents: DataFrame) -> DataFrame:
    """``keys`` of each document once: their two digests are read by several branches below, the texts only here."""
    return keys(documents).distinct().persist(StorageLevel.MEMORY_AND_DISK)


def _texts(k: DataFrame) -> DataFrame:
    """``look, raw, rep, copies`` of the different texts of looks that several texts share."""
    texts = k.groupBy("look", "raw").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    several = texts.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    return texts.join(several, "look")


def classes(documents: DataFrame) -> DataFrame:
    """``look, variants, docs, first_doc``: one row per look that several different texts share."""
    t = _texts(_kept(documents))
    return t.groupBy("look").agg(F.count("*").alias("variants"), F.sum("copies").alias("docs"), F.min("rep").alias("first_doc"))


def p10_found(documents: DataFrame, salts: int = 8) -> DataFrame:
    """``doc_id_a, doc_id_b``: every document with the representative of each other text that looks like its own.

    Equal texts are one class with the least id for representative, so links between different texts are all there while
    a text copied over a third of the rows gives pairs in proportion to its copies.  The joins are salted by document.
    """
    k = _kept(documents)
    reps = _texts(k).select(F.col("look").alias("_look"), F.col("raw").alias("_raw"), "rep")
    reps = reps.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    d = k.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    p = d.join(reps, (d.look == reps._look) & (d._s == reps._salt) & (d.raw != reps._raw))
    return p.select(F.least("doc_id", "rep").alias("doc_id_a"), F.greatest("doc_id", "rep").alias("doc_id_b")).distinct()
