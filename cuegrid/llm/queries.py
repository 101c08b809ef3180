"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuegrid.llm import abuse, lang, leaks, lookalike, pairs, pii, sentences, tokens, turns
from cuegrid.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.p2_found(table(spark, d, "cues"), table(spark, d, "tracks"))


def p2_layouts(spark: SparkSession, d: str) -> DataFrame:
    return turns.mine_layouts(table(spark, d, "cues"), table(spark, d, "tracks"))


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(table(spark, d, "cues"), table(spark, d, "tracks"), with_words=True)


QUERIES = {"p2_found": p2_found, "p2_layouts": p2_layouts, "p2_turns": p2_turns}
SQL: dict[str, str] = {}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lang.p1_found(table(spark, d, "cues"))


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    return lang.languages(table(spark, d, "cues"))


QUERIES |= {"p1_found": p1_found, "p1_languages": p1_languages}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.p3_found(table(spark, d, "cues"))


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "cues"))


QUERIES |= {"p3_found": p3_found, "p3_sentences": p3_sentences}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.p4_found(table(spark, d, "cues"), table(spark, d, "name_parts"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "cues"), table(spark, d, "name_parts"))


def p4_disclosure(spark: SparkSession, d: str) -> DataFrame:
    return pii.disclosure(table(spark, d, "cues"), table(spark, d, "name_parts")).select("term", "n", "given_share", "family_share", "given_bits", "family_bits", "thing_share", "number_n")


QUERIES |= {"p4_found": p4_found, "p4_redacted": p4_redacted, "p4_disclosure": p4_disclosure}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.p5_found(table(spark, d, "cues"))


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "cues"), table(spark, d, "entries"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "cues"), table(spark, d, "recordings"))


QUERIES |= {"p5_found": p5_found, "p5_scores": p5_scores, "p5_rates": p5_rates}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.p7_found(table(spark, d, "translations"), table(spark, d, "cues"))


QUERIES |= {"p7_found": p7_found}


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    return tokens.lengths(table(spark, d, "documents"))


QUERIES |= {"p8_ids": p8_ids, "p8_lengths": p8_lengths}


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.p9_found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    return leaks.coverage(table(spark, d, "documents"), table(spark, d, "eval_items"))


QUERIES |= {"p9_found": p9_found, "p9_items": p9_items, "p9_coverage": p9_coverage}


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.p10_found(table(spark, d, "documents"))


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.classes(table(spark, d, "documents"))


QUERIES |= {"p10_found": p10_found, "p10_canonical": p10_canonical, "p10_classes": p10_classes}

_FORM = f"SELECT doc_id, text, {lookalike.canonical_sql()} AS form FROM documents"
SQL["p10_canonical"] = f"SELECT doc_id, form AS text FROM ({_FORM})"
SQL["p10_found"] = f"""WITH k AS (SELECT DISTINCT doc_id, form, text FROM ({_FORM}) WHERE text IS NOT NULL AND doc_id IS NOT NULL AND regexp_matches(form, '[^\\s\\p{{C}}\\p{{Z}}\\x{{fe00}}-\\x{{fe0f}}]')),
    t AS (SELECT form, text, min(doc_id) AS rep FROM k GROUP BY 1, 2) SELECT DISTINCT least(doc_id, rep) AS doc_id_a, greatest(doc_id, rep) AS doc_id_b FROM k JOIN t ON t.form = k.form AND t.text <> k.text"""
