"""Queries of the core's training-data problem (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuegrid.operators.intervals import speaker_periods
from cuegrid.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return speaker_periods(table(spark, d, "cues"), table(spark, d, "tracks"))


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
