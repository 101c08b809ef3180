"""Operator inputs made of the star-schema tables, in Spark and, for the oracle, as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.session import table

PHRASES = ["我觉得我觉得很好", "的老大的老大的", "你你说就是就是这样", "一九年和三四年", "二零二五年卧槽", "九八年九九年", "，今天用GPT写3年？", "呃嗯好啊啊啊对吧。", "十九八年一五一九年", "然后然后看看Spark。"]


def event_cues(spark: SparkSession, d: str, speakers: int = 2) -> DataFrame:
    """One cue per event; a day is a recording, compressed sixty to one."""
    e = table(spark, d, "events")
    us = "unix_micros(CAST(ts AS TIMESTAMP)) DIV 60000 - unix_micros(CAST(date(ts) AS TIMESTAMP)) DIV 60000"
    return e.select(
        F.expr("CAST(date(ts) AS STRING)").alias("rec_id"), F.col("event_id").alias("cue_id"), F.expr(f"CAST({us} AS DOUBLE)").alias("start_ms"),
        F.expr(f"CAST({us} + greatest(1L, CAST(floor(value * 60) AS BIGINT)) AS DOUBLE)").alias("end_ms"), F.expr(f"concat('spk', user_id % {speakers} + 1)").alias("speaker"), F.concat(F.lit("line "), F.col("event_id").cast("string")).alias("text"), "event_type",
    )


def EV(speakers: int = 2) -> str:
    us = "epoch_us(ts) // 60000 - epoch_us(date_trunc('day', ts)) // 60000"
    return f"""c AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS rec_id, event_id AS cue_id, CAST({us} AS DOUBLE) AS start_ms,
        CAST({us} + greatest(1, CAST(floor(value * 60) AS BIGINT)) AS DOUBLE) AS end_ms, concat('spk', user_id % {speakers} + 1) AS speaker, concat('line ', event_id) AS text, event_type FROM events)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("track_id"), F.expr("vec_id DIV 4").alias("group_id"), F.posexplode("embedding").alias("frame_no", "x")).select("track_id", "group_id", "frame_no", F.expr("CAST(x AS DOUBLE) * 40 - 45").alias("db"))


FR = "f AS (SELECT vec_id AS track_id, vec_id // 4 AS group_id, CAST(i - 1 AS INT) AS frame_no, CAST(embedding[i] AS DOUBLE) * 40 - 45 AS db FROM embeddings, generate_series(1, len(embedding)) t(i))"


def zh_text(spark: SparkSession, d: str) -> DataFrame:
    arr = F.array(*[F.lit(p) for p in PHRASES])
    return table(spark, d, "events").select(F.col("event_id").alias("cue_id"), F.element_at(arr, (F.col("event_id") % len(PHRASES) + 1).cast("int")).alias("text"), F.expr("CASE WHEN event_id % 7 = 0 THEN 'en' ELSE 'zh' END").alias("language"))


ZH = "z AS (SELECT event_id AS cue_id, [" + ", ".join("'" + p + "'" for p in PHRASES) + f"][event_id % {len(PHRASES)} + 1] AS text, CASE WHEN event_id % 7 = 0 THEN 'en' ELSE 'zh' END AS language FROM events)"


def ranges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.expr("CAST(date(ts) AS STRING)").alias("rec_id"), F.expr("event_id * 2 + user_id % 7").alias("cue"), F.expr("event_id * 2 + user_id % 7 + user_id % 4").alias("cue_end"), F.col("event_type").alias("category"), F.expr("CAST(floor(value) AS BIGINT) % 3").alias("severity"))


RANGES = "r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS rec_id, event_id * 2 + user_id % 7 AS cue, event_id * 2 + user_id % 7 + user_id % 4 AS cue_end, event_type AS category, CAST(floor(value) AS BIGINT) % 3 AS severity FROM events)"


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = event_cues(spark, d).select("rec_id", F.col("cue_id").alias("pos"), F.concat(F.col("start_ms").cast("bigint").cast("string"), F.lit(">"), F.col("end_ms").cast("bigint").cast("string")).alias("stamp"), "text")
    after = c.where("pos % 37 <> 0").withColumn("text", F.expr("CASE WHEN pos % 29 = 0 THEN concat(text, ' and quite a lot more') WHEN pos % 11 = 0 THEN concat(text, '!') ELSE text END"))
    return c, after


VERSIONS = EV() + """, b AS (SELECT rec_id, cue_id AS pos, concat(CAST(CAST(start_ms AS BIGINT) AS VARCHAR), '>', CAST(CAST(end_ms AS BIGINT) AS VARCHAR)) AS stamp, text FROM c),
    a AS (SELECT rec_id, pos, stamp, CASE WHEN pos % 29 = 0 THEN concat(text, ' and quite a lot more') WHEN pos % 11 = 0 THEN concat(text, '!') ELSE text END AS text FROM b WHERE pos % 37 <> 0)"""


def hard_cues(spark: SparkSession, d: str) -> DataFrame:
    """The event cues with null speakers, cues longer than any limit, and a language."""
    c = event_cues(spark, d, 3)
    return c.withColumns({"speaker": F.expr("CASE WHEN cue_id % 17 <> 0 THEN speaker END"), "end_ms": F.expr("CASE WHEN cue_id % 40 = 0 THEN end_ms + 55000 ELSE end_ms END"), "language": F.expr("CASE WHEN cue_id % 5 = 0 THEN 'en' ELSE 'zh' END")})


HARD = EV(3).replace("c AS (", "c0 AS (", 1) + """, c AS (SELECT rec_id, cue_id, start_ms, CASE WHEN cue_id % 40 = 0 THEN end_ms + 55000 ELSE end_ms END AS end_ms, CASE WHEN cue_id % 17 <> 0 THEN speaker END AS speaker, text, event_type,
    CASE WHEN cue_id % 5 = 0 THEN 'en' ELSE 'zh' END AS language FROM c0)"""


def marks(spark: SparkSession, d: str) -> DataFrame:
    """Review items on the ordinals of the event cues, with empty reasons, repeated actions and an unknown severity."""
    return table(spark, d, "events").select(
        F.expr("CAST(date(ts) AS STRING)").alias("rec_id"), F.col("event_id").alias("item_no"), F.expr("event_id % 300").alias("cue"), F.expr("event_id % 300 + user_id % 3").alias("cue_end"),
        F.col("event_type").alias("category"), F.expr("element_at(array('高', '中', '低', '?'), CAST(CAST(floor(value) AS BIGINT) % 4 + 1 AS INT))").alias("severity"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('r', event_id % 4) END").alias("reason"), F.expr("concat('a', event_id % 2)").alias("action"),
    ).where("item_no % 7 < 2")


MARKS = """r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS rec_id, event_id AS item_no, event_id % 300 AS cue, event_id % 300 + user_id % 3 AS cue_end, event_type AS category,
    ['高', '中', '低', '?'][CAST(floor(value) AS BIGINT) % 4 + 1] AS severity, CAST(floor(value) AS BIGINT) % 4 AS rank0, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('r', event_id % 4) END AS reason, concat('a', event_id % 2) AS action
    FROM events WHERE event_id % 7 < 2)"""


def versions_hard(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions: rows gone, texts longer or only spaced anew, a stamp made up, and in some recordings the order turned or the text much longer."""
    b, _ = versions(spark, d)
    day = "CAST(substring(rec_id, 9, 2) AS INT)"
    a = b.where(f"NOT (pos % 37 = 0 AND {day} % 2 = 0)").withColumns({
        "text": F.expr(f"CASE WHEN pos % 29 = 0 AND {day} % 3 = 0 THEN concat(text, ' and quite a lot more') WHEN pos % 11 = 0 THEN concat(text, '!') WHEN pos % 13 = 0 THEN concat(' ', text) ELSE text END"),
        "stamp": F.expr(f"CASE WHEN pos % 41 = 0 AND {day} % 5 = 0 THEN concat('x', stamp) ELSE stamp END"), "pos": F.expr(f"CASE WHEN {day} % 7 = 0 THEN -pos ELSE pos END"),
    })
    return b, a


VERSIONS_HARD = EV() + """, b AS (SELECT rec_id, cue_id AS pos, concat(CAST(CAST(start_ms AS BIGINT) AS VARCHAR), '>', CAST(CAST(end_ms AS BIGINT) AS VARCHAR)) AS stamp, text, CAST(rec_id[9:10] AS INT) AS dd FROM c),
    a AS (SELECT rec_id, CASE WHEN dd % 7 = 0 THEN -pos ELSE pos END AS pos, CASE WHEN pos % 41 = 0 AND dd % 5 = 0 THEN concat('x', stamp) ELSE stamp END AS stamp,
    CASE WHEN pos % 29 = 0 AND dd % 3 = 0 THEN concat(text, ' and quite a lot more') WHEN pos % 11 = 0 THEN concat(text, '!') WHEN pos % 13 = 0 THEN concat(' ', text) ELSE text END AS text FROM b WHERE NOT (pos % 37 = 0 AND dd % 2 = 0))"""

