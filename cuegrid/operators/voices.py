"""Who speaks: from the names and labels of a recording's tracks to the speaker at the end of their merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The same spellings as ``functions.lines.label_key``, as a JVM-side expression.
_SPK = r"^(?:spk|speaker|说话人|話者|화자|спикер|locuteur|sprecher)[ _]*0*([0-9]+)$"


def alias_key(c: Column) -> Column:
    """Normal form of a speaker spelling; null stays null, blank becomes null."""
    s = F.lower(F.regexp_replace(c, r"^[\s\u00a0\u200b\u3000\ufeff]+|[\s\u00a0\u200b\u3000\ufeff]+$", ""))
    return F.when(s == "", None).when(s.rlike(_SPK), F.concat(F.lit("spk"), F.regexp_extract(s, _SPK, 1))).otherwise(s)


def voice_map(tracks: DataFrame) -> DataFrame:
    """One row per recording: ``rec_id, voices map<alias, speaker>, sole int``.

    ``merged_into`` is followed to its end (as many steps as the recording has tracks, so a cycle ends somewhere on it).
    An alias that leads to two speakers names nobody.  ``sole`` is the only speaker all tracks lead to, if there is one.
    Repeated rows, null speakers and tracks without names are harmless.
    """
    t = tracks.select("rec_id", "speaker", "label", "merged_into", "display_name").where("speaker IS NOT NULL AND rec_id IS NOT NULL")
    per = t.groupBy("rec_id").agg(
        F.collect_set(F.struct("speaker", "label", "display_name")).alias("ts"),
        F.map_from_entries(F.array_distinct(F.expr("transform(array_distinct(collect_list(speaker)), s -> struct(s, s))"))).alias("ids"),
        F.collect_set(F.when(F.col("merged_into").isNotNull(), F.struct("speaker", "merged_into"))).alias("ms"),
    )
    per = per.withColumn("m", F.expr("map_from_entries(transform(array_distinct(ms.speaker), k -> struct(k, array_min(filter(ms, x -> x.speaker = k).merged_into))))"))
    per = per.withColumn(
        "ends",
        F.expr("transform(ts, t -> struct(t.speaker AS speaker, t.label AS label, t.display_name AS display_name, aggregate(sequence(1, size(ts)), t.speaker, (c, i) -> coalesce(m[c], c)) AS root))"),
    )
    per = per.withColumn(
        "pairs",
        F.array_distinct(
            F.expr(
                "flatten(transform(ends, e -> filter(array("
                "struct(concat('spk', cast(e.speaker + 1 AS string)) AS k, e.root AS r),"
                "struct(lower(trim(e.label)) AS k, e.root AS r),"
                "struct(lower(trim(e.display_name)) AS k, e.root AS r)), p -> p.k IS NOT NULL AND p.k <> '')))"
            )
        ),
    )
    per = per.withColumn("keys", F.expr("filter(array_distinct(pairs.k), k -> size(array_distinct(filter(pairs, p -> p.k = k).r)) = 1)"))
    return per.select(
        "rec_id",
        F.expr("map_from_entries(transform(keys, k -> struct(k, filter(pairs, p -> p.k = k)[0].r)))").alias("voices"),
        F.expr("CASE WHEN size(array_distinct(ends.root)) = 1 THEN ends[0].root END").alias("sole"),
    )


def with_voices(rows: DataFrame, tracks: DataFrame, salts: int = 8, on: str = "cue_id") -> DataFrame:
    """Join every row to its recording's voice map (left), whatever share of the rows one recording holds.

    The map side has one row per recording; it is repeated ``salts`` times and the row side salted by ``on``, so no task
    gets more than ``1/salts`` of a hot recording.  It is never broadcast: it grows with the recordings.
    """
    v = voice_map(tracks).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("rec_id", "_rec")
    r = rows.withColumn("_salt_row", F.pmod(F.xxhash64(on), F.lit(salts)).cast("int"))
    return r.join(v.hint("merge"), (r.rec_id == v._rec) & (r._salt_row == v._salt), "left").drop("_salt_row", "_salt", "_rec")


def speaker_of(label: Column, column: Column) -> Column:
    """Speaker named by the label, else by the column, else the sole one; needs ``voices`` and ``sole``."""
    return F.coalesce(F.expr("voices")[label], F.expr("voices")[column], F.col("sole"))
