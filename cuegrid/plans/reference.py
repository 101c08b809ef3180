"""Queries of the timed-text operators and their SQL for the oracle (written apart where the engines allow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.functions import rules, text
from cuegrid.functions.segmenting import Terms
from cuegrid.operators import align, cluster, diff, frames, highlights, matching, review, segment, tasks, timeline, tree
from cuegrid.plans.views import EV, FR, HARD, MARKS, VERSIONS, VERSIONS_HARD, ZH, event_cues, hard_cues, marks, versions, versions_hard, zh_text
from cuegrid.plans.views import frames as frame_view
from cuegrid.session import table
from cuegrid.sources import subtitles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


W = "OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms, cue_id)"
CROSS = "(speaker <> '' AND nsp <> '' AND speaker <> nsp AND least({e}, ne) - greatest(start_ms, ns) >= 200)"
LEAD = f"l AS (SELECT *, lead(start_ms) {W} AS ns, lead(end_ms) {W} AS ne, lead(speaker) {W} AS nsp, least(end_ms, start_ms + 6000) AS e1 FROM c)"
T1 = f"""{EV()}, {LEAD}, t1 AS (SELECT rec_id, cue_id, start_ms, speaker, text, CASE WHEN ns IS NULL THEN greatest(e1, start_ms + 1000) WHEN {CROSS.format(e='e1')} THEN e1
    ELSE least(greatest(e1, least(start_ms + 1000, ns - 40)), greatest(ns - 40, start_ms + 1)) END AS end_ms FROM l)"""


@query("t1_normalize_timeline", f"WITH {T1} SELECT rec_id, cue_id, start_ms, end_ms FROM t1")
def t1(s: SparkSession, d: str) -> DataFrame:
    return timeline.normalize_timeline(event_cues(s, d)).select("rec_id", "cue_id", "start_ms", "end_ms")


@query(
    "t2_merge_overlaps",
    f"""WITH {T1}, l2 AS (SELECT *, lead(start_ms) {W} AS ns, lead(end_ms) {W} AS ne, lead(speaker) {W} AS nsp, row_number() {W} AS rn FROM t1),
    m AS (SELECT *, coalesce({CROSS.format(e='end_ms')} AND greatest(end_ms, ne) - start_ms <= 6000, false) AS f FROM l2),
    g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY rn) AS grp FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY rec_id, grp, f ORDER BY rn) AS k FROM g),
    o AS (SELECT *, f AND k % 2 = 1 AS opens FROM p), q AS (SELECT *, coalesce(lag(opens) OVER (PARTITION BY rec_id ORDER BY rn), false) AS gone FROM o),
    x AS (SELECT rec_id, cue_id, start_ms, CASE WHEN opens THEN greatest(end_ms, ne) ELSE end_ms END AS e, CASE WHEN opens THEN NULL ELSE speaker END AS speaker, opens AS merged, rn FROM q WHERE NOT gone),
    y AS (SELECT *, lead(start_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, rn) AS n2 FROM x)
    SELECT rec_id, cue_id, start_ms, CASE WHEN n2 IS NULL THEN e ELSE least(e, greatest(n2 - 40, start_ms + 1)) END AS end_ms, speaker, merged FROM y""",
)
def t2(s, d):
    return timeline.merge_speaker_overlaps(timeline.normalize_timeline(event_cues(s, d))).select("rec_id", "cue_id", "start_ms", "end_ms", "speaker", "merged")


T3 = f"""{HARD}, o AS (SELECT *, row_number() {W} AS rn FROM c),
    w AS (SELECT rec_id, rn, cue_id, speaker, start_ms, end_ms, start_ms AS f, end_ms AS m, 1 AS cl FROM o WHERE rn = 1
      UNION ALL SELECT o.rec_id, o.rn, o.cue_id, o.speaker, o.start_ms, o.end_ms, CASE WHEN o.start_ms - w.m > 800 OR o.end_ms - w.f > 40000 THEN o.start_ms ELSE w.f END,
      CASE WHEN o.start_ms - w.m > 800 OR o.end_ms - w.f > 40000 THEN o.end_ms ELSE greatest(w.m, o.end_ms) END, w.cl + CASE WHEN o.start_ms - w.m > 800 OR o.end_ms - w.f > 40000 THEN 1 ELSE 0 END
      FROM w JOIN o ON o.rec_id = w.rec_id AND o.rn = w.rn + 1)"""
MANY = "count(DISTINCT coalesce(speaker, '?'))"


@query("t3_crosstalk_clusters", f"WITH RECURSIVE {T3} SELECT rec_id, arg_min(cue_id, rn) AS first_cue, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, {MANY} AS speakers FROM w GROUP BY rec_id, cl HAVING {MANY} > 1")
def t3(s, d):
    return cluster.crosstalk_clusters(hard_cues(s, d))


@query("t3_cluster_members", f"WITH RECURSIVE {T3}, g AS (SELECT rec_id, cl, arg_min(cue_id, rn) AS first_cue FROM w GROUP BY rec_id, cl HAVING {MANY} > 1) SELECT w.rec_id, cue_id, first_cue FROM w JOIN g ON g.rec_id = w.rec_id AND g.cl = w.cl")
def t3m(s, d):
    return cluster.cluster_members(hard_cues(s, d))


MERGED = f"""{MARKS}, i AS (SELECT *, CASE severity WHEN '高' THEN 0 WHEN '中' THEN 1 WHEN '低' THEN 2 ELSE 9 END AS rank, row_number() OVER (PARTITION BY rec_id ORDER BY cue, cue_end, item_no) AS k,
      max(cue_end) OVER (PARTITION BY rec_id ORDER BY cue, cue_end, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR cue > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM i),
    t AS (SELECT rec_id, g, category, min(rank) AS rank, arg_min(severity, rank * 1000000 + k) AS severity, min(k) AS k FROM g GROUP BY 1, 2, 3),
    rs AS (SELECT rec_id, g, reason AS v, min(k) AS k FROM g WHERE reason <> '' GROUP BY 1, 2, 3), ac AS (SELECT rec_id, g, action AS v, min(k) AS k FROM g WHERE action <> '' GROUP BY 1, 2, 3),
    m AS (SELECT rec_id, g, min(cue) AS cue, max(cue_end) AS cue_end FROM g GROUP BY 1, 2),
    e AS (SELECT m.*, (SELECT string_agg(concat(category, '·', severity), '｜' ORDER BY rank, k) FROM t WHERE t.rec_id = m.rec_id AND t.g = m.g) AS label, (SELECT arg_min(severity, rank * 1000000 + k) FROM t WHERE t.rec_id = m.rec_id AND t.g = m.g) AS top_severity,
      (SELECT string_agg(category, ',' ORDER BY category) FROM t WHERE t.rec_id = m.rec_id AND t.g = m.g) AS categories, (SELECT string_agg(v, '；' ORDER BY k) FROM rs WHERE rs.rec_id = m.rec_id AND rs.g = m.g) AS reason, (SELECT string_agg(v, ' / ' ORDER BY k) FROM ac WHERE ac.rec_id = m.rec_id AND ac.g = m.g) AS action FROM m),
    n AS (SELECT *, row_number() {W} - 1 AS ordinal FROM cc), x AS (SELECT e.rec_id, e.cue, arg_min(n.start_ms, ordinal) AS start_ms, arg_max(n.end_ms, ordinal) AS end_ms, string_agg(n.text, ' ' ORDER BY ordinal) AS body FROM e JOIN n ON n.rec_id = e.rec_id AND n.ordinal BETWEEN e.cue AND e.cue_end GROUP BY 1, 2),
    z AS (SELECT e.rec_id, e.cue, e.cue_end, start_ms, end_ms, '【' || label || '】' || body AS text, body, label, top_severity, categories, coalesce(reason, '-') AS reason, coalesce(action, '自行判断') AS action FROM e JOIN x ON x.rec_id = e.rec_id AND x.cue = e.cue)"""
CC = EV().replace("c AS (", "cc AS (", 1)


def _ordinals(s, d):
    return event_cues(s, d).withColumn("ordinal", F.row_number().over(timeline._w()) - 1)


@query("t4_merge_ranges", f"WITH {CC}, {MERGED} SELECT rec_id, cue, cue_end, (SELECT count(*) FROM t WHERE t.rec_id = m.rec_id AND t.g = m.g) AS tags, (SELECT string_agg(concat(category, ':', severity), ',' ORDER BY k) FROM t WHERE t.rec_id = m.rec_id AND t.g = m.g) AS label FROM m")
def t4(s, d):
    m = review.merge_ranges(marks(s, d))
    return m.select("rec_id", "cue", "cue_end", F.size("tags").cast("bigint").alias("tags"), F.expr("array_join(transform(tags, t -> concat(t.category, ':', t.severity)), ',')").alias("label"))


@query("a9_entries", f"WITH {CC}, {MERGED} SELECT * FROM z")
def a9(s, d):
    return review.build_entries(review.merge_ranges(marks(s, d)), _ordinals(s, d)).withColumn("categories", F.array_join("categories", ","))


SHORT = "lpad(CAST(CAST(floor({0} / 1000) AS BIGINT) // 60 AS VARCHAR), greatest(2, length(CAST(CAST(floor({0} / 1000) AS BIGINT) // 60 AS VARCHAR))::INT), '0') || ':' || lpad(CAST(CAST(floor({0} / 1000) AS BIGINT) % 60 AS VARCHAR), 2, '0')"


@query("s15_review_report", f"""WITH {CC}, {MERGED}, y AS (SELECT *, '| ' || {SHORT.format('start_ms')} || ' - ' || {SHORT.format('end_ms')} || ' | ' || label || ' | ' || replace(body, '|', '/') || ' | ' || replace(reason, '|', '/') || ' | ' || action || ' |' AS row FROM z),
    h AS (SELECT rec_id, count(*) AS hits, count(*) FILTER (top_severity = '高') AS high, count(*) FILTER (top_severity = '中') AS medium, count(*) FILTER (top_severity = '低') AS low, string_agg(row, chr(10) ORDER BY cue) AS tab FROM y GROUP BY 1), k AS (SELECT rec_id, count(*) AS total FROM cc GROUP BY 1)
    SELECT k.rec_id, total, coalesce(hits, 0) AS hits, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(tab, '| - | - | 未发现风险片段 | - | - |') AS "table" FROM k LEFT JOIN h ON h.rec_id = k.rec_id""")
def s15(s, d):
    return review.review_report(review.build_entries(review.merge_ranges(marks(s, d)), _ordinals(s, d)), event_cues(s, d))


@query("p12_hit_ratio", f"WITH {CC}, {MERGED}, k AS (SELECT rec_id, count(*) AS n FROM cc GROUP BY 1), f AS (SELECT rec_id, sum(cue_end - cue + 1) AS f FROM m GROUP BY 1) SELECT k.rec_id, CAST(coalesce(f, 0) AS BIGINT) AS flagged, round(coalesce(f, 0) / n, 9) AS ratio, coalesce(f, 0) / n > 0.3 AS suspicious FROM k LEFT JOIN f ON f.rec_id = k.rec_id")
def p12(s, d):
    return review.hit_ratio(review.merge_ranges(marks(s, d)), event_cues(s, d)).withColumn("ratio", F.round("ratio", 9))


@query(
    "t5_batches",
    f"""WITH RECURSIVE {EV()}, o AS (SELECT rec_id, cue_id, length(text) AS k, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, cue_id) AS rn FROM c),
    w AS (SELECT rec_id, rn, cue_id, 1 AS n, k AS size, 0 AS batch FROM o WHERE rn = 1
      UNION ALL SELECT o.rec_id, o.rn, o.cue_id, CASE WHEN w.n >= 3 OR w.size + o.k > 900 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 3 OR w.size + o.k > 900 THEN o.k ELSE w.size + o.k END, w.batch + CASE WHEN w.n >= 3 OR w.size + o.k > 900 THEN 1 ELSE 0 END
      FROM w JOIN o ON o.rec_id = w.rec_id AND o.rn = w.rn + 1) SELECT rec_id, cue_id, CAST(batch AS BIGINT) AS batch FROM w""",
)
def t5(s, d):
    return cluster.batches(event_cues(s, d), 3, 900)


def _items(s, d):
    c = event_cues(s, d)
    kind, text = "CASE WHEN event_type = 'signup' THEN 'chapter' ELSE 'highlight' END", "CASE WHEN cue_id % 4 = 0 THEN '' ELSE concat('Tip ', cue_id % 400, '!') END"
    c = c.select("rec_id", "cue_id", "start_ms", F.expr(kind).alias("kind"), F.expr(text).alias("text"), F.max("end_ms").over(timeline.Window.partitionBy("rec_id")).alias("last_end"))
    return c.withColumn("key", highlights.label_key(F.col("text")))


ITEMS = f"""{EV()}, i AS (SELECT rec_id, cue_id, start_ms, CASE WHEN event_type = 'signup' THEN 'chapter' ELSE 'highlight' END AS kind, CASE WHEN cue_id % 4 = 0 THEN '' ELSE concat('Tip ', cue_id % 400, '!') END AS text,
    CASE WHEN cue_id % 4 = 0 THEN '' ELSE concat('Tip', cue_id % 400) END AS key, max(end_ms) OVER (PARTITION BY rec_id) AS last_end FROM c)"""


@query(
    "t6_highlight_dedupe",
    f"""WITH RECURSIVE {ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, cue_id) AS rn FROM i),
    w AS (SELECT rec_id, rn, cue_id AS cur, start_ms AS t, kind AS k, key AS ck, [key] AS seen, CAST(NULL AS BIGINT) AS out_id, CAST(NULL AS VARCHAR) AS out_kind FROM o WHERE rn = 1
      UNION ALL SELECT rec_id, rn, CASE WHEN take THEN cue_id ELSE cur END, CASE WHEN take THEN start_ms ELSE t END, CASE WHEN take THEN kind ELSE k END, CASE WHEN take THEN key ELSE ck END,
        CASE WHEN take AND near THEN list_append(list_filter(seen, lambda z: z <> ck), key) WHEN take THEN list_append(seen, key) ELSE seen END, CASE WHEN take AND NOT near THEN cur END, CASE WHEN take AND NOT near THEN k END
        FROM (SELECT w.rec_id, o.rn, w.cur, w.t, w.k, w.ck, w.seen, o.cue_id, o.start_ms, o.kind, o.key, o.start_ms - w.t < 8000 AS near,
          NOT (o.key <> '' AND list_contains(w.seen, o.key)) AND (o.start_ms - w.t >= 8000 OR (o.kind = 'chapter' AND w.k <> 'chapter')) AS take FROM w JOIN o ON o.rec_id = w.rec_id AND o.rn = w.rn + 1))
    SELECT rec_id, out_id AS cue_id, out_kind AS kind FROM w WHERE out_id IS NOT NULL UNION ALL SELECT rec_id, arg_max(cur, rn), arg_max(k, rn) FROM w GROUP BY rec_id""",
)
def t6(s, d):
    return highlights.dedupe(_items(s, d))


@query(
    "t7_assign_timeline",
    f"""WITH {ITEMS}, j AS (SELECT *, lead(start_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, cue_id) AS ns, count(*) FILTER (kind = 'chapter') OVER (PARTITION BY rec_id ORDER BY start_ms, cue_id) AS no FROM i)
    SELECT rec_id, cue_id, kind, start_ms, greatest(least(start_ms + CASE WHEN kind = 'chapter' THEN 3500 ELSE 2600 END, coalesce(ns - 100, last_end), last_end), start_ms + 1200) AS end_ms,
    no AS chapter_no, CASE WHEN kind = 'chapter' THEN concat('【', no, '】', text) ELSE text END AS label FROM j""",
)
def t7(s, d):
    return highlights.assign_timeline(_items(s, d))


@query("t8_rule_chapters", f"WITH {EV()} SELECT rec_id, cue_id, start_ms FROM (SELECT *, lag(end_ms) {W} AS p FROM c) WHERE start_ms - p >= 20000")
def t8(s, d):
    return highlights.rule_chapters(event_cues(s, d)).select("rec_id", "cue_id", "start_ms")


@query("t12_moving_average", f"WITH {FR} SELECT track_id, frame_no, round(sum(db) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10.0, 6) AS smooth FROM f")
def t12(s, d):
    return frames.moving_average(frame_view(s, d), 10).select("track_id", "frame_no", F.round("smooth", 6).alias("smooth"))


@query("t13_dilate", f"WITH {FR} SELECT track_id, frame_no, max(CASE WHEN db > -40 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS dilated FROM f")
def t13(s, d):
    f = frame_view(s, d).withColumn("mask", F.expr("CASE WHEN db > -40 THEN 1 ELSE 0 END"))
    return frames.dilate(f, 3).select("track_id", "frame_no", "dilated")


SMOOTH = "sum(db) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN {0} PRECEDING AND {1} FOLLOWING) / {2}.0"


@query(
    "t14_gate",
    f"""WITH {FR}, s AS (SELECT *, {SMOOTH.format(5, 4, 10)} AS v FROM f), g AS (SELECT a.group_id, a.track_id, a.frame_no, CASE WHEN a.v - coalesce(max(b.v), -90.0) > -2 THEN 1 ELSE 0 END AS mask FROM s a LEFT JOIN s b ON a.group_id = b.group_id AND a.frame_no = b.frame_no AND a.track_id <> b.track_id GROUP BY a.group_id, a.track_id, a.frame_no, a.v)
    SELECT group_id, track_id, frame_no, mask, max(mask) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS dilated FROM g""",
)
def t14(s, d):
    return frames.gate(frame_view(s, d))


def _two(s, d):
    """Power frames of the first two tracks of each group."""
    return frame_view(s, d).where("track_id % 4 < 2").withColumn("p", F.expr("pow(10, db / 10)"))


@query(
    "t14_separate",
    f"""WITH {FR}, q AS (SELECT *, pow(10, db / 10) AS p FROM f WHERE track_id % 4 < 2), s AS (SELECT *, greatest(10 * log10(sum(p) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 + 1e-12), -90) AS v FROM q),
    g AS (SELECT a.group_id, a.track_id, a.frame_no, CASE WHEN coalesce(a.v - b.v > -2, true) THEN 1 ELSE 0 END AS m FROM s a LEFT JOIN s b ON a.group_id = b.group_id AND a.frame_no = b.frame_no AND a.track_id <> b.track_id),
    e AS (SELECT group_id, track_id, frame_no, max(m) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS dilated FROM g)
    SELECT *, round(sum(dilated) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0, 6) AS gain FROM e""",
)
def t14s(s, d):
    return frames.separate(_two(s, d)).withColumn("gain", F.round("gain", 6))


SAMPLES = "x AS (SELECT vec_id AS track_id, CAST(i - 1 AS INT) AS sample_no, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, generate_series(1, len(embedding)) t(i))"


def _samples(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("track_id"), F.posexplode("embedding").alias("sample_no", "v")).select("track_id", "sample_no", F.col("v").cast("double").alias("x"))


@query("a7_levels", f"WITH {SAMPLES} SELECT track_id, CAST(sample_no // 10 AS INT) AS frame_no, round(greatest(10 * log10(avg(x * x) + 1e-12), -90), 6) AS db FROM x GROUP BY 1, 2 HAVING count(*) = 10")
def a7(s, d):
    return frames.levels(_samples(s, d), 10).withColumn("db", F.round("db", 6))


@query("t15_apply_gate", f"""WITH {SAMPLES}, n AS (SELECT track_id, count(*) AS n FROM x GROUP BY 1), g AS (SELECT track_id, CAST(i AS INT) AS frame_no, CASE WHEN i + track_id % 3 - 1 BETWEEN 0 AND 5 AND (i + track_id % 3 - 1) % 3 < 2 THEN 1.0 ELSE 0.0 END AS o FROM n, generate_series(0, n // 10) t(i)),
    h AS (SELECT track_id, frame_no, sum(o) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0 AS gain FROM g) SELECT x.track_id, sample_no, round(x * gain, 9) AS x FROM x JOIN h ON h.track_id = x.track_id AND h.frame_no = sample_no // 10""")
def t15(s, d):
    x = _samples(s, d)
    tr = x.select("track_id").distinct()
    mask = tr.withColumn("frame_no", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("dilated", F.expr("CASE WHEN frame_no % 3 < 2 THEN 1 ELSE 0 END"))
    return frames.apply_gate(x, mask, tr.withColumn("offset_ms", F.expr("CAST(track_id % 3 - 1 AS DOUBLE) * 10")), 10).withColumn("x", F.round("x", 9))


@query("t16_place", f"WITH {FR}, t AS (SELECT DISTINCT track_id, CAST(track_id % 5 - 2 AS INT) AS k FROM f) SELECT t.track_id, CAST(i AS INT) AS frame_no, coalesce(db, -90.0) AS db FROM t CROSS JOIN generate_series(0, 69) g(i) LEFT JOIN f ON f.track_id = t.track_id AND f.frame_no + k = i")
def t16p(s, d):
    f = frame_view(s, d)
    return frames.place_on_timeline(f, f.select("track_id").distinct().withColumn("offset_ms", F.expr("CAST(track_id % 5 - 2 AS DOUBLE) * 10")), 70)


@query("t16_shift", f"WITH {EV()} SELECT rec_id, cue_id, round(start_ms * 1.001 + 5000, 3) AS start_ms, round(end_ms * 1.001 + 5000, 3) AS end_ms FROM c")
def t16(s, d):
    return timeline.shift(event_cues(s, d), 1.001, 5000).select("rec_id", "cue_id", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"))


def _media(s, d):
    o = table(s, d, "orders")
    return o.select(F.expr("CAST(o_custkey % 500 AS STRING)").alias("folder"), F.col("o_orderkey").cast("string").alias("path"), F.expr("CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END").alias("created"), F.expr("timestampadd(DAY, CAST(o_orderkey % 400 AS INT), TIMESTAMP_NTZ '2020-01-01 00:00:00')").alias("birth"), F.expr("floor(o_totalprice)").cast("double").alias("duration_ms"))


MEDIA = """m AS (SELECT CAST(o_custkey % 500 AS VARCHAR) AS folder, CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS created,
    TIMESTAMP '2020-01-01' + INTERVAL (o_orderkey % 400) DAY AS birth, CAST(floor(o_totalprice) AS DOUBLE) AS duration_ms FROM orders),
    n AS (SELECT *, bool_and(created IS NOT NULL) OVER (PARTITION BY folder) AS every FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN every THEN created ELSE birth END, path) AS position FROM n)"""


@query("o1_sort_media", f"WITH {MEDIA} SELECT folder, path, CAST(position AS INT) AS position FROM p")
def o1(s, d):
    return timeline.sort_media(_media(s, d)).select("folder", "path", "position")


@query("t17_offsets", f"WITH {MEDIA} SELECT folder AS rec_id, path, coalesce(sum(duration_ms) OVER (PARTITION BY folder ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS offset_ms FROM p")
def t17(s, d):
    return timeline.layout_offsets(timeline.sort_media(_media(s, d)).withColumn("rec_id", F.col("folder"))).select("rec_id", "path", "offset_ms")


@query("t18_relabel", "SELECT rec_id, track_no, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY track_no) - 1 AS INT) AS new_speaker FROM (SELECT DISTINCT rec_id, track_no FROM tracks WHERE merged_into IS NULL)")
def t18(s, d):
    return timeline.relabel(table(s, d, "tracks")).select("rec_id", "track_no", "new_speaker")


@query("t20_chunks", f"WITH {EV()} SELECT rec_id, cue_id, CAST((row_number() OVER (PARTITION BY rec_id ORDER BY cue_id) - 1) // 100 AS INT) AS batch FROM c")
def t20(s, d):
    return timeline.chunks(event_cues(s, d)).select("rec_id", "cue_id", "batch")


TOTALS = f"{EV(9)}, g AS (SELECT rec_id, speaker, sum(greatest(0.0, end_ms - start_ms)) AS total_ms FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY total_ms DESC, speaker) AS rank, sum(total_ms) OVER (PARTITION BY rec_id) AS all_ms FROM g)"


@query("o4_top_speakers", f"WITH {TOTALS} SELECT rec_id, speaker, total_ms, CAST(rank AS INT) AS rank FROM k WHERE rank <= 2")
def o4(s, d):
    return timeline.top_speakers(event_cues(s, d, 9), 2)


A1 = f"""{EV(50)}, g AS (SELECT rec_id, speaker, sum(greatest(0.0, end_ms - start_ms)) AS total_ms FROM c WHERE cue_id % 19 <> 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY total_ms DESC, speaker) AS rank, sum(total_ms) OVER (PARTITION BY rec_id) AS all_ms FROM g),
    st AS (SELECT rec_id, speaker, total_ms, CAST(rank AS INT) AS rank, round_even(total_ms / 1000, 1) AS seconds, round_even(total_ms / all_ms, 3) AS share, rank > 1 AND total_ms < 0.03 * all_ms AND total_ms < 20000 AS bystander FROM k)"""


def _voices(s, d):
    return event_cues(s, d, 50).withColumn("speaker", F.expr("CASE WHEN cue_id % 19 <> 0 THEN speaker END"))


@query("a1_bystanders", f"WITH {A1} SELECT * FROM st")
def a1(s, d):
    return timeline.bystanders(_voices(s, d))


@query("f14_speaker_summary", f"WITH {A1} SELECT rec_id, string_agg(speaker || ' ' || CAST(round_even(share * 100, 0) AS INT) || '%' || CASE WHEN bystander THEN '（疑似旁人）' ELSE '' END, '、' ORDER BY rank) AS line FROM st GROUP BY 1")
def f14(s, d):
    return timeline.speaker_summary(timeline.bystanders(_voices(s, d)))


@query("a13_speakers", f"WITH {EV(9)} SELECT rec_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM c GROUP BY rec_id")
def a13(s, d):
    return timeline.distinct_speakers(event_cues(s, d, 9)).withColumn("speakers", F.array_join("speakers", ","))


@query("a4_device_gain", f"WITH {FR}, p AS (SELECT track_id, quantile_cont(db, 0.2) AS p20 FROM f GROUP BY 1) SELECT f.track_id, round(coalesce(quantile_cont(db, 0.9) FILTER (db > p20 + 8 AND db > -55), quantile_cont(db, 0.5)), 5) AS gain_db FROM f JOIN p USING (track_id) GROUP BY f.track_id")
def a4(s, d):
    return frames.device_gain(frame_view(s, d)).select("track_id", F.round("gain_db", 5).alias("gain_db"))


@query(
    "a2_separation",
    f"""WITH {FR}, s AS (SELECT *, {SMOOTH.format(2, 2, 5)} AS v FROM f), o AS (SELECT a.group_id, a.track_id, a.frame_no, a.v, max(b.v) AS other FROM s a LEFT JOIN s b ON a.group_id = b.group_id AND a.frame_no = b.frame_no AND a.track_id <> b.track_id GROUP BY 1, 2, 3, 4),
    h AS (SELECT group_id, frame_no, max(v) AS m FROM s GROUP BY 1, 2), p AS (SELECT group_id, quantile_cont(m, 0.2) AS p20 FROM h GROUP BY 1),
    q AS (SELECT o.group_id, quantile_cont(abs(v - other), 0.5) AS q FROM o JOIN p USING (group_id) WHERE v > p20 + 8 AND v > -55 AND other > -80 GROUP BY 1)
    SELECT p.group_id, round(coalesce(q, CAST('Infinity' AS DOUBLE)), 5) AS separation_db FROM p LEFT JOIN q USING (group_id)""",
)
def a2(s, d):
    return frames.separation(frame_view(s, d)).select("group_id", F.expr("CASE WHEN separation_db = double('Infinity') THEN separation_db ELSE round(separation_db, 5) END").alias("separation_db"))


@query("a6_pool", f"WITH {FR} SELECT track_id, CAST(frame_no // 5 AS INT) AS block, CAST(round_even(max(db), 0) AS INT) AS db FROM f GROUP BY 1, 2 HAVING count(*) = 5")
def a6(s, d):
    return frames.pool_max(frame_view(s, d))


def _sources(s, d):
    """Frames of three files a group; the second file of every third group records the first one's source a little louder."""
    f = frame_view(s, d).where("track_id % 4 < 3")
    own = f.groupBy("group_id", "frame_no").agg(F.max(F.expr("CASE WHEN track_id % 4 = 0 THEN db END")).alias("x0"))
    db = F.expr("CASE WHEN track_id % 4 = 1 AND group_id % 3 = 0 THEN 0.97 * x0 + 0.03 * db + 1 ELSE db END")
    return f.join(own, ["group_id", "frame_no"]).select("group_id", F.expr("CAST(track_id % 4 AS INT)").alias("file_idx"), "track_id", "frame_no", db.alias("db"))


SOURCES = "q AS (SELECT f.group_id, f.track_id % 4 AS file_idx, f.track_id, f.frame_no, CASE WHEN f.track_id % 4 = 1 AND f.group_id % 3 = 0 THEN 0.97 * x.db + 0.03 * f.db + 1 ELSE f.db END AS db FROM f JOIN f x ON x.group_id = f.group_id AND x.frame_no = f.frame_no AND x.track_id % 4 = 0 WHERE f.track_id % 4 < 3)"


@query("j9_same_source", f"""WITH {FR}, {SOURCES}, j AS (SELECT a.group_id, a.track_id AS a, b.track_id AS b, a.db AS x, b.db AS y, greatest(a.db, b.db) AS loud FROM q a JOIN q b ON a.group_id = b.group_id AND a.frame_no = b.frame_no AND a.track_id < b.track_id AND a.file_idx <> b.file_idx),
    p AS (SELECT group_id, a, b, quantile_cont(loud, 0.2) AS p20 FROM j GROUP BY 1, 2, 3) SELECT group_id, a, b, count(*) AS n FROM j JOIN p USING (group_id, a, b) WHERE loud > p20 + 8 AND loud > -55 GROUP BY 1, 2, 3 HAVING count(*) >= 10 AND corr(x, y) >= 0.9""")
def j9(s, d):
    return frames.same_source(_sources(s, d), 10)  # a vector has 64 frames, so that ten are asked for instead of a thousand


BLEED = """k AS (SELECT 'r' || event_id % 9 AS rec_id, event_id AS cue_id, event_id % 500 AS track_id, (event_id % 60) * 100.0 AS a, (event_id % 60) * 100.0 + floor(value) * 10 AS b FROM events),
    o AS (SELECT a.track_id, a.frame_no, a.db - max(b.db) AS dd FROM f a JOIN f b ON a.group_id = b.group_id AND a.frame_no = b.frame_no AND a.track_id <> b.track_id GROUP BY a.track_id, a.frame_no, a.db),
    v AS (SELECT rec_id, cue_id, k.track_id, list_sort(list(dd) FILTER (dd IS NOT NULL)) AS ds FROM k LEFT JOIN o ON o.track_id = k.track_id AND o.frame_no BETWEEN CAST(floor(a / 100) AS INT) AND CAST(floor(b / 100) AS INT) GROUP BY ALL)"""


def _frame_cues(s, d):
    return table(s, d, "events").select(F.expr("concat('r', event_id % 9)").alias("rec_id"), F.col("event_id").alias("cue_id"), F.expr("event_id % 500").alias("track_id"), F.expr("(event_id % 60) * 100.0D").alias("start_ms"), F.expr("(event_id % 60) * 100.0D + floor(value) * 10").alias("end_ms"))


@query("a5_bleed", f"WITH {FR}, {BLEED}, p AS (SELECT rec_id, cue_id, track_id, CASE WHEN len(ds) > 0 THEN ds[least(len(ds), CAST(floor(len(ds) * 0.75) AS INT) + 1)] END AS p75 FROM v) SELECT rec_id, cue_id, track_id, round(p75, 6) AS p75, coalesce(p75 < 0, false) AS bleed FROM p")
def a5(s, d):
    return frames.mark_bleed(_frame_cues(s, d), frame_view(s, d)).withColumn("p75", F.round("p75", 6))


@query("j6_own_minus_others", f"WITH {FR}, {BLEED} SELECT rec_id, cue_id, track_id, CAST(coalesce(len(ds), 0) AS INT) AS n, round(coalesce(list_sum(ds), 0), 5) AS total FROM v")
def j6b(s, d):
    return frames.own_minus_others(_frame_cues(s, d), frame_view(s, d)).select("rec_id", "cue_id", "track_id", F.size("diffs").alias("n"), F.round(F.expr("aggregate(diffs, 0D, (a, x) -> a + x)"), 5).alias("total"))


@query(
    "j6_interval_levels",
    f"""WITH {FR}, k AS (SELECT 'r' || event_id % 9 AS rec_id, event_id AS cue_id, event_id % 500 AS track_id, (event_id % 60) * 100.0 AS a, (event_id % 60) * 100.0 + floor(value) * 10 AS b FROM events)
    SELECT rec_id, cue_id, k.track_id, round(coalesce(avg(db), -90.0), 5) AS mean_db, count(db) AS frames FROM k LEFT JOIN f ON f.track_id = k.track_id AND f.frame_no BETWEEN CAST(floor(a / 100) AS INT) AND CAST(floor(greatest(a, b) / 100) AS INT) GROUP BY ALL""",
)
def j6(s, d):
    return frames.interval_levels(_frame_cues(s, d), frame_view(s, d)).select("rec_id", "cue_id", "track_id", F.round("mean_db", 5).alias("mean_db"), "frames")


STEREO = """v AS (SELECT label AS rec_id, vec_id, embedding, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS k, vec_id % 2 AS side FROM embeddings), y AS (SELECT CAST(a.rec_id AS VARCHAR) AS rec_id, CAST(a.k * 64 + i - 1 AS BIGINT) AS sample_no, CAST(a.embedding[i] AS DOUBLE) * CASE WHEN a.k % 3 = 0 THEN 0.1 ELSE 1.0 END AS l,
    CAST(b.embedding[i] AS DOUBLE) * CASE WHEN a.k % 2 = 0 THEN 0.2 ELSE 1.0 END AS r FROM v a JOIN v b ON a.rec_id = b.rec_id AND a.k = b.k AND a.side = 0 AND b.side = 1, generate_series(1, 64) t(i))"""


def _stereo(s, d):
    """Vectors of one label one after the other: even ones left, odd ones right, some much softer."""
    e = table(s, d, "embeddings").withColumn("k", F.expr("row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1"))
    a, b = (e.where(f"vec_id % 2 = {i}").select(F.col("label").cast("string").alias("rec_id"), "k", F.posexplode("embedding").alias("i", x)) for i, x in ((0, "l"), (1, "r")))
    j = a.join(b, ["rec_id", "k", "i"])
    return j.select("rec_id", F.expr("CAST(k * 64 + i AS BIGINT)").alias("sample_no"), (F.col("l").cast("double") * F.expr("CASE WHEN k % 3 = 0 THEN 0.1D ELSE 1.0D END")).alias("l"), (F.col("r").cast("double") * F.expr("CASE WHEN k % 2 = 0 THEN 0.2D ELSE 1.0D END")).alias("r"))


@query("a3_dual_channel", f"""WITH {STEREO}, w AS (SELECT rec_id, sum(l * r) / sqrt(sum(l * l) * sum(r * r)) AS c, count(*) AS n FROM y GROUP BY 1),
    g AS (SELECT rec_id, sample_no // 16 AS fr, greatest(10 * log10(avg(l * l) + 1e-12), -90) AS l, greatest(10 * log10(avg(r * r) + 1e-12), -90) AS r FROM y GROUP BY 1, 2 HAVING count(*) = 16), p AS (SELECT rec_id, quantile_cont(greatest(l, r), 0.2) AS p20 FROM g GROUP BY 1),
    a AS (SELECT g.rec_id, count(*) AS n, avg(CASE WHEN l - r >= 6 THEN 1.0 ELSE 0.0 END) AS ls, avg(CASE WHEN l - r <= -6 THEN 1.0 ELSE 0.0 END) AS rs FROM g JOIN p USING (rec_id) WHERE greatest(l, r) > p20 + 8 AND greatest(l, r) > -55 GROUP BY 1),
    sm AS (SELECT rec_id, fr, sum(l) OVER o / 5.0 AS l, sum(r) OVER o / 5.0 AS r FROM g WINDOW o AS (PARTITION BY rec_id ORDER BY fr ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), sp AS (SELECT rec_id, quantile_cont(greatest(l, r), 0.2) AS p20 FROM sm GROUP BY 1),
    u AS (SELECT rec_id, abs(l - r) AS dd FROM sm JOIN sp USING (rec_id) WHERE l > p20 + 8 AND l > -55 AND r > -80 UNION ALL SELECT rec_id, abs(l - r) FROM sm JOIN sp USING (rec_id) WHERE r > p20 + 8 AND r > -55 AND l > -80), se AS (SELECT rec_id, quantile_cont(dd, 0.5) AS q FROM u GROUP BY 1)
    SELECT w.rec_id, round(coalesce(c, 1), 6) AS corr, CAST(round(coalesce(a.n, 0) * 0.02, 6) AS DOUBLE) AS active_s, CAST(round(coalesce(ls, 0), 6) AS DOUBLE) AS left_share, CAST(round(coalesce(rs, 0), 6) AS DOUBLE) AS right_share, CASE WHEN a.n > 0 THEN round(least(coalesce(q, 99), 99), 5) END AS separation_db,
    CASE WHEN w.n < 800 THEN 'too short' WHEN a.n IS NULL THEN 'no speech' WHEN c > 0.5 THEN 'same' WHEN least(ls, rs) < greatest(0.05, 5 / greatest(a.n * 0.02, 1e-6)) THEN 'one side' ELSE 'dual' END AS verdict FROM w LEFT JOIN a ON a.rec_id = w.rec_id LEFT JOIN se ON se.rec_id = w.rec_id""")
def a3(s, d):
    r = frames.dual_channel(_stereo(s, d), 800)
    return r.select("rec_id", *[F.round(c, 6).alias(c) for c in ("corr", "active_s", "left_share", "right_share")], F.round("separation_db", 5).alias("separation_db"), "verdict")


@query("d2_align")
def d2(s, d):
    return align.align_tracks(frame_view(s, d), least_peak=3.0).select("group_id", "track_id", "offset_ms", F.round("ncc", 6).alias("ncc"), "confident", "speed")


@query("o3_parallel_order")
def o3(s, d):
    return align.parallel_order(align.align_tracks(frame_view(s, d), least_peak=3.0)).select("group_id", "track_id", "position")


@query("d4_plan_parallel")
def d4(s, d):
    f = _sources(s, d)
    files = f.select("group_id", "file_idx").distinct().withColumn("dual", F.col("file_idx") == 2)
    return align.plan_parallel(f, files, least=10, least_peak=3.0)


@query("j1_backfill", f"WITH {VERSIONS}, x AS (SELECT rec_id, stamp, arg_max(text, pos) AS t FROM a GROUP BY 1, 2) SELECT b.rec_id, pos, coalesce(t, text) AS text FROM b LEFT JOIN x ON x.rec_id = b.rec_id AND x.stamp = b.stamp")
def j1(s, d):
    return diff.backfill(*versions(s, d)).select("rec_id", "pos", "text")


@query("j2_diff", f"WITH {VERSIONS}, k AS (SELECT DISTINCT rec_id, stamp, 1 AS s FROM b UNION ALL SELECT DISTINCT rec_id, stamp, 2 FROM a) SELECT rec_id, stamp, CASE sum(s) WHEN 3 THEN 'kept' WHEN 1 THEN 'deleted' ELSE 'fabricated' END AS state FROM k GROUP BY 1, 2")
def j2(s, d):
    return diff.key_diff(*versions(s, d))


A8 = f"""{VERSIONS_HARD}, kn AS (SELECT rec_id, stamp, arg_max(text, pos) AS src, max(pos) AS rank FROM b GROUP BY 1, 2), j AS (SELECT a.*, src, rank, rank IS NOT NULL AS hit, length(regexp_replace(coalesce(src, ''), '\\s', '', 'g')) AS la, length(regexp_replace(a.text, '\\s', '', 'g')) AS lb,
      rank IS NOT NULL AND regexp_replace(coalesce(src, ''), '\\s', '', 'g') <> regexp_replace(a.text, '\\s', '', 'g') AS ch FROM a LEFT JOIN kn ON kn.rec_id = a.rec_id AND kn.stamp = a.stamp),
    h AS (SELECT *, lag(rank) OVER (PARTITION BY rec_id ORDER BY pos) AS pr FROM j WHERE hit), bk AS (SELECT rec_id, count(*) FILTER (rank <= pr) AS back FROM h GROUP BY 1),
    se AS (SELECT rec_id, count(*) FILTER (hit) AS kept, count(*) FILTER (NOT hit) AS fabricated, count(*) FILTER (ch) AS changed, count(*) FILTER (ch AND lb - la > 12) AS bloated, coalesce(sum(la) FILTER (hit), 0) AS cb, coalesce(sum(lb) FILTER (hit), 0) AS ca FROM j GROUP BY 1),
    st AS (SELECT rec_id, stamp, max(CASE WHEN ch THEN 1 ELSE 0 END) AS ed FROM j GROUP BY 1, 2), n AS (SELECT b.rec_id, st.ed, row_number() OVER (PARTITION BY b.rec_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY b.rec_id) AS n FROM b LEFT JOIN st ON st.rec_id = b.rec_id AND st.stamp = b.stamp),
    te AS (SELECT rec_id, CAST(ceil(10.0 * (i + 1) / n) AS INT) - 1 AS t, avg(coalesce(ed, 1)) AS x, count(*) AS c, count(*) FILTER (ed IS NULL) AS dl FROM n GROUP BY 1, 2), de AS (SELECT rec_id, CAST(sum(c) AS BIGINT) AS rows, CAST(sum(dl) AS BIGINT) AS deleted, sum(x) / 10 AS m, coalesce(sum(x) FILTER (t >= 7), 0) / 3 AS l FROM te GROUP BY 1)"""


@query("a8_structure_check", f"""WITH {A8} SELECT de.rec_id, rows, kept, deleted, fabricated, changed, bloated, CAST(cb AS BIGINT) AS chars_before, CAST(ca AS BIGINT) AS chars_after, round((ca - cb) / greatest(cb, 1), 9) AS growth, back = 0 AS ordered, round(m, 9) AS mean_density, round(l, 9) AS tail_density, m > 0.15 AND l < 0.35 * m AS lazy_tail,
    fabricated = 0 AND bloated = 0 AND (ca - cb) / greatest(cb, 1) <= 0.08 AND back = 0 AND NOT (m > 0.15 AND l < 0.35 * m) AS ok FROM de JOIN se ON se.rec_id = de.rec_id JOIN bk ON bk.rec_id = de.rec_id""")
def a8(s, d):
    r = diff.structure_check(*versions_hard(s, d))
    return r.withColumns({c: F.round(c, 9) for c in ("growth", "mean_density", "tail_density")})


@query("e2_accept_whole", f"""WITH {A8}, v AS (SELECT de.rec_id, fabricated = 0 AND bloated = 0 AND (ca - cb) / greatest(cb, 1) <= 0.08 AND back = 0 AND NOT (m > 0.15 AND l < 0.35 * m) AS ok FROM de JOIN se ON se.rec_id = de.rec_id JOIN bk ON bk.rec_id = de.rec_id),
    la AS (SELECT rec_id, stamp, arg_max(text, pos) AS t FROM a GROUP BY 1, 2) SELECT b.rec_id, b.pos, b.stamp, CASE WHEN b.dd % 11 <> 0 AND ok THEN coalesce(t, text) ELSE text END AS text, CASE WHEN b.dd % 11 = 0 THEN 'no list' WHEN ok THEN 'taken' ELSE 'rejected' END AS state FROM b JOIN v ON v.rec_id = b.rec_id LEFT JOIN la ON la.rec_id = b.rec_id AND la.stamp = b.stamp""")
def e2(s, d):
    b, a = versions_hard(s, d)
    doubts = b.select("rec_id").distinct().withColumn("items", F.expr("CASE WHEN CAST(substring(rec_id, 9, 2) AS INT) % 11 <> 0 THEN CAST(array() AS ARRAY<STRING>) END"))
    return diff.accept_whole(b, a, doubts)


FINAL = """fi AS (SELECT rec_id, pos, CASE pos % 5 WHEN 0 THEN text WHEN 1 THEN text || '!' WHEN 2 THEN text || '?' ELSE text || '!' END AS final FROM b WHERE pos % 6 <> 0 OR CAST(rec_id[9:10] AS INT) % 2 = 0), ok AS (SELECT rec_id FROM fi GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM b WHERE b.rec_id = fi.rec_id))"""


@query("s14_edit_report", f"""WITH {VERSIONS}, {FINAL}, j AS (SELECT b.rec_id, b.pos, b.text AS before, b.text || '!' AS aft, CASE WHEN b.rec_id IN (SELECT rec_id FROM ok) THEN final END AS final FROM b LEFT JOIN fi ON fi.rec_id = b.rec_id AND fi.pos = b.pos),
    q AS (SELECT *, CASE WHEN final = before THEN 'rolled back' WHEN final IS NOT NULL AND final <> before AND final <> aft THEN 'edited later' ELSE 'kept' END AS status FROM j)
    SELECT rec_id, pos, status, '- **' || pos || '** [' || CASE status WHEN 'rolled back' THEN '已回滚' WHEN 'kept' THEN '保留' ELSE '纠错后又改过' END || '] `' || before || '` → `' || aft || '`' || CASE WHEN status = 'edited later' THEN '　最终：`' || final || '`' ELSE '' END AS line,
    count(*) OVER (PARTITION BY rec_id) AS edits, count(*) FILTER (status = 'rolled back') OVER (PARTITION BY rec_id) AS rolled_back FROM q""")
def s14(s, d):
    b, _ = versions(s, d)
    final = b.where("pos % 6 <> 0 OR CAST(substring(rec_id, 9, 2) AS INT) % 2 = 0").select("rec_id", "pos", F.expr("CASE pos % 5 WHEN 0 THEN text WHEN 1 THEN concat(text, '!') WHEN 2 THEN concat(text, '?') ELSE concat(text, '!') END").alias("text"))
    return diff.edit_report(b.select("rec_id", "pos", F.col("text").alias("before"), F.concat("text", F.lit("!")).alias("after")), final, b.groupBy("rec_id").agg(F.count("*").alias("n")))


def _chinese(s, d):
    """Every cue's text, with its language in the two-letter form where the label gives one."""
    c = table(s, d, "cues").where("rec_id IS NOT NULL").select("rec_id", "cue_id", "start_ms", "end_ms", "speaker", "text", F.expr("CASE WHEN lower(substring(trim(lang), 1, 2)) = 'zh' THEN 'zh' ELSE coalesce(lower(trim(lang)), 'auto') END").alias("language"))
    return c.distinct()


@query("j10_context", f"WITH {EV()} SELECT rec_id, cue_id, coalesce(lag(text, 2) {W.replace('end_ms, ', '')}, '') || '/' || coalesce(lag(text) {W.replace('end_ms, ', '')}, '') AS b, coalesce(lead(text) {W.replace('end_ms, ', '')}, '') || '/' || coalesce(lead(text, 2) {W.replace('end_ms, ', '')}, '') AS a FROM c")
def j10(s, d):
    c = timeline.context(event_cues(s, d))
    return c.select("rec_id", "cue_id", F.expr("concat(CASE WHEN size(before) > 1 THEN before[0] ELSE '' END, '/', CASE WHEN size(before) > 0 THEN element_at(before, -1) ELSE '' END)").alias("b"), F.expr("concat(CASE WHEN size(after) > 0 THEN after[0] ELSE '' END, '/', CASE WHEN size(after) > 1 THEN after[1] ELSE '' END)").alias("a"))


def _delivered(s, d):
    """The cues with a level of their recogniser track, as often as they were delivered."""
    c = table(s, d, "cues").where("rec_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL")
    return c.select("rec_id", "cue_id", "start_ms", "end_ms", "speaker", "text", F.expr("-20.0D - cue_id % 7").alias("level"))


def _voiced(s, d):
    """The same; redelivered rows count once."""
    return _delivered(s, d).distinct()


@query("j5_cross_channel_dedupe")
def j5(s, d):
    return matching.dedupe_cross_channel(_voiced(s, d))


@query("j7_reanchor")
def j7(s, d):
    """Quotes of every twentieth cue, some with a letter wrong, all with minutes added to their time."""
    c = _voiced(s, d)
    items = c.where("cue_id % 20 = 0 AND text IS NOT NULL").select("rec_id", F.col("cue_id").alias("item_id"), (F.col("start_ms") + 60_000 * (1 + F.col("cue_id") % 7)).alias("time_ms"), F.expr("CASE WHEN cue_id % 40 = 0 THEN concat(substring(text, 1, 4), substring(text, 6)) ELSE text END").alias("quote"))
    return matching.anchor(items, _delivered(s, d))


@query("j13_tree_diff", "WITH a AS (SELECT doc_id % 900 AS k, doc_id, md5(coalesce(text, '')) AS h FROM documents), s AS (SELECT concat('f/', doc_id) AS path, h FROM a WHERE doc_id % 7 <> 0), t AS (SELECT concat('f/', doc_id) AS path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE h END AS h FROM a WHERE doc_id % 11 <> 0) SELECT coalesce(s.path, t.path) AS path, CASE WHEN s.h IS NULL THEN 'extra' WHEN t.h IS NULL THEN 'missing' WHEN s.h <> t.h THEN 'changed' ELSE 'same' END AS state FROM s FULL JOIN t ON s.path = t.path")
def j13(s, d):
    a = table(s, d, "documents").select("doc_id", F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return tree.tree_diff(a.where("doc_id % 7 <> 0").select("path", "digest"), a.where("doc_id % 11 <> 0").select("path", F.expr("CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE digest END").alias("digest")))


@query("f3_display_width")
def f3(s, d):
    return table(s, d, "documents").select("doc_id", text.display_width("text").alias("width"), text.token_count("text").alias("tokens"), text.grapheme_count("text").alias("graphemes"))


@query("g1_segments")
def g1(s, d):
    return segment.segment_texts(_chinese(s, d), 16.0, _terms())


def _terms():
    return Terms(["camera angle", "small studio", "麦克 → 第二支麦克风", "片尾字幕", "Blue Door to Studio"])


MASK = "text"
for _a, _b in rules.MASKED:
    MASK = f"replace({MASK}, '{_a}', '{_b}')"


@query("f10_mask", f"WITH {ZH} SELECT cue_id, {MASK} AS text FROM z")
def f10(s, d):
    return zh_text(s, d).select("cue_id", rules.mask_words(F.col("text")).alias("text"))


def _simple_stutter_sql() -> str:
    t = "text"
    for w in rules.STUTTER_WORDS:
        t = f"regexp_replace({t}, '({w})+', '{w}', 'g')"
    return t


@query("f6_stutter_words", f"WITH {ZH} SELECT cue_id, {_simple_stutter_sql()} AS text FROM (SELECT cue_id, replace(text, '你你说', '你说') AS text FROM z)")
def f6(s, d):
    return zh_text(s, d).select("cue_id", rules.stutter_simple(F.col("text")).alias("text"))


@query("f6_stutter_full")
def f6b(s, d):
    return _chinese(s, d).select("cue_id", F.when(rules.chinese(F.col("text"), F.col("language")), rules.stutter(F.col("text"))).otherwise(F.col("text")).alias("text"))


_DIG = "translate({0}, '〇零一二三四五六七八九', '00123456789')"


@query(
    "f7_years",
    f"""WITH {ZH}, t AS (SELECT cue_id, regexp_extract_all(text, '[十百千两〇零一二三四五六七八九]*[〇零一二三四五六七八九]+年|.') AS k FROM z)
    SELECT cue_id, array_to_string(list_transform(k, lambda x: CASE WHEN regexp_full_match(x, '[〇零一二三四五六七八九]{{2}}年') AND CAST({_DIG.format('x[2]')} AS INT) - CAST({_DIG.format('x[1]')} AS INT) <> 1 THEN {_DIG.format('x[1:2]')} || '年'
    WHEN regexp_full_match(x, '[〇零一二三四五六七八九]{{4}}年') AND {_DIG.format('x[1:2]')} IN ('19', '20') THEN {_DIG.format('x[1:4]')} || '年' ELSE x END), '') AS text FROM t""",
)
def f7(s, d):
    return zh_text(s, d).select("cue_id", rules.years(F.col("text")).alias("text"))


@query("e9_captured_edits", "WITH y AS (" + SQL["f7_years"] + f"), {ZH} SELECT 'all' AS rec_id, n AS ordinal, b AS before, a AS \"after\" FROM (SELECT z.text AS b, CASE WHEN language = 'zh' THEN y.text ELSE z.text END AS a, CAST(row_number() OVER (ORDER BY z.cue_id) AS INT) AS n FROM z JOIN y ON y.cue_id = z.cue_id) WHERE a <> b")
def e9(s, d):
    z = zh_text(s, d).withColumns({"rec_id": F.lit("all"), "start_ms": F.lit(0.0)})
    return diff.captured_edits(z, lambda t, k: F.when(rules.chinese(t, k), rules.years(t)).otherwise(t))


_HL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '[\\s　]+', ' ', 'g')), '^[，。、；：,.;:！？!?]+ *', ''), '([一-鿿])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([一-鿿])', '\\1\x01\\2', 'g'), '\x01([年月日号点岁])', '\\1', 'g')"


@query("f8_finalize", f"WITH {ZH}, h AS (SELECT cue_id, language, text AS raw, trim(regexp_replace(replace({_HL}, '\x01', ' '), '[，。、；：,.;:！？!?]+$', '')) AS text FROM z) SELECT cue_id, CASE WHEN language = 'zh' THEN {MASK} ELSE trim(raw) END AS text FROM h")
def f8(s, d):
    return zh_text(s, d).select("cue_id", rules.finalize(F.col("text"), F.col("language")).alias("text"))


@query("f9_rule_polish")
def f9(s, d):
    return _chinese(s, d).select("cue_id", rules.polish(F.col("text"), F.col("language")).alias("text"))


FILL = "'[\\s　，。、？！,.?!]*(' || '" + "|".join(rules.FILLERS) + "' || ')[\\s　，。、？！,.?!]*'"


@query("p5_filler_only", f"WITH c AS (SELECT DISTINCT cue_id, text, lang FROM cues WHERE rec_id IS NOT NULL) SELECT cue_id FROM c WHERE lower(trim(lang)[1:2]) = 'zh' AND NOT regexp_matches(text, '[ぁ-ヿ가-힯]') AND regexp_full_match(text, {FILL}) GROUP BY 1")
def p5f(s, d):
    return _chinese(s, d).where(rules.filler_only(F.col("text"), F.col("language"))).select("cue_id").distinct()


FMT = "lpad(CAST(floor({m} / 3600000) AS BIGINT)::VARCHAR, 2, '0') || ':' || lpad((CAST({m} AS BIGINT) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((CAST({m} AS BIGINT) // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((CAST({m} AS BIGINT) % 1000)::VARCHAR, 3, '0')"
BLOCKS = f"{EV()}, n AS (SELECT *, row_number() {W} AS k FROM c)"


@query("s9_render", f"WITH {BLOCKS} SELECT rec_id, string_agg(k || chr(10) || {FMT.format(m='start_ms')} || ' --> ' || {FMT.format(m='end_ms')} || chr(10) || speaker || ': ' || text || chr(10), chr(10) ORDER BY k) AS document FROM n GROUP BY rec_id")
def s9(s, d):
    return subtitles.render(event_cues(s, d), speaker_tags=True)


@query("s4_parse_text", f"WITH {BLOCKS} SELECT rec_id AS path, CAST(k - 1 AS INT) AS block_no, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, text FROM n")
def s4(s, d):
    docs = subtitles.render(event_cues(s, d)).select(F.col("rec_id").alias("path"), F.col("document").alias("raw"))
    return subtitles.parse_text(docs, numeric=True)


@query("s7_stamps", "SELECT doc_id, (regexp_extract(text, '(\\d\\d):(\\d\\d):(\\d\\d),(\\d\\d\\d)', 1)::BIGINT * 3600 + regexp_extract(text, '(\\d\\d):(\\d\\d):(\\d\\d),(\\d\\d\\d)', 2)::BIGINT * 60 + regexp_extract(text, '(\\d\\d):(\\d\\d):(\\d\\d),(\\d\\d\\d)', 3)::BIGINT) * 1000 + regexp_extract(text, '(\\d\\d):(\\d\\d):(\\d\\d),(\\d\\d\\d)', 4)::BIGINT AS ms FROM documents WHERE regexp_matches(text, '\\d\\d:\\d\\d:\\d\\d,\\d\\d\\d')")
def s7(s, d):
    c = F.regexp_extract("text", r"\d\d:\d\d:\d\d,\d\d\d", 0)
    return table(s, d, "documents").withColumn("st", c).where("st <> ''").select("doc_id", subtitles.parse_stamp(F.col("st")).alias("ms"))


@query("k2_json_list", "SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_id % 8 < 7 THEN json_extract_string(props, '$.k') END AS k FROM events")
def k2(s, d):
    e = table(s, d, "events")
    key = F.element_at(F.array(*[F.lit(k) for k in ("cues", "items", "results", "result", "data", "highlights", "output", "other")]), (F.col("event_id") % 8 + 1).cast("int"))
    raw = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.concat(F.lit('{"note": 1, "'), key, F.lit('": ['), F.col("props"), F.lit("]}")))
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), raw, F.lit("\n```"))).otherwise(raw)
    return e.select("event_id", F.element_at(tasks.json_items(tasks.json_block(fenced), "struct<k:string>"), 1)["k"].alias("k"))


ANSWERS = f"{EV()}, q AS (SELECT rec_id AS batch, cue_id, text FROM c), w AS (SELECT batch, cue_id, 'A' || cue_id AS answer, CASE WHEN cue_id % 13 = 0 THEN 'unsure' END AS uncertain FROM q WHERE NOT (CAST(batch[9:10] AS INT) % 3 = 0 AND cue_id % 3 = 0))"


@query("e3_batch_acceptance", f"WITH {ANSWERS}, j AS (SELECT q.batch, q.cue_id, text, answer, uncertain, avg(CASE WHEN answer IS NULL THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY q.batch) >= 0.8 AS ok FROM q LEFT JOIN w ON w.batch = q.batch AND w.cue_id = q.cue_id) SELECT batch, cue_id, CASE WHEN ok AND answer IS NOT NULL AND uncertain IS NULL THEN answer ELSE text END AS text, CASE WHEN NOT ok THEN 'failed' WHEN answer IS NULL THEN 'missing' WHEN uncertain IS NOT NULL THEN 'uncertain' ELSE 'taken' END AS state FROM j")
def e3(s, d):
    q = event_cues(s, d).select(F.col("rec_id").alias("batch"), "cue_id", "text")
    a = q.where("NOT (CAST(substring(batch, 9, 2) AS INT) % 3 = 0 AND cue_id % 3 = 0)").select("batch", "cue_id", F.concat(F.lit("A"), F.col("cue_id").cast("string")).alias("answer"), F.expr("CASE WHEN cue_id % 13 = 0 THEN 'unsure' END").alias("uncertain"))
    return tasks.accept_batches(q, a)


@query("r2_pending_tasks", f"WITH {EV()}, k AS (SELECT cue_id, 'polish-cue-' || sha1('fix' || chr(0) || text)[1:8] AS task_key FROM c) SELECT task_key FROM k WHERE cue_id % 2 = 1")
def r2(s, d):
    c = event_cues(s, d).select("cue_id", tasks.task_key(F.lit("polish/cue "), F.lit("fix"), F.col("text")).alias("task_key"))
    return tasks.pending(c, c.where("cue_id % 2 = 0")).select("task_key")


@query("p3_boundaries", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[。！？!?…؟۔।॥]')) + len(regexp_extract_all(text, '[.]([\\s\\x1c-\\x1f\\x85\\x{a0}\\p{Z}]|$)')) AS INT) AS ends FROM documents WHERE text IS NOT NULL")
def p3b(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", text.boundary_count("text").alias("ends"))


@query("t9_repair_term_splits")
def t9(s, d):
    return segment.repair_term_splits(_chinese(s, d), _terms())


@query("t10_enforce_width")
def t10(s, d):
    return segment.enforce_width(_chinese(s, d), 16.0, _terms())


@query("g8_sentence_cues")
def g8(s, d):
    """Sentences of the raw texts with a word stamp per blank-parted word, evenly spaced but for a long pause behind every fifth."""
    c = _chinese(s, d).withColumn("ws", F.expr("filter(split(text, '\\\\s+'), w -> w <> '')"))
    step = F.expr("(end_ms - start_ms) / greatest(size(ws) + size(ws) DIV 5, 1)")
    words = F.expr("transform(ws, (w, i) -> named_struct('word', w, 'start', start_ms + step * (i + i DIV 5), 'end', start_ms + step * (i + i DIV 5 + 1)))")
    return segment.cues_of_sentences(c.withColumn("step", step).withColumn("words", words).withColumnRenamed("cue_id", "sent_id").withColumn("spk", F.expr("CAST(sent_id % 3 AS INT)")), terms=_terms())


@query("s13_uncertain_list", f"""WITH {EV()}, q AS (SELECT *, CASE WHEN cue_id % 5 = 0 THEN 0 ELSE start_ms END AS st FROM c) SELECT rec_id, cue_id AS item_id, {FMT.format(m='st')} AS start, {FMT.format(m='(st + 3000)')} AS end,
    '【存疑】' || text || '　→？' || CASE WHEN cue_id % 2 = 0 THEN 'a ／ b' ELSE '-' END || CASE WHEN cue_id % 3 = 0 THEN '　【时间未校准】' ELSE '' END AS text FROM q""")
def s13(s, d):
    c = event_cues(s, d)
    time = F.when(F.col("cue_id") % 5 == 0, "about noon").otherwise(subtitles.format_stamp(F.col("start_ms")))
    return segment.uncertain_list(c.select("rec_id", F.col("cue_id").alias("item_id"), time.alias("time"), "text", F.expr("CASE WHEN cue_id % 2 = 0 THEN array('a', 'b') END").alias("candidates"), F.expr("CASE WHEN cue_id % 3 = 0 THEN false WHEN cue_id % 3 = 1 THEN true END").alias("anchored")))


@query("mask_active", f"WITH {FR}, p AS (SELECT track_id, quantile_cont(db, 0.2) AS p20 FROM f GROUP BY 1) SELECT f.track_id, count(*) FILTER (db > p20 + 8 AND db > -55) AS active FROM f JOIN p USING (track_id) GROUP BY 1")
def p10a(s, d):
    return frames.active(frame_view(s, d)).groupBy("track_id").agg(F.sum(F.col("active").cast("int")).alias("active"))


@query("a10_width_audit")
def a10(s, d):
    return segment.width_audit(_chinese(s, d), 16.0)
