"""Queries of the operators around an external answerer, of files, names and trees, and their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.operators import cluster, highlights, review, tasks, timeline, tree
from cuegrid.plans.reference import FMT, T3, A1, _chinese, _voices
from cuegrid.plans.views import EV, HARD, ZH, event_cues, hard_cues, zh_text
from cuegrid.session import table
from cuegrid.sources import glossary, subtitles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _batches(s: SparkSession, d: str) -> DataFrame:
    """Batches of 13 cues in order, with their language."""
    w = timeline.Window.partitionBy("rec_id").orderBy("start_ms", "cue_id")
    c = event_cues(s, d).withColumn("k", F.row_number().over(w) - 1)
    return c.select(F.expr("concat(rec_id, '/', k DIV 13)").alias("batch"), "cue_id", F.expr("k % 13").alias("pos"), "text", F.lit("zh").alias("language"))


def _part_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers to every part: a cue is answered in parts of at most ``cue_id % 9 + 1`` cues, else skipped; some are unsure."""
    p = tasks.segments_of(_batches(s, d))
    given = F.expr("hi - lo <= cue_id % 9 + 1 AND cue_id % 31 <> 0")
    return p.select("batch", "lo", "hi", F.col("cue_id").cast("string").alias("cue_id"), F.when(given, F.concat(F.lit("A"), F.col("cue_id").cast("string"))).alias("answer"), F.expr("CASE WHEN cue_id % 17 = 0 THEN 'unsure' END").alias("uncertain")).where("lo + hi > 3 OR cue_id % 2 = 0")


HALVES = f"""{EV()}, b AS (SELECT rec_id || '/' || k // 13 AS batch, cue_id, k % 13 AS pos, text FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, cue_id) - 1 AS k FROM c)), n AS (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM b),
    p AS (SELECT batch, cue_id, pos, text, 0 AS lo, n AS hi, 0 AS level FROM n UNION ALL SELECT batch, cue_id, pos, text, CASE WHEN pos < lo + (hi - lo) // 2 THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN pos < lo + (hi - lo) // 2 THEN lo + (hi - lo) // 2 ELSE hi END, level + 1 FROM p WHERE hi - lo > 1)"""


@query("e3_bisecting", f"""WITH RECURSIVE {HALVES}, a AS (SELECT batch, lo, hi, cue_id, CASE WHEN hi - lo <= cue_id % 9 + 1 AND cue_id % 31 <> 0 THEN 'A' || cue_id END AS answer, CASE WHEN cue_id % 17 = 0 THEN 'unsure' END AS uncertain FROM p WHERE lo + hi > 3 OR cue_id % 2 = 0),
    k AS (SELECT DISTINCT batch, lo, hi FROM a), j AS (SELECT p.*, answer, uncertain, k.batch IS NOT NULL AS asked, avg(CASE WHEN answer IS NULL THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY p.batch, p.lo, p.hi) AS share
      FROM p LEFT JOIN a ON a.batch = p.batch AND a.lo = p.lo AND a.hi = p.hi AND a.cue_id = p.cue_id LEFT JOIN k ON k.batch = p.batch AND k.lo = p.lo AND k.hi = p.hi),
    q AS (SELECT *, CASE WHEN NOT asked THEN 'pending' WHEN share > 0 AND share >= 0.8 THEN 'taken' ELSE 'failed' END AS part FROM j), r AS (SELECT batch, cue_id, any_value(pos) AS pos, any_value(text) AS text, arg_min({{'part': part, 'answer': answer, 'uncertain': uncertain}}, CASE WHEN part = 'failed' THEN 1000 + level ELSE level END) AS x FROM q GROUP BY 1, 2)
    SELECT batch, cue_id, pos, CASE WHEN x.part = 'taken' AND x.answer IS NOT NULL AND x.uncertain IS NULL THEN x.answer ELSE text END AS text, CASE WHEN x.part = 'taken' AND x.answer IS NULL THEN 'missing' WHEN x.part = 'taken' AND x.uncertain IS NOT NULL THEN 'uncertain' ELSE x.part END AS state FROM r""")
def e3b(s, d):
    return tasks.accept_bisecting(_batches(s, d), _part_answers(s, d))


@query("e4_polish_minimal", f"WITH {EV()}, t AS (SELECT *, CASE cue_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE text END AS x FROM c), u AS (SELECT rec_id, cue_id, trim(coalesce(CASE WHEN cue_id % 4 = 0 THEN 'B' || cue_id WHEN cue_id % 10 = 3 THEN '' END, x)) AS text FROM t), v AS (SELECT *, coalesce(text, '') = '' AS gone FROM u) SELECT rec_id, cue_id, text, dropped FROM (SELECT *, CAST(count(*) FILTER (gone) OVER (PARTITION BY rec_id) AS BIGINT) AS dropped FROM v) WHERE NOT gone")
def e4(s, d):
    c = event_cues(s, d).withColumn("text", F.expr("CASE cue_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE text END")).withColumn("language", F.lit("zh"))
    given = c.where("cue_id % 4 = 0 OR cue_id % 10 = 3").select("rec_id", "cue_id", F.expr("CASE WHEN cue_id % 4 = 0 THEN concat('B', cue_id) ELSE '' END").alias("answer"))
    return tasks.polish_cues(c.select("rec_id", "cue_id", "text", "language"), "minimal", given).select("rec_id", "cue_id", "text", "dropped")


@query("e4_polish_clean")
def e4c(s, d):
    return tasks.polish_cues(_chinese(s, d).select("rec_id", "cue_id", "text", "language"), "clean")


MEMBERS = T3 + ", g AS (SELECT rec_id, cl, arg_min(cue_id, rn) AS first_cue FROM w GROUP BY rec_id, cl HAVING count(DISTINCT coalesce(speaker, '?')) > 1), m AS (SELECT w.rec_id, cue_id FROM w JOIN g ON g.rec_id = w.rec_id AND g.cl = w.cl)"


@query("e5_reconcile", f"""WITH RECURSIVE {MEMBERS}, v AS (SELECT c.rec_id, c.cue_id, CASE WHEN cue_id % 3 = 0 AND (CAST(rec_id[9:10] AS INT) % 3 > 0 OR cue_id % 2 = 0) OR cue_id % 7 < 5 AND CAST(rec_id[9:10] AS INT) % 5 = 0 THEN 'drop' WHEN cue_id % 4 = 1 THEN 'fix' WHEN cue_id % 4 = 2 THEN 'unsure' END AS verdict FROM c JOIN m USING (rec_id, cue_id)),
    n AS (SELECT rec_id, count(*) FILTER (verdict = 'drop') > 0.5 * count(*) AS off FROM v GROUP BY 1), j AS (SELECT c.rec_id, c.cue_id, c.text, v.verdict, coalesce(off, false) AS off FROM c LEFT JOIN v ON v.rec_id = c.rec_id AND v.cue_id = c.cue_id LEFT JOIN n ON n.rec_id = c.rec_id),
    x AS (SELECT *, CASE WHEN off THEN 'ignored' WHEN verdict = 'drop' THEN 'dropped' WHEN verdict = 'fix' AND cue_id % 8 <> 1 THEN 'fixed' WHEN verdict = 'unsure' THEN 'unsure' ELSE 'kept' END AS state FROM j) SELECT rec_id, cue_id, CASE WHEN state = 'fixed' THEN 'F' || cue_id ELSE text END AS text, state FROM x WHERE state <> 'dropped'""")
def e5(s, d):
    c = hard_cues(s, d)
    verdict = "CASE WHEN cue_id % 3 = 0 AND (CAST(substring(rec_id, 9, 2) AS INT) % 3 > 0 OR cue_id % 2 = 0) OR cue_id % 7 < 5 AND CAST(substring(rec_id, 9, 2) AS INT) % 5 = 0 THEN 'drop' WHEN cue_id % 4 = 1 THEN 'fix' WHEN cue_id % 4 = 2 THEN 'unsure' END"
    v = c.select("rec_id", F.col("cue_id").cast("string").alias("cue_id"), F.expr(verdict).alias("verdict"), F.expr("CASE WHEN cue_id % 8 <> 1 THEN concat('F', cue_id) ELSE ' ' END").alias("text"))
    return tasks.reconcile(c.select("rec_id", "cue_id", "text"), cluster.cluster_members(c), v)


@query("e6_highlight_answers", "WITH a AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS rec_id, event_id AS item_no, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(event_id % 400 AS VARCHAR) END AS cue, CASE event_id % 3 WHEN 0 THEN ' chapter ' WHEN 1 THEN 'highlight' ELSE 'odd' END AS type, CASE WHEN event_id % 6 = 0 THEN '  ' ELSE ' T' || event_id END AS text FROM events) SELECT rec_id, item_no, CAST(cue AS BIGINT) AS cue, CASE WHEN trim(type) = 'chapter' THEN 'chapter' ELSE 'highlight' END AS kind, trim(text) AS text FROM a WHERE try_cast(cue AS BIGINT) BETWEEN 10 AND 300 AND trim(text) <> ''")
def e6(s, d):
    a = table(s, d, "events").select(F.expr("CAST(date(ts) AS STRING)").alias("rec_id"), F.col("event_id").alias("item_no"), F.expr("CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(event_id % 400 AS STRING) END").alias("cue"), F.expr("CASE event_id % 3 WHEN 0 THEN ' chapter ' WHEN 1 THEN 'highlight' ELSE 'odd' END").alias("type"), F.expr("CASE WHEN event_id % 6 = 0 THEN '  ' ELSE concat(' T', event_id) END").alias("text"))
    return highlights.answer_items(a, a.select("rec_id").distinct().withColumns({"first": F.lit(10), "last": F.lit(300)}))


REV = "a AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, event_id AS item_no, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(event_id % 400 AS VARCHAR) END AS cue, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(event_id % 400 + 5 AS VARCHAR) WHEN 2 THEN '2' ELSE 'y' END AS cue_end, CASE event_id % 3 WHEN 0 THEN ' 敏感信息' WHEN 1 THEN 'other' ELSE NULL END AS category, CASE event_id % 5 WHEN 0 THEN '高' WHEN 1 THEN 'high' ELSE '低 ' END AS severity, ' r' AS reason, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '删除' END AS action FROM events)"


@query("e7_review_answers", f"WITH {REV} SELECT batch, item_no, CAST(cue AS BIGINT) AS cue, greatest(CAST(cue AS BIGINT), least(coalesce(try_cast(cue_end AS BIGINT), CAST(cue AS BIGINT)), 300)) AS cue_end, CASE WHEN trim(category) = '敏感信息' THEN '敏感信息' ELSE '冒犯性' END AS category, CASE WHEN trim(severity) IN ('高', '中', '低') THEN trim(severity) ELSE '中' END AS severity, 'r' AS reason, CASE WHEN trim(action) = '' THEN '自行判断' ELSE trim(action) END AS action FROM a WHERE try_cast(cue AS BIGINT) BETWEEN 10 AND 300")
def e7(s, d):
    e = table(s, d, "events")
    a = e.select(F.expr("CAST(date(ts) AS STRING)").alias("batch"), F.col("event_id").alias("item_no"), F.expr("CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(event_id % 400 AS STRING) END").alias("cue"), F.expr("CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(event_id % 400 + 5 AS STRING) WHEN 2 THEN '2' ELSE 'y' END").alias("cue_end"), F.expr("CASE event_id % 3 WHEN 0 THEN ' 敏感信息' WHEN 1 THEN 'other' END").alias("category"), F.expr("CASE event_id % 5 WHEN 0 THEN '高' WHEN 1 THEN 'high' ELSE '低 ' END").alias("severity"), F.lit(" r").alias("reason"), F.expr("CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '删除' END").alias("action"))
    return review.answer_items(a, a.select("batch").distinct().withColumns({"first": F.lit(10), "last": F.lit(300)}))


@query("t19_next_round", "WITH p AS (SELECT event_id, event_id % 50 AS cursor, event_id % 50 + 199 AS last, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 400 END AS st, event_id % 13 AS round, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 9000 END AS cues, event_id % 90000 AS chars FROM events), q AS (SELECT *, greatest(cursor, least(coalesce(st, last), last)) + 1 AS nx FROM p) SELECT CAST(event_id AS VARCHAR) AS rec_id, nx AS cursor, nx + least(CASE WHEN cues <= 4000 AND chars <= 60000 THEN cues ELSE 200 END, cues) - 1 AS last, round + 1 AS round, cues > 0 AND round < 12 AS goes_on FROM q")
def t19(s, d):
    p = table(s, d, "events").select(F.col("event_id").cast("string").alias("rec_id"), F.expr("event_id % 50").alias("cursor"), F.expr("event_id % 50 + 199").alias("last"), F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 400 END").alias("scanned_to"), F.expr("event_id % 13").alias("round"), F.expr("CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 9000 END").alias("cues"), F.expr("event_id % 90000").alias("chars"))
    return review.next_round(p)


BATCHED = f"{EV()}, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, cue_id) - 1 AS o, count(*) OVER (PARTITION BY rec_id) AS an, sum(length(text)) OVER (PARTITION BY rec_id) AS ch FROM c), bt AS (SELECT *, CASE WHEN an <= 330 AND ch <= 60000 THEN 0 ELSE CAST(o // 200 AS INT) END AS batch FROM n)"


@query("p7_single_pass", f"WITH {EV()} SELECT rec_id, count(*) AS cues, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) <= 330 AND sum(length(text)) <= 3000 AS single FROM c GROUP BY 1")
def p7(s, d):
    return highlights.single_pass(event_cues(s, d), 330, 3000)


@query("t20_plan_batches", f"WITH {BATCHED} SELECT rec_id, cue_id, batch FROM bt")
def t20(s, d):
    return highlights.plan_batches(event_cues(s, d), 200, 330).select("rec_id", "cue_id", "batch")


@query("a12_budgets", f"WITH {BATCHED}, g AS (SELECT rec_id, batch, any_value(an) AS an, count(*) AS n, greatest((arg_max(end_ms, o) - arg_min(start_ms, o)) / 60000, 0.1) AS m FROM bt GROUP BY 1, 2) SELECT rec_id, batch, round(m, 6) AS minutes, CAST(greatest(round_even(m * 1.2, 0), 1) AS INT) AS budget, CASE WHEN n = an THEN CAST(least(8, greatest(3, round_even(m / 8, 0))) AS INT) ELSE 3 END AS chapters FROM g")
def a12(s, d):
    return highlights.budgets(highlights.plan_batches(event_cues(s, d), 200, 330)).withColumn("minutes", F.round("minutes", 6))


@query("f11_clean_label")
def f11(s, d):
    z = zh_text(s, d)
    return z.select("cue_id", highlights.clean_label(F.concat(F.lit("【第三章】 "), "text", F.lit("。")), F.col("language")).alias("label"))


def _translation(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    src = _batches(s, d).select("batch", "pos", F.col("cue_id").alias("id"), F.expr("concat(CASE WHEN cue_id % 2 = 0 THEN 'spk1: ' ELSE '' END, text, CASE WHEN cue_id % 5 = 0 THEN '\\nmore' ELSE '' END)").alias("text"))
    ans = src.select("batch", "pos", F.expr("CASE WHEN id % 331 = 0 THEN id + 1 ELSE id END").alias("id"), F.expr("CASE WHEN id % 97 = 0 THEN ' ' WHEN id % 89 = 0 THEN replace(text, 'spk1: ', '') WHEN id % 83 = 0 THEN replace(text, '\\n', ' ') WHEN id % 79 = 0 THEN concat(text, '-->') ELSE replace(text, 'line', 'Zeile') END").alias("text"), F.expr("CASE WHEN id % 211 = 0 THEN 'what?' END").alias("uncertain"))
    return src, ans.where("NOT (pos = 12 AND id % 10 = 0)")


TRANS = f"""{EV()}, b AS (SELECT rec_id || '/' || k // 13 AS batch, cue_id AS id, k % 13 AS pos, CASE WHEN cue_id % 2 = 0 THEN 'spk1: ' ELSE '' END || text || CASE WHEN cue_id % 5 = 0 THEN chr(10) || 'more' ELSE '' END AS text FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, cue_id) - 1 AS k FROM c)),
    a AS (SELECT batch, pos, CASE WHEN id % 331 = 0 THEN id + 1 ELSE id END AS id, CASE WHEN id % 97 = 0 THEN ' ' WHEN id % 89 = 0 THEN replace(text, 'spk1: ', '') WHEN id % 83 = 0 THEN replace(text, chr(10), ' ') WHEN id % 79 = 0 THEN text || '-->' ELSE replace(text, 'line', 'Zeile') END AS text, CASE WHEN id % 211 = 0 THEN 'what?' END AS uncertain FROM b WHERE NOT (pos = 12 AND id % 10 = 0))"""


@query("j4_same_order", f"WITH {TRANS}, w AS (SELECT batch, list(id ORDER BY pos) AS x FROM b GROUP BY 1), g AS (SELECT batch, list(id ORDER BY pos) AS y FROM a GROUP BY 1) SELECT w.batch, coalesce(x = y, false) AS ok FROM w LEFT JOIN g ON g.batch = w.batch")
def j4(s, d):
    return tasks.same_order(*_translation(s, d))


@query("e8_translation_defects", f"""WITH {TRANS}, w AS (SELECT batch, list(id ORDER BY pos) AS x FROM b GROUP BY 1), g AS (SELECT batch, list(id ORDER BY pos) AS y, max(CASE WHEN uncertain IS NOT NULL THEN 1 ELSE 0 END) AS du FROM a GROUP BY 1),
    j AS (SELECT b.batch, max(CASE WHEN a.id IS NULL OR trim(a.text) = '' OR contains(a.text, '-->') OR starts_with(b.text, 'spk1: ') <> starts_with(a.text, 'spk1: ') OR contains(b.text, chr(10)) <> contains(a.text, chr(10)) THEN 1 ELSE 0 END) AS bad FROM b LEFT JOIN a ON a.batch = b.batch AND a.pos = b.pos GROUP BY 1)
    SELECT w.batch, CASE WHEN y IS NULL THEN 'pending' WHEN x <> y THEN 'ids' WHEN du = 1 THEN 'uncertain' WHEN bad = 1 THEN 'text' END AS defect FROM w JOIN j ON j.batch = w.batch LEFT JOIN g ON g.batch = w.batch""")
def e8(s, d):
    return tasks.translation_defects(*_translation(s, d))


BLOCK = f"k || chr(10) || {FMT.format(m='start_ms')} || ' --> ' || {FMT.format(m='end_ms')} || chr(10) || {{t}} || chr(10)"
NUMBERED = f"{EV()}, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms, cue_id) AS k FROM c)"


def _documents(s: SparkSession, d: str) -> DataFrame:
    """One file a recording; those of every tenth day have a cue that ends before it starts."""
    c = event_cues(s, d).withColumn("end_ms", F.expr("CASE WHEN substring(rec_id, 9, 2) IN ('10', '20', '30') AND cue_id % 50 = 0 THEN start_ms ELSE end_ms END"))
    return subtitles.render(c).select(F.col("rec_id").alias("path"), F.col("document").alias("raw"))


@query("s6_parse_strict", f"WITH {NUMBERED}, b AS (SELECT rec_id FROM n WHERE rec_id[9:10] IN ('10', '20', '30') AND cue_id % 50 = 0 GROUP BY 1), x AS (SELECT rec_id, k - 1 AS cue_no, start_ms, end_ms, text FROM n WHERE rec_id NOT IN (SELECT rec_id FROM b)) SELECT rec_id AS path, CAST(cue_no AS INT) AS cue_no, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, text, false AS refused FROM x UNION ALL SELECT rec_id, NULL, NULL, NULL, NULL, true FROM b")
def s6(s, d):
    return subtitles.parse_strict(_documents(s, d)).select("path", "cue_no", "start_ms", "end_ms", F.trim(F.regexp_replace("text", "\\n+$", "")).alias("text"), F.col("error").isNotNull().alias("refused"))


@query("e8_assemble", f"WITH {NUMBERED}, b AS (SELECT rec_id FROM n WHERE rec_id[9:10] IN ('10', '20', '30') AND cue_id % 50 = 0 GROUP BY 1) SELECT rec_id AS path, CASE WHEN rec_id NOT IN (SELECT rec_id FROM b) THEN string_agg({BLOCK.format(t='replace(text, chr(108), chr(76))')}, chr(10) ORDER BY k) END AS document, rec_id IN (SELECT rec_id FROM b) AS refused FROM n GROUP BY 1")
def e8a(s, d):
    docs = _documents(s, d)
    cues = subtitles.parse_strict(docs).where("error IS NULL").select("path", "cue_no", F.replace("text", F.lit("l"), F.lit("L")).alias("text"))
    return subtitles.assemble(docs, cues).select("path", "document", F.col("error").isNotNull().alias("refused"))


@query("s12_track_documents", f"""WITH {HARD}, b AS (SELECT *, cue_id % 9 = 0 AS bl FROM c WHERE speaker IS NOT NULL), l AS (SELECT *, lead(start_ms) OVER w AS ns FROM b WINDOW w AS (PARTITION BY rec_id, speaker ORDER BY start_ms, end_ms, cue_id)),
    t AS (SELECT *, least(end_ms, start_ms + 6000) AS e1 FROM l), u AS (SELECT *, CASE WHEN ns IS NULL THEN greatest(e1, start_ms + 1000) ELSE least(greatest(e1, least(start_ms + 1000, ns - 40)), greatest(ns - 40, start_ms + 1)) END AS e2 FROM t),
    n AS (SELECT *, row_number() OVER (PARTITION BY rec_id, speaker ORDER BY start_ms, e2, cue_id) AS k FROM u) SELECT rec_id, speaker, string_agg(k || chr(10) || {FMT.format(m='start_ms')} || ' --> ' || {FMT.format(m='e2')} || chr(10) || CASE WHEN bl THEN '【串音】' ELSE '' END || text || chr(10), chr(10) ORDER BY k) AS document, count(*) AS cues, count(*) FILTER (bl) AS bleed FROM n GROUP BY 1, 2""")
def s12(s, d):
    return subtitles.track_document(hard_cues(s, d).withColumn("bleed", F.expr("cue_id % 9 = 0")))


@query("s16_manifest", f"""WITH {EV(9)}, g AS (SELECT rec_id, count(*) AS n, max(end_ms) AS t, list_sort(list(DISTINCT speaker)) AS sp FROM c GROUP BY 1) SELECT rec_id, '{{"rec_id":"' || rec_id || '","source":"s","path":"p","cue_count":' || n || ',"total_ms":' || CASE WHEN t < 10000000 THEN CAST(t AS VARCHAR) ELSE CAST(t / 10000000.0 AS VARCHAR) || 'E7' END || ',"speakers":["' || array_to_string(sp, '","') || '"]}}' AS manifest FROM g""")
def s16(s, d):
    c = event_cues(s, d, 9)
    return subtitles.manifest(c, c.select("rec_id").distinct().withColumns({"source": F.lit("s"), "path": F.lit("p")}))


@query("s16_transcript")
def s16t(s, d):
    return subtitles.transcript(_chinese(s, d))


NAMES = "CASE event_id % 5 WHEN 0 THEN '2024-03-07 ' WHEN 1 THEN '20240307_1530 ' WHEN 2 THEN '' WHEN 3 THEN '2024年3月7日 ' ELSE '  ' END || 'My/Talk  --' || event_id % 20 || '.'"


@query("s17_names", f"WITH n AS (SELECT event_id, {NAMES} AS name FROM events) SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2024-03-07 ' WHEN 1 THEN '20240307_1530 ' WHEN 2 THEN '' WHEN 3 THEN '2024年3月7日 ' ELSE '' END || 'My-Talk -' || event_id % 20 AS safe, 'my-talk -' || event_id % 20 AS key FROM n")
def s17(s, d):
    e = table(s, d, "events").select("event_id", F.expr(NAMES.replace("||", "||")).alias("name"))
    return e.select("event_id", subtitles.sanitize_name(F.col("name")).alias("safe"), subtitles.project_key(F.col("name")).alias("key"))


@query("s17_projects", "WITH m AS (SELECT 'f' || event_id AS path, event_id % 12 AS k FROM events) SELECT path, 'Talk ' || k AS name, CASE WHEN k < 8 THEN '2023-01-02 talk ' || k END AS project FROM m")
def s17p(s, d):
    m = table(s, d, "events").select(F.concat(F.lit("f"), "event_id").alias("path"), F.concat(F.lit("Talk "), F.expr("event_id % 12")).alias("name"))
    names = [f"2023-01-02 talk {i}" for i in range(9)] + ["2024-05-06 Talk 8", "_2023-01-02 talk 9"]
    return subtitles.resolve_projects(m, s.createDataFrame([(n,) for n in names], "project string"))


@query("s1_media", "WITH p AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'a/b.MP4' WHEN 1 THEN '.x/b.mp3' WHEN 2 THEN 'a/.b.wav' WHEN 3 THEN '__pycache__/b.ts' WHEN 4 THEN 'c.3gp' WHEN 5 THEN 'd.mpeg' WHEN 6 THEN 'e.mts' WHEN 7 THEN 'f.txt' ELSE 'g/h.opus' END AS path FROM events) SELECT event_id, path FROM p WHERE event_id % 9 IN (0, 4, 5, 8)")
def s1(s, d):
    e = table(s, d, "events").select("event_id", F.expr("CASE event_id % 9 WHEN 0 THEN 'a/b.MP4' WHEN 1 THEN '.x/b.mp3' WHEN 2 THEN 'a/.b.wav' WHEN 3 THEN '__pycache__/b.ts' WHEN 4 THEN 'c.3gp' WHEN 5 THEN 'd.mpeg' WHEN 6 THEN 'e.mts' WHEN 7 THEN 'f.txt' ELSE 'g/h.opus' END").alias("path"))
    return e.where(subtitles.is_media(F.col("path")))


@query("s4_lenient", f"WITH {NUMBERED} SELECT rec_id AS path, CAST(k - 1 AS INT) AS block_no, {FMT.format(m='start_ms')} || ' --> ' || {FMT.format(m='end_ms')} AS stamp, CASE WHEN cue_id % 8 = 0 THEN '' ELSE text END AS text FROM n")
def s4(s, d):
    docs = subtitles.render(event_cues(s, d).withColumn("text", F.expr("CASE WHEN cue_id % 8 = 0 THEN '' ELSE text END")))
    return subtitles.parse_text(docs.select(F.col("rec_id").alias("path"), F.col("document").alias("raw")))


GLOSS = ["# notes", " 麦克, 话筒 → 第二支麦克风 ", "片尾字幕", "", "camera angle", "片尾字幕", "Bluedor, blu dor → Blue Door to Studio"]


@query("u2_glossary", "SELECT * FROM (VALUES (1, '麦克, 话筒 → 第二支麦克风', '麦克|话筒', '第二支麦克风'), (2, '片尾字幕', '', '片尾字幕'), (3, 'camera angle', '', 'camera angle'), (4, 'Bluedor, blu dor → Blue Door to Studio', 'Bluedor|blu dor', 'Blue Door to Studio'), (5, 'small studio', '', 'small studio')) t(line_no, line, wrong, \"right\")")
def u2(s, d):
    a = glossary.clean_lines(s.createDataFrame(list(enumerate(GLOSS)), "line_no int, line string"))
    b = s.createDataFrame(list(enumerate(glossary.listed("camera angle，small studio、 片尾字幕"))), "line_no int, line string")
    m = glossary.merged(a, b)
    return m.join(glossary.parse(m), "line_no").select("line_no", "line", F.array_join("wrong", "|").alias("wrong"), "right")


@query("f18_markers", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'spk1: ' WHEN 1 THEN '<i>|</i>' WHEN 2 THEN 'Anna: ' ELSE 'at 10: ' END AS marks FROM events")
def f18(s, d):
    t = "CASE event_id % 4 WHEN 0 THEN 'spk1: hi' WHEN 1 THEN 'so <i>x</i>' WHEN 2 THEN 'Anna: yes' ELSE 'at 10: no' END"
    return table(s, d, "events").select("event_id", F.array_join(tasks.markers(F.expr(t)), "|").alias("marks"))


@query("k3_scan_lists", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[{\"k\":' || event_id || '}]' WHEN 1 THEN '[1,2,3]' END AS list FROM events")
def k3(s, d):
    t = "CASE event_id % 3 WHEN 0 THEN concat('see [1] and [2, 3, 4]: [{\"k\": ', event_id, '}] [x') WHEN 1 THEN 'only [7], [1, 2, 3] and [' ELSE 'nothing [ here' END"
    return table(s, d, "events").select("event_id", tasks.scan_lists(F.expr(t)).alias("list"))


@query("e1_task_states", "SELECT 'k' || event_id AS task_key, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'unparseable' WHEN 2 THEN 'rejected' ELSE 'answered' END AS state FROM events")
def e1(s, d):
    t = table(s, d, "events").select(F.concat(F.lit("k"), "event_id").alias("task_key"), "event_id")
    a = t.where("event_id % 5 > 0").select("task_key", F.expr("CASE event_id % 5 WHEN 1 THEN 'no idea' WHEN 4 THEN 'x [{\"a\": 1}] y' ELSE '{\"items\": []}' END").alias("answer"), F.expr("event_id % 5 = 2").alias("rejected"))
    return tasks.task_states(t.select("task_key"), a)


@query("p13_target_language", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'zh-hant' WHEN 2 THEN 'zh' WHEN 5 THEN 'ja' END AS lang FROM events")
def p13(s, d):
    return table(s, d, "events").select("event_id", tasks.target_language(F.expr("element_at(array(' English', 'zh-Hant', '中文', 'auto', 'x y', 'JA'), CAST(event_id % 6 + 1 AS INT))")).alias("lang"))


@query("p8_decide_gate", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE WHEN event_id % 5 = 0 THEN true ELSE value >= 6 END END AS gate FROM events")
def p8(s, d):
    e = table(s, d, "events")
    return e.select("event_id", tasks.decide_gate(F.expr("CASE WHEN event_id % 5 = 0 THEN double('Infinity') ELSE value END"), F.expr("element_at(array('on', 'off', 'auto'), CAST(event_id % 3 + 1 AS INT))")).alias("gate"))


VOTE = "w AS (SELECT user_id AS rec_id, CASE WHEN event_id % 3 = 0 AND user_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, 0.7 + (event_id % 30) / 100.0 AS p FROM events), v AS (SELECT rec_id, bool_and(lang = 'zh' AND p >= 0.7) AS zh, arg_max(lang, {'p': p, 'l': lang}) AS top FROM w GROUP BY 1)"


def _windows(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("rec_id"), F.expr("CASE WHEN event_id % 3 = 0 AND user_id % 2 = 0 THEN 'en' ELSE 'zh' END").alias("lang"), F.expr("CAST(0.7 + (event_id % 30) / 100.0 AS DECIMAL(10, 4))").alias("p"))


@query("a14_language_vote", f"WITH {VOTE} SELECT rec_id, CASE WHEN zh THEN 'zh' ELSE top END AS language, zh AS chinese FROM v")
def a14(s, d):
    return tasks.language_vote(_windows(s, d))


@query("e12_route", f"WITH {VOTE}, e AS (SELECT rec_id, zh, CASE rec_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'firered' ELSE 'whisper' END AS engine, rec_id % 2 = 1 AS di FROM v), u AS (SELECT *, CASE WHEN NOT zh THEN 'whisper' WHEN engine = 'auto' THEN 'funasr' ELSE engine END AS used FROM e) SELECT rec_id, CASE WHEN di AND used <> 'funasr' THEN NULL ELSE used END AS engine, CASE WHEN di AND NOT zh THEN 'voices need Chinese' WHEN di AND used <> 'funasr' THEN 'engine tells no voices' END AS error FROM u")
def e12(s, d):
    v = tasks.language_vote(_windows(s, d))
    return tasks.route(v.withColumns({"engine": F.expr("CASE rec_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'firered' ELSE 'whisper' END"), "diarize": F.expr("rec_id % 2 = 1")}))


@query("e11_probe", f"WITH {A1}, n AS (SELECT rec_id, count(*) FILTER (NOT bystander) AS k FROM st GROUP BY 1) SELECT rec_id, CAST(k AS BIGINT) AS speakers, CASE WHEN rec_id[10:10] = '5' THEN 'by channel' WHEN k > 1 THEN 'by voice' ELSE 'single' END AS advice FROM n")
def e11(s, d):
    st = timeline.bystanders(_voices(s, d))
    return tasks.probe(st, st.select("rec_id").distinct().withColumn("verdict", F.expr("CASE WHEN substring(rec_id, 10, 1) = '5' THEN 'dual' ELSE 'same' END")))


@query("p6_drop_empty", f"WITH {EV()}, t AS (SELECT rec_id, cue_id, CASE cue_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE text END AS text FROM c) SELECT * FROM (SELECT *, count(*) FILTER (coalesce(trim(text), '') = '') OVER (PARTITION BY rec_id) AS dropped FROM t) WHERE trim(text) <> ''")
def p6(s, d):
    c = event_cues(s, d).select("rec_id", "cue_id", F.expr("CASE cue_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE text END").alias("text"))
    return timeline.drop_empty(c)


@query("a11_stage_shares", "SELECT user_id AS run_id, event_type AS stage, value AS seconds, round(value / sum(value) OVER (PARTITION BY user_id), 9) AS share FROM events")
def a11(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return timeline.stage_shares(e).withColumn("share", F.round("share", 9))


@query("u1_union_tracks", f"WITH {EV()} SELECT rec_id, cue_id, speaker, text FROM c WHERE cue_id % 2 = 0 UNION ALL SELECT rec_id, cue_id, NULL, text FROM c WHERE cue_id % 2 = 1")
def u1(s, d):
    c = event_cues(s, d).select("rec_id", "cue_id", "speaker", "text")
    return timeline.union_tracks(c.where("cue_id % 2 = 0"), c.where("cue_id % 2 = 1").drop("speaker"))


def _trees(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(s, d, "documents").select("doc_id", F.expr("concat('g', doc_id % 9, '/', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.py' END)").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.expr("concat('g', doc_id % 9)").alias("group"))
    t = a.where("doc_id % 101 <> 0").withColumn("digest", F.expr("CASE WHEN doc_id % 55 = 0 THEN 'x' ELSE digest END"))
    return a.where("doc_id % 303 <> 5").drop("doc_id"), t.drop("doc_id")


@query("e13_sync_plan", "WITH s AS (SELECT doc_id, 'g' || doc_id % 9 AS g, doc_id % 2 = 0 AS doc, doc_id % 303 <> 5 AS ins, doc_id % 101 <> 0 AS int_, doc_id % 55 = 0 AS ch FROM documents) SELECT g AS \"group\", count(*) FILTER (int_ AND NOT ins) AS extra, count(*) FILTER (NOT doc AND ins AND (NOT int_ OR ch)) AS copy, count(*) FILTER (doc AND ins AND NOT int_) > 0 OR g IN ('g3', 'g4') AS stale FROM s GROUP BY 1")
def e13(s, d):
    a, t = _trees(s, d)
    now = tree.fingerprints(a, "p").withColumnRenamed("fingerprint", "source").join(tree.fingerprints(t, "p").withColumnRenamed("fingerprint", "target"), "group")
    return tree.sync_plan(a, t, now.withColumn("source", F.expr("CASE WHEN group = 'g3' THEN 'old' ELSE source END")).where("group <> 'g4'"), "p")


@query("u5_unexpected", "SELECT 'g' || doc_id % 9 || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.py' END AS path, CASE WHEN doc_id % 303 = 5 THEN 'extra' WHEN doc_id % 101 = 0 THEN 'missing' ELSE 'changed' END AS state FROM documents WHERE (doc_id % 303 = 5 AND doc_id % 101 <> 0) OR (doc_id % 2 = 1 AND doc_id % 303 <> 5 AND (doc_id % 101 = 0 OR doc_id % 55 = 0))")
def u5(s, d):
    a, t = _trees(s, d)
    return tree.unexpected_changes(a, t, a.where("endswith(path, '.md')").select("path"))


def _markdown(s: SparkSession, d: str) -> DataFrame:
    src = "concat('---\\nname: x\\ndescription: d\\n---\\n# T', doc_id, '\\n```py\\n# no\\n```\\nuse --fast and SUBTITLE_X', CASE WHEN doc_id % 7 = 0 THEN '\\n## more' ELSE '' END)"
    tgt = "CASE doc_id % 6 WHEN 0 THEN replace(s, '--fast', '') WHEN 1 THEN s WHEN 2 THEN replace(s, '# T', '## T') WHEN 3 THEN concat(s, '\\n```') WHEN 4 THEN replace(s, 'description', 'desc') ELSE replace(s, 'use', 'nimm') END"
    return table(s, d, "documents").select(F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('a/x/SKILL.md') ELSE concat('a/', doc_id, '.md') END").alias("path"), "doc_id", F.expr(src).alias("s")).select("doc_id", "path", F.col("s").alias("source"), F.expr(tgt).alias("target"))


@query("f17_validate_translation", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'lost options' WHEN 1 THEN 'untranslated' WHEN 2 THEN 'structure' WHEN 3 THEN 'unclosed fence' WHEN 4 THEN 'front matter' END AS defect FROM documents")
def f17(s, d):
    m = _markdown(s, d)
    keyed = m.withColumn("path", F.expr("CASE WHEN endswith(path, 'SKILL.md') THEN concat(doc_id, '/x/SKILL.md') ELSE path END"))
    return keyed.select("doc_id", "path").join(tree.validate_translations(keyed), "path").select("doc_id", "defect")


@query("f16_structure", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '1,2' ELSE '1' END AS headings, 'py' AS fences FROM documents")
def f16(s, d):
    return _markdown(s, d).select("doc_id", tree.structure_column(F.col("source")).alias("x")).select("doc_id", F.array_join(F.transform("x.headings", lambda h: h.cast("string")), ",").alias("headings"), F.array_join("x.fences", ",").alias("fences"))


@query("a15_content_keys", f"WITH {ZH} SELECT cue_id, sha1(concat_ws(chr(31), 'engine', language, text))[1:16] AS key FROM z")
def a15(s, d):
    return zh_text(s, d).select("cue_id", tasks.content_key([F.lit("engine"), F.col("language"), F.col("text")]).alias("key"))


@query("f12_normal")
def f12(s, d):
    from cuegrid.operators.diff import squeeze
    from cuegrid.operators.matching import normal

    return table(s, d, "documents").select("doc_id", F.length(normal(F.col("text"))).alias("said"), F.length(squeeze(F.coalesce("text", F.lit("")))).alias("chars"))


@query("f4_flat_sentences")
def f4(s, d):
    from cuegrid.operators.segment import sentences_of_flat

    c = _chinese(s, d).where("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    stamps = F.expr("transform(sequence(0, 1 + CAST(cue_id % 9 AS INT)), i -> named_struct('s', start_ms + i * 100, 'e', start_ms + i * 100 + 90))")
    return sentences_of_flat(c.withColumn("rec_id", F.concat_ws("/", "rec_id", "cue_id")).withColumn("stamps", stamps))
