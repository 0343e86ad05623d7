"""Queries over reports and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations
from ..operators import reports as R
from ..sources import tables as T

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT round(avg(l_quantity), 2) AS avg_wer_pct, round(avg(l_discount * 100), 2) AS avg_cer_pct, round(max(l_quantity), 2) AS max_wer_pct, CASE WHEN avg(l_quantity) <= 20 THEN 'ACCEPT' ELSE 'REJECT' END AS verdict FROM lineitem")
def agg16_bench_summary(spark, d):
    return R.bench_summary(T.table(spark, d, "lineitem").select(F.col("l_quantity").alias("wer_pct"), (F.col("l_discount") * 100).alias("cer_pct")), 20)


@query("""SELECT o_orderpriority AS relation, count(*) AS peers, (SELECT round(avg(o_totalprice / 500000), 2) FROM orders) AS mean_confidence, (SELECT count(*) FROM orders WHERE o_totalprice / 500000 < 0.4) AS unsure FROM orders GROUP BY 1""")
def mx23_relation_report(spark, d):
    return R.relation_report(T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("relation"), (F.col("o_totalprice") / 500000).alias("confidence")), 0.4)


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 AND coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END, 0) >= 3""")
def mx25_eligible(spark, d):
    k = F.col("o_orderkey")
    s = T.table(spark, d, "orders").select(k.alias("id"), F.when(F.col("o_orderstatus") != "P", "both_agreed").alias("consent_status"), F.when(k % 3 > 0, "approved").otherwise("open").alias("review_status"), F.when(k % 4 == 0, "x").alias("session_topic_summary"), F.when(k % 5 > 0, k % 7).alias("utterance_count"))
    return R.eligible(s).select("id")


@query("""WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 3 > 0) AS v FROM orders GROUP BY 1)
 SELECT c_custkey AS session_id, v AS auto_label, CASE WHEN c_custkey % 2 = 0 THEN 'm1' END AS pii_mask, 'large' AS stt, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS duration FROM customer LEFT JOIN f ON o_custkey = c_custkey""")
def js2_run_records(spark, d):
    k = F.col("c_custkey")
    results = T.table(spark, d, "customer").select(k.alias("session_id"), k.alias("task_id"), F.when(k % 5 > 0, F.col("c_acctbal")).cast("double").alias("duration_seconds"), F.when(k % 2 == 0, "m1").alias("pii_mask_version"))
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("index"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).otherwise("").alias("auto_label_model_version"))
    r = R.run_records(results, o, stt="large")
    return r.select("session_id", "model_versions.auto_label", "model_versions.pii_mask", "model_versions.stt", F.try_element_at("audio_info", F.lit("duration_sec")).alias("duration"))


_HASHED = "('0x' || left(md5({k} || ':42'), 15))::BIGINT"


@query(f"""WITH c AS (SELECT c_custkey, {_HASHED.format(k="c_custkey")} AS h FROM customer)
 SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY h % 65536, h, c_custkey) <= greatest(1, floor((SELECT count(*) FROM c) * 0.1)) THEN 'val' ELSE 'train' END AS part FROM c""")
def set14_sampled_split(spark, d):
    return R.sampled_split(T.table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query(f"""WITH s AS (SELECT DISTINCT conv_id, conv_id % 3 AS label, {_HASHED.format(k="conv_id")} AS h FROM conversations),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h % 65536, h, conv_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM s) SELECT conv_id, label FROM r WHERE r <= (SELECT min(n) FROM r)""")
def mx19_segment_holdout(spark, d):
    s = T.table(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 3).alias("label")).distinct()
    return relations.balanced(s, "label", "conv_id")


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
 SELECT 'A' || CASE i % 3 WHEN 0 THEN '가' WHEN 1 THEN '나' ELSE '다' END || ' ' || o_orderkey AS text, CASE i % 3 WHEN 0 THEN '20대' WHEN 1 THEN '30대' ELSE '40대' END AS age_group, 'dummy' AS source FROM o""")
def mx28_dummy_rows(spark, d):
    """One row of the templates for each order, in turn."""
    o = T.table(spark, d, "orders").select("o_orderkey")
    return R.dummy_rows(o, "o_orderkey", [("A가", "20대"), ("A나", "30대"), ("A다", "40대")], "age_group")


@query("""SELECT event_id AS id, event_id % 3 AS masked, CASE event_id % 4 WHEN 0 THEN '김현정' WHEN 1 THEN '010-1234-5678' WHEN 2 THEN '김현정|01012345678|900101-1234567' ELSE '' END AS suspects FROM events""")
def mx16_review_sheet(spark, d):
    k = F.col("event_id")
    said = F.get(F.array(*map(F.lit, ("김현정이 왔다", "전화 010-1234-5678", "김현정 01012345678 900101-1234567", "현정아 02-123-4567"))), (k % 4).cast("int"))
    u = T.table(spark, d, "events").select(k.alias("id"), F.concat(F.repeat(F.lit("[PII_이름] "), (k % 3).cast("int")), said).alias("text"))
    return R.review_sheet(u).select("id", "masked", F.array_join("suspects", "|").alias("suspects"))


@query("""WITH g AS (SELECT conv_id, max(contains(text, 'the ')::INT) + max(contains(text, 'and ')::INT) + max(contains(text, 'der ')::INT) >= 2 AS ok FROM conversations GROUP BY conv_id)
 SELECT conv_id AS session_id, turn AS idx, CASE WHEN ok THEN replace(text, 'th', 'TH') ELSE text END AS text, CASE WHEN ok THEN 'TH' ELSE 'th' END AS word, CASE WHEN ok THEN len(regexp_extract_all(text, 'th')) ELSE 0 END AS n FROM conversations JOIN g USING (conv_id)""")
def fn37_corrected_by_domain(spark, d):
    s = T.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "text", F.array(F.lit("th")).alias("words"))
    return R.corrected_by_domain(s, [("th", "TH")], ["the ", "and ", "der "], 2).select("session_id", "idx", "text", F.col("words")[0].alias("word"), "n")


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value ELSE 0 END AS start, value AS end, event_type AS text, CASE WHEN event_id % 4 > 0 THEN 'S' || (user_id % 3) ELSE '?' END AS speaker FROM events WHERE event_id % 5 > 0""")
def mx20_result_segments(spark, d):
    k = F.col("event_id")
    e = T.table(spark, d, "events").select(k, F.when(k % 3 > 0, F.col("value")).alias("start"), F.col("value").alias("end"), F.when(k % 5 > 0, F.concat(F.lit(" \t"), "event_type", F.lit("\n"))).otherwise(" ").alias("text"), F.when(k % 4 > 0, F.concat(F.lit("S"), F.col("user_id") % 3)).otherwise("").alias("speaker"))
    return R.result_segments(e)
