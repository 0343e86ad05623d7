"""Queries over row cleaning, lookups, metrics, ladders, splits and small sequence rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N
from ..functions import pii as P
from ..operators import clustering
from ..operators import intervals as I
from ..operators import sequences as S
from ..sources import tables as T
from . import rules

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_r2 = lambda x: f"round_even(({x}) * 100, 0) / 100"


@query(f"""WITH {T.SQL_WORDS}, k AS (SELECT *, CASE WHEN word_idx % 6 = 0 THEN NULL ELSE end_sec END AS e FROM words)
 SELECT session_id, {_r2('min(start_sec)')} AS start_sec, {_r2('max(end_sec)')} AS end_sec, count(e) AS n_words, round(sum({_r2('e')}), 2) AS ends FROM k GROUP BY session_id""")
def prj1_clean_segments(spark, d):
    k = T.words(spark, d).withColumn("e", F.when(F.col("word_idx") % 6 != 0, F.col("end_sec")))
    seg = k.groupBy("session_id").agg(F.min("start_sec").alias("s"), F.max("end_sec").alias("z"), F.collect_list(F.struct("word_idx", "start_sec", F.col("e").alias("end_sec"))).alias("words"))
    clean = F.transform(F.filter("words", lambda w: w["start_sec"].isNotNull() & w["end_sec"].isNotNull()), lambda w: N.round2(w["end_sec"]))
    return seg.select("session_id", N.round2(F.col("s")).alias("start_sec"), N.round2(F.col("z")).alias("end_sec"), F.size(clean).cast("long").alias("n_words"), F.round(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x), 2).alias("ends"))


@query(f"WITH {T.SQL_WORDS} SELECT session_id, word_idx, start_sec + 30.0 * (word_idx % 4) AS absolute FROM words")
def prj4_absolute_times(spark, d):
    return T.words(spark, d).select("session_id", "word_idx", (F.col("start_sec") + 30.0 * (F.col("word_idx") % 4)).alias("absolute"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'None' WHEN 1 THEN ' none ' WHEN 2 THEN NULL ELSE event_type END AS given FROM events)
 SELECT event_id, CASE WHEN lower(trim(given)) = 'none' THEN NULL ELSE given END AS speaker, event_id % 5 > 2 AS human FROM s""")
def prj8_speaker_ids(spark, d):
    k = F.col("event_id") % 5
    given = F.when(k == 0, "None").when(k == 1, " none ").when(k > 2, F.col("event_type"))
    e = T.table(spark, d, "events").select("event_id", rules.speaker_id(given).alias("speaker"))
    return e.withColumn("human", rules.is_human(F.col("speaker")))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' OR l_linestatus = 'F' THEN NULL ELSE l_quantity END AS intervals FROM lineitem""")
def prj11_strip_curated(spark, d):
    curated = (F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "F")
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(~curated, F.col("l_quantity")).alias("intervals"))


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS} SELECT w.session_id, w.word_idx, string_agg(CAST(t.turn_idx AS VARCHAR), ',' ORDER BY t.turn_idx) AS touching
 FROM spoken w JOIN turns t ON w.session_id = t.session_id AND w.start_sec <= t.end_sec AND w.end_sec >= t.start_sec GROUP BY ALL""")
def jn4_attach_overlaps(spark, d):
    on = (F.col("start_sec") <= F.col("r_end")) & (F.col("end_sec") >= F.col("r_start"))
    met = I.overlap_join(T.spoken(spark, d), I.as_right(T.turns(spark, d), ["session_id"]), ["session_id"], on)
    return met.groupBy("session_id", "word_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r_turn_idx")), lambda x: x.cast("string")), ",").alias("touching"))


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS}, j AS (SELECT w.session_id, w.word_idx, t.turn_idx, t.speaker, w.start_sec BETWEEN t.start_sec AND t.end_sec AS inside, abs(t.start_sec - w.start_sec) AS dist FROM spoken w LEFT JOIN turns t USING (session_id))
 SELECT session_id, word_idx, arg_min(speaker, struct_pack(a := CASE WHEN inside THEN 0 ELSE 1 END, b := CASE WHEN inside THEN 0.0 ELSE dist END, c := turn_idx)) AS turn_speaker FROM j GROUP BY ALL""")
def jn20_turn_or_nearest(spark, d):
    turns = T.turns(spark, d)
    points = T.spoken(spark, d).select("session_id", F.col("word_idx").cast("long").alias("word_idx"), F.col("start_sec").alias("at"))
    right = I.as_right(turns, ["session_id"])
    inside = I.first_inside(points, right, "word_idx", "r_turn_idx", "r_speaker")
    near = I.nearest_start(points, right.withColumnRenamed("r_turn_idx", "turn_idx"), "word_idx", "turn_idx").join(turns.select("session_id", "turn_idx", "speaker"), ["session_id", "turn_idx"], "left")
    return inside.join(near.select("session_id", "word_idx", "speaker"), ["session_id", "word_idx"]).select("session_id", "word_idx", F.coalesce("r_speaker", "speaker").alias("turn_speaker"))


@query("""SELECT source, count(*) FILTER (WHERE regexp_matches(text, '[A-Z][0-9]{8}')) AS passports, sum(len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'))) AS emails FROM documents GROUP BY source""")
def agg1_pii_by_source(spark, d):
    email = F.regexp_count("text", F.lit(P.RULES[4][1]))
    return T.table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("text").rlike(P.RULES[2][1])).alias("passports"), F.sum(email).alias("emails"))


@query("""SELECT conv_id, round(count(*) FILTER (WHERE role <> 'assistant') / count(*), 6) AS ratio FROM conversations GROUP BY conv_id""")
def agg11_ratio(spark, d):
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.count_if(F.col("role") != "assistant") / F.count("*"), 6).alias("ratio"))


@query("""SELECT sum(l_quantity) AS words, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS wer, round(avg(l_tax), 6) AS der, CASE WHEN count(*) FILTER (WHERE l_returnflag <> 'A') = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*) FILTER (WHERE l_returnflag <> 'A'), 6) END AS recall FROM lineitem""")
def agg15_grader_totals(spark, d):
    masked, all_ = F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_returnflag") != "A")
    return T.table(spark, d, "lineitem").agg(F.sum("l_quantity").alias("words"), F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("wer"), F.round(F.avg("l_tax"), 6).alias("der"), F.when(all_ == 0, 1.0).otherwise(F.round(masked / F.when(all_ > 0, all_), 6)).alias("recall"))


@query("SELECT event_type, round(avg(CASE WHEN value > 10 THEN value END), 6) AS rtf, max(value) AS peak FROM events GROUP BY event_type")
def agg17_positive_mean(spark, d):
    return T.table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 10, F.col("value"))), 6).alias("rtf"), F.max("value").alias("peak"))


@query()
def agg20_permutation_accuracy(spark, d):
    e = T.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("a"), (F.pmod(F.col("label") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0), F.lit(10))).cast("string").alias("b"))
    return spark.createDataFrame([(round(clustering.permutation_accuracy(e, "a", "b"), 6),)], "accuracy double")


@query("""WITH n AS (SELECT label, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS same, lead(embedding) OVER (ORDER BY vec_id) AS nxt, lead(label) OVER (ORDER BY vec_id) AS nl FROM embeddings),
 c AS (SELECT CASE WHEN same IS NOT NULL THEN list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(same AS DOUBLE[])) END AS s, CASE WHEN nl <> label THEN list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(nxt AS DOUBLE[])) END AS o FROM n)
 SELECT round((avg(CASE WHEN s < 0.25 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END) + avg(CASE WHEN o >= 0.25 THEN 1.0 WHEN o IS NOT NULL THEN 0.0 END)) / 2, 6) AS eer FROM c""")
def agg27_error_rate(spark, d):
    e = T.table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("nl"), F.col("embedding").alias("nxt"))
    n = e.withColumn("same", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).join(nxt, "vec_id", "left")
    s = F.when(F.col("same").isNotNull(), N.cosine(F.col("embedding"), F.col("same")))
    o = F.when(F.col("nl") != F.col("label"), N.cosine(F.col("embedding"), F.col("nxt")))
    miss, false = F.avg(F.when(s < 0.25, 1.0).when(s.isNotNull(), 0.0)), F.avg(F.when(o >= 0.25, 1.0).when(o.isNotNull(), 0.0))
    return n.agg(F.round((miss + false) / 2, 6).alias("eer"))


@query("""SELECT s_nationkey, s_suppkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier) WHERE rn <= 2""")
def top2_capped_pairs(spark, d):
    return S.top_per(T.table(spark, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 2).select("s_nationkey", "s_suppkey", "rn")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice / 500000 AS confidence, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders), t AS (SELECT * FROM r WHERE rn <= 3),
 p AS (SELECT o_custkey, coalesce(min(rn) FILTER (WHERE confidence >= 0.7), max(rn)) AS pick FROM t GROUP BY o_custkey) SELECT t.o_custkey, t.o_orderkey, rn FROM t JOIN p ON t.o_custkey = p.o_custkey AND rn = pick""")
def top4_ladder(spark, d):
    t = S.top_per(T.table(spark, d, "orders").withColumn("confidence", F.col("o_totalprice") / 500000), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    p = t.groupBy("o_custkey").agg(F.coalesce(F.min(F.when(F.col("confidence") >= 0.7, F.struct("rn", "o_orderkey"))), F.max(F.struct("rn", "o_orderkey"))).alias("b"))
    return p.select("o_custkey", F.col("b.o_orderkey").alias("o_orderkey"), F.col("b.rn").alias("rn"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'failed' WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01' THEN 'expired' ELSE 'kept' END AS fate FROM orders""")
def top7_expiry(spark, d):
    s, at = F.col("o_orderstatus"), F.col("o_orderdate")
    before = lambda y: at < F.to_timestamp_ntz(F.lit(y))
    return T.table(spark, d, "orders").select("o_orderkey", F.when((s == "P") & before("1996-01-01 00:00:00"), "failed").when((s == "F") & before("1995-01-01 00:00:00"), "expired").otherwise("kept").alias("fate"))


@query("SELECT p_brand AS suggestion, count(*) AS hits FROM part WHERE p_size > 25 GROUP BY p_brand HAVING count(*) >= 3")
def top8_suggestions(spark, d):
    return T.table(spark, d, "part").where("p_size > 25").groupBy(F.col("p_brand").alias("suggestion")).agg(F.count("*").alias("hits")).where("hits >= 3").orderBy(F.desc("hits"), "suggestion")


@query("SELECT 'src0_' || s_suppkey AS speaker, s_acctbal AS v FROM supplier UNION ALL SELECT 'src1_' || c_custkey, c_acctbal FROM customer")
def set4_prefixed_union(spark, d):
    a = T.table(spark, d, "supplier").select(F.concat(F.lit("src0_"), "s_suppkey").alias("speaker"), F.col("s_acctbal").alias("v"))
    return a.union(T.table(spark, d, "customer").select(F.concat(F.lit("src1_"), "c_custkey"), "c_acctbal"))


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS latest_run_id, count(*) AS runs FROM orders GROUP BY o_custkey")
def snk3_latest_run(spark, d):
    return T.table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("latest_run_id"), F.count("*").alias("runs"))


@query("""SELECT c_custkey, upper(c_mktsegment) AS old_label, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE 'CREDIT' END AS new_label FROM customer WHERE upper(c_mktsegment) <> CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE 'CREDIT' END""")
def snk8_delta(spark, d):
    c = T.table(spark, d, "customer").select("c_custkey", F.upper("c_mktsegment").alias("old_label"), F.when(F.col("c_acctbal") < 0, "DEBT").otherwise("CREDIT").alias("new_label"))
    return c.where("old_label <> new_label")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
 SELECT user_id, event_type AS status, event_type = 'signup' AS claimable FROM e WHERE rn = 1""")
def src2_claims(spark, d):
    last = T.table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("status"))
    return last.withColumn("claimable", F.col("status") == "signup")


@query()
def seq27_split_points(spark, d):
    return rules.split_points(T.words(spark, d), 60.0, 10.0)


@query(f"WITH {T.SQL_WORDS} SELECT session_id, word_idx, row_number() OVER (PARTITION BY session_id ORDER BY floor(start_sec / 60), word_idx) - 1 AS global_index FROM words")
def seq29_global_index(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.floor(F.col("start_sec") / 60), "word_idx")
    return T.words(spark, d).select("session_id", "word_idx", (F.row_number().over(w) - 1).alias("global_index"))


@query("""SELECT conv_id, contains(t, 'the ')::INT + contains(t, 'der ')::INT + contains(t, 'que ')::INT >= 2 AS in_domain FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)""")
def fn34_domain(spark, d):
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ")
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(t.alias("t")).select("conv_id", L.in_domain(F.col("t"), ["the ", "der ", "que "], 2).alias("in_domain"))


@query("""SELECT doc_id, len(regexp_extract_all(text, 'the')) AS n, replace(text, 'the', 'THE') AS text FROM documents""")
def fn36_corrections(spark, d):
    return T.table(spark, d, "documents").select("doc_id", L.corrected(F.col("text"), [("the", "THE")]).alias("c")).select("doc_id", F.col("c.n").alias("n"), F.col("c.text").alias("text"))


@query("SELECT event_id, CASE WHEN k BETWEEN 10 AND 59 THEN '부정' WHEN k BETWEEN 60 AND 69 THEN '긍정' END AS emotion, CASE WHEN k < 30 THEN '20s' WHEN k < 40 THEN '30s' WHEN k < 50 THEN '40s' ELSE '50s+' END AS age FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)")
def fn46_emotion_and_age(spark, d):
    k = F.from_json("props", "k int")["k"]
    return T.table(spark, d, "events").select("event_id", L.emotion_of_code(F.concat(F.lit("E"), k)).alias("emotion"), L.age_range(k.cast("string")).alias("age"))


@query("""SELECT item_id, trim(regexp_replace(regexp_replace(text, '[^0-9A-Za-z<> ]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm, lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS chars FROM benchmark""")
def fn55_normalized(spark, d):
    return T.table(spark, d, "benchmark").select("item_id", rules.graded(F.col("text")).alias("norm"), rules.bare(F.col("text")).alias("chars"))


@query()
def lm4_rescoring(spark, d):
    return rules.rescored_conversations(T.table(spark, d, "conversations"))


@query(f"""WITH {T.SQL_WORDS} SELECT session_id, word_idx, start_sec - greatest(0, 0.7 - (end_sec - start_sec)) / 2 AS a, end_sec + greatest(0, 0.7 - (end_sec - start_sec)) / 2 AS b FROM words""")
def mx5_centre_expanded(spark, d):
    more = F.greatest(F.lit(0.0), 0.7 - (F.col("end_sec") - F.col("start_sec"))) / 2
    return T.words(spark, d).select("session_id", "word_idx", (F.col("start_sec") - more).alias("a"), (F.col("end_sec") + more).alias("b"))


@query(f"WITH {T.SQL_WORDS} SELECT session_id, speaker, arg_max(end_sec, word_idx) - arg_min(start_sec, word_idx) AS duration FROM words GROUP BY ALL")
def mx11_duration(spark, d):
    return T.words(spark, d).groupBy("session_id", "speaker").agg((F.max(F.struct("word_idx", "end_sec"))["end_sec"] - F.min(F.struct("word_idx", "start_sec"))["start_sec"]).alias("duration"))


@query("SELECT conv_id, count(*) AS n_lines FROM conversations WHERE length(text) >= 2 GROUP BY conv_id HAVING count(*) >= 3")
def mx18_long_enough(spark, d):
    return T.table(spark, d, "conversations").where(F.length("text") >= 2).groupBy("conv_id").agg(F.count("*").alias("n_lines")).where("n_lines >= 3")


@query("SELECT o_orderkey, epoch(TIMESTAMP '2002-01-01' - o_orderdate) AS waited FROM orders WHERE o_orderstatus = 'P'")
def dt2_elapsed(spark, d):
    now = F.to_timestamp_ntz(F.lit("2002-01-01 00:00:00"))
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return T.table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", (sec(now) - sec(F.col("o_orderdate"))).alias("waited"))


@query("""WITH e AS (SELECT vec_id, vec_id % 9 = 0 AS z, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS c FROM embeddings)
 SELECT vec_id, CASE WHEN z THEN 1.0 ELSE c END AS zero_one, CASE WHEN NOT z THEN c END AS zero_null FROM e""")
def vec1_zero_norm(spark, d):
    e, zero = F.col("embedding"), F.col("vec_id") % 9 == 0
    other = F.when(zero, F.transform(e, lambda x: x * 0)).otherwise(F.reverse(e))
    return T.table(spark, d, "embeddings").select("vec_id", F.round(N.cosine(e, other, 1.0), 6).alias("zero_one"), F.round(N.cosine(e, other, None, 1e-9), 6).alias("zero_null"))


@query()
def vec7_recluster(spark, d):
    e = T.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("session_id"), F.col("vec_id").alias("window_idx"), "embedding")
    return clustering.reclustered(e)


@query("SELECT event_id, CASE WHEN f0 < 165 THEN 'male' ELSE 'female' END AS gender, CASE WHEN f0 < 165 THEN CASE WHEN f0 > 130 THEN '20대' WHEN f0 > 110 THEN '30대' WHEN f0 > 95 THEN '40대' ELSE '50대+' END ELSE CASE WHEN f0 > 220 THEN '20대' WHEN f0 > 195 THEN '30대' WHEN f0 > 175 THEN '40대' ELSE '50대+' END END AS age FROM (SELECT event_id, 80 + value AS f0 FROM events)")
def dz7_gender_and_age(spark, d):
    f0 = 80 + F.col("value")
    return T.table(spark, d, "events").select("event_id", L.gender(f0).alias("gender"), L.voice_age(f0, F.lit(1.0)).alias("age"))


@query(f"WITH {T.SQL_WORDS} SELECT session_id, CASE WHEN max(end_sec) - min(start_sec) <= 110 THEN 'full' ELSE 'anchor' END AS route FROM words GROUP BY session_id")
def dz2_router(spark, d):
    return T.words(spark, d).groupBy("session_id").agg(F.when(F.max("end_sec") - F.min("start_sec") <= 110, "full").otherwise("anchor").alias("route"))


@query("SELECT event_id, 2 * (value / 500) - 1 AS valence FROM events")
def md13_valence(spark, d):
    return T.table(spark, d, "events").select("event_id", L.valence(F.col("value") / 500).alias("valence"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 12 THEN 'failed' ELSE 'running' END AS status FROM events GROUP BY user_id")
def st3_sweep(spark, d):
    n = F.count_if(F.col("event_type") == "error")
    return T.table(spark, d, "events").groupBy("user_id").agg(n.alias("failures"), F.when(n >= 12, "failed").otherwise("running").alias("status"))
