"""Queries over aggregations, top-k, sets, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pii
from ..operators import graph, relations
from ..operators import sequences as S
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


@query(f"WITH {T.SQL_WORDS} SELECT session_id, speaker, count(*) AS n_words, round(sum(end_sec - start_sec) FILTER (WHERE end_sec > start_sec), 4) AS seconds FROM words GROUP BY ALL")
def agg4_speech_seconds(spark, d):
    dur = F.when(F.col("end_sec") > F.col("start_sec"), F.col("end_sec") - F.col("start_sec"))
    return T.words(spark, d).groupBy("session_id", "speaker").agg(F.count("*").alias("n_words"), F.round(F.sum(dur), 4).alias("seconds"))


@query("""SELECT event_type AS source, split_part(event_type, 'e', 1) AS prefix, count(*) AS n FROM events GROUP BY ALL""")
def agg3_source_distribution(spark, d):
    return T.table(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.split_part("event_type", F.lit("e"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_id, greatest(0, least(100, round_even(100 - abs(value - 50), 0))) AS score FROM events)
 SELECT event_id, CAST(score AS INT) AS score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 50 THEN 'B' ELSE 'C' END AS grade FROM s""")
def agg5_quality_grade(spark, d):
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(100 - F.abs(F.col("value") - 50)))).cast("int")
    return T.table(spark, d, "events").select("event_id", score.alias("score")).withColumn("grade", F.when(F.col("score") >= 80, "A").when(F.col("score") >= 50, "B").otherwise("C"))


@query("SELECT conv_id, count(DISTINCT role) AS speakers, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY conv_id")
def agg6_speaker_count(spark, d):
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("speakers"), F.count_if(F.col("role") == "user").alias("n_user"))


@query(f"""WITH {T.SQL_WORDS}, s AS (SELECT session_id, speaker, round(sum(end_sec - start_sec), 4) AS seconds, min(word_idx) AS first FROM words GROUP BY ALL)
 SELECT session_id, speaker AS self_speaker, seconds FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seconds DESC, first) AS rn FROM s) WHERE rn = 1""")
def agg8_longest_speaker(spark, d):
    s = T.words(spark, d).groupBy("session_id", "speaker").agg(F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 4).alias("seconds"), F.min("word_idx").alias("first"))
    best = s.groupBy("session_id").agg(F.min(F.struct((-F.col("seconds")).alias("m"), "first", "speaker", "seconds")).alias("b"))
    return best.select("session_id", F.col("b.speaker").alias("self_speaker"), F.col("b.seconds").alias("seconds"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL)
 SELECT o_custkey, v AS majority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1""")
def agg9_majority(spark, d):
    c = T.table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("v")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    best = c.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "v", "n")).alias("b"))
    return best.select("o_custkey", F.col("b.v").alias("majority"), F.col("b.n").alias("n"))


# call relations of a customer: the order's priority stands for the relation, with one reciprocal pair
_RELATION = "CASE o_orderpriority WHEN '1-URGENT' THEN '부모' WHEN '2-HIGH' THEN '자녀' WHEN '3-MEDIUM' THEN '친구' WHEN '4-NOT SPECIFIED' THEN '기타' END"


@query(f"""WITH r AS (SELECT o_custkey AS peer_id, {_RELATION} AS rel, o_orderkey AS call FROM orders),
 v AS (SELECT * FROM r WHERE rel IS NOT NULL AND rel <> '기타'),
 c AS (SELECT peer_id, rel, count(*) AS n, min(call) AS first FROM v GROUP BY ALL),
 m AS (SELECT peer_id, CASE WHEN rel IN ('부모', '자녀') THEN '부모' ELSE rel END AS rel, sum(n) AS n, min(first) AS first FROM c GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY n DESC, first) AS rk, count(*) OVER (PARTITION BY peer_id) AS kinds, sum(n) OVER (PARTITION BY peer_id) AS total FROM m),
 raw AS (SELECT peer_id, rel FROM (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY n DESC, first) AS rk FROM c) WHERE rk = 1),
 t AS (SELECT peer_id, max(CASE WHEN rk = 1 THEN rel END) AS top, max(CASE WHEN rk = 1 THEN n END) AS n1, coalesce(max(CASE WHEN rk = 2 THEN n END), 0) AS n2, any_value(kinds) AS kinds, any_value(total) AS total FROM k GROUP BY peer_id)
 SELECT p.peer_id, CASE WHEN kinds = 1 THEN raw.rel WHEN n1 >= 2 AND n1 >= 2 * n2 THEN top END AS relation,
  CASE WHEN kinds IS NULL THEN 0.0 WHEN kinds = 1 AND total >= 2 THEN round(least(0.95, 0.6 + 0.1 * CAST(total AS DOUBLE)), 2) WHEN kinds = 1 THEN 0.5 WHEN n1 >= 2 AND n1 >= 2 * n2 THEN round(least(0.9, 0.5 + CAST(n1 AS DOUBLE) / CAST(total AS DOUBLE) * 0.4), 2) ELSE 0.0 END AS confidence,
  CASE WHEN kinds IS NULL THEN 'no_signal' WHEN kinds = 1 AND total >= 2 THEN 'cross_call_consistent' WHEN kinds = 1 THEN 'single_call' WHEN n1 >= 2 AND n1 >= 2 * n2 THEN 'cross_call_dominant' ELSE 'conflict' END AS source
 FROM (SELECT DISTINCT peer_id FROM r) p LEFT JOIN t USING (peer_id) LEFT JOIN raw USING (peer_id)""")
def agg10_peer_relation(spark, d):
    p = F.col("o_orderpriority")
    rel = F.when(p == "1-URGENT", "부모").when(p == "2-HIGH", "자녀").when(p == "3-MEDIUM", "친구").when(p == "4-NOT SPECIFIED", "기타")
    return relations.consolidated(T.table(spark, d, "orders").select(F.col("o_custkey").alias("peer_id"), rel.alias("relation"), F.col("o_orderkey").alias("call")))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY grouping(l_linestatus), CASE WHEN grouping(l_linestatus) = 0 THEN l_linestatus END), 4) AS pct
 FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))""")
def agg12_distribution(spark, d):
    g = T.table(spark, d, "lineitem").groupingSets([["l_returnflag"], ["l_returnflag", "l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_linestatus").alias("g"))
    whole = F.sum("n").over(Window.partitionBy("g", "l_linestatus"))
    return g.select("l_returnflag", "l_linestatus", "n", F.round(F.col("n") * 100.0 / whole, 4).alias("pct"))


@query("SELECT c_mktsegment AS label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 4) AS pct FROM customer GROUP BY 1")
def agg13_counts(spark, d):
    c = T.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query("SELECT conv_id, role, count(*) AS n_utterances, sum(len(list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> ''))) AS n_words FROM conversations GROUP BY ALL")
def agg18_speaker_stats(spark, d):
    n = F.size(F.filter(F.split("text", "[ \n\t\r]+"), lambda t: t != ""))
    return T.table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n_utterances"), F.sum(n).alias("n_words"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def agg19_label_histogram(spark, d):
    return T.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("WITH r(rule_idx, type, pattern) AS (VALUES " + ", ".join(f"({i}, '{label}', '{pattern}')" for i, (label, pattern) in enumerate((*pii.RULES, *pii.CANDIDATES))) + """)
 SELECT lang, rule_idx, type, count(*) FILTER (WHERE regexp_matches(text, pattern)) AS n FROM documents, r GROUP BY ALL""")
def agg21_pattern_coverage(spark, d):
    """In how many texts of each language each rule and each candidate has a match."""
    rules = (*pii.RULES, *pii.CANDIDATES)
    hits = [F.count_if(F.coalesce(F.col("text"), F.lit("")).rlike("(?U)" + pattern)).alias(f"n{i}") for i, (_, pattern) in enumerate(rules)]
    wide = T.table(spark, d, "documents").groupBy("lang").agg(*hits)
    long = F.array(*(F.struct(F.lit(i).alias("rule_idx"), F.lit(label).alias("type"), F.col(f"n{i}").alias("n")) for i, (label, _) in enumerate(rules)))
    return wide.select("lang", F.explode(long).alias("r")).select("lang", "r.*")


@query("""WITH h AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS hits FROM documents WHERE regexp_matches(text, '[0-9]{6}')),
 n AS (SELECT source, count(*) AS total FROM documents GROUP BY source)
 SELECT n.source, coalesce(max(hits), 0) AS hits, round(coalesce(max(hits), 0) * 100.0 / max(total), 4) AS rate_pct, coalesce(string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY doc_id) FILTER (WHERE rn <= 5), '') AS examples FROM n LEFT JOIN h USING (source) GROUP BY n.source""")
def agg22_candidate_hits(spark, d):
    docs = T.table(spark, d, "documents").select("source", "doc_id", F.col("text").rlike("[0-9]{6}").alias("hit"))
    totals = docs.groupBy("source").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"))
    first = S.top_per(docs.where("hit"), ["source"], [F.col("doc_id")], 5).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "|").alias("examples"))
    return totals.join(first, "source", "left").select("source", "hits", F.round(F.col("hits") * 100.0 / F.col("total"), 4).alias("rate_pct"), F.coalesce("examples", F.lit("")).alias("examples"))


@query()
def agg23_number_shapes(spark, d):
    return pii.number_shapes(T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("""WITH t AS (SELECT lang AS topic, doc_id, unnest(list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: length(x) >= 2)) AS tok FROM documents),
 c AS (SELECT topic, tok, count(*) AS n, min(doc_id) AS first FROM t GROUP BY ALL), g AS (SELECT tok, sum(n) AS gf FROM c GROUP BY tok), s AS (SELECT topic, sum(n) AS total FROM c GROUP BY topic),
 r AS (SELECT topic, tok, round((n / total) * ((SELECT count(*) FROM documents) / gf), 9) AS score, first FROM c JOIN g USING (tok) JOIN s USING (topic))
 SELECT topic, tok, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, first, tok) AS rn FROM r) WHERE rn <= 20""")
def agg24_topic_keywords(spark, d):
    docs = T.table(spark, d, "documents")
    toks = docs.select(F.col("lang").alias("topic"), "doc_id", F.explode(F.filter(F.split("text", "[ \n\t\r]+"), lambda t: F.length(t) >= 2)).alias("tok"))
    c = toks.groupBy("topic", "tok").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    s = c.groupBy("topic").agg(F.sum("n").alias("total"))
    rows = docs.agg(F.count("*").alias("rows"))
    # a token's topics are few: its counts stay together instead of being joined to their sum
    by = c.groupBy("tok").agg(F.sum("n").alias("gf"), F.collect_list(F.struct("topic", "n", "first")).alias("by"))
    r = by.select("tok", "gf", F.inline("by")).join(s, "topic").crossJoin(F.broadcast(rows))  # one row: the number of documents
    r = r.withColumn("score", F.round((F.col("n") / F.col("total")) * (F.col("rows") / F.col("gf")), 9))
    return S.top_per(r, ["topic"], [F.desc("score"), F.col("first"), F.col("tok")], 20).select("topic", "tok", "score")


@query("""WITH d AS (SELECT unnest(['F', 'O', 'P', 'X']) AS label), c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1)
 SELECT label, coalesce(round((SELECT count(*) FROM orders) / ((SELECT count(*) FROM d) * n), 6), 1.0) AS weight FROM d LEFT JOIN c USING (label)""")
def agg25_class_weights(spark, d):
    labels = spark.createDataFrame([(x,) for x in "FOPX"], "label string")
    c = T.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    c = c.withColumn("weight", F.round(total / (F.lit(4) * F.col("n")), 6)).select("label", "weight")
    return labels.join(c, "label", "left").select("label", F.coalesce("weight", F.lit(1.0)).alias("weight"))


@query("""WITH p AS (SELECT l_returnflag AS truth, CASE WHEN l_quantity > 33 THEN 'A' WHEN l_quantity > 16 THEN 'N' ELSE 'R' END AS guess FROM lineitem),
 k AS (SELECT truth AS label FROM p UNION SELECT guess FROM p),
 f AS (SELECT label, count(*) FILTER (WHERE truth = label AND guess = label) AS tp, count(*) FILTER (WHERE truth <> label AND guess = label) AS fp, count(*) FILTER (WHERE truth = label AND guess <> label) AS fn FROM p, k GROUP BY label)
 SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1, round(sum(tp) / (SELECT count(*) FROM p), 6) AS accuracy FROM f""")
def agg26_macro_f1(spark, d):
    q = F.col("l_quantity")
    guess = F.when(q > 33, "A").when(q > 16, "N").otherwise("R")
    cells = T.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("truth"), guess.alias("guess")).agg(F.count("*").alias("n"))
    side = F.explode(F.array_distinct(F.array("truth", "guess"))).alias("label")
    f = cells.select("*", side).groupBy("label").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(n) for n, c in (("tp", F.col("truth") == F.col("guess")), ("fp", (F.col("truth") != F.col("label"))), ("fn", (F.col("guess") != F.col("label"))))))
    f1 = 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    total = cells.agg(F.sum("n").alias("total"))
    return f.agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.sum("tp").alias("tp")).crossJoin(F.broadcast(total)).select("macro_f1", F.round(F.col("tp") / F.col("total"), 6).alias("accuracy"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 3")
def agg28_at_least_three(spark, d):
    return T.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 3")


@query("""WITH o AS (SELECT *, o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS held FROM orders WHERE o_orderstatus IN ('P', 'O'))
 SELECT count(*) FILTER (WHERE held) > 0 AS gpu_busy, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (WHERE held) AS current_task, count(*) FILTER (WHERE NOT held) AS queue_depth,
 round(count(*) FILTER (WHERE held) / count(*), 6) AS utilisation, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (WHERE NOT held) AS next_task FROM o""")
def agg29_queue_snapshot(spark, d):
    held = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0)
    at = F.struct("o_orderdate", "o_orderkey")
    o = T.table(spark, d, "orders").where("o_orderstatus in ('P', 'O')").withColumn("held", held)
    return o.agg((F.count_if("held") > 0).alias("gpu_busy"), F.max(F.when(F.col("held"), at))["o_orderkey"].alias("current_task"), F.count_if(~F.col("held")).alias("queue_depth"), F.round(F.count_if("held") / F.count("*"), 6).alias("utilisation"), F.min(F.when(~F.col("held"), at))["o_orderkey"].alias("next_task"))


@query(f"""WITH {T.SQL_UTTERANCES}, s AS (SELECT session_id, count(DISTINCT speaker) AS speakers, count(*) AS n FROM utterances GROUP BY ALL)
 SELECT session_id, speakers, n, CASE WHEN n = 0 THEN 'failed' WHEN speakers = 1 AND n >= 6 THEN 'requeue' ELSE 'done' END AS status FROM s""")
def agg30_completion(spark, d):
    s = T.utterances(spark, d).groupBy("session_id").agg(F.count_distinct("speaker").alias("speakers"), F.count("*").alias("n"))
    return s.withColumn("status", F.when(F.col("n") == 0, "failed").when((F.col("speakers") == 1) & (F.col("n") >= 6), "requeue").otherwise("done"))


@query(f"WITH {T.SQL_WORDS} SELECT session_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS n FROM words GROUP BY ALL")
def agg31_session_rollup(spark, d):
    return T.words(spark, d).groupBy("session_id").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count("*").alias("n"))


@query(f"""WITH {T.SQL_WORDS}, s AS (SELECT session_id, min(start_sec) AS a, max(end_sec) AS b FROM words GROUP BY ALL), e AS (SELECT session_id, speaker || '-' || (word_idx // 10) AS speaker, max(end_sec) AS last FROM words GROUP BY ALL)
 SELECT session_id, speaker FROM e JOIN s USING (session_id) WHERE last - a < 0.5 * (b - a)""")
def agg32_early_speakers(spark, d):
    """Voices that are over by half of the call: speakers with a new name after every ten words."""
    voice = F.concat("speaker", F.lit("-"), F.floor(F.col("word_idx") / 10))
    e = T.words(spark, d).withColumn("speaker", voice).groupBy("session_id", "speaker").agg(F.max("end_sec").alias("last"), F.min("start_sec").alias("first"))
    w = Window.partitionBy("session_id")
    return e.withColumn("a", F.min("first").over(w)).withColumn("b", F.max("last").over(w)).where("last - a < 0.5 * (b - a)").select("session_id", "speaker")


@query("""SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def top1_capped(spark, d):
    order = [F.desc("o_totalprice"), F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")]
    return S.top_per(T.table(spark, d, "orders"), ["o_custkey"], order, 3).select("o_custkey", "o_orderkey", "rn")


@query("SELECT event_id, CAST(value AS INT) AS score FROM events WHERE CAST(value AS INT) > 300")
def top3_review_queue(spark, d):
    return T.table(spark, d, "events").select("event_id", F.rint("value").cast("int").alias("score")).where("score > 300").orderBy(F.desc("score"))


@query(f"""WITH {T.SQL_WORDS} SELECT session_id, speaker, word_idx FROM (SELECT *, row_number() OVER (PARTITION BY session_id, speaker ORDER BY end_sec - start_sec DESC, word_idx) AS rn FROM words) WHERE rn = 1""")
def top5_longest_turn(spark, d):
    m = F.min(F.struct((F.col("start_sec") - F.col("end_sec")).alias("minus"), "word_idx"))
    return T.words(spark, d).groupBy("session_id", "speaker").agg(m.alias("b")).select("session_id", "speaker", F.col("b.word_idx").alias("word_idx"))


@query("""WITH n AS (SELECT o_orderpriority AS stratum, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
 SELECT stratum, CAST(k AS INT) AS k, o_orderkey FROM n, unnest(range(5)) AS t(k) WHERE i = CAST(floor((k + 0.5) * n / 5) AS BIGINT)""")
def top6_stratified_sample(spark, d):
    w = Window.partitionBy("stratum")
    n = T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("stratum"), "o_orderkey", "o_totalprice").withColumn("i", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")) - 1).withColumn("n", F.count("*").over(w))
    k = F.floor((F.col("i").cast("double") * 5) / F.col("n") + 0.5).cast("int")  # the only rank that can be picked at i
    hit = n.withColumn("k", F.explode(F.array_distinct(F.array(F.greatest(F.lit(0), k - 1), k))))
    return hit.where((F.col("k") < 5) & (F.col("i") == F.floor((F.col("k") + 0.5) * F.col("n") / 5))).select("stratum", "k", "o_orderkey")


@query("SELECT doc_id, sha256(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def set1_dedup_digest(spark, d):
    return T.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


@query("SELECT min(turn) AS turn, conv_id, role FROM conversations GROUP BY conv_id, role")
def set2_first_of_equal(spark, d):
    c = T.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return S.first_of_equal(c, F.struct("conv_id", "role"), ["turn"]).select("turn", "conv_id", "role")


@query("SELECT doc_id AS id, text, 'documents' AS corpus FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark UNION ALL SELECT conv_id, text, 'conversations' FROM conversations")
def set3_union(spark, d):
    parts = [T.table(spark, d, t).select(F.col(k).alias("id"), "text", F.lit(t).alias("corpus")) for t, k in (("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _labelled(spark, d):
    return T.table(spark, d, "documents").select("doc_id", "lang").join(T.table(spark, d, "labels"), "doc_id")


_HASHED = "('0x' || left(md5({k} || ':42'), 15))::BIGINT"
_BY_LANG = f"""WITH d AS (SELECT doc_id, lang, {_HASHED.format(k="doc_id")} AS h FROM documents JOIN labels USING (doc_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h % 65536, h, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM d)"""


@query(_BY_LANG + " SELECT doc_id, lang FROM r WHERE r <= (SELECT min(n) FROM r)")
def set5_balanced(spark, d):
    return relations.balanced(_labelled(spark, d), "lang", "doc_id").select("doc_id", "lang")


@query(_BY_LANG + " SELECT doc_id, lang FROM r WHERE r <= least((SELECT min(n) FROM r), 10)")
def set6_balanced_cap(spark, d):
    return relations.balanced(_labelled(spark, d), "lang", "doc_id", 10).select("doc_id", "lang")


@query(f"""WITH d AS (SELECT doc_id, lang, {_HASHED.format(k="doc_id")} AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h % 65536, h, doc_id) AS r FROM d)
 SELECT doc_id, lang FROM r WHERE lang <> 'en' OR r <= (SELECT count(*) FROM documents WHERE lang <> 'en')""")
def set7_majority_cap(spark, d):
    return relations.majority_capped(T.table(spark, d, "documents").select("doc_id", "lang"), "lang", "en", 0.5, "doc_id").select("doc_id", "lang")


@query(f"""WITH d AS (SELECT doc_id, {_HASHED.format(k="doc_id")} % 65536 AS h FROM documents)
 SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY h, doc_id) <= floor((SELECT count(*) FROM d) * 0.8) THEN 'train' ELSE 'val' END AS part FROM d""")
def set8_split(spark, d):
    return relations.split(T.table(spark, d, "documents").select("doc_id"), "doc_id", 0.2)


@query(f"""WITH g AS (SELECT source, {_HASHED.format(k="source")} AS h FROM documents GROUP BY source), r AS (SELECT source, row_number() OVER (ORDER BY h % 65536, h, source) AS r, count(*) OVER () AS n FROM g)
 SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'val' ELSE 'test' END AS part FROM documents JOIN r USING (source)""")
def set9_group_split(spark, d):
    return relations.group_split(T.table(spark, d, "documents").select("doc_id", "source"), "source", (0.8, 0.1, 0.1)).select("doc_id", "part")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || c_custkey AS u, 'n' || (c_custkey % 40) AS v FROM customer UNION SELECT DISTINCT 'n' || (c_custkey % 40), 'c' || c_custkey FROM customer),
 l AS (SELECT DISTINCT 'n' || (c_custkey % 40) AS hub, c_custkey FROM customer) SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY hub) AS root FROM l""")
def set10_components(spark, d):
    c = T.table(spark, d, "customer").select("c_custkey")
    w = Window.partitionBy(F.col("c_custkey") % 40).orderBy("c_custkey")
    edges = c.withColumn("v", F.lag("c_custkey").over(w)).select(F.col("c_custkey").alias("u"), F.coalesce("v", "c_custkey").alias("v"))
    return graph.components(edges)


@query("SELECT a.o_custkey AS custkey, a.p AS priorities, list_has_any(string_split(a.p, '|'), ['1-URGENT', '2-HIGH']) AS overlaps FROM (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS p FROM orders GROUP BY 1) a")
def set12_overlap(spark, d):
    a = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return a.select("custkey", F.array_join("p", "|").alias("priorities"), F.arrays_overlap("p", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("overlaps"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > 3 AND o_orderstatus <> 'P' AND l_shipdate < TIMESTAMP '2001-01-01' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def set13_orphans(spark, d):
    l, o, p = (T.table(spark, d, t) for t in ("lineitem", "orders", "part"))
    j = l.where("l_linenumber > 3 and l_shipdate < timestamp_ntz '2001-01-01'").join(o.where("o_orderstatus <> 'P'"), l.l_orderkey == o.o_orderkey)
    return j.join(p.where("p_size > 40"), l.l_partkey == p.p_partkey, "left_anti").select("l_orderkey", "l_linenumber")


@query("""WITH p AS (SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey FROM p ORDER BY o_orderdate, o_orderkey LIMIT 5""")
def src1_claimable(spark, d):
    return T.table(spark, d, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(5).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL AND o_totalprice > 250000")
def src3_scan(spark, d):
    return T.table(spark, d, "orders").where("o_orderstatus = 'F' and o_custkey is not null and o_totalprice > 250000").select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def snk1_upsert(spark, d):
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))
    return T.table(spark, d, "orders").groupBy("o_custkey").agg(last.alias("l")).select("o_custkey", F.col("l.o_orderkey").alias("o_orderkey"), F.col("l.o_totalprice").alias("o_totalprice"))


@query("SELECT CAST(quality AS VARCHAR) || '/' || CAST(toxic AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY ALL")
def snk5_stats(spark, d):
    return T.table(spark, d, "labels").groupBy(F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT user_id, event_type, ts, event_id FROM events WHERE event_type IN ('purchase', 'error'))
 SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM t) WHERE rn = 1""")
def st6_terminal_state(spark, d):
    t = T.table(spark, d, "events").where("event_type in ('purchase', 'error')")
    return t.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("f")).select("user_id", F.col("f.event_type").alias("status"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND value >= 10) AS retries FROM events GROUP BY user_id")
def st5_retries(spark, d):
    return T.table(spark, d, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("value") >= 10)).alias("retries"))
