"""Queries over text, personal data, vectors and user memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import pii as P
from ..functions import texts as X
from ..operators import memory, repetition
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


@query("""WITH m AS (SELECT doc_id, '이메일' AS kind, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) AS s FROM documents
 UNION ALL SELECT doc_id, '여권번호', unnest(regexp_extract_all(text, '[A-Z][0-9]{8}')) FROM documents)
 SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs, 'auto_confirmed' AS tier FROM m GROUP BY kind""")
def fn1_pii_counts(spark, d):
    rules = [r for r in P.RULES if r[0] in ("이메일", "여권번호")]
    docs = T.table(spark, d, "documents").where(P.has_pii(F.col("text"), rules))
    spans = docs.select("doc_id", F.explode(P.scored(P.pii_spans(F.col("text"), rules))).alias("s"))
    return spans.groupBy(F.col("s.type").alias("kind"), F.col("s.confidence_tier").alias("tier")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).select("kind", "n", "docs", "tier")


@query()
def fn1_pii_spans(spark, d):
    docs = T.table(spark, d, "documents").where(P.has_pii(F.col("text")))
    return docs.select("doc_id", F.explode(P.scored(P.pii_spans(F.col("text")))).alias("s")).select("doc_id", "s.*")


@query("SELECT doc_id, regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', '[PII_이메일]', 'g') AS masked FROM documents")
def fn5_mask_emails(spark, d):
    rules = [r for r in P.RULES if r[0] == "이메일"]
    return T.table(spark, d, "documents").select("doc_id", P.masked(F.col("text"), P.pii_spans(F.col("text"), rules)).alias("masked"))


@query()
def fn5_mask(spark, d):
    text = F.col("text")
    return T.table(spark, d, "documents").select("doc_id", P.masked(text).alias("masked"))


@query("""WITH c AS (SELECT event_id, round(value / 400, 2) AS confidence, event_type IN ('view', 'click') AS precise, event_type = 'error' AS ambiguous FROM events)
 SELECT event_id, CASE WHEN confidence >= 0.9 AND precise THEN 'auto_confirmed' WHEN ambiguous THEN 'needs_human_decision' WHEN confidence < 0.5 AND NOT precise THEN 'auto_rejected' ELSE 'needs_human_decision' END AS tier FROM c""")
def fn11_tiers(spark, d):
    c = F.round(F.col("value") / 400, 2)
    return T.table(spark, d, "events").select("event_id", P.tier(c, F.col("event_type").isin("view", "click"), F.col("event_type") == "error").alias("tier"))


_TOKENS = "list_filter(string_split_regex(text, '\\s+'), lambda x: regexp_matches(x, '[0-9A-Za-z]'))"


@query(f"SELECT conv_id, turn, len({_TOKENS}) AS n_tokens, round_even(len({_TOKENS}) / ((turn + 1) * 7 / 60.0) * 10, 0) / 10 AS wpm FROM conversations WHERE len({_TOKENS}) > 0")
def fn24_speech_rate(spark, d):
    c = T.table(spark, d, "conversations")
    t = F.col("text")
    return c.select("conv_id", "turn", F.size(X.tokens(t)).alias("n_tokens"), X.words_per_minute(t, (F.col("turn") + 1) * 7).alias("wpm")).where("n_tokens > 0")


@query("""SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '[0-9A-Za-z]') THEN NULL WHEN regexp_matches(text, '[A-Za-z]{2,}') THEN 'english' ELSE 'korean' END AS mix,
 CASE WHEN contains(text, '?') THEN 'yes_no' END AS question, 0 AS fillers, CAST(NULL AS VARCHAR) AS honorific FROM conversations""")
def fn28_text_labels(spark, d):
    t = F.col("text")
    return T.table(spark, d, "conversations").select("conv_id", "turn", X.language_mix(t).alias("mix"), X.question_type(t).alias("question"), X.filler_count(t).alias("fillers"), X.honorific_level(t).alias("honorific"))


@query("SELECT event_id, CASE g WHEN 'A' THEN 'excellent' WHEN 'B' THEN 'good' WHEN 'C' THEN 'fair' END AS quality FROM (SELECT event_id, upper(substr(event_type, 2, 1)) AS g FROM events UNION ALL SELECT event_id + 1000000, 'A' FROM events)")
def fn29_quality_class(spark, d):
    e = T.table(spark, d, "events")
    both = e.select("event_id", F.upper(F.substring("event_type", 2, 1)).alias("g")).union(e.select(F.col("event_id") + 1000000, F.lit("A")))
    return both.select("event_id", X.quality_class(F.col("g")).alias("quality"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z가-힣]')) AS content FROM documents")
def fn30_content_length(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.content_length(F.col("text")).alias("content"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def fn32_squeezed(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query("SELECT c_custkey, '[REDACTED:' || length(c_name) || ']' AS placeholder FROM customer")
def fn33_redacted(spark, d):
    return T.table(spark, d, "customer").select("c_custkey", X.redacted(F.col("c_name")).alias("placeholder"))


_TOPICS = [("work", ["the ", "and "]), ("home", ["der ", "die ", "das "]), ("travel", ["que ", "de la "])]


@query("""WITH k AS (SELECT doc_id, contains(text, 'the ')::INT + contains(text, 'and ')::INT AS a, contains(text, 'der ')::INT + contains(text, 'die ')::INT + contains(text, 'das ')::INT AS b, contains(text, 'que ')::INT + contains(text, 'de la ')::INT AS c FROM documents)
 SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'other' WHEN a >= b AND a >= c THEN 'work' WHEN b >= c THEN 'home' ELSE 'travel' END AS topic FROM k""")
def fn42_keyword_topic(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.keyword_argmax(F.col("text"), _TOPICS, "other").alias("topic"))


@query("SELECT event_id, CASE WHEN value < 30 THEN 'short' WHEN value < 120 THEN 'mid' ELSE 'long' END AS bucket FROM events")
def fn51_duration_bucket(spark, d):
    v = F.col("value")
    return T.table(spark, d, "events").select("event_id", F.when(v < 30, "short").when(v < 120, "mid").otherwise("long").alias("bucket"))


@query("SELECT conv_id, string_agg(role || ': ' || text, ' / ' ORDER BY role, turn) AS dialogue FROM conversations GROUP BY conv_id")
def fn52_dialogue(spark, d):
    lines = F.array_sort(F.collect_list(F.struct("role", "turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda s: s["line"]), " / ").alias("dialogue"))


@query("SELECT conv_id, left(string_agg(text, ' ' ORDER BY turn), 6000) AS transcript FROM conversations GROUP BY conv_id")
def fn53_transcript(spark, d):
    lines = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(F.left(F.array_join(F.transform(lines, lambda s: s["text"]), " "), F.lit(6000)).alias("transcript"))


@query("SELECT event_id, lpad(CAST(floor(value / 60) AS BIGINT)::VARCHAR, 2, '0') || ':' || lpad((CAST(floor(value) AS BIGINT) % 60)::VARCHAR, 2, '0') AS clock FROM events")
def fn58_clock(spark, d):
    return T.table(spark, d, "events").select("event_id", N.clock(F.col("value")).alias("clock"))


# DuckDB's distance counts bytes, so its side writes each letter beyond ASCII that the texts hold as a mark that they do not hold; distances stay the same.
_ONE_BYTE = "translate({t}, 'ÄÇÈÉÊÑÖÜßäçèéêíñóöü', '!#$%&*+/0123456789:')"
_NEXT = f"WITH n AS (SELECT item_id, {_ONE_BYTE.format(t='text')} AS a, lead({_ONE_BYTE.format(t='text')}) OVER (ORDER BY item_id) AS b FROM benchmark)"


def _pairs(spark, d):
    t = T.table(spark, d, "benchmark")
    nxt = t.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b"))
    return t.select("item_id", F.col("text").alias("a")).join(nxt, "item_id")


@query(_NEXT + " SELECT item_id, round(greatest(0, 1 - levenshtein(a, b) / length(a)), 6) AS accuracy FROM n WHERE b IS NOT NULL")
def fne1_char_accuracy(spark, d):
    return _pairs(spark, d).select("item_id", F.round(X.char_accuracy(F.col("a"), F.col("b")), 6).alias("accuracy"))


@query()
def fne2_word_accuracy(spark, d):
    return _pairs(spark, d).select("item_id", F.round(X.word_accuracy(X.all_tokens(F.col("a")), X.all_tokens(F.col("b"))), 6).alias("accuracy"))


@query(f"""SELECT sum(levenshtein(a, b)) AS errors, sum(greatest(1, length(a))) AS length, round(sum(levenshtein(a, b)) / sum(greatest(1, length(a))), 6) AS rate
 FROM (SELECT {_ONE_BYTE.format(t='x.text')} AS a, {_ONE_BYTE.format(t='y.text')} AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1)""")
def agg14_error_rate(spark, d):
    e, n = F.sum(F.levenshtein("a", "b")), F.sum(F.greatest(F.lit(1), F.length("a")))
    return _pairs(spark, d).agg(e.alias("errors"), n.alias("length")).withColumn("rate", F.round(F.col("errors") / F.col("length"), 6))


@query("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec2_cosine(spark, d):
    e = T.table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(N.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query("SELECT label, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INT) AS canonical FROM (SELECT label, min(vec_id) AS f FROM embeddings GROUP BY label)")
def vec6_canonical(spark, d):
    f = T.table(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("f"))
    return f.select("label", (F.dense_rank().over(Window.orderBy("f")) - 1).cast("int").alias("canonical"))  # one row per label


@query("SELECT event_id, round(value * pow(0.5, greatest(0, 1706745600 - epoch_us(ts) / 1e6) / (14 * 86400)), 6) AS weight FROM events")
def vec11_decay(spark, d):
    used = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return T.table(spark, d, "events").select("event_id", F.round(N.decayed(F.col("value"), used, 1706745600.0, 14), 6).alias("weight"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * l_discount * 100, 0) / 100 AS rounded FROM lineitem")
def vec13_round2(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.round2(F.col("l_extendedprice") * F.col("l_discount")).alias("rounded"))


@query("SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0) AS number FROM events")
def vec14_number(spark, d):
    s = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return T.table(spark, d, "events").select("event_id", N.number_or_zero(s).alias("number"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS finite FROM events")
def prj5_finite(spark, d):
    v = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value"))
    return T.table(spark, d, "events").select("event_id", N.finite(v).alias("finite"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def js1_json_field(spark, d):
    return T.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_PAIR_SQL = """WITH p AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN user_id + 1 ELSE user_id END AS owner, CAST(json_extract(props, '$.k') AS INT) % 7 AS confirm, CAST(json_extract(props, '$.k') AS INT) % 3 AS reject, event_id % 4 = 0 AS ctx, round(value / 100, 2) AS score FROM events)
 SELECT event_id, CASE WHEN owner <> user_id OR confirm < 2 OR reject >= confirm THEN 0.0 ELSE round(confirm * 0.05 - reject * 0.10 + CASE WHEN ctx THEN 0.08 ELSE 0 END, 6) END AS score_delta,
 owner = user_id AND confirm >= 2 AND reject < confirm AND score >= 0.5 AS applied, owner = user_id AND confirm >= 2 AND reject < confirm AND score < 0.5 AS needs_review FROM p"""


@query(_PAIR_SQL)
def lm1_pair_scores(spark, d):
    k = F.from_json("props", "k int")["k"]
    owner = F.when(F.col("event_id") % 11 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    scored = memory.pair_score(owner, F.col("user_id"), k % 7, k % 3, F.col("event_id") % 4 == 0, F.round(F.col("value") / 100, 2))
    return T.table(spark, d, "events").select("event_id", scored.alias("s")).select("event_id", F.round("s.score_delta", 6).alias("score_delta"), "s.applied", "s.needs_review")


@query("""WITH m AS (SELECT DISTINCT role AS user_id, left(text, 3) AS phrase, CAST(turn AS DOUBLE) - 2 AS weight FROM conversations WHERE turn < 6 AND length(text) >= 3)
 SELECT c.conv_id, c.turn, round(coalesce(sum(greatest(0, m.weight)), 0), 4) AS boost FROM conversations c LEFT JOIN m ON m.user_id = c.role AND contains(c.text, m.phrase) GROUP BY ALL""")
def lm2_phrase_boost(spark, d):
    c = T.table(spark, d, "conversations")
    m = c.where((F.col("turn") < 6) & (F.length("text") >= 3)).select(F.col("role").alias("user_id"), F.left("text", F.lit(3)).alias("phrase"), (F.col("turn").cast("double") - 2).alias("weight")).distinct()
    texts = c.select("conv_id", "turn", F.col("role").alias("user_id"), "text")
    return memory.phrase_boost(texts, m, ["conv_id", "turn"]).withColumn("boost", F.round("boost", 4))


@query()
def seq10_collapse_repetitions(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    return repetition.collapsed(docs, "doc_id")
