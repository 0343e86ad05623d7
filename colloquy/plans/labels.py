"""Queries over rule labels, scores and sinks. Texts and labels, Korean ones too, are dealt to the rows of a table by number, on both
engines alike."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N
from ..functions import pii as P
from ..functions import texts as X
from ..operators import intervals as I
from ..operators import relations
from ..operators import sequences as S
from ..sources import corpora, sinks
from ..operators.graph import checkpoint_dir
from ..sources import tables as T
from ..sources.published import Published
from ..streaming import worker as W
from ..streaming import jobs
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


def _dealt(values: tuple, key: str = "event_id") -> str:
    """SQL: the value that the row's number deals to it."""
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[CAST(1 + {key} % {len(values)} AS INT)]"


def _value(values: tuple, key: str = "event_id"):
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(key) % len(values)).cast("int"))


def _events(spark, d, **columns):
    return T.table(spark, d, "events").select("event_id", *(_value(v).alias(k) for k, v in columns.items()))


_KINDS = ("credential_like", "foreign_id_like", "payment_like", "numeric_sensitive_like", "korean_name_like_candidate", "주민등록번호", "이름", "기타")


@query(f"""WITH e AS (SELECT event_id, {_dealt(_KINDS)} AS kind FROM events) SELECT event_id, kind IN ('credential_like', 'korean_name_like_candidate') AS candidate,
 CASE WHEN kind IN ('credential_like', 'foreign_id_like', 'payment_like') THEN 'high' WHEN kind IN ('numeric_sensitive_like', 'korean_name_like_candidate') THEN 'medium' ELSE 'low' END AS hint,
 CASE kind WHEN '주민등록번호' THEN 0.95 WHEN '이름' THEN 0.7 ELSE 0.4 END AS confidence FROM e""")
def fn9_kinds(spark, d):
    kind = F.col("kind")
    return _events(spark, d, kind=_KINDS).select("event_id", L.is_candidate(kind).alias("candidate"), L.suggested_confidence(kind).alias("hint"), P.confidence_of(kind).alias("confidence"))


_EXTENDED = ("외국인 900101-5234567 입니다", "송금 1234567 원", "1234567", "송금 12345 와 입금 999999", "900101 6234567", None)


@query(f"""WITH e AS (SELECT event_id, {_dealt(_EXTENDED)} AS t FROM events), m AS (SELECT event_id, regexp_extract_all(t, '\\b[0-9]{{6}}[-_\\s][5-8][0-9]{{6}}\\b') AS f,
 CASE WHEN contains(t, '송금') OR contains(t, '입금') THEN regexp_extract_all(t, '\\b[0-9]{{6,16}}\\b') ELSE [] END AS p FROM e)
 SELECT event_id, coalesce(array_to_string(f, '|'), '') AS foreign_ids, coalesce(array_to_string(p, '|'), '') AS payments FROM m""")
def fn7_extended(spark, d):
    spans = L.extended_spans(F.col("t"))
    of = lambda k: F.array_join(F.transform(F.filter(spans, lambda s: s["type"] == k), lambda s: s["matched_text"]), "|")
    return _events(spark, d, t=_EXTENDED).select("event_id", of("foreign_id_like").alias("foreign_ids"), of("payment_like").alias("payments"))


_PII = ("전화 010-1234-5678", "메일 a.b@c.org 와 b@d.kr", "카드 1234-5678-9012-3456", "주민 900101-1234567", "없음", None)


@query(f"""WITH e AS (SELECT event_id, {_dealt(_PII)} AS t FROM events) SELECT event_id, CASE event_id % 6 WHEN 0 THEN '전화번호/0.95/auto_confirmed' WHEN 1 THEN '이메일/0.95/auto_confirmed|이메일/0.95/auto_confirmed' WHEN 2 THEN '카드번호/0.95/auto_confirmed'
 WHEN 3 THEN '주민등록번호/0.95/auto_confirmed' ELSE '' END AS spans, coalesce(regexp_matches(t, '[0-9]{{3}}-|@'), false) AS gate FROM e""")
def fn13_scored(spark, d):
    t = F.col("t")
    spans = F.transform(P.scored(P.pii_spans(t)), lambda s: F.concat_ws("/", s["type"], s["confidence"].cast("string"), s["confidence_tier"]))
    return _events(spark, d, t=_PII).select("event_id", F.array_join(spans, "|").alias("spans"), P.has_pii(t).alias("gate"))


_SAID = ("우리 엄마 친구", "여보 어디야", "팀장님 안녕하세요", "선생님!", "친구야", "그래 ... 2 그래요!!", "음 -- 어", None)
_RELATIONS = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{r}'" for p, r in L.SALUTATIONS)


@query(f"""WITH e AS (SELECT event_id, {_dealt(_SAID)} AS t FROM events) SELECT event_id, CASE {_RELATIONS} END AS relation, CASE WHEN event_id % 9 = 0 THEN '동료' ELSE CASE {_RELATIONS} END END AS fallback,
 coalesce(array_to_string(list_filter(string_split(t, ' '), lambda x: regexp_matches(x, '[0-9A-Za-z가-힣]')), '|'), '') AS tokens FROM e""")
def fn39_salutations(spark, d):
    t = F.col("t")
    return _events(spark, d, t=_SAID).select("event_id", L.relation_by_salutation(t).alias("relation"), L.relation(F.when(F.col("event_id") % 9 == 0, "동료"), t).alias("fallback"), F.array_join(X.tokens(t), "|").alias("tokens"))


_RELATED, _TOPICS = ("교사", "친구", None, "직장상사"), ("교육/공부", "식사/음식", "교육")


@query(f"""WITH e AS (SELECT event_id, {_dealt(_RELATED)} AS r, {_dealt(_TOPICS)} AS t FROM events), c AS (SELECT *, CASE WHEN r IS NULL OR r = '친구' THEN 'broad_or_none' WHEN r <> '교사' THEN 'no_rule_keep' WHEN t IN ('교육/공부', '교육') THEN 'topic_supported' ELSE 'topic_unsupported' END AS reason FROM e)
 SELECT event_id, reason, CASE WHEN reason <> 'topic_unsupported' THEN r END AS validated FROM c""")
def fn41_crossvalidated(spark, d):
    e = _events(spark, d, relation=_RELATED, topic=_TOPICS).withColumn("topics", F.array("topic"))
    return relations.crossvalidated(e).select("event_id", "reason", "validated")


_FELT, _AGED = ("기쁨", " 슬픔 ", "평온", "사랑", "분노"), ("20대 초반", "50", "70대 이상", "열 살", "30s", "50대이상")


@query(f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '긍정' WHEN 1 THEN '부정' WHEN 2 THEN '중립' WHEN 3 THEN '긍정' ELSE '부정' END AS emotion,
 CASE event_id % 6 WHEN 0 THEN '20대' WHEN 1 THEN '50대+' WHEN 2 THEN '50대+' WHEN 4 THEN '30대' WHEN 5 THEN '50대+' END AS age FROM events""")
def fn47_emotions_and_ages(spark, d):
    return _events(spark, d, felt=_FELT, aged=_AGED).select("event_id", L.emotion_of_name(F.col("felt")).alias("emotion"), corpora.age_group_of(F.col("aged")).alias("age"))


@query("""WITH f AS (SELECT event_id, event_id % 7 = 0 AS g, event_id % 5 = 0 AS b, CASE event_id % 4 WHEN 0 THEN 'closing' WHEN 1 THEN 'middle' END AS turn, CASE event_id % 3 WHEN 0 THEN 'question' WHEN 1 THEN 'answer' END AS kind FROM events)
 SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'default_context' WHEN g THEN 'opening' WHEN b THEN 'backchannel' WHEN turn = 'closing' THEN 'closing' WHEN kind = 'question' THEN 'question' WHEN kind = 'answer' THEN 'response'
  WHEN turn IS NOT NULL THEN 'statement' ELSE 'default_context' END AS role FROM f""")
def fn50_discourse_roles(spark, d):
    k = F.col("event_id")
    form = F.struct((k % 7 == 0).alias("is_greeting"), F.lit(None).cast("boolean").alias("is_closing"), (k % 5 == 0).alias("is_backchannel"), F.lit(False).alias("is_short_response"), _value(("closing", "middle", None, None)).alias("turn_type"), _value(("question", "answer", None)).alias("utterance_type"))
    return T.table(spark, d, "events").select("event_id", L.discourse_role(F.when(k % 11 > 0, form)).alias("role"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'street' WHEN 1 THEN 'babble' WHEN 2 THEN 'clean' ELSE 'music' END AS noise FROM events""")
def md12_noise(spark, d):
    tags = F.split(_value(("Speech|Inside|Car|Music", "Hubbub, speech noise|Static", "Speech|a|b|c|d|Music", "Music")), r"\|")
    return T.table(spark, d, "events").select("event_id", L.noise_category(tags).alias("noise"))


@query("""SELECT event_id, event_id % 3 > 0 AS protected FROM events""")
def lm3_protected(spark, d):
    e = _events(spark, d, surface=("그거", "금액", "그거"), before=("a", "b", None), after=("c", "d", "계좌 말이야"))
    return e.select("event_id", rules.protected(F.col("surface"), F.col("before"), F.col("after"), ["금액", "계좌"]).alias("protected"))


@query("""SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) END AS cosine,
 round(CASE WHEN vec_id % 3 = 0 THEN 2.0 ELSE 2.0 * pow(0.5, (vec_id % 50) / 14.0) END, 6) AS weight FROM embeddings""")
def vec12_decayed_pairs(spark, d):
    k, e = F.col("vec_id"), F.col("embedding")
    used = F.when(k % 3 > 0, F.lit(1.7e9) - (k % 50) * 86400)
    return T.table(spark, d, "embeddings").select("vec_id", F.round(N.cosine(F.when(k % 4 > 0, e), F.reverse(e), None, 1e-12), 6).alias("cosine"), F.round(N.decayed(F.lit(2.0), used, 1.7e9, 14), 6).alias("weight"))


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS} SELECT w.session_id, w.word_idx, arg_min(t.speaker, t.turn_idx) AS held_by, count(t.turn_idx) > 0 AS inside
 FROM spoken w LEFT JOIN turns t ON w.session_id = t.session_id AND (w.start_sec + w.end_sec) / 2 BETWEEN t.start_sec AND t.end_sec GROUP BY ALL""")
def jn21_held_by(spark, d):
    points = T.spoken(spark, d).select("session_id", "word_idx", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("at"))
    held = I.first_inside(points, I.as_right(T.turns(spark, d), ["session_id"]), "word_idx", "r_turn_idx", "r_speaker")
    return held.select("session_id", "word_idx", F.col("r_speaker").alias("held_by"), F.col("r_speaker").isNotNull().alias("inside"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey % 5 AS slot, o_totalprice, o_orderdate, o_orderkey, o_orderkey % 3 = 0 AS fresh FROM orders)
 SELECT o_custkey, slot, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, slot ORDER BY fresh DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM o) WHERE rn = 1""")
def snk2_upserted(spark, d):
    o = T.table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 5).alias("slot"), "o_totalprice", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return sinks.upserted(o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 3 = 0"), ["o_custkey", "slot"], "at").select("o_custkey", "slot", "o_orderkey")


@query("SELECT event_id, event_type FROM events")
def snk6_without_binary(spark, d):
    e = T.table(spark, d, "events").select("event_id", "event_type", F.encode("event_type", "UTF-8").alias("raw"))
    return sinks.without_binary(e)


@query("""SELECT event_id, user_id, 'failed' AS status FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10 MINUTE""")
def st3_stuck(spark, d):
    sessions = T.table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
    return jobs.stuck(sessions, "2024-01-15 00:00:00").select("event_id", "user_id", "status")


@query(f"""WITH {T.SQL_WORDS}, f AS (SELECT session_id, speaker, min(word_idx) AS first FROM words GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) - 1 AS k FROM f)
 SELECT session_id, word_idx, 'SPEAKER_' || lpad(CAST(k AS VARCHAR), 2, '0') AS label FROM words JOIN n USING (session_id, speaker)""")
def seq23b_renumbered(spark, d):
    return S.renumbered(T.words(spark, d)).select("session_id", "word_idx", "label")


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n FROM conversations GROUP BY conv_id")
def agg7_label_count(spark, d):
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n"))


_PICKED = "o_orderstatus <> 'F' AND o_custkey % 3 <> 0 AND o_orderkey % 7 <> 0"
_NOW = "TIMESTAMP '2024-01-01 12:00:00'"


def _sessions(spark, d):
    """Orders as sessions: who agreed, whether there is audio, how often they were tried."""
    o = T.table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("long").alias("session_id"),
        F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"),
        F.when(F.col("o_custkey") % 3 == 0, "one").otherwise("both_agreed").alias("consent"),
        F.when(F.col("o_orderkey") % 7 != 0, "audio").alias("audio"),
        (F.col("o_orderkey") % 3).cast("int").alias("retries"),
        F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("not_before"),
        F.when(F.col("o_orderkey") % 5 == 0, "SPEAKER_REQUEUE: before").alias("error"),
        F.lit(None).cast("int").alias("n_utterances"),
        F.lit(None).cast("string").alias("quality"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        "o_orderpriority",
        "o_custkey",
    )


@query(f"""WITH s AS (SELECT o_orderkey AS session_id, o_orderkey % 3 AS tried, o_orderkey % 5 = 0 AS before, o_custkey % 11 AS n, 1 + o_custkey % 2 AS speakers,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'unavailable' WHEN o_orderpriority LIKE '2%' THEN 'error' ELSE 'done' END AS outcome FROM orders WHERE {_PICKED}),
 t AS (SELECT *, outcome = 'done' AND n >= 6 AND speakers = 1 AND NOT before AS again FROM s)
 SELECT session_id, CASE WHEN again THEN 'pending' WHEN outcome = 'done' THEN 'done' WHEN outcome = 'error' AND tried + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status,
 CAST(CASE WHEN again THEN 0 WHEN outcome = 'error' THEN tried + 1 ELSE tried END AS INT) AS retries, outcome = 'unavailable' AS pauses,
 CASE WHEN again THEN 'SPEAKER_REQUEUE: 1 speaker, ' || n || ' utterances' WHEN outcome = 'done' THEN NULL ELSE 'why' END AS error,
 CASE WHEN outcome = 'done' AND NOT again THEN CASE WHEN n > 0 THEN 'done' ELSE 'skipped' END END AS quality FROM t""")
def st2_after_processing(spark, d):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    ready = W.due(_sessions(spark, d), now)
    kind = F.when(F.col("o_orderpriority").startswith("1"), "unavailable").when(F.col("o_orderpriority").startswith("2"), "error").otherwise("done")
    outcomes = ready.select("session_id", kind.alias("outcome"), (F.col("o_custkey") % 11).cast("int").alias("n_utterances"), (1 + F.col("o_custkey") % 2).cast("int").alias("n_speakers"), F.lit("why").alias("message"))
    return W.after(ready, outcomes, now).select("session_id", "status", "retries", F.col("not_before").isNotNull().alias("pauses"), "error", "quality")


@query("SELECT count(*) AS n, count(*) > 5 AS alert FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 3 <> 0 AND o_orderkey % 7 = 0")
def st3_missing_audio(spark, d):
    return W.missing_audio(_sessions(spark, d))


@query("""WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k, event_type FROM events)
 SELECT user_id, event_type, event_id, value FROM e WHERE k = 1""")
def snk3_published(spark, d):
    """Two runs into a published table: half of the events, then the others; the later event of each user and type stays."""
    base = f"{checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    table = Published(spark, base, "user_id long, event_type string, event_id long, value double, ts timestamp", ["user_id", "event_type"], buckets=16)
    events = T.table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    latest = F.max_by(F.struct("event_id", "value", "ts"), F.struct("ts", "event_id")).alias("e")
    early, late = (events.where(F.col("event_id") % 2 == half).groupBy("user_id", "event_type").agg(latest).select("user_id", "event_type", "e.*") for half in (0, 1))
    table.upsert(early, "ts", "snk3", 0)
    before = table.read().withColumnRenamed("ts", "old_ts").withColumnRenamed("event_id", "old_id").drop("value")
    newer = late.join(before, ["user_id", "event_type"], "left").where("old_ts is null or ts > old_ts or ts = old_ts and event_id > old_id").drop("old_ts", "old_id")
    table.upsert(newer, "ts", "snk3", 1)
    return table.read().select("user_id", "event_type", "event_id", "value")
