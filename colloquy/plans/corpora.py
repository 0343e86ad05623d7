"""Queries over labelled corpora and nested utterances. Their JSON documents are composed from the tables, so that the SQL side can say
what the loaders have to find in them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pii as P
from ..operators import anchors as A
from ..operators import cleaning as C
from ..sources import corpora
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


def _documents(spark, d, item, *head, name: str | None = None):
    """One JSON document per conversation: head fields, and its turns as a list under name, or the list alone."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda t: t["item"])
    g = T.table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return g.select("conv_id", F.to_json(F.struct(*head, F.col("turns").alias(name)) if name else F.col("turns")).alias("value"))


def _case(key, names):
    out = F.lit(None).cast("string")
    for k, v in enumerate(names):
        out = F.when(key == k, v).otherwise(out)
    return out


_TRIM = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH t AS (SELECT conv_id, {_TRIM} AS text FROM conversations WHERE turn < 3), e AS (SELECT *, conv_id % 70 AS code FROM t)
 SELECT text, CASE WHEN code BETWEEN 10 AND 59 THEN '부정' ELSE '긍정' END AS emotion, '기타' AS dialog_act, 'aihub_dialog' AS source FROM e WHERE text <> '' AND code >= 10""")
def src7_emotion_dialogs(spark, d):
    said = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("HS0"), F.col("turn") + 1), F.coalesce("text", F.lit("")))))
    g = T.table(spark, d, "conversations").where("turn < 3").groupBy("conv_id").agg(said.alias("content"))
    code = F.concat(F.lit("E"), F.col("conv_id") % 70)
    item = F.struct(F.struct(F.struct(code.alias("type")).alias("emotion")).alias("profile"), F.struct("content").alias("talk"))
    return corpora.emotion_dialogs(g.select(F.to_json(F.array(item)).alias("value")))


@query(f"""SELECT {_TRIM} AS text, CASE turn % 4 WHEN 0 THEN '긍정' WHEN 1 THEN '중립' ELSE '부정' END AS emotion, '기타' AS dialog_act, 'aihub_free_adult' AS source
 FROM conversations WHERE turn % 4 < 3 AND {_TRIM} <> ''""")
def src8_free_dialogs(spark, d):
    item = F.struct(F.col("text").alias("Text"), _case(F.col("turn") % 4, ("긍정", " 중립 ", "부정", "화남")).alias("VerifyEmotionCategory"))
    return corpora.free_dialogs(_documents(spark, d, item, name="Conversation"), "aihub_free_adult")


@query(f"""SELECT {_TRIM} AS text, CASE conv_id % 4 WHEN 0 THEN '긍정' WHEN 1 THEN '부정' ELSE '중립' END AS emotion, '기타' AS dialog_act, 'empathy_dialog' AS source
 FROM conversations WHERE conv_id % 4 < 3 AND {_TRIM} <> ''""")
def src9_empathy_dialogs(spark, d):
    emotion = F.struct(_case(F.col("conv_id") % 4, ("기쁨", "슬픔", "평온", "")).alias("speaker_emotion")).alias("info")
    return corpora.empathy_dialogs(_documents(spark, d, F.struct("text"), emotion, name="utterances"))


@query(f"""WITH t AS (SELECT role, {_TRIM} AS text, CASE conv_id % 6 WHEN 0 THEN '20s' WHEN 1 THEN '20s' WHEN 2 THEN '30s' WHEN 3 THEN '40s' WHEN 4 THEN '50s+' END AS file_age, conv_id % 3 AS k FROM conversations),
 a AS (SELECT text, CASE WHEN role = 'user' AND k = 0 THEN '30s' WHEN role = 'user' AND k = 1 THEN 'unknown' ELSE file_age END AS age_range FROM t)
 SELECT text, age_range, 'age_speech' AS source FROM a WHERE length(text) >= 2 AND age_range IS NOT NULL AND age_range <> 'unknown'""")
def src10_age_speech(spark, d):
    item = F.struct(F.col("role").alias("Speaker"), F.when(F.col("turn") % 3 > 0, F.col("text")).alias("TextConvert"), F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise("x").alias("SpeakerText"))
    category = _case(F.col("conv_id") % 6, ("10대", "20대", "30대", "40대", "50대이상", "?")).alias("Category")
    age = _case(F.col("conv_id") % 3, ("35", "?", ""))
    speakers = F.array(F.struct(F.lit("user").alias("Speaker"), age.alias("AgeGroup"))).alias("Speakers")
    return corpora.age_speech(_documents(spark, d, item, category, speakers, name="Dialogs"))


_RAW = ("건강", "IT 기술", "가족", "모르는 말", "제주 여행", "집", "")
_MAPPED = "CASE {k} WHEN 0 THEN '건강/의료' WHEN 1 THEN 'IT/기술' WHEN 2 THEN '가족' WHEN 3 THEN '기타' WHEN 4 THEN '여행/외출' WHEN 5 THEN '식사/음식' WHEN 6 THEN '건강/의료' END"


@query(f"""SELECT {_TRIM} AS text, {_MAPPED.format(k='conv_id % 7')} AS topic, 'aihub_topic_dialog' AS source FROM conversations WHERE conv_id % 7 < 6 AND {_TRIM} <> ''""")
def src11_topic_dialogs(spark, d):
    topic, c = _case(F.col("conv_id") % 7, _RAW), F.col("conv_id") % 3
    flat = _documents(spark, d, F.struct(F.col("text").alias("utterance"), topic.alias("category"))).where(c == 0)
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.struct(t["text"].alias("text")))
    g = T.table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("u"))
    data = g.where(c == 1).select(F.to_json(F.struct(F.array(F.struct(topic.alias("topic"), F.col("u").alias("conversations"))).alias("data"))).alias("value"))
    dialogues = g.where(c == 2).select(F.to_json(F.struct(F.array(F.struct(topic.alias("topic"), F.col("u").alias("utterances"))).alias("dialogues"))).alias("value"))
    return corpora.topic_dialogs(flat.select("value").union(data).union(dialogues))


_AGES = ("20대 초반", "50", "70대 이상", "열 살", "30s")


@query(f"""SELECT {_TRIM} AS text, CASE turn % 5 WHEN 0 THEN '20대' WHEN 1 THEN '50대+' WHEN 2 THEN '50대+' ELSE '30대' END AS age_group, 'aihub_speech_age' AS source FROM conversations WHERE turn % 5 <> 3 AND {_TRIM} <> ''""")
def src12_speech_ages(spark, d):
    age, c = _case(F.col("turn") % 5, _AGES), F.col("conv_id") % 3
    flat = _documents(spark, d, F.struct(F.col("text").alias("발화"), age.alias("연령대"))).where(c == 0)
    plain = _documents(spark, d, F.struct(F.col("text").alias("content"), age.alias("speaker_age")), name="dataset").where(c == 1)
    inner = _documents(spark, d, F.struct("text", age.alias("age")), name="utterances").where(c == 2)
    nested = inner.select(F.concat(F.lit('{"data": ['), "value", F.lit("]}")).alias("value"))
    return corpora.speech_ages(flat.select("value").union(plain.select("value")).union(nested))


@query(f"SELECT conv_id, turn, {_MAPPED.format(k='turn % 7')} AS topic FROM conversations")
def fn43_topic_names(spark, d):
    return T.table(spark, d, "conversations").select("conv_id", "turn", corpora.topic_of(_case(F.col("turn") % 7, _RAW)).alias("topic"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '상거래 전반' WHEN 1 THEN '시사/뉴스' WHEN 2 THEN '교통' END AS subject FROM conversations")
def fn44_subjects(spark, d):
    return T.table(spark, d, "conversations").select("conv_id", "turn", corpora.subject_of(_case(F.col("turn") % 4, ("상거래전반", " 타 국가 이슈 ", "교통", "없음"))).alias("subject"))


@query("""SELECT conv_id, turn, regexp_replace(regexp_replace(CASE WHEN turn % 2 = 0 THEN '화자1 : ' || text ELSE text END, '^[^:：]{1,12}\\s*[:：]\\s*', ''), '^\\s+|\\s+$', '', 'g') AS text FROM conversations""")
def fn45_without_prefix(spark, d):
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("화자1 : "), "text")).otherwise(F.col("text"))
    return T.table(spark, d, "conversations").select("conv_id", "turn", C.without_prefix(said).alias("text"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true ELSE o_orderkey % 2 = 0 END AS masks FROM orders")
def fn4_name_masking(spark, d):
    grade = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "standard").otherwise("excluded")).when(F.col("o_orderkey") % 3 == 1, "premium")
    return T.table(spark, d, "orders").select("o_orderkey", P.masks_names(F.col("o_orderkey") % 2 == 0, grade).alias("masks"))


@query("""WITH w AS (SELECT event_id, user_id, event_type, value FROM events) SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS word,
 CASE WHEN event_id % 5 = 0 THEN 0 ELSE round_even(value * 100, 0) / 100 END AS start, CASE WHEN event_id % 3 > 0 THEN 'S' || (user_id % 3) END AS speaker FROM w""")
def prj2_clean_words(spark, d):
    k = F.col("event_id")
    word = F.struct(F.when(k % 7 > 0, F.col("event_type")).alias("word"), F.when(k % 5 > 0, F.col("value")).alias("start"), F.col("value").alias("end"), F.when(k % 3 > 0, F.concat(F.lit("S"), F.col("user_id") % 3)).alias("speaker"), F.lit("exact").alias("speaker_source"))
    return T.table(spark, d, "events").select(k, C.clean_word(word).alias("w")).select("event_id", "w.word", "w.start", "w.speaker")


@query("""WITH w AS (SELECT conv_id, turn, role, unnest(generate_series(0, 2)) AS k FROM conversations)
 SELECT conv_id AS session_id, turn AS index, k::INT AS word_idx, CASE WHEN k = 1 THEN role ELSE CASE WHEN turn % 2 = 0 THEN 'U' || turn ELSE 'SPEAKER_00' END END AS speaker,
 CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS word FROM w""")
def prj7_flattened(spark, d):
    word = lambda text, other, speaker: F.struct(F.lit(text).cast("string").alias("word"), F.lit(other).cast("string").alias("text"), F.lit(None).cast("double").alias("start"), F.lit(1.5).alias("end"), speaker.alias("speaker"), F.lit(None).cast("string").alias("speaker_id"))
    none = F.lit(None).cast("string")
    u = T.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("index"), none.alias("speaker_id"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("U"), "turn")).otherwise("").alias("speaker"), F.array(word("a", "x", none), word("", "b", F.col("role")), word(None, None, F.lit(""))).alias("words"))
    return C.flattened(u).select("session_id", "index", "word_idx", "speaker", "word")


@query("SELECT user_id AS session_id, event_id AS sequence_order FROM events WHERE event_id % 4 = 0 OR event_id % 9 = 0")
def prj10_curated(spark, d):
    k = F.col("event_id")
    rows = T.table(spark, d, "events").select(F.col("user_id").alias("session_id"), k.alias("sequence_order"), F.when(k % 4 == 0, F.col("ts")).alias("pii_reviewed_at"), F.when(k % 9 == 0, F.col("ts")).alias("pii_masked_at"))
    return C.curated(rows)


@query("""WITH r AS (SELECT event_id AS id, user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS so, ts, event_type FROM events),
 n AS (SELECT session_id, count(*) AS n, CAST(ceil(count(*) * CASE WHEN session_id % 3 = 0 THEN 0.3 ELSE 0.8 END) AS BIGINT) AS new_count FROM r GROUP BY session_id)
 SELECT id, session_id, so AS sequence_order FROM r JOIN n USING (session_id) WHERE so > new_count AND new_count / n >= 0.5 AND id % 5 > 0 AND id % 7 > 0 AND id % 11 > 0 AND id % 13 > 0 AND ts < TIMESTAMP '2024-01-25'""")
def st8_orphans(spark, d):
    k, ts = F.col("event_id"), F.col("ts")
    e = T.table(spark, d, "events").withColumn("so", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    rows = e.select(k.alias("id"), F.col("user_id").alias("session_id"), F.col("so").alias("sequence_order"), F.when(k % 5 == 0, ts).alias("pii_reviewed_at"), F.when(k % 7 == 0, ts).alias("pii_masked_at"), F.when(k % 11 == 0, "x").alias("quality_reviewed_by"), ts.alias("updated_at"))
    share = F.when(F.col("session_id") % 3 == 0, 0.3).otherwise(0.8)
    runs = rows.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.ceil(F.col("n") * share).alias("new_count"), F.expr("timestamp_ntz '2024-01-25'").alias("run_start"))
    return C.orphans(rows, runs, rows.where("id % 13 = 0").select("id"))


@query("""WITH w AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS word_idx, event_id FROM events),
 o AS (SELECT *, word_idx < 10 AND event_id % 4 > 0 AS open, CASE WHEN word_idx < 4 THEN 'A' WHEN event_id % 4 = 0 THEN NULL ELSE 'B' END AS role, CASE event_id % 6 WHEN 0 THEN '여보세요?' WHEN 1 THEN '네' ELSE '말' END AS word FROM (SELECT * FROM w)),
 q AS (SELECT session_id, word_idx, word, CASE WHEN word_idx < 4 THEN 'A' ELSE role END AS role, (word_idx < 10 AND CASE WHEN word_idx < 4 THEN 'A' ELSE role END IS NOT NULL) AS open FROM o),
 l AS (SELECT *, CASE WHEN row_number() OVER v > 1 AND (lag(open) OVER v <> open OR lag(role) OVER v IS DISTINCT FROM role) THEN 1 ELSE 0 END AS f FROM q WINDOW v AS (PARTITION BY session_id ORDER BY word_idx)),
 g AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS run FROM l),
 c AS (SELECT *, max(CASE WHEN open AND word LIKE '여보%' THEN word_idx END) OVER (PARTITION BY session_id, run) AS call FROM g),
 a AS (SELECT *, min(CASE WHEN word_idx > call AND word = '네' THEN word_idx END) OVER (PARTITION BY session_id, run) AS answer FROM c)
 SELECT session_id, word_idx, CASE WHEN answer IS NULL THEN role WHEN word_idx < answer THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS split_role FROM a""")
def seq20_split_openings(spark, d):
    k = F.col("event_id")
    words = T.words(spark, d).select("session_id", "word_idx", (F.col("word_idx") / 2.0).alias("start_sec"), F.when(k % 6 == 0, "여보세요?").when(k % 6 == 1, "네").otherwise("말").alias("word"), F.when(F.col("word_idx") < 4, "A").when(k % 4 > 0, "B").alias("role"))
    return C.split_openings(words).select("session_id", "word_idx", "split_role")


@query("""WITH a AS (SELECT vec_id // 100 AS session_id, arg_min(embedding, vec_id) AS low, arg_max(embedding, vec_id) AS high FROM embeddings GROUP BY 1),
 c AS (SELECT vec_id // 100 AS session_id, vec_id AS word_idx, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(low AS DOUBLE[])) AS l, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(high AS DOUBLE[])) AS h, vec_id % 6 = 0 AS none FROM embeddings JOIN a ON vec_id // 100 = a.session_id)
 SELECT session_id, word_idx, CASE WHEN NOT none THEN CASE WHEN l >= h THEN 'SPEAKER_01' ELSE 'SPEAKER_00' END END AS label, round(CASE WHEN none THEN 0 ELSE abs(l - h) END, 5) AS margin FROM c""")
def vec10_nearest_anchor(spark, d):
    e = T.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("session_id"), F.col("vec_id").alias("word_idx"), "embedding")
    anchors = e.groupBy("session_id").agg(F.min_by("embedding", "word_idx").alias("low"), F.max_by("embedding", "word_idx").alias("high"))
    words = e.withColumn("embedding", F.when(F.col("word_idx") % 6 > 0, F.col("embedding")))
    return A.nearest_anchor(words, anchors).withColumn("margin", F.round("margin", 5))


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS}, w AS (SELECT *, CASE WHEN word_idx % 7 > 0 THEN 'S' || (word_idx % 3) END AS role FROM spoken),
 m AS (SELECT w.session_id, w.word_idx, arg_min(t.speaker, t.turn_idx) AS n FROM w JOIN turns t ON w.session_id = t.session_id AND w.start_sec < 86150 AND t.start_sec >= w.start_sec AND t.end_sec <= w.end_sec AND t.end_sec - t.start_sec >= 0.12 AND t.speaker <> w.role GROUP BY ALL)
 SELECT w.session_id, w.word_idx, coalesce(n, role) AS new_role FROM w LEFT JOIN m ON w.session_id = m.session_id AND w.word_idx = m.word_idx""")
def seq21_corrected_opening(spark, d):
    words = T.spoken(spark, d).withColumn("role", F.when(F.col("word_idx") % 7 > 0, F.concat(F.lit("S"), F.col("word_idx") % 3)))
    return A.corrected_opening(words, T.turns(spark, d).withColumnRenamed("speaker", "label"), 86150.0).select("session_id", "word_idx", "new_role")


@query(f"""WITH {T.SQL_WORDS}, w AS (SELECT session_id, word_idx, word_idx >= 6 AS body, CASE WHEN event_id % 5 > 0 THEN 'SPEAKER_0' || (event_id % 2) END AS role, end_sec - start_sec AS f0 FROM words),
 s AS (SELECT session_id, median(f0) FILTER (WHERE role = 'SPEAKER_01') AS lo, median(f0) FILTER (WHERE role = 'SPEAKER_00') AS hi FROM w WHERE body AND role IS NOT NULL GROUP BY session_id)
 SELECT session_id, word_idx, CASE WHEN body AND lo > hi THEN CASE role WHEN 'SPEAKER_01' THEN 'SPEAKER_00' WHEN 'SPEAKER_00' THEN 'SPEAKER_01' END ELSE role END AS pinned_role FROM w LEFT JOIN s USING (session_id)""")
def seq22_pinned_body(spark, d):
    k = F.col("event_id")
    words = T.words(spark, d).select("session_id", "word_idx", F.col("word_idx").cast("double").alias("start_sec"), F.when(k % 5 > 0, F.concat(F.lit("SPEAKER_0"), k % 2)).alias("role"), (F.col("end_sec") - F.col("start_sec")).alias("f0"))
    return A.pinned_body(words, 6.0).select("session_id", "word_idx", "pinned_role")


@query(f"""WITH {T.SQL_WORDS}, p AS (SELECT session_id, speaker AS a, CASE WHEN event_id % 4 = 0 THEN 'x' ELSE 'n' || speaker END AS b, count(*) AS n FROM words GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, a ORDER BY n DESC, b) AS k FROM p)
 SELECT session_id, sum(n) AS words, sum(CASE WHEN a IS DISTINCT FROM b THEN n ELSE 0 END) AS raw_changed, sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS semantic_changed FROM r GROUP BY session_id""")
def mx24_changed_words(spark, d):
    before = T.words(spark, d)
    after = before.withColumn("speaker", F.when(F.col("event_id") % 4 == 0, "x").otherwise(F.concat(F.lit("n"), "speaker")))
    return A.changed_words(before, after)


@query("""WITH w AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 > 0 THEN 'L' || (turn % 4) ELSE role END AS s, conv_id * 100 + turn // 4 AS seg FROM conversations),
 v AS (SELECT conv_id, turn // 4 AS seg, s, count(*) AS n, min(turn) AS first FROM w GROUP BY ALL)
 SELECT conv_id AS session_id, seg AS segment_idx, arg_max(s, struct_pack(a := n, b := -first)) AS speaker FROM v GROUP BY ALL""")
def mx7_written_back(spark, d):
    c = T.table(spark, d, "conversations").withColumn("segment_idx", F.floor(F.col("turn") / 4))
    word = F.struct("turn", F.lit("w").alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.col("role").alias("speaker"))
    g = c.groupBy(F.col("conv_id").alias("session_id"), "segment_idx").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x.dropFields("turn")).alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id", "segment_idx").orderBy("turn")) - 1
    labels = c.withColumn("word_idx", place).where("turn % 3 > 0").select(F.col("conv_id").alias("session_id"), "segment_idx", "word_idx", F.concat(F.lit("L"), F.col("turn") % 4).alias("speaker"))
    return A.written_back(g.withColumn("speaker", F.lit("?")), labels).select("session_id", "segment_idx", "speaker")
