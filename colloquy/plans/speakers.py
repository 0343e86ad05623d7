"""Queries over the speakers of a call, and over names and labels composed from a table's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import speakers as P
from ..operators.graph import checkpointed
from ..sources import tables as T
from .joins import _REGIONS

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# What is said in a turn, by the turn's number and session: a salutation or none.
_SAID = ("엄마 왔어", "네 사장님", "그래요", "누나 선생님", "여보 나야", "아니요", "친구야 가자")
_YEARS = ("20s", "30s", "40s", None)


def _dealt(values: tuple, key: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.pmod(key, F.lit(len(values))).cast("int"))


def _sql_dealt(values: tuple, key: str) -> str:
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"])[CAST(1 + ({key}) % {len(values)} AS INT)]"


def _called(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The turns of an announcement and of persons as segments, voices and profiles out of the given embeddings."""
    turns = T.turns(spark, d)
    name = F.when((F.col("session_id") % 5 == 0) & (F.col("speaker") == "S0"), "SPEAKER_IVR").otherwise(F.col("speaker"))
    key = F.col("turn_idx") + F.col("session_id")
    segments = turns.select("session_id", F.col("turn_idx").alias("idx"), name.alias("speaker"), "start_sec", "end_sec", _dealt(_SAID, key).alias("text"), _dealt(_YEARS, key * 3 + 1).alias("speech_age"))
    e = T.table(spark, d, "embeddings").select("vec_id", "embedding")
    who = segments.groupBy("session_id", "speaker").agg(F.round(F.max("end_sec") - F.min("start_sec"), 3).alias("x"), F.count("*").alias("n"))
    f0 = 80 + F.pmod(F.col("n") * 37 + F.col("session_id") * 11, F.lit(170)).cast("double")
    vec = F.col("session_id") % 250 + F.when((F.col("speaker") == "S1") & (F.col("session_id") % 2 == 0), 0).otherwise(F.col("n") % 3 + 7)
    voices = who.select("session_id", "speaker", vec.alias("vec_id"), f0.alias("f0"), (f0 / (5 + F.col("session_id") % 20)).alias("f0_std"), F.when(F.col("session_id") % 7 == 0, "배우자").alias("relation"))
    voices = voices.join(e, "vec_id", "left").drop("vec_id")
    profiles = segments.select("session_id").distinct().where(F.col("session_id") % 3 > 0).withColumn("vec_id", F.col("session_id") % 250).join(e.withColumnRenamed("embedding", "profile"), "vec_id").drop("vec_id")
    return segments, voices, profiles


@query(f"""WITH {T.SQL_TURNS}, seg AS (SELECT session_id, turn_idx AS idx, CASE WHEN session_id % 5 = 0 AND speaker = 'S0' THEN 'SPEAKER_IVR' ELSE speaker END AS speaker, end_sec - start_sec AS dur,
  {_sql_dealt(_SAID, 'turn_idx + session_id')} AS text, {_sql_dealt(_YEARS, '(turn_idx + session_id) * 3 + 1')} AS age FROM turns),
 w AS (SELECT session_id, speaker, count(*) AS n, round(sum(dur), 6) AS spoken, min(idx) AS first, string_agg(text, ' ' ORDER BY idx) AS said FROM seg GROUP BY ALL),
 v AS (SELECT *, 80.0 + (n * 37 + session_id * 11) % 170 AS f0, 5 + session_id % 20 AS j, CASE WHEN session_id % 7 = 0 THEN '배우자' END AS inferred, session_id % 250 + CASE WHEN speaker = 'S1' AND session_id % 2 = 0 THEN 0 ELSE n % 3 + 7 END AS vec FROM w),
 a AS (SELECT session_id, speaker, arg_min(age, struct_pack(m := -n, f := f)) AS speech_age FROM (SELECT session_id, speaker, age, count(*) AS n, min(idx) AS f FROM seg WHERE age IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 l AS (SELECT v.*, CASE WHEN session_id % 3 > 0 AND speaker <> 'SPEAKER_IVR' AND spoken >= 0.5 THEN list_cosine_similarity(p.embedding::DOUBLE[], e.embedding::DOUBLE[]) END AS near
   FROM v LEFT JOIN embeddings e ON e.vec_id = vec LEFT JOIN embeddings p ON p.vec_id = session_id % 250),
 b AS (SELECT session_id, max(near) AS top, arg_min(speaker, struct_pack(m := -near, s := speaker)) FILTER (WHERE near IS NOT NULL) AS most, arg_min(speaker, struct_pack(m := -spoken, f := first)) FILTER (WHERE speaker <> 'SPEAKER_IVR') AS longest FROM l GROUP BY session_id),
 c AS (SELECT l.*, coalesce(top >= 0.75, false) AS known, CASE WHEN coalesce(top >= 0.75, false) THEN most ELSE longest END AS me FROM l JOIN b USING (session_id))
 SELECT session_id, speaker, CASE WHEN speaker IS NOT DISTINCT FROM me THEN 'self' ELSE 'other' END AS role, CASE WHEN speaker IS NOT DISTINCT FROM me AND known THEN 'profile_match' ELSE 'heuristic' END AS role_source,
  CASE WHEN f0 < 165 THEN 'male' ELSE 'female' END AS gender,
  CASE WHEN f0 < 165 THEN CASE WHEN f0 > 130 AND 1.0 / j < 0.08 THEN '20대' WHEN f0 > 110 THEN '30대' WHEN f0 > 95 THEN '40대' ELSE '50대+' END
       ELSE CASE WHEN f0 > 220 AND 1.0 / j < 0.08 THEN '20대' WHEN f0 > 195 THEN '30대' WHEN f0 > 175 THEN '40대' ELSE '50대+' END END AS voice_age, speech_age,
  CASE WHEN speaker IS DISTINCT FROM me AND speaker <> 'SPEAKER_IVR' THEN coalesce(inferred, CASE WHEN regexp_matches(said, '엄마') THEN '부모' WHEN regexp_matches(said, '여보') THEN '배우자' WHEN regexp_matches(said, '누나') THEN '형제자매'
    WHEN regexp_matches(said, '사장님') THEN '직장상사' WHEN regexp_matches(said, '선생') THEN '교사' WHEN regexp_matches(said, '친구|야') THEN '친구' END) END AS relation
 FROM c LEFT JOIN a USING (session_id, speaker)""")
def dz6_speaker_analysis(spark, d):
    return P.analysed(*_called(spark, d))


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS}, s AS (SELECT w.session_id, word_idx, t.speaker, round(sum(least(w.end_sec, t.end_sec) - greatest(w.start_sec, t.start_sec)), 9) AS s FROM spoken w JOIN turns t
   ON w.session_id = t.session_id AND least(w.end_sec, t.end_sec) > greatest(w.start_sec, t.start_sec) GROUP BY ALL)
 SELECT session_id, word_idx, (SELECT arg_min(speaker, struct_pack(m := -s, n := speaker)) FROM s WHERE s.session_id = spoken.session_id AND s.word_idx = spoken.word_idx) AS mapped_speaker, 'overlap' AS speaker_source FROM spoken""")
def dz1_by_shared_time(spark, d):
    return P.assigned(T.spoken(spark, d), T.turns(spark, d), "shared")


@query(f"WITH {T.SQL_TURNS} SELECT session_id, start_sec, end_sec FROM turns WHERE end_sec - start_sec >= 1.5")
def jn7_timeline_regions(spark, d):
    return P.timeline_regions(T.turns(spark, d), 1.5)


@query(_REGIONS + f""", {T.SQL_SPOKEN}, c AS (SELECT w.session_id, word_idx, round_even(greatest(w.start_sec, r.start_sec) * 1000, 0) / 1000 AS a, round_even(least(w.end_sec, r.end_sec) * 1000, 0) / 1000 AS b
   FROM spoken w JOIN regions r ON w.session_id = r.session_id AND least(w.end_sec, r.end_sec) - greatest(w.start_sec, r.start_sec) > 0.001),
 s AS (SELECT session_id, word_idx, count(*) AS n, sum(b - a) AS total, string_agg(printf('%.3f-%.3f', a, b), ',' ORDER BY a) AS intervals FROM c GROUP BY ALL)
 SELECT w.session_id, w.word_idx, n IS NOT NULL AS is_overlapping, coalesce(n, 0) AS overlap_count, round_even(coalesce(total, 0) * 1000, 0) / 1000 AS overlap_total,
  CASE WHEN end_sec > start_sec THEN round_even(coalesce(total, 0) / (end_sec - start_sec) * 10000, 0) / 10000 ELSE 0 END AS overlap_ratio, coalesce(intervals, '') AS intervals FROM spoken w LEFT JOIN s USING (session_id, word_idx)""")
def jn8_with_overlap(spark, d):
    out = P.with_overlap(T.spoken(spark, d), T.turns(spark, d), "word_idx")
    told = F.array_join(F.transform("overlap_intervals", lambda x: F.format_string("%.3f-%.3f", x["start_sec"], x["end_sec"])), ",")
    return out.select("session_id", "word_idx", "is_overlapping", "overlap_count", "overlap_total", "overlap_ratio", told.alias("intervals"))


@query(f"""WITH {T.SQL_WORDS}, r AS (SELECT session_id, max(end_sec) - min(start_sec) <= 110 AS short FROM words GROUP BY session_id)
 SELECT session_id, word_idx, CASE WHEN short AND session_id % 7 > 0 THEN 'F' || word_idx % 2 WHEN NOT short AND word_idx % 3 > 0 THEN 'A' || word_idx % 2 ELSE speaker END AS new_speaker, CASE WHEN short THEN 'full' ELSE 'anchor' END AS route FROM words JOIN r USING (session_id)""")
def mx8_routed(spark, d):
    words = T.words(spark, d)
    lengths = words.groupBy("session_id").agg((F.max("end_sec") - F.min("start_sec")).alias("seconds"))
    label = lambda p: F.concat(F.lit(p), F.col("word_idx") % 2).alias("speaker")
    whole = words.where(F.col("session_id") % 7 > 0).select("session_id", "word_idx", label("F"))
    anchored = words.where(F.col("word_idx") % 3 > 0).select("session_id", "word_idx", label("A"))
    return P.routed(words, lengths, whole, anchored, 110)


@query()
def vec8_reclustered_words(spark, d):
    """Embeddings of the given table are dealt to the windows; every eleventh window has none. Words are numbered once and checkpointed, as three steps read them."""
    words = checkpointed(T.words(spark, d))
    e = T.table(spark, d, "embeddings").select("vec_id", "embedding")
    windows = P.embedding_windows(words).where(F.col("window_idx") % 11 < 10)
    embedded = windows.withColumn("vec_id", (F.col("session_id") * 31 + F.col("window_idx")) % 500).join(e, "vec_id").drop("vec_id")
    return P.reclustered_words(words, embedded, 0.0).withColumn("confidence", F.round("confidence", 4))


@query("""SELECT conv_id, turn, text FROM conversations WHERE turn % 3 = 0 AND regexp_matches(coalesce(text, ''), '\\S')""")
def st10_pending(spark, d):
    c = T.table(spark, d, "conversations").withColumn("label", F.when(F.col("turn") % 3 > 0, F.col("role")))
    return P.pending(c).select("conv_id", "turn", "text")


@query("SELECT c_custkey AS session_id, 'true' AS preprocess_gain, 'raw_direct' AS speaker_mapping_mode, 'false' AS overlap_detection, NULL::VARCHAR AS loudness_norm FROM customer")
def mx13_gates(spark, d):
    g = P.gates({"preprocess_gain": True, "speaker_mapping_mode": "raw_direct", "overlap_detection": False})
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), g.alias("g")).select("session_id", "g.preprocess_gain", "g.speaker_mapping_mode", "g.overlap_detection", "g.loudness_norm")


@query("""WITH c AS (SELECT conv_id, text, count(*) FILTER (WHERE len(text) >= 2) OVER (PARTITION BY conv_id) AS n FROM conversations)
 SELECT text, conv_id % 4 AS label, conv_id % 4 AS label_group, conv_id AS seg_id, 'calls' AS source FROM c WHERE n >= 3 AND len(text) >= 2""")
def mx17_segment_rows(spark, d):
    c = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("texts"))  # turns of one conversation
    return P.segment_rows(c.select(F.col("conv_id").alias("seg_id"), (F.col("conv_id") % 4).alias("label"), "texts"), "calls")


# A line of words composed by the event's number: surname, given name and what follows, a word of the table, a name that is called.
_LAST, _FIRST = tuple(N.SURNAMES[:11]), tuple(N.GIVEN[:23])
_TAIL = ("", "가", "에게", "씨", "쪽", "은,", "입니다.", "아")


def _line(spark, d) -> DataFrame:
    k = F.col("event_id")
    name = F.concat(_dealt(_LAST, k), _dealt(_FIRST, k * 7), _dealt(_TAIL, k * 5))
    called = F.concat(_dealt(_FIRST, k * 3), F.when(k % 2 == 0, "아").otherwise("야"))
    return T.table(spark, d, "events").select("event_id", F.concat(name, F.lit("  "), "event_type", F.lit(" "), called, F.lit("! "), name).alias("text"))


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NAME = f"{_sql_dealt(_LAST, 'event_id')} || {_sql_dealt(_FIRST, 'event_id * 7')} || {_sql_dealt(_TAIL, 'event_id * 5')}"
_NAMED = f"""WITH t AS (SELECT event_id, {_NAME} || '  ' || event_type || ' ' || {_sql_dealt(_FIRST, 'event_id * 3')} || CASE WHEN event_id % 2 = 0 THEN '아' ELSE '야' END || '! ' || {_NAME} AS text FROM events),
 p AS (SELECT event_id, unnest(regexp_extract_all(text, '\\S+|\\s+')) AS piece, generate_subscripts(regexp_extract_all(text, '\\S+|\\s+'), 1) AS i FROM t),
 q AS (SELECT *, regexp_replace(piece, '[^가-힣]', '', 'g') AS h, coalesce(sum(len(piece)) OVER (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos FROM p),
 r AS (SELECT *, CASE WHEN list_contains({_listed(N.SURNAMES)}, h[1:1]) AND list_contains({_listed(N.GIVEN)}, h[2:3]) AND (h[4:] = '' OR list_contains({_listed(N.PARTICLES)}, h[4:])) THEN h[1:3] END AS full_name,
   CASE WHEN len(h) = 3 AND list_contains({_listed(N.GIVEN)}, h[1:2]) AND h[3:3] = CASE WHEN (unicode(h[2:2]) - 44032) % 28 > 0 THEN '아' ELSE '야' END THEN h END AS called FROM q)"""


@query(_NAMED + """ SELECT event_id, coalesce(string_agg(coalesce(full_name, called) || '@' || pos || '-' || (pos + len(piece)) || CASE WHEN full_name IS NULL THEN ':vocative' ELSE ':full' END, ',' ORDER BY i), '') AS hits,
 string_agg(CASE WHEN full_name IS NULL THEN piece ELSE replace(piece, full_name, '[PII_이름]') END, '' ORDER BY i) AS masked FROM r GROUP BY event_id""")
def fn17_names(spark, d):
    """Full names with particles, and names that are called, with the offsets of their words."""
    hits = F.transform(N.name_hits(F.col("text")), lambda h: F.concat(h["name"], F.lit("@"), h["char_start"], F.lit("-"), h["char_end"], F.lit(":"), h["kind"]))
    return _line(spark, d).select("event_id", F.array_join(hits, ",").alias("hits"), N.masked(F.col("text")).alias("masked"))


@query(_NAMED + """, f AS (SELECT event_id, pos, pos + len(piece) AS e, called, i FROM r WHERE full_name IS NULL AND called IS NOT NULL)
 SELECT event_id, count(i) AS n_flags, count(i) AS priority, coalesce(string_agg('호격 추정: ' || called || '@' || pos || '-' || e, ',' ORDER BY i), '') AS flags FROM t LEFT JOIN f USING (event_id) GROUP BY event_id""")
def fn22_review_flags(spark, d):
    """What a person should look at: names that are called."""
    r = _line(spark, d).select("event_id", N.review_flags(F.col("text")).alias("r"))
    told = F.transform("r.flags", lambda f: F.concat(f["detail"], F.lit("@"), f["char_start"], F.lit("-"), f["char_end"]))
    return r.select("event_id", F.size("r.flags").alias("n_flags"), F.col("r.priority").alias("priority"), F.array_join(told, ",").alias("flags"))
