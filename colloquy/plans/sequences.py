"""Queries over ordered sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine
from ..operators import scans
from ..operators import sequences as S
from ..operators import speakers
from ..sources import tables as T
from . import segmentation

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _islands(condition: str) -> str:
    return f"""WITH {T.SQL_WORDS}, l AS (SELECT *, lag(speaker) OVER w AS p_spk, lag(end_sec) OVER w AS p_end FROM words WINDOW w AS (PARTITION BY session_id ORDER BY word_idx)),
 s AS (SELECT *, CASE WHEN p_end IS NULL THEN 0 WHEN {condition} THEN 1 ELSE 0 END AS f FROM l),
 u AS (SELECT *, CAST(sum(f) OVER (PARTITION BY session_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS INT) AS utt_idx FROM s)"""


_BY_GAP = _islands("p_spk <> speaker OR start_sec - p_end >= 0.5")
_ROLLED = """, a AS (SELECT session_id, utt_idx, speaker, count(*) AS n_words, arg_min(start_sec, word_idx) AS s, arg_max(end_sec, word_idx) AS e FROM u GROUP BY ALL),
 b AS (SELECT *, greatest(0, s - 0.15) AS ps, least(max(e) OVER (PARTITION BY session_id), e + 0.15) AS pe FROM a)"""
_r2 = lambda x: f"round_even(({x}) * 100, 0) / 100"


@query(_BY_GAP + " SELECT session_id, word_idx, utt_idx FROM u")
def seq1_islands(spark, d):
    return S.utterance_islands(T.words(spark, d)).select("session_id", "word_idx", "utt_idx")


@query(_islands("p_spk <> speaker") + " SELECT session_id, utt_idx, count(*) AS n_words FROM u GROUP BY ALL")
def seq2_speaker_islands(spark, d):
    return S.utterance_islands(T.words(spark, d), None).groupBy("session_id", "utt_idx").agg(F.count("*").alias("n_words"))


@query(_BY_GAP + _ROLLED + f" SELECT session_id, utt_idx, speaker, n_words, {_r2('s')} AS start_sec, {_r2('e')} AS end_sec, {_r2('ps')} AS padded_start_sec, {_r2('pe')} AS padded_end_sec, {_r2('pe - ps')} AS duration_sec FROM b")
def seq7_padding(spark, d):
    return S.rolled_up(S.utterance_islands(T.words(spark, d)))


@query("""WITH c AS (SELECT *, CASE WHEN turn % 5 = 0 THEN NULL ELSE role END AS spk FROM conversations),
 l AS (SELECT *, lag(spk) OVER w AS p, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, CAST(sum(CASE WHEN rn > 1 AND spk IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INT) AS run FROM l""")
def seq9_null_safe_islands(spark, d):
    c = T.table(spark, d, "conversations").withColumn("spk", F.when(F.col("turn") % 5 != 0, F.col("role")))
    return S.islands(c, ["conv_id"], ["turn"], S.differs("spk"), "run").select("conv_id", "turn", "run")


@query(f"WITH {T.SQL_WORDS} SELECT session_id, word_idx, CASE WHEN p IS NOT NULL THEN {_r2('greatest(0, start_sec - p)')} END AS silence_before_sec FROM (SELECT *, lag(end_sec) OVER (PARTITION BY session_id ORDER BY word_idx) AS p FROM words)")
def seq12_silence_before(spark, d):
    return S.silence_before(T.words(spark, d), "word_idx").select("session_id", "word_idx", "silence_before_sec")


@query(f"""WITH {T.SQL_UTTERANCES}, l AS (SELECT *, lag(speaker) OVER w AS p, row_number() OVER w AS rn FROM utterances WINDOW w AS (PARTITION BY session_id ORDER BY sequence_order)),
 r AS (SELECT *, CAST(sum(CASE WHEN rn > 1 AND speaker IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY sequence_order ROWS UNBOUNDED PRECEDING) AS INT) AS run FROM l),
 e AS (SELECT session_id, run + 1 AS run, left(arg_max(text, sequence_order), 60) AS gist FROM r GROUP BY ALL)
 SELECT session_id, sequence_order, run, gist FROM r LEFT JOIN e USING (session_id, run)""")
def seq13_previous_turn(spark, d):
    return S.previous_turn(T.utterances(spark, d))


@query("SELECT conv_id, turn, coalesce(try_cast(CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(turn AS VARCHAR) END AS BIGINT), row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS turn_index FROM conversations")
def seq14_turn_index(spark, d):
    given = F.when(F.col("turn") % 3 != 0, F.col("turn").cast("string"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return T.table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(given.try_cast("long"), pos).alias("turn_index"))


def _similarities(spark, d):
    w = Window.partitionBy("session_id").orderBy("vec_id")
    e = T.table(spark, d, "embeddings").withColumn("session_id", F.floor(F.col("vec_id") / 100)).withColumn("next", F.lead("embedding").over(w)).withColumn("next_label", F.lead("label").over(w))
    return e.where("next is not null").select("session_id", F.col("vec_id").alias("pos"), cosine(F.col("embedding"), F.col("next"), 1.0).alias("sim"), (F.col("label") == F.col("next_label")).alias("same"))


_SIMS = """v AS (SELECT vec_id // 100 AS session_id, vec_id, label, embedding, lead(embedding) OVER w AS nxt, lead(label) OVER w AS nl FROM embeddings WINDOW w AS (PARTITION BY vec_id // 100 ORDER BY vec_id)),
 sims AS (SELECT session_id, vec_id AS pos, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(nxt AS DOUBLE[])) AS sim, label = nl AS same FROM v WHERE nxt IS NOT NULL),
 d AS (SELECT *, greatest(0, coalesce(avg(sim) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), sim) - sim
   + coalesce(avg(sim) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), sim) - sim) AS depth FROM sims)"""


@query(f"WITH {_SIMS} SELECT session_id, pos, round(sim, 6) AS sim, round(depth, 6) AS depth FROM d")
def seq15_depth(spark, d):
    return S.depth_scores(_similarities(spark, d), 5).select("session_id", "pos", F.round("sim", 6).alias("sim"), F.round("depth", 6).alias("depth"))


@query(f"WITH {_SIMS} SELECT session_id, pos, round(CASE WHEN same THEN depth / 1.5 ELSE depth * 1.5 END, 6) AS score FROM d WHERE CASE WHEN same THEN depth / 1.5 ELSE depth * 1.5 END >= 0.06")
def seq16_candidates(spark, d):
    s = S.depth_scores(_similarities(spark, d), 5).withColumn("score", F.when(F.col("same"), F.col("depth") / 1.5).otherwise(F.col("depth") * 1.5))
    return s.where("score >= 0.06").select("session_id", "pos", F.round("score", 6).alias("score"))


@query()
def seq16_boundaries(spark, d):
    s = S.depth_scores(_similarities(spark, d), 5).withColumn("score", F.when(F.col("same"), F.col("depth") / 1.5).otherwise(F.col("depth") * 1.5))
    return segmentation.spaced_boundaries(s)


@query(_islands("p_spk <> speaker OR start_sec - p_end > 0.5") + """, r AS (SELECT session_id, utt_idx, arg_min(start_sec, word_idx) AS a, arg_max(end_sec, word_idx) AS b FROM u GROUP BY ALL),
 k AS (SELECT *, CAST(floor((b - a + 3.0) / 4.0) AS INT) AS n FROM r WHERE b - a >= 1.0)
 SELECT session_id, utt_idx, CAST(i AS INT) AS part, round(a + i * (b - a) / n, 6) AS win_start, round(a + (i + 1) * (b - a) / n, 6) AS win_end FROM k, unnest(range(n)) AS t(i)""")
def seq18_embedding_windows(spark, d):
    at = lambda c: F.round(c, 6).alias(c)
    return speakers.embedding_windows(T.words(spark, d)).select("session_id", "utt_idx", "part", at("win_start"), at("win_end"))


@query(f"""WITH {T.SQL_WORDS} SELECT session_id, word_idx, CASE WHEN p = n AND p <> speaker AND start_sec - pe < 2.0 AND ns - end_sec < 2.0 THEN p ELSE speaker END AS smoothed
 FROM (SELECT *, lag(speaker) OVER w AS p, lead(speaker) OVER w AS n, lag(end_sec) OVER w AS pe, lead(start_sec) OVER w AS ns FROM words WINDOW w AS (PARTITION BY session_id ORDER BY word_idx))""")
def seq19_smoothing(spark, d):
    return S.smoothed(T.words(spark, d), 2.0).select("session_id", "word_idx", "smoothed")


@query(f"""WITH {T.SQL_WORDS}, f AS (SELECT session_id, speaker, min(word_idx) AS i FROM words GROUP BY ALL),
 n AS (SELECT *, 'SPEAKER_' || lpad(CAST(row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS VARCHAR), 2, '0') AS label FROM f)
 SELECT session_id, word_idx, label FROM words JOIN n USING (session_id, speaker)""")
def seq23_renumber(spark, d):
    return S.renumbered(T.words(spark, d)).select("session_id", "word_idx", "label")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS queue_position FROM orders WHERE o_orderstatus = 'P'")
def seq24_queue_position(spark, d):
    waiting = T.table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return scans.Sliced(waiting, ["o_orderpriority"], ["o_orderdate", "o_orderkey"]).add("queue_position", scans.row_number()).result().select("o_orderkey", F.col("queue_position").cast("int").alias("queue_position"))


@query(f"""WITH {T.SQL_WORDS} SELECT session_id, word_idx, coalesce(p2 || ' ', '') || coalesce(p1, '') AS before, coalesce(n1, '') || coalesce(' ' || n2, '') AS after
 FROM (SELECT *, lag(speaker, 2) OVER w AS p2, lag(speaker) OVER w AS p1, lead(speaker) OVER w AS n1, lead(speaker, 2) OVER w AS n2 FROM words WINDOW w AS (PARTITION BY session_id ORDER BY word_idx))""")
def seq25_context(spark, d):
    w = Window.partitionBy("session_id").orderBy("word_idx")
    before, after = F.collect_list("speaker").over(w.rowsBetween(-2, -1)), F.collect_list("speaker").over(w.rowsBetween(1, 2))
    return T.words(spark, d).select("session_id", "word_idx", F.array_join(before, " ").alias("before"), F.array_join(after, " ").alias("after"))


@query("SELECT conv_id, turn, list_position(t, 'the') AS at FROM (SELECT conv_id, turn, list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM conversations) WHERE list_position(t, 'the') IS NOT NULL AND list_position(t, 'the') > 0")
def seq26_first_token(spark, d):
    from ..functions.texts import all_tokens

    at = F.array_position(all_tokens(F.col("text")), "the")
    return T.table(spark, d, "conversations").select("conv_id", "turn", at.cast("int").alias("at")).where("at > 0")


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS} SELECT session_id, start_sec, 'a' AS run, speaker FROM spoken UNION ALL SELECT session_id, start_sec, 'b' AS run, speaker FROM turns""")
def seq28_timeline(spark, d):
    a = T.spoken(spark, d).select("session_id", "start_sec", F.lit("a").alias("run"), "speaker")
    return a.unionByName(T.turns(spark, d).select("session_id", "start_sec", F.lit("b").alias("run"), "speaker")).orderBy("session_id", "start_sec", "run")


@query(f"""WITH {T.SQL_WORDS}, m AS (SELECT *, CASE WHEN word_idx % 4 IN (0, 1) THEN NULL ELSE speaker END AS spk FROM words),
 x AS (SELECT *, last_value(spk IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS b, lead(spk) OVER (PARTITION BY session_id ORDER BY word_idx) AS n FROM m)
 SELECT session_id, word_idx, coalesce(b, CASE WHEN word_idx = 0 THEN n END, 'SPEAKER_00') AS filled FROM x""")
def prj6_speaker_fallback(spark, d):
    m = T.words(spark, d).withColumn("speaker", F.when(~(F.col("word_idx") % 4).isin(0, 1), F.col("speaker")))
    return S.speaker_fallback(m).select("session_id", "word_idx", "filled")


@query(f"""WITH {T.SQL_WORDS}, c AS (SELECT *, floor(start_sec / 60) AS chunk FROM words), d AS (SELECT session_id, chunk, max(end_sec) - min(start_sec) AS dur FROM c GROUP BY ALL),
 o AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY session_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d)
 SELECT session_id, CAST(chunk AS BIGINT) AS chunk, round(off, 4) AS offset_sec FROM o""")
def prj3_chunk_offsets(spark, d):
    c = T.words(spark, d).groupBy("session_id", F.floor(F.col("start_sec") / 60).alias("chunk")).agg((F.max("end_sec") - F.min("start_sec")).alias("dur"))
    off = F.sum("dur").over(Window.partitionBy("session_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return c.select("session_id", "chunk", F.round(F.coalesce(off, F.lit(0.0)), 4).alias("offset_sec"))


@query()
def seq3_dynamic_windows(spark, d):
    return segmentation.utterances(T.words(spark, d), dynamic=True)


@query()
def seq8_segmentation(spark, d):
    return segmentation.utterances(T.words(spark, d))
