"""Queries over audio as frame rows. Embeddings serve as pieces of recordings: twenty vectors in a row are one, at 200 samples a second, every
fifth vector is loud, the others are soft or silent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames
from ..sources import tables as T

QUERIES: dict = {}
SQL: dict = {}
RATE = 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pieces(spark, d):
    k = F.col("vec_id") % 5
    scale = F.when(k == 0, 0.5).when(k == 4, 0.0).otherwise(0.01 * k)
    samples = F.transform("embedding", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * scale)))
    return T.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("rec_id"), F.lit(RATE).alias("rate"), F.col("vec_id").alias("piece"), samples.alias("samples"))


def _told(pieces):
    """Digests of the samples of each recording: how many, their sum, and a sum that depends on their places."""
    whole = frames.joined(pieces)
    total = lambda f: F.round(F.aggregate(F.transform("samples", f), F.lit(0.0), lambda s, x: s + x), 4) + 0.0
    return whole.select("rec_id", F.size("samples").alias("n"), total(lambda x, i: x).alias("total"), total(lambda x, i: x * (i % 7)).alias("weighed"))


_SAMPLES = """WITH r AS (SELECT vec_id, vec_id // 20 AS rec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM embeddings),
 s AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY vec_id, j) - 1 AS i,
  greatest(-1, least(1, CAST(x AS DOUBLE) * CASE vec_id % 5 WHEN 0 THEN 0.5 WHEN 4 THEN 0.0 ELSE 0.01 * (vec_id % 5) END)) AS x FROM r)"""
_DIGESTS = "SELECT rec_id, count(*) AS n, round(sum(x), 4) + 0.0 AS total, round(sum(x * (i % 7)), 4) + 0.0 AS weighed"


def _gained(gate: str) -> str:
    return (
        _SAMPLES
        + f""", e AS (SELECT rec_id, i // 20 AS k, sum(x * x) AS e, count(*) AS c FROM s GROUP BY ALL),
 l AS (SELECT * FROM (SELECT rec_id, k, sqrt(sum(e) OVER w / 100) AS level, sum(c) OVER w AS c FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE c = 100),
 f AS (SELECT rec_id, 3 * greatest(coalesce(quantile_cont(level, 0.1) FILTER (WHERE level > 1e-9), 0), pow(10, -2.5)) AS gate, max(k) AS last FROM l GROUP BY rec_id),
 g AS (SELECT rec_id, k, CASE WHEN level <= 1e-7 OR {gate} THEN 1 ELSE greatest(1, least(0.1 / level, 10)) END AS gain FROM l JOIN f USING (rec_id)),
 p AS (SELECT s.*, (i - 50) / 20.0 AS p, last FROM s LEFT JOIN f USING (rec_id)),
 o AS (SELECT p.rec_id, i, CASE WHEN last IS NULL THEN x ELSE greatest(-1, least(1, x * (a.gain + (p - floor(p)) * (b.gain - a.gain)))) END AS x FROM p
  LEFT JOIN g a ON a.rec_id = p.rec_id AND a.k = greatest(0, least(last, floor(p))) LEFT JOIN g b ON b.rec_id = p.rec_id AND b.k = greatest(0, least(last, floor(p) + 1)))
 {_DIGESTS} FROM o GROUP BY rec_id"""
    )


@query(_gained("false"))
def aud2_local_gain(spark, d):
    return _told(frames.locally_gained(_pieces(spark, d)))


@query(_gained("level < gate"))
def aud3_gated_gain(spark, d):
    return _told(frames.locally_gained(_pieces(spark, d), gated=True))


@query(_SAMPLES + f""", f AS (SELECT rec_id, i // 4 AS k, sqrt(avg(x * x)) < 0.005 AND count(*) = 4 AS quiet FROM s GROUP BY ALL),
 b AS (SELECT *, CASE WHEN quiet IS DISTINCT FROM lag(quiet) OVER (PARTITION BY rec_id ORDER BY k) THEN 1 ELSE 0 END AS new FROM f),
 t AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM b),
 n AS (SELECT *, count(*) OVER (PARTITION BY rec_id, run) AS n, min(k) OVER (PARTITION BY rec_id, run) AS first FROM t),
 h AS (SELECT s.rec_id, s.i AS place, CASE WHEN quiet AND n * 4 > 200 THEN 0 ELSE x END AS x FROM s JOIN n ON n.rec_id = s.rec_id AND n.k = s.i // 4 WHERE NOT (quiet AND n * 4 > 200 AND s.i - first * 4 >= 100)),
 o AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY place) - 1 AS i, x FROM h)
 {_DIGESTS} FROM o GROUP BY rec_id""")
def aud4_silence(spark, d):
    return _told(frames.silence_compressed(_pieces(spark, d)))


@query(_SAMPLES + """, f AS (SELECT rec_id, i // 20 AS k, sqrt(avg(x * x)) AS l, count(*) AS c FROM s GROUP BY ALL),
 q AS (SELECT rec_id, l, row_number() OVER (PARTITION BY rec_id ORDER BY l) - 1 AS r, count(*) OVER (PARTITION BY rec_id) AS m FROM f WHERE c = 20),
 v AS (SELECT rec_id, max(m) AS m, avg(l) FILTER (WHERE r < greatest(1, m // 10)) AS noise, avg(l) FILTER (WHERE r >= m // 2) AS speech FROM q GROUP BY rec_id),
 w AS (SELECT rec_id, sqrt(avg(x * x)) AS rms, avg(CASE WHEN abs(x) > 0.99 THEN 1.0 ELSE 0.0 END) AS c FROM s GROUP BY rec_id)
 SELECT rec_id, round(rms, 4) AS rms, round(c, 5) AS clipping_ratio, round(CASE WHEN m > 1 THEN CASE WHEN noise > 1e-8 THEN 20 * log10(speech / noise) ELSE 60.0 END ELSE 0.0 END, 1) AS snr_db FROM w LEFT JOIN v USING (rec_id)""")
def aud8_statistics(spark, d):
    return frames.statistics(_pieces(spark, d))


@query(_SAMPLES + f""", m AS (SELECT rec_id, 0.5 AS a, 1.2 AS b FROM s GROUP BY rec_id UNION ALL SELECT rec_id, 1.1, 2.005 + rec_id % 3 FROM s GROUP BY rec_id),
 o AS (SELECT rec_id, i, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.rec_id = s.rec_id AND i >= floor(a * 200) AND i < floor(b * 200)) THEN x ELSE 0 END AS x FROM s)
 {_DIGESTS} FROM o GROUP BY rec_id""")
def aud12_speaker_only(spark, d):
    p = _pieces(spark, d)
    recs = p.select("rec_id").distinct()
    spans = recs.select("rec_id", F.lit(0.5).alias("start_sec"), F.lit(1.2).alias("end_sec")).union(recs.select("rec_id", F.lit(1.1), 2.005 + F.col("rec_id") % 3))
    return _told(frames.only(p, spans))
