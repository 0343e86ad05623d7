"""Queries over interval, semi, anti and matching joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine
from ..operators import clustering
from ..operators import intervals as I
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


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS},
 m AS (SELECT *, (start_sec + end_sec) / 2 AS mid FROM spoken),
 j AS (SELECT m.session_id, m.word_idx, m.mid, m.end_sec - m.start_sec AS dur, t.turn_idx, t.speaker, m.mid >= t.start_sec AND m.mid <= t.end_sec AS inside,
         greatest(t.start_sec - m.mid, m.mid - t.end_sec, 0.0) AS dist FROM m LEFT JOIN turns t USING (session_id)),
 a AS (SELECT session_id, word_idx, any_value(dur) AS dur, count(*) FILTER (WHERE inside) AS n, array_to_string(list_sort(list_distinct(list(speaker) FILTER (WHERE inside))), '_') AS names,
         min(struct_pack(d := dist, i := turn_idx, s := speaker)) AS b FROM j GROUP BY ALL),
 r AS (SELECT *, CASE WHEN b.i IS NULL THEN 'no_diar_segments' WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'overlap_' || names
         WHEN b.d <= 0.150 THEN 'tolerance_' || CAST(floor(b.d * 1000) AS INT) || 'ms' WHEN b.d <= 0.300 AND dur <= 0.7 THEN 'backchannel_' || CAST(floor(b.d * 1000) AS INT) || 'ms' ELSE 'ambiguous' END AS speaker_source FROM a)
 SELECT session_id, word_idx, CASE WHEN speaker_source = 'exact' OR speaker_source LIKE 'tolerance%' OR speaker_source LIKE 'backchannel%' THEN b.s END AS mapped_speaker, speaker_source FROM r""")
def jn1_map_speakers(spark, d):
    return I.map_speakers(T.spoken(spark, d), T.turns(spark, d))


_PAIRS = """SELECT a.session_id, a.turn_idx AS a_idx, b.turn_idx AS b_idx, greatest(a.start_sec, b.start_sec) AS start_sec, least(a.end_sec, b.end_sec) AS end_sec{more}
 FROM turns a JOIN turns b ON a.session_id = b.session_id AND a.turn_idx < b.turn_idx AND least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec) >= {least}{other}"""


@query(f"WITH {T.SQL_TURNS} " + _PAIRS.format(more=", CASE WHEN a.speaker = b.speaker THEN a.speaker ELSE least(a.speaker, b.speaker) || '|' || greatest(a.speaker, b.speaker) END AS speakers", least=0.05, other=""))
def jn3_overlap_ranges(spark, d):
    return I.overlapping_pairs(T.turns(spark, d), 0.05, False).withColumn("speakers", F.array_join("speakers", "|"))


_MERGED = """f AS (SELECT *, CASE WHEN start_sec > max(end_sec) OVER (PARTITION BY session_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM {src}),
 g AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS i FROM f),
 regions AS (SELECT session_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM g GROUP BY session_id, i)"""
_REGIONS = f"WITH {T.SQL_TURNS}, p AS ({_PAIRS.format(more='', least=0.2, other=' AND a.speaker <> b.speaker AND a.end_sec > a.start_sec AND b.end_sec > b.start_sec')}), " + _MERGED.format(src="p")


@query(_REGIONS + " SELECT session_id, start_sec, end_sec FROM regions")
def jn5_overlap_regions(spark, d):
    return I.overlap_regions(T.turns(spark, d))


@query(f"WITH {T.SQL_TURNS}, " + _MERGED.format(src="turns") + " SELECT session_id, start_sec, end_sec FROM regions")
def seq11_merge_ranges(spark, d):
    return I.merged(T.turns(spark, d).select("session_id", "start_sec", "end_sec"), ["session_id"])


@query(_REGIONS + """, c AS (SELECT t.session_id, t.turn_idx, round_even(least(t.end_sec, r.end_sec) * 1000, 0) / 1000 - round_even(greatest(t.start_sec, r.start_sec) * 1000, 0) / 1000 AS part
   FROM turns t JOIN regions r ON t.session_id = r.session_id AND least(t.end_sec, r.end_sec) - greatest(t.start_sec, r.start_sec) > 0.001),
 s AS (SELECT session_id, turn_idx, count(*) AS n, sum(part) AS total FROM c GROUP BY ALL)
 SELECT t.session_id, t.turn_idx, coalesce(n, 0) AS overlap_count, round(coalesce(total, 0), 3) AS overlap_total, CASE WHEN t.end_sec > t.start_sec THEN round(coalesce(total, 0) / (t.end_sec - t.start_sec), 4) ELSE 0 END AS overlap_ratio
 FROM turns t LEFT JOIN s USING (session_id, turn_idx)""")
def jn6_overlap_features(spark, d):
    turns = T.turns(spark, d)
    return I.clipped_overlap(turns, I.overlap_regions(turns), "turn_idx")


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS}
 SELECT w.session_id, w.word_idx, t.turn_idx, round_even(greatest(w.start_sec, t.start_sec) * 100, 0) / 100 AS iv_start, round_even(least(w.end_sec, t.end_sec) * 100, 0) / 100 AS iv_end
 FROM spoken w JOIN turns t ON w.session_id = t.session_id AND t.start_sec < w.end_sec AND t.end_sec > w.start_sec""")
def jn9_half_open_intervals(spark, d):
    on = (F.col("r_start") < F.col("end_sec")) & (F.col("r_end") > F.col("start_sec"))
    met = I.overlap_join(T.spoken(spark, d), I.as_right(T.turns(spark, d), ["session_id"]), ["session_id"], on)
    two = lambda c: F.rint(c * 100) / 100
    return met.select("session_id", "word_idx", F.col("r_turn_idx").alias("turn_idx"), two(F.greatest("start_sec", "r_start")).alias("iv_start"), two(F.least("end_sec", "r_end")).alias("iv_end"))


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS},
 j AS (SELECT w.session_id, w.word_idx, t.turn_idx, t.start_sec AS s, w.start_sec >= t.start_sec AND w.start_sec <= t.end_sec AS inside, abs(t.start_sec - w.start_sec) AS dist FROM spoken w LEFT JOIN turns t USING (session_id))
 SELECT session_id, word_idx, arg_min(turn_idx, struct_pack(a := CASE WHEN inside THEN 0 ELSE 1 END, b := CASE WHEN inside THEN s ELSE dist END, c := turn_idx)) AS turn_idx, coalesce(bool_or(inside), false) AS inside FROM j GROUP BY ALL""")
def jn11_inside_or_nearest(spark, d):
    points = T.spoken(spark, d).select("session_id", F.col("word_idx").cast("long").alias("word_idx"), F.col("start_sec").alias("at"))
    return I.nearest_start(points, I.as_right(T.turns(spark, d), ["session_id"]).withColumnRenamed("r_turn_idx", "turn_idx"), "word_idx", "turn_idx")


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS}
 SELECT w.session_id, w.word_idx, arg_min(t.speaker, t.turn_idx) AS turn_speaker FROM spoken w LEFT JOIN turns t ON w.session_id = t.session_id AND w.start_sec >= t.start_sec AND w.start_sec <= t.end_sec GROUP BY ALL""")
def jn12_first_match(spark, d):
    points = T.spoken(spark, d).select("session_id", "word_idx", F.col("start_sec").alias("at"))
    right = I.as_right(T.turns(spark, d), ["session_id"]).withColumnRenamed("r_speaker", "turn_speaker")
    return I.first_inside(points, right, "word_idx", "r_turn_idx", "turn_speaker")


@query("SELECT o.o_orderkey, o.o_custkey, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def jn13_label_lookup(spark, d):
    o, c, n = (T.table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("o_orderkey", "o_custkey", "c_name", "n_name")


@query("SELECT o_orderkey, l_linenumber, l_linenumber + 1 AS sequence_order FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def jn14_bridge(spark, d):
    o, l = T.table(spark, d, "orders").where("o_orderstatus = 'F'"), T.table(spark, d, "lineitem")
    packed = l.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("indices"))  # an order has at most seven lines
    return o.join(packed, o.o_orderkey == packed.l_orderkey).select("o_orderkey", F.explode("indices").alias("l_linenumber")).withColumn("sequence_order", F.col("l_linenumber") + 1)


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn15_unlabelled(spark, d):
    return T.table(spark, d, "documents").select("doc_id", "source").join(T.table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)")
def jn16_eligible(spark, d):
    o = T.table(spark, d, "orders").where("o_orderstatus = 'P' and o_totalprice > 400000")
    c = T.table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("""SELECT c_custkey, n_name, r_name, count(*) AS n_orders, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def jn17_four_way(spark, d):
    o, c, n, r = (T.table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("c_custkey", "n_name", "r_name").agg(F.count("*").alias("n_orders"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS}
 SELECT w.session_id, w.word_idx, EXISTS (SELECT 1 FROM turns t WHERE t.session_id = w.session_id AND NOT (w.end_sec < t.start_sec OR w.start_sec > t.end_sec)) AS touched FROM spoken w""")
def jn18_touches_any(spark, d):
    w = T.spoken(spark, d)
    hit = I.overlap_join(w, I.as_right(T.turns(spark, d), ["session_id"]), ["session_id"], (F.col("end_sec") >= F.col("r_start")) & (F.col("start_sec") <= F.col("r_end"))).select("session_id", "word_idx").distinct().withColumn("hit", F.lit(True))
    return w.join(hit, ["session_id", "word_idx"], "left").select("session_id", "word_idx", F.coalesce("hit", F.lit(False)).alias("touched"))


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS},
 j AS (SELECT w.session_id, w.word_idx, w.speaker, t.turn_idx, t.speaker AS ref, abs((w.start_sec + w.end_sec) / 2 - (t.start_sec + t.end_sec) / 2) AS dist FROM spoken w JOIN turns t USING (session_id))
 SELECT session_id, word_idx, arg_min(ref, struct_pack(a := dist, b := turn_idx)) AS ref_speaker FROM j WHERE dist < 0.25 GROUP BY ALL""")
def jn19_nearest_with_collar(spark, d):
    w = T.spoken(spark, d).withColumn("mid", (F.col("start_sec") + F.col("end_sec")) / 2)
    r = I.as_right(T.turns(spark, d), ["session_id"]).withColumn("r_mid", (F.col("r_start") + F.col("r_end")) / 2)
    dist = F.abs(F.col("mid") - F.col("r_mid"))
    met = I.overlap_join(w, r, ["session_id"], dist < 0.25, ("mid", "mid"), ("r_mid", "r_mid"), pad=0.25)
    return met.groupBy("session_id", "word_idx").agg(F.min(F.struct(dist.alias("d"), "r_turn_idx", "r_speaker")).alias("b")).select("session_id", "word_idx", F.col("b.r_speaker").alias("ref_speaker"))


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS}, small AS (SELECT * FROM spoken WHERE end_sec - start_sec >= 0.12)
 SELECT b.session_id, b.turn_idx, min(s.word_idx) AS word_idx FROM turns b JOIN small s ON b.session_id = s.session_id AND s.start_sec >= b.start_sec AND s.end_sec <= b.end_sec GROUP BY ALL""")
def jn22_enclosed(spark, d):
    big = T.turns(spark, d)
    small = I.as_right(T.spoken(spark, d).where("end_sec - start_sec >= 0.12"), ["session_id"])
    met = I.overlap_join(big, small, ["session_id"], (F.col("r_start") >= F.col("start_sec")) & (F.col("r_end") <= F.col("end_sec")))
    return met.groupBy("session_id", "turn_idx").agg(F.min("r_word_idx").alias("word_idx"))


@query(f"""WITH {T.SQL_SPOKEN}, {T.SQL_TURNS}
 SELECT w.session_id, w.speaker AS spk_a, t.speaker AS spk_b, round(sum(least(w.end_sec, t.end_sec) - greatest(w.start_sec, t.start_sec)), 4) AS seconds
 FROM spoken w JOIN turns t ON w.session_id = t.session_id AND least(w.end_sec, t.end_sec) - greatest(w.start_sec, t.start_sec) > 0 GROUP BY ALL""")
def jn23_overlap_area(spark, d):
    part = F.least("end_sec", "r_end") - F.greatest("start_sec", "r_start")
    met = I.overlap_join(T.spoken(spark, d), I.as_right(T.turns(spark, d), ["session_id"]), ["session_id"], part > 0)
    return met.groupBy("session_id", F.col("speaker").alias("spk_a"), F.col("r_speaker").alias("spk_b")).agg(F.round(F.sum(part), 4).alias("seconds"))


_CENTRES = """e AS (SELECT label, vec_id % 2 AS side, generate_subscripts(embedding, 1) AS k, unnest(embedding) AS x FROM embeddings),
 m AS (SELECT label, side, k, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL),
 p AS (SELECT a.label AS la, b.label AS lb, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS c FROM m a JOIN m b ON a.k = b.k AND a.side = 0 AND b.side = 1 GROUP BY ALL)"""


def _centre_pairs(spark, d):
    """Cosines of label centres of the two halves; the number of labels is fixed, so the pairs are few."""
    e = T.table(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("side"), F.posexplode("embedding").alias("k", "x"))
    m = e.groupBy("label", "side", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = m.groupBy("label", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    a, b = v.where("side = 0").select(F.lit(1).alias("one"), F.col("label").alias("la"), F.col("v").alias("va")), v.where("side = 1").select(F.lit(1).alias("one"), F.col("label").alias("lb"), F.col("v").alias("vb"))
    return a.join(b, "one").select("la", "lb", cosine(F.col("va"), F.col("vb")).alias("c"))


@query(f"""WITH {_CENTRES}, r AS (SELECT *, row_number() OVER (PARTITION BY la ORDER BY c DESC, lb) AS ra, row_number() OVER (PARTITION BY lb ORDER BY c DESC, la) AS rb FROM p),
 f AS (SELECT la, max(CASE WHEN ra = 1 THEN lb END) AS lb, max(c) AS c, max(c) - coalesce(max(CASE WHEN ra = 2 THEN c END), -1) AS m FROM r GROUP BY la),
 b AS (SELECT lb, max(CASE WHEN rb = 1 THEN la END) AS la, max(c) - coalesce(max(CASE WHEN rb = 2 THEN c END), -1) AS m FROM r GROUP BY lb),
 j AS (SELECT f.la, f.lb, f.c, b.la = f.la AS mutual, f.m >= 0.05 AND b.m >= 0.05 AND b.la = f.la AS ok FROM f JOIN b ON f.lb = b.lb)
 SELECT la, lb, round(c, 6) AS cosine, mutual, ok, bool_and(ok) OVER () AS clear FROM j""")
def jn24_mutual_best(spark, d):
    """Every label's best match over the vectors as they are; mutual ones are marked, and whether the map is clear as a whole."""
    return clustering.best_matches(_centre_pairs(spark, d)).withColumn("cosine", F.round("c", 6)).select("la", "lb", "cosine", "mutual", "ok", "clear")


@query(f"""WITH {_CENTRES}, r AS (SELECT la, c, row_number() OVER (PARTITION BY la ORDER BY c DESC, lb) AS ra FROM p)
 SELECT round(min(b), 6) AS margin FROM (SELECT la, max(CASE WHEN ra = 1 THEN c END) - coalesce(max(CASE WHEN ra = 2 THEN c END), -1) AS b FROM r GROUP BY la)""")
def jn25_cosine_margin(spark, d):
    r = _centre_pairs(spark, d).withColumn("ra", F.row_number().over(Window.partitionBy("la").orderBy(F.desc("c"), "lb")))
    b = r.groupBy("la").agg((F.max(F.when(F.col("ra") == 1, F.col("c"))) - F.coalesce(F.max(F.when(F.col("ra") == 2, F.col("c"))), F.lit(-1.0))).alias("b"))
    return b.agg(F.round(F.min("b"), 6).alias("margin"))


@query(f"""WITH {T.SQL_WORDS}, f AS (SELECT session_id, speaker, median(end_sec - start_sec) AS f0, word_idx % 2 AS side FROM words GROUP BY session_id, speaker, word_idx % 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY session_id, side ORDER BY f0, speaker) AS rk FROM f)
 SELECT a.session_id, a.rk, a.speaker AS spk_a, b.speaker AS spk_b FROM r a JOIN r b ON a.session_id = b.session_id AND a.rk = b.rk AND a.side = 0 AND b.side = 1""")
def jn26_rank_match(spark, d):
    f = T.words(spark, d).groupBy("session_id", "speaker", (F.col("word_idx") % 2).alias("side")).agg(F.percentile(F.col("end_sec") - F.col("start_sec"), 0.5).alias("f0"))
    r = f.withColumn("rk", F.row_number().over(Window.partitionBy("session_id", "side").orderBy("f0", "speaker")))
    a, b = r.where("side = 0").select("session_id", "rk", F.col("speaker").alias("spk_a")), r.where("side = 1").select("session_id", "rk", F.col("speaker").alias("spk_b"))
    return a.join(b, ["session_id", "rk"])


@query(f"""WITH {T.SQL_WORDS}, c AS (SELECT *, floor(start_sec / 30) AS chunk FROM words), w AS (SELECT session_id, chunk, chunk * 30 AS c0, chunk * 30 + 30 AS c1 FROM c GROUP BY ALL)
 SELECT w.session_id, CAST(w.chunk AS BIGINT) AS chunk, count(*) AS n_words FROM w JOIN words x ON x.session_id = w.session_id AND x.start_sec < w.c1 AND x.end_sec > w.c0 GROUP BY ALL""")
def jn27_words_in_chunks(spark, d):
    words = T.words(spark, d)
    chunk = F.floor(F.col("start_sec") / 30)
    w = words.select("session_id", chunk.alias("chunk")).distinct().select("session_id", "chunk", (F.col("chunk") * 30).cast("double").alias("r_start"), (F.col("chunk") * 30 + 30).cast("double").alias("r_end"))
    met = I.overlap_join(words, w, ["session_id"], (F.col("start_sec") < F.col("r_end")) & (F.col("end_sec") > F.col("r_start")), width=30.0)
    return met.groupBy("session_id", "chunk").agg(F.count("*").alias("n_words"))


@query("""SELECT a.conv_id, a.turn, coalesce(b.text, '') AS hypothesis FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def jn28_gold_hypothesis(spark, d):
    c = T.table(spark, d, "conversations")
    hyp = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return c.select("conv_id", "turn").join(hyp, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("hypothesis", F.lit("")).alias("hypothesis"))


@query("SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
def jn29_common_keys(spark, d):
    o = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    c = T.table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return o.join(c, "k").select("k", "n")


@query("""SELECT s.s_suppkey, c.c_custkey, c.c_nationkey = s.s_nationkey AS allowed FROM supplier s JOIN customer c ON s.s_suppkey = c.c_custkey""")
def jn30_user_isolation(spark, d):
    s, c = T.table(spark, d, "supplier"), T.table(spark, d, "customer")
    return s.join(c, s.s_suppkey == c.c_custkey).select("s_suppkey", "c_custkey", (F.col("c_nationkey") == F.col("s_nationkey")).alias("allowed"))
