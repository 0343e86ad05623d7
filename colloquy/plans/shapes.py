"""Queries over nested values, JSON of any shape, clusters, anchors, names in words, and splits by groups and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, nested
from ..operators import anchors as A
from ..operators import clustering, relations
from ..sources import files
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


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN value END AS field, CASE WHEN event_id % 4 <> 2 THEN value END AS element, value AS other,
 CASE WHEN event_id % 4 <> 3 THEN value END AS in_map, event_type AS name, event_id % 5 = 0 AS missing FROM events""")
def prj5_nested(spark, d):
    """NaN and the infinities in a struct's field, in a struct inside an array, in a map inside a struct; a struct that is null stays null."""
    v, k = F.col("value").cast("double"), F.col("event_id") % 4
    of = lambda n, bad: F.when(k == n, F.lit(bad)).otherwise(v)
    e = T.table(spark, d, "events").select(
        "event_id",
        F.struct(of(1, float("nan")).alias("field"), F.col("event_type").alias("name"), F.create_map(F.lit("x"), F.array(of(3, float("-inf")))).alias("m")).alias("s"),
        F.array(F.struct(of(2, float("inf")).cast("float").alias("x")), F.struct(v.cast("float").alias("x"))).alias("a"),
        F.when(F.col("event_id") % 5 != 0, F.struct(v.alias("x"))).alias("n"),
        v.alias("v"),
    )
    c = nested.finite_everywhere(e)
    exact = lambda x: F.when(x.isNotNull(), F.col("v"))  # noqa: E731  the arrays hold floats
    return c.select("event_id", "s.field", exact(F.col("a")[0]["x"]).alias("element"), exact(F.col("a")[1]["x"]).alias("other"), F.col("s.m")["x"][0].alias("in_map"), "s.name", F.col("n").isNull().alias("missing"))


@query(r"""SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE (turn % 4 < 3 AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '') OR (turn % 4 = 3 AND length(text) > 1)
 UNION ALL SELECT conv_id, turn, 'more' FROM conversations WHERE turn % 4 = 3""")
def src5_found_texts(spark, d):
    """Turns as JSON documents of four shapes: an object, a list of objects deep inside, an alias that is no string beside one that is, bare strings."""
    c, t = T.table(spark, d, "conversations"), F.col("text")
    stripped = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    first = F.to_json(F.struct(F.lit("u").alias("role"), t.alias("text")))
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit(1).alias("n"), t.alias("발화"))).alias("list")).alias("data")))
    beside = F.to_json(F.struct(F.lit(7).alias("text"), t.alias("utterance"), F.lit("not looked at").alias("원문")))
    bare = F.to_json(F.struct(F.array(F.array(stripped, F.lit("x")), F.array(F.lit("more"))).alias("parts")))
    shape = F.when(F.col("turn") % 4 == 0, first).when(F.col("turn") % 4 == 1, deep).when(F.col("turn") % 4 == 2, beside).otherwise(bare)
    return files.found_texts(c.select(F.struct("conv_id", "turn").alias("file"), shape.alias("value"))).select("file.*", "text")


_UNIT = "SELECT vec_id, vec_id // 50 AS s, label % 2 AS k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"


@query(f"""WITH v AS ({_UNIT}), p AS (SELECT a.s, a.k = b.k AS same, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.s = b.s AND a.vec_id < b.vec_id)
 SELECT s AS session_id, round(least(1, greatest(0, coalesce(avg(c) FILTER (WHERE same), 1) - coalesce(avg(c) FILTER (WHERE NOT same), 0))), 6) + 0.0 AS confidence FROM p GROUP BY s""")
def vec5_confidence(spark, d):
    e = T.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("session_id"), (F.col("label") % 2).alias("label"), "embedding")
    return clustering.confidences(e).select("session_id", (F.round("confidence", 6) + 0.0).alias("confidence"))


def _openings(spark, d):
    """Vectors as turns of two speakers with pitches; in every third session the pitches are too near."""
    k, s = F.col("vec_id") % 2, F.floor(F.col("vec_id") / 50)
    f0 = 120.0 + F.when(s % 3 == 0, 3).otherwise(60) * k + F.col("vec_id") % 7
    start = (F.col("vec_id") % 50).cast("double")
    return T.table(spark, d, "embeddings").select(s.alias("session_id"), F.concat(F.lit("spk"), k).alias("speaker"), start.alias("start_sec"), (start + 0.25 * (F.col("vec_id") % 5)).alias("end_sec"), f0.alias("f0"), "embedding", "vec_id")


_ANCHORS = """WITH t AS (SELECT vec_id // 50 AS s, vec_id % 2 AS k, 0.25 * (vec_id % 5) AS n, 120.0 + CASE WHEN vec_id // 50 % 3 = 0 THEN 3 ELSE 60 END * (vec_id % 2) + vec_id % 7 AS f0, vec_id, embedding FROM embeddings),
 f AS (SELECT s, k, quantile_cont(f0, 0.5) AS f0 FROM t GROUP BY ALL), p AS (SELECT s FROM f GROUP BY s HAVING count(*) = 2 AND max(f0) - min(f0) >= 8),
 u AS (SELECT s, k, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM t WHERE n >= 0.6), m AS (SELECT s, k, i, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY ALL),
 a AS (SELECT s, k, list(x ORDER BY i) AS v FROM m GROUP BY ALL), l AS (SELECT * FROM a JOIN p USING (s))"""


@query(_ANCHORS + """, n AS (SELECT s, k, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM l)
 SELECT x.s AS session_id, round(list_inner_product(x.v, list_transform(range(len(x.v)), lambda i: CAST(i % 5 AS DOUBLE))), 6) AS low, round(list_inner_product(y.v, list_transform(range(len(y.v)), lambda i: CAST(i % 5 AS DOUBLE))), 6) AS high,
 round(list_inner_product(x.v, y.v), 6) AS alike FROM n x JOIN n y ON x.s = y.s AND x.k = 0 AND y.k = 1""")
def vec9_anchors(spark, d):
    a = clustering.anchors(_openings(spark, d))
    digest = lambda c: F.round(F.aggregate(F.transform(c, lambda x, i: x * (i % 5)), F.lit(0.0), lambda s, x: s + x), 6)
    alike = F.round(F.aggregate(F.zip_with("low", "high", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6)
    return a.select("session_id", digest("low").alias("low"), digest("high").alias("high"), alike.alias("alike"))


@query(_ANCHORS + """, c AS (SELECT t.s, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), x.v) AS lo, list_cosine_similarity(CAST(embedding AS DOUBLE[]), y.v) AS hi, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM t LEFT JOIN l x ON x.s = t.s AND x.k = 0 LEFT JOIN l y ON y.s = t.s AND y.k = 1)
 SELECT s AS session_id, vec_id AS word_idx, CASE WHEN lo IS NOT NULL THEN CASE WHEN lo >= hi THEN 'SPEAKER_01' ELSE 'SPEAKER_00' END END AS label, round(coalesce(abs(lo - hi), 0), 6) AS margin FROM c""")
def dz5_anchored(spark, d):
    """Anchors from the openings' turns, then each vector to the nearer one."""
    t = _openings(spark, d)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    words = t.select("session_id", F.col("vec_id").alias("word_idx"), F.transform("embedding", lambda x: x.cast("double") / norm).alias("embedding"))
    return A.nearest_anchor(words, clustering.anchors(t)).select("session_id", "word_idx", "label", F.round("margin", 6).alias("margin"))


_RANKED = "('0x' || left(md5({k} || ':42'), 15))::BIGINT"


@query(f"""WITH g AS (SELECT o_custkey, min(o_orderpriority) AS stratum FROM orders GROUP BY o_custkey), h AS (SELECT *, {_RANKED.format(k='o_custkey')} AS h FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h % 65536, h, o_custkey) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM h)
 SELECT o_orderkey, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'val' ELSE 'test' END AS part FROM orders JOIN r USING (o_custkey)""")
def set9_stratified_groups(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return relations.group_split(o, "o_custkey", (0.8, 0.1, 0.1), stratum="o_orderpriority").select("o_orderkey", "part")


@query("""WITH RECURSIVE c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), o AS (SELECT n, row_number() OVER (ORDER BY n DESC, o_custkey) AS i FROM c),
 g AS (SELECT 0::BIGINT AS i, 0::BIGINT AS n, '' AS part, 70 * sum(n)::BIGINT AS a, 15 * sum(n)::BIGINT AS b, 15 * sum(n)::BIGINT AS c FROM o
  UNION ALL SELECT o.i, o.n, p, a - CASE p WHEN 'train' THEN 100 * o.n ELSE 0 END, b - CASE p WHEN 'val' THEN 100 * o.n ELSE 0 END, c - CASE p WHEN 'test' THEN 100 * o.n ELSE 0 END
  FROM g JOIN o ON o.i = g.i + 1, LATERAL (SELECT CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END AS p) x)
 SELECT n AS size, part, count(*) AS components FROM g WHERE i > 0 GROUP BY ALL""")
def set11_component_split(spark, d):
    """Customers as components of their orders; which component of a size goes where is a matter of its rank, so counts by size and part are compared."""
    parts = clustering.component_split(T.table(spark, d, "orders").select("o_custkey"), "o_custkey")
    return parts.groupBy("size", "part").agg(F.count("*").alias("components"))


_CALLED = """WITH t AS (SELECT conv_id, turn, text, string_split_regex(text, '\\s+') AS ws, turn % 3 AS k FROM conversations)"""


def _called(spark, d):
    """Turns with a name in front, a name that is called behind, or neither."""
    k, t = F.col("turn") % 3, F.col("text")
    said = F.when(k == 0, F.concat(F.lit("김현정이 왔다 "), t)).when(k == 1, F.concat(t, F.lit(" 소리야"))).otherwise(t)
    return T.table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), said.alias("text"), F.transform(F.split(said, r"\s+"), lambda w: F.struct(w.alias("word"))).alias("words"))


@query(_CALLED + """ SELECT conv_id, turn, CASE k WHEN 0 THEN '[PII_이름]이 왔다 ' || text WHEN 1 THEN text || ' 소리야' ELSE text END AS masked,
 CASE k WHEN 0 THEN '[PII_이름]이 왔다 ' ELSE '' END || array_to_string(ws, ' ') || CASE k WHEN 1 THEN ' 소리야' ELSE '' END AS words, CASE k WHEN 0 THEN 1 ELSE 0 END AS n_masked FROM t""")
def fn18_names_in_words(spark, d):
    out = names.masked_in_step(_called(spark, d))
    return out.select("id.*", "masked", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("words"), "n_masked")


@query(_CALLED + """ SELECT conv_id, turn, CASE k WHEN 0 THEN 'object_nim:사물+님 확신형환각 추정: 인증서님' WHEN 1 THEN 'vocative:호격 추정: 소리야' ELSE '' END AS flags, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS priority FROM t""")
def fn22_review_flags(spark, d):
    """Every third turn comes with a noun and its honorific as morphemes, another third with a title or a name and theirs."""
    k = F.col("id.turn") % 3
    of = lambda *pairs: F.array(*(F.struct(F.lit(a).alias("form"), F.lit(b).alias("tag")) for a, b in pairs))
    morphemes = F.when(k == 0, of(("인증서", "NNG"), ("님", "XSN"))).when(k == 1, of(("선생", "NNG"), ("님", "XSN"), ("김현정", "NNP"), ("님", "XSN"))).otherwise(of(("님", "XSN"), ("가", "VV"), ("님", "XSN")))
    r = _called(spark, d).select("id", names.review_flags(F.col("text"), morphemes).alias("r"))
    return r.select("id.*", F.array_join(F.transform("r.flags", lambda f: F.concat(f["type"], F.lit(":"), f["detail"])), "|").alias("flags"), "r.priority")


@query(f"""WITH {T.SQL_WORDS}, {T.SQL_TURNS}, v AS (SELECT *, CASE WHEN turn_idx < 5 THEN 'I' ELSE speaker END AS c, 100.0 + 10 * (turn_idx % 3) + ascii(right(speaker, 1)) % 2 AS f0 FROM turns WHERE speaker <> 'S2' OR turn_idx < 5),
 g AS (SELECT session_id, c, max(end_sec) AS last, quantile_cont(f0, 0.5) AS f0 FROM v GROUP BY ALL), s AS (SELECT session_id, max(end_sec) AS dur FROM words GROUP BY ALL),
 i AS (SELECT g.*, count(*) OVER (PARTITION BY session_id) > 2 AND last < 0.5 * dur AS ivr FROM g JOIN s USING (session_id)),
 m AS (SELECT session_id, coalesce(max(CASE WHEN ivr THEN last END), 0) AS cut, count(*) FILTER (WHERE NOT ivr) AS n, arg_min(c, struct_pack(a := f0, b := c)) FILTER (WHERE NOT ivr) AS lo, arg_max(c, struct_pack(a := f0, b := c)) FILTER (WHERE NOT ivr) AS hi,
  max(f0) FILTER (WHERE NOT ivr) - min(f0) FILTER (WHERE NOT ivr) AS gap, bool_or(ivr) AS announced FROM i GROUP BY session_id),
 j AS (SELECT w.session_id, w.word_idx, arg_min(v.c, struct_pack(a := CASE WHEN w.start_sec BETWEEN v.start_sec AND v.end_sec THEN 0 ELSE 1 END, b := CASE WHEN w.start_sec BETWEEN v.start_sec AND v.end_sec THEN 0.0 ELSE least(abs(w.start_sec - v.start_sec), abs(w.start_sec - v.end_sec)) END, c := v.turn_idx)) AS c FROM words w JOIN v USING (session_id) GROUP BY ALL)
 SELECT w.session_id, w.word_idx, CASE WHEN n = 2 AND (gap >= 8 OR announced) THEN CASE WHEN i.ivr OR (cut > 0 AND w.start_sec < cut) THEN 'SPEAKER_IVR' WHEN j.c = lo THEN 'SPEAKER_01' WHEN j.c = hi THEN 'SPEAKER_00' ELSE w.speaker END ELSE w.speaker END AS speaker
 FROM words w LEFT JOIN m USING (session_id) LEFT JOIN j USING (session_id, word_idx) LEFT JOIN i ON i.session_id = w.session_id AND i.c = j.c""")
def dz4_rediarized(spark, d):
    """The first turns of a session as an announcement, two speakers behind them."""
    t = T.turns(spark, d).where((F.col("speaker") != "S2") | (F.col("turn_idx") < 5))
    f0 = 100.0 + 10 * (F.col("turn_idx") % 3) + F.ascii(F.right("speaker", F.lit(1))) % 2
    t = t.withColumn("f0", f0).withColumn("speaker", F.when(F.col("turn_idx") < 5, "I").otherwise(F.col("speaker")))
    w = T.words(spark, d)
    return A.rediarized(w, t, w.groupBy("session_id").agg(F.max("end_sec").alias("duration"))).select("session_id", "word_idx", "speaker")
