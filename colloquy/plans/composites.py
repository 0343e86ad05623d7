"""Composite operators: speaker assignment of segments, personal data in words and time, topic segments, hybrid intro."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import pii as P
from ..functions import texts as X
from ..functions.numbers import cosine
from ..operators import intervals as I
from ..operators import sequences as S
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


def assigned(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Words with speakers, cut into segments where the speaker changes (an unknown speaker counts as one of its own):
    bounds, number of words, and how many words each kind of source decided."""
    mapped = I.map_speakers(words, turns)
    spoken = words.drop("speaker").join(mapped, ["session_id", "word_idx"])
    runs = S.islands(spoken, ["session_id"], ["word_idx"], S.differs("mapped_speaker"), "segment_idx")
    kind = F.regexp_replace("speaker_source", "^(overlap|tolerance|backchannel)_.*$", "$1")
    of = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return runs.withColumn("kind", kind).groupBy("session_id", "segment_idx", "mapped_speaker").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count("*").alias("n_words"), *map(of, ("exact", "overlap", "tolerance", "backchannel", "ambiguous")))


PLACE = "struct<a:int,b:int>"
PLACES = f"array<{PLACE}>"
WORDS = "array<struct<word:string,start_sec:double,end_sec:double>>"
RANGES = "array<struct<start_sec:double,end_sec:double,type:string>>"


def word_offsets(text: Column, words: Column) -> Column:
    """Where each word stands in the text, searched on from the word before, in any case; null where it isn't found.

    Folds copy the array they grow, so words are folded in parts of about the square root of their number, and each part looks on in
    what is left of the text.
    """

    def step(rest: Column):
        def one(acc: Column, word: Column) -> Column:
            found = F.when(F.length(word) > 0, F.call_function("locate", F.lower(word), rest, acc["at"] + 1) - 1).otherwise(-1)
            place = F.when(found >= 0, F.struct(found.alias("a"), (found + F.length(word)).alias("b")))
            return F.struct(F.when(found >= 0, found + F.length(word)).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.array(place)).cast(PLACES).alias("out"))

        return one

    def part(acc: Column, some: Column) -> Column:
        def joined(inner: Column) -> Column:
            moved = F.transform(inner["out"], lambda p: F.when(p.isNotNull(), F.struct((p["a"] + acc["at"]).alias("a"), (p["b"] + acc["at"]).alias("b"))).cast(PLACE))
            rest = F.substring(acc["rest"], inner["at"] + 1, F.length(acc["rest"]))
            return F.struct((acc["at"] + inner["at"]).cast("int").alias("at"), rest.alias("rest"), F.concat(acc["out"], moved).cast(PLACES).alias("out"))

        return F.aggregate(some, F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out")), step(acc["rest"]), joined)

    def all_(s: Column) -> Column:
        n, size = F.size(s["words"]), s["size"]
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / size) - 1, F.lit(0)).cast("int")), lambda k: F.slice(s["words"], k * size + 1, size))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), s["low"].alias("rest"), F.array().cast(PLACES).alias("out")), part, lambda acc: acc["out"])

    return X.once(all_, low=F.coalesce(F.lower(text), F.lit("")), words=words, size=F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(words)))).cast("int"))


def touched_words(rows: DataFrame) -> DataFrame:
    """rows(id, words, places, spans array<struct<a, b, k>>) -> one row per pair of a span and a word that it touches: id, j (number of
    the span), k (its type), i (number of the word), start_sec, end_sec. Both sides meet in stretches of 64 characters."""
    w = rows.select("id", F.posexplode(F.arrays_zip("places", "words")).alias("i", "w")).where("w.places is not null")
    w = w.select("id", "i", F.col("w.places.a").alias("a"), F.col("w.places.b").alias("b"), F.col("w.words.start_sec").alias("start_sec"), F.col("w.words.end_sec").alias("end_sec"))
    s = rows.select("id", F.posexplode("spans").alias("j", "s")).select("id", "j", F.col("s.a").alias("r_start"), F.col("s.b").alias("r_end"), F.col("s.k").alias("k"))
    return I.overlap_join(w, s, ["id"], (F.col("a") < F.col("r_end")) & (F.col("b") > F.col("r_start")), ("a", "b"), width=64.0).select("id", "j", "k", "i", "start_sec", "end_sec")


def time_ranges(touched: DataFrame, pad: float = 0.15) -> DataFrame:
    """Spans in seconds: from the first to the last word they touch, padded; equal ranges of one type once. (id, j, start_sec, end_sec, type)"""
    spans = touched.groupBy("id", "j", F.col("k").alias("type")).agg(F.greatest(F.lit(0.0), F.min("start_sec") - pad).alias("start_sec"), (F.max("end_sec") + pad).alias("end_sec"))
    first = F.min(F.struct("j", "start_sec", "end_sec")).alias("f")
    return spans.groupBy("id", "type", F.round("start_sec", 4).alias("s"), F.round("end_sec", 4).alias("e")).agg(first).select("id", "f.*", "type")


def masked_words(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Words in step with the masked text: the first word of a span becomes its token and lasts to the span's last word,
    the others go. (id, words)"""
    spans = touched.groupBy("id", "j", "k").agg(F.min("i").alias("first"), F.max(F.struct("i", "end_sec"))["end_sec"].alias("till"))
    token = F.struct(F.concat(F.lit("[PII_"), F.col("k"), F.lit("]")).alias("word"), F.col("till").alias("end_sec"))
    begins = F.col("i") == F.col("first")
    marks = touched.select("id", "j", "i").join(spans, ["id", "j"]).groupBy("id", "i").agg(F.bool_or(~begins).alias("gone"), F.max_by(token, F.when(begins, F.col("j"))).alias("token"))
    words = rows.select("id", F.posexplode("words").alias("i", "w")).join(marks, ["id", "i"], "left").where(~F.coalesce("gone", F.lit(False)))
    new = F.struct(F.coalesce("token.word", "w.word").alias("word"), F.col("w.start_sec").alias("start_sec"), F.when(F.col("token").isNotNull(), F.col("token.end_sec")).otherwise(F.col("w.end_sec")).alias("end_sec"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", new.alias("w")))), lambda x: x["w"])
    return words.groupBy("id").agg(listed.cast(WORDS).alias("words"))


def _given(rows: DataFrame) -> Column:
    """The words as WORDS, null ones as empty."""
    kind = rows.schema["words"].dataType
    if isinstance(kind, ArrayType) and not kind.containsNull and not kind.elementType["word"].nullable and kind.simpleString() == WORDS:
        return F.coalesce("words", F.array().cast(WORDS))
    return F.transform(F.coalesce(F.col("words"), F.array().cast(WORDS)), lambda w: F.struct(F.coalesce(w["word"], F.lit("")).alias("word"), w["start_sec"].cast("double").alias("start_sec"), w["end_sec"].cast("double").alias("end_sec"))).cast(WORDS)


def _located(rows: DataFrame, rules) -> DataFrame:
    """rows(id, text, words) that hold a span: text, words, all spans (raw), spans without overlaps."""
    found = rows.where(P.has_span(F.col("text"), rules)).select("id", F.coalesce("text", F.lit("")).alias("text"), _given(rows).alias("words"), P.pii_spans(F.col("text"), rules).alias("raw"))
    taken = F.transform(P.without_overlaps(F.col("raw")), lambda s: F.struct(s["char_start"].alias("a"), s["char_end"].alias("b"), s["type"].alias("k")))
    return found.select("*", taken.alias("spans"))


def _least(times: list):
    """The least time, or None; null times don't count, NaN lies above all."""
    return min((t for t in times if t is not None), key=lambda t: (t != t, t), default=None)


def _greatest(times: list):
    return max((t for t in times if t is not None), key=lambda t: (t != t, t), default=None)


def _rounded(time: float | None):
    """To four decimals, halves away from zero, as Spark rounds."""
    return None if time is None else str(time) if not math.isfinite(time) else Decimal(repr(time)).quantize(Decimal("0.0001"), ROUND_HALF_UP)


def _found(low: str, words: list, lengths: list) -> list:
    """As word_offsets, of a text and words in lower case: (number of the word, start, end) of the words that are found."""
    at, found = 0, []
    for i, (word, n) in enumerate(zip(words, lengths)):
        k = low.find(word, at) if n else -1
        if k >= 0:
            at = k + n
            found.append((i, k, at))
    return found


def _marks(low: str, words: list, lengths: list, spans: list, starts: list, ends: list, pad: float) -> dict:
    """What the spans of one text, without overlaps and in order, do to its words: per word 0 (stays), -1 (goes) or the number of the span, from 1, whose token
    it becomes; per span the last word that it touches; the spans in seconds, equal ranges of one type once. Words that are found lie in
    order, so those that a span touches follow each other."""
    places = _found(low, words, lengths)
    found, begins, stops = ([p[k] for p in places] for k in range(3))
    marks, lasts, ranges, gone = [0] * len(words), [-1] * len(spans), {}, set()
    for j, s in enumerate(spans):
        touched = found[bisect_right(stops, s["a"]) : bisect_left(begins, s["b"])]
        if not touched:
            continue
        marks[touched[0]], lasts[j] = j + 1, touched[-1]
        gone.update(touched[1:])
        low, high = _least([starts[i] for i in touched]), _greatest([ends[i] for i in touched])
        low, high = _greatest([0.0, None if low is None else low - pad]), None if high is None else high + pad
        ranges.setdefault((s["k"], _rounded(low), _rounded(high)), {"start_sec": low, "end_sec": high, "type": s["k"]})
    for i in gone:
        marks[i] = -1
    return {"marks": marks, "lasts": lasts, "ranges": list(ranges.values())}


def _marker(pad: float):
    kind = pa.struct([("marks", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32())), ("ranges", pa.list_(pa.struct([("start_sec", pa.float64()), ("end_sec", pa.float64()), ("type", pa.string())])))])

    def marked(low: pa.Array, words: pa.Array, lengths: pa.Array, spans: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array((_marks(*(x.as_py() for x in row), pad) for row in zip(low, words, lengths, spans, starts, ends)), kind, size=len(low))

    return F.arrow_udf(marked, f"struct<marks:array<int>,lasts:array<int>,ranges:{RANGES}>")


def _told(found: DataFrame, pad: float = 0.15) -> DataFrame:
    """found with what the spans do to the words (`told`, see _marks)."""
    of = lambda f: F.transform("words", lambda w: f(w["word"]))
    return found.withColumn("told", _marker(pad)(F.lower("text"), of(F.lower), of(F.length), "spans", "words.start_sec", "words.end_sec"))


def masked_utterances(rows: DataFrame, rules=P.RULES) -> DataFrame:
    """rows(id, text, words array<struct<word, start_sec, end_sec>>) -> id, masked text, masked words, time ranges. Rows without a span, most of them,
    pass as they are; in the others the spans meet the words in the row itself. Nothing is shuffled; rows are read twice, once for each kind. The words
    are in step with the masked text: the first word of a span becomes its token and lasts to the span's last word, the others go."""
    found = _told(_located(rows, rules))

    def new(w: Column, i: Column) -> Column:
        mark = F.col("told.marks")[i]
        token = F.struct(F.concat(F.lit("[PII_"), F.col("spans")[mark - 1]["k"], F.lit("]")).alias("word"), w["start_sec"].alias("start_sec"), F.col("words")[F.col("told.lasts")[mark - 1]]["end_sec"].alias("end_sec"))
        return F.when(mark == 0, w).when(mark > 0, token)

    words = F.filter(F.transform("words", new), lambda w: w.isNotNull()).cast(WORDS)
    done = found.select("id", P.masked(F.col("text"), F.col("raw")).alias("masked"), words.alias("words"), F.col("told.ranges").cast(RANGES).alias("ranges"))
    none = F.array().cast(RANGES).alias("ranges")
    return rows.where(~P.has_span(F.col("text"), rules)).select("id", P.plain(F.col("text")).alias("masked"), _given(rows).alias("words"), none).union(done)


def pii_summary(rows: DataFrame, rules=P.RULES) -> DataFrame:
    """rows(id, text, words) -> per id and type how many spans were masked and how many time ranges there are; a type that is only
    among the ranges counts as often as it has ranges."""
    of = lambda kinds, n: F.transform(kinds, lambda k: F.struct(k.alias("type"), F.lit(n).alias("ranges")))
    both = F.concat(of(F.col("spans.k"), 0), of(F.col("told.ranges.type"), 1))
    counts = _told(_located(rows, rules)).select("id", F.inline(both)).groupBy("id", "type").agg(F.count_if(F.col("ranges") == 0).alias("n_spans"), F.count_if(F.col("ranges") == 1).alias("n_ranges"))
    return counts.select("id", "type", F.when(F.col("n_spans") > 0, F.col("n_spans")).otherwise(F.col("n_ranges")).alias("n"), "n_ranges")


def topic_segments(utterances: DataFrame, window: int = 5, least: float = 0.06, apart: int = 3, topics=(("기타", []),), default: str = "기타") -> DataFrame:
    """utterances(session_id, index, start_sec, end_sec, speaker, text, embedding) -> one row per topic segment. Boundaries by
    similarity depth, weighed by changes of speaker; the topic by keywords; a session without embeddings is one segment."""
    w = Window.partitionBy("session_id").orderBy("index")
    e = utterances.withColumn("next", F.lead("embedding").over(w)).withColumn("next_speaker", F.lead("speaker").over(w)).withColumn("pos", F.row_number().over(w) - 1)
    sims = e.where("next is not null and embedding is not null").select("session_id", "pos", cosine(F.col("embedding"), F.col("next"), 1.0).alias("sim"), F.col("speaker").eqNullSafe(F.col("next_speaker")).alias("same"))
    scored = S.depth_scores(sims, window).withColumn("score", F.when(F.col("same"), F.col("depth") / 1.5).otherwise(F.col("depth") * 1.5))
    cuts = segmentation.spaced_boundaries(scored, least, apart)
    marked = e.join(cuts.select("session_id", F.col("boundary").alias("pos"), F.lit(1).alias("cut")), ["session_id", "pos"], "left")
    numbered = marked.withColumn("segment_index", F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), " ")
    seg = numbered.groupBy("session_id", "segment_index").agg(
        (F.min(F.struct("index", "start_sec"))["start_sec"] * 1000).cast("int").alias("start_ms"),
        (F.max(F.struct("index", "end_sec"))["end_sec"] * 1000).cast("int").alias("end_ms"),
        F.array_sort(F.collect_list("index")).alias("utterance_indices"),
        joined.alias("text"),
    )
    return seg.withColumn("topic", X.keyword_argmax(F.col("text"), list(topics), default)).drop("text")


def hybrid_intro(words: DataFrame, outer: DataFrame, names: DataFrame, seconds: float, overlaps: DataFrame) -> DataFrame:
    """Words that begin within the intro take the speaker of the outer turn they begin in, under the name it maps to,
    unless they begin inside an overlap region. names(session_id, outer, speaker)."""
    intro = words.where(F.col("start_sec") < seconds).withColumn("at", F.col("start_sec"))
    right = I.as_right(outer, ["session_id"])
    turn = I.first_inside(intro.select("session_id", "word_idx", "at"), right, "word_idx", "r_turn_idx", "r_speaker")
    inside = I.overlap_join(intro.select("session_id", "word_idx", "at"), I.as_right(overlaps, ["session_id"]), ["session_id"], (F.col("at") >= F.col("r_start")) & (F.col("at") <= F.col("r_end")), ("at", "at"))
    known = turn.join(inside.select("session_id", "word_idx").distinct(), ["session_id", "word_idx"], "left_anti").join(names, (turn.session_id == names.session_id) & (F.col("r_speaker") == F.col("outer"))).select(turn.session_id, "word_idx", names.speaker.alias("new"))
    return words.join(known, ["session_id", "word_idx"], "left").withColumn("speaker", F.coalesce("new", "speaker")).drop("new")


_ASSIGNED = """, k AS (SELECT session_id, word_idx, start_sec, end_sec, mapped_speaker, CASE WHEN speaker_source LIKE '%\\_%' ESCAPE '\\' AND speaker_source NOT LIKE 'no\\_%' ESCAPE '\\' THEN split_part(speaker_source, '_', 1) ELSE speaker_source END AS kind FROM mapped JOIN spoken USING (session_id, word_idx)),
 f AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND mapped_speaker IS DISTINCT FROM lag(mapped_speaker) OVER w THEN 1 ELSE 0 END AS n FROM k WINDOW w AS (PARTITION BY session_id ORDER BY word_idx)),
 g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY session_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS INT) AS segment_idx FROM f)
 SELECT session_id, segment_idx, mapped_speaker, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS n_words, count(*) FILTER (WHERE kind = 'exact') AS n_exact, count(*) FILTER (WHERE kind = 'overlap') AS n_overlap,
 count(*) FILTER (WHERE kind = 'tolerance') AS n_tolerance, count(*) FILTER (WHERE kind = 'backchannel') AS n_backchannel, count(*) FILTER (WHERE kind = 'ambiguous') AS n_ambiguous FROM g GROUP BY session_id, segment_idx, mapped_speaker"""


def _assigned_sql() -> str:
    from . import joins

    body = joins.SQL["jn1_map_speakers"]
    head, _, last = body.rpartition("\n SELECT session_id, word_idx, CASE")
    return f"{head}, mapped AS (SELECT session_id, word_idx, CASE{last}){_ASSIGNED}"


@query(_assigned_sql())
def jn2_assign_speakers(spark, d):
    return assigned(T.spoken(spark, d), T.turns(spark, d))


@query()
def seq17_topic_segments(spark, d):
    e = T.table(spark, d, "embeddings")
    u = e.select(F.floor(F.col("vec_id") / 100).alias("session_id"), F.col("vec_id").cast("int").alias("index"), F.col("vec_id").cast("double").alias("start_sec"), (F.col("vec_id") + 0.5).alias("end_sec"), F.col("label").cast("string").alias("speaker"), F.lit("").alias("text"), "embedding")
    return topic_segments(u).withColumn("utterance_indices", F.array_join(F.transform("utterance_indices", lambda x: x.cast("string")), ","))


def _timed(spark, d):
    """Documents as utterances: their tokens as words of half a second each."""
    words = F.transform(X.all_tokens(F.col("text")), lambda t, i: F.struct(t.alias("word"), i.cast("double").alias("start_sec"), (i + 0.5).cast("double").alias("end_sec")))
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", words.alias("words"))


_EMAIL = next(r for r in P.RULES if r[0] == "이메일")
_MAIL = f"'{_EMAIL[1]}'"
_TIMED_SQL = f"""WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS ws FROM documents),
 w AS (SELECT id, text, ws, list_filter(range(len(ws)), lambda i: regexp_matches(ws[i + 1], {_MAIL})) AS hit FROM t)"""


@query(_TIMED_SQL + f""" SELECT id, regexp_replace(text, {_MAIL}, '[PII_이메일]', 'g') AS masked, array_to_string(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, {_MAIL}) THEN '[PII_이메일]' ELSE w END), ' ') AS words,
 array_to_string(list_transform(hit, lambda i: printf('%.2f-%.2f', greatest(0, i - 0.15), i + 0.65)), ',') AS ranges FROM w""")
def fn6_masked_utterances(spark, d):
    """Mail addresses only, so that SQL can say it; the other rules are tested on fixtures."""
    out = masked_utterances(_timed(spark, d), [_EMAIL])
    told = F.transform("ranges", lambda r: F.format_string("%.2f-%.2f", r["start_sec"], r["end_sec"]))
    return out.select("id", "masked", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("words"), F.array_join(told, ",").alias("ranges"))


@query(_TIMED_SQL + f" SELECT id, '이메일' AS type, len(regexp_extract_all(text, {_MAIL})) AS n, len(hit) AS n_ranges FROM w WHERE len(hit) > 0")
def agg2_pii_summary(spark, d):
    return pii_summary(_timed(spark, d), [_EMAIL])


@query()
def fn6_all_rules(spark, d):
    out = masked_utterances(_timed(spark, d))
    return out.select("id", "masked", F.size("words").alias("n_words"), F.size("ranges").alias("n_ranges"))
