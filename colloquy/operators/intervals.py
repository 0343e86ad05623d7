"""Interval joins: an equi-join on keys and time bins, never a cross product of a session.

Each interval is put into all bins of BIN seconds that it touches; two intervals meet in the first bin they share, so a
pair comes out once. Work grows with the overlaps there are, not with the square of a session's rows, and
a session that holds a third of all rows is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans

BIN = 4.0


def _binned(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    first = F.floor(start / width)
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, F.floor(end / width)))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], on: Column, left_span=("start_sec", "end_sec"), right_span=("r_start", "r_end"), pad: float = 0.0, width: float = BIN) -> DataFrame:
    """Inner join of rows whose spans touch (right ones widened by pad) and that satisfy `on`. Right columns other
    than keys must have names of their own; `on` refers to columns of both sides by name."""
    l = _binned(left, F.col(left_span[0]), F.col(left_span[1]), width).withColumnRenamed("_first", "_l")
    r = _binned(right, F.col(right_span[0]) - pad, F.col(right_span[1]) + pad, width).withColumnRenamed("_first", "_r")
    met = l.join(r, [*keys, "_bin"]).where(F.col("_bin") == F.greatest("_l", "_r")).where(on)
    return met.drop("_bin", "_l", "_r")


def as_right(df: DataFrame, keys: list[str], prefix: str = "r_") -> DataFrame:
    """df with its columns other than keys renamed for use as the right side (start_sec -> r_start)."""
    names = {"start_sec": f"{prefix}start", "end_sec": f"{prefix}end"}
    return df.select(*keys, *(F.col(c).alias(names.get(c, prefix + c)) for c in df.columns if c not in keys))


TOLERANCE, BACKCHANNEL, BACKCHANNEL_MAX = 0.150, 0.300, 0.7


def map_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Words to speakers by their midpoint: in exactly one turn (both ends count) it is that turn's speaker; in more it
    is none, with the names; else the nearest turn edge within tolerance decides, for short words within a wider one."""
    middle = (F.col("start_sec") + F.col("end_sec")) / 2
    w = words.withColumn("mid", middle)
    near = F.greatest(F.col("r_start") - F.col("mid"), F.col("mid") - F.col("r_end"), F.lit(0.0))
    met = overlap_join(w.select("session_id", "word_idx", "mid"), as_right(turns, ["session_id"]), ["session_id"], near <= BACKCHANNEL, ("mid", "mid"), pad=BACKCHANNEL)
    inside = (F.col("mid") >= F.col("r_start")) & (F.col("mid") <= F.col("r_end"))
    found = met.groupBy("session_id", "word_idx").agg(
        F.count_if(inside).alias("n"),
        F.array_sort(F.collect_set(F.when(inside, F.col("r_speaker")))).alias("names"),
        F.min(F.struct(near.alias("dist"), F.col("r_turn_idx").alias("turn_idx"), F.col("r_speaker").alias("speaker"))).alias("nearest"),
    )
    some = turns.select("session_id").distinct().withColumn("any_turn", F.lit(True))
    joined = words.join(found, ["session_id", "word_idx"], "left").join(some, "session_id", "left")
    dist, ms = F.col("nearest.dist"), F.floor(F.col("nearest.dist") * 1000).cast("int")
    short = F.col("end_sec") - F.col("start_sec") <= BACKCHANNEL_MAX
    n = F.coalesce("n", F.lit(0))
    source = (
        F.when(F.col("start_sec").isNull() | F.col("end_sec").isNull(), "no_timestamp")
        .when(F.col("any_turn").isNull(), "no_diar_segments")
        .when(n == 1, "exact")
        .when(n > 1, F.concat(F.lit("overlap_"), F.array_join("names", "_")))
        .when(dist <= TOLERANCE, F.concat(F.lit("tolerance_"), ms, F.lit("ms")))
        .when((dist <= BACKCHANNEL) & short, F.concat(F.lit("backchannel_"), ms, F.lit("ms")))
        .otherwise("ambiguous")
    )
    named = joined.withColumn("speaker_source", source)
    speaker = F.when(F.col("speaker_source").rlike("^(exact|tolerance_|backchannel_)"), F.col("nearest.speaker"))
    return named.select("session_id", "word_idx", speaker.alias("mapped_speaker"), "speaker_source")


def overlapping_pairs(turns: DataFrame, least: float, other_speaker: bool) -> DataFrame:
    """Pairs of turns whose intersection lasts at least `least` seconds."""
    r = as_right(turns, ["session_id"])
    lo, hi = F.greatest("start_sec", "r_start"), F.least("end_sec", "r_end")
    on = (F.col("turn_idx") < F.col("r_turn_idx")) & (hi - lo >= least)
    if other_speaker:
        on = on & (F.col("speaker") != F.col("r_speaker"))
    return overlap_join(turns, r, ["session_id"], on).select("session_id", F.col("turn_idx").alias("a_idx"), F.col("r_turn_idx").alias("b_idx"), lo.alias("start_sec"), hi.alias("end_sec"), F.array_sort(F.array_distinct(F.array_compact(F.array("speaker", "r_speaker")))).alias("speakers"))


def merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Touching or overlapping ranges as one: a new one starts where start lies beyond all ends before. Equal ranges count once, so both scans see one order."""
    cut = scans.Sliced(ranges.select(*keys, "start_sec", "end_sec").distinct(), keys, ["start_sec", "end_sec"]).add("_before", scans.highest_before(F.col("end_sec")))
    cut.with_column("_new", F.when(F.col("start_sec") > F.col("_before"), 1).otherwise(0))
    islands = cut.add("_island", scans.running_sum(F.col("_new"))).result()
    return islands.groupBy(*keys, "_island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")).drop("_island")


def overlap_regions(turns: DataFrame, cutoff: float = 0.2) -> DataFrame:
    """Where different speakers talk at once for at least cutoff seconds, merged."""
    real = turns.where("start_sec is not null and end_sec > start_sec")
    return merged(overlapping_pairs(real, cutoff, True).select("session_id", "start_sec", "end_sec"), ["session_id"])


def clipped_overlap(spans: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Per span of spans(session_id, key, start_sec, end_sec): number, total and share of regions inside it, halves rounded up."""
    lo, hi = F.greatest("start_sec", "r_start"), F.least("end_sec", "r_end")
    part = F.rint(hi * 1000) / 1000 - F.rint(lo * 1000) / 1000
    cut = overlap_join(spans, as_right(regions, ["session_id"]), ["session_id"], hi - lo > 0.001).select("session_id", key, part.alias("part"))
    sums = cut.groupBy("session_id", key).agg(F.count("*").alias("n"), F.sum("part").alias("total"))
    length = F.col("end_sec") - F.col("start_sec")
    total = F.coalesce("total", F.lit(0.0))
    return spans.join(sums, ["session_id", key], "left").select("session_id", key, F.coalesce("n", F.lit(0)).alias("overlap_count"), (F.round(total * 1000) / 1000).alias("overlap_total"), F.when(length > 0, F.round(total / length * 10000) / 10000).otherwise(0.0).alias("overlap_ratio"))


def first_inside(points: DataFrame, spans: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per point (session_id, key, at): the value of the first span, by order, that holds it (both ends count), or null."""
    met = overlap_join(points, spans, ["session_id"], (F.col("at") >= F.col("r_start")) & (F.col("at") <= F.col("r_end")), ("at", "at"))
    best = met.groupBy("session_id", key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("b"))
    return points.join(best, ["session_id", key], "left").select("session_id", key, F.col("b.v").alias(value))


def nearest_start(points: DataFrame, spans: DataFrame, key: str, idx: str) -> DataFrame:
    """Per point: the span that holds it (earliest start first), else the span with the nearest start, at any
    distance. The second half is an as-of lookup in both directions over the union of both sides, not a join."""
    inside = overlap_join(points, spans, ["session_id"], (F.col("at") >= F.col("r_start")) & (F.col("at") <= F.col("r_end")), ("at", "at"))
    held = inside.groupBy("session_id", key).agg(F.min(F.struct("r_start", idx)).alias("i"))
    none = F.lit(None)
    span = F.struct(F.col("r_start").alias("s"), F.col(idx).alias("k"))
    p = points.select("session_id", F.col("at").alias("t"), F.lit(1).alias("side"), F.col(key), none.cast("struct<s:double,k:int>").alias("x"))
    s = spans.select("session_id", F.col("r_start").alias("t"), F.lit(0).alias("side"), none.cast("long").alias(key), span.cast("struct<s:double,k:int>").alias("x"))
    both = scans.Sliced(p.unionByName(s), ["session_id"], ["t", "side"]).add("b", scans.last_known(F.col("x"))).result()
    both = scans.Sliced(both.withColumn("_back", -F.col("t")), ["session_id"], ["_back", "side"]).add("a", scans.last_known(F.col("x"))).result().where("side = 1")

    def far(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.s") - F.col("t")).alias("d"), F.col(f"{c}.k").alias("k")))

    nearest = both.select("session_id", key, F.array_min(F.array_compact(F.array(far("b"), far("a"))))["k"].alias("n"))
    return nearest.join(held, ["session_id", key], "left").select("session_id", key, F.coalesce(F.col(f"i.{idx}"), F.col("n")).alias(idx), F.col("i").isNotNull().alias("inside"))


def nearest_edge(points: DataFrame, spans: DataFrame, key: str, idx: str) -> DataFrame:
    """Per point (session_id, key, at): the first span, by idx, that holds it, else the span whose start or end is nearest, the first of equals. Outside all
    spans only the last end before and the first start behind a point matter: two scans over the union of both sides."""
    inside = first_inside(points, spans.withColumn("_idx", F.col(idx)), key, idx, "_idx").withColumnRenamed("_idx", "_in")

    def scan(bound: str, sign: int, name: str, rows: DataFrame) -> DataFrame:
        empty = F.lit(None).cast("struct<t:double,k:long>")
        p = rows.select("*", (sign * F.col("at")).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_o"), empty.alias("_x"))
        s = spans.select("session_id", (sign * F.col(bound)).alias("_t"), F.lit(0).alias("_side"), (-F.col(idx)).cast("long").alias("_o"), F.struct(F.col(bound).cast("double").alias("t"), F.col(idx).cast("long").alias("k")).alias("_x"))
        both = scans.Sliced(p.unionByName(s, allowMissingColumns=True), ["session_id"], ["_t", "_side", "_o"]).add(name, scans.last_known(F.col("_x"))).result()
        return both.where("_side = 1").drop("_t", "_side", "_o", "_x")

    found = scan("r_start", -1, "_ahead", scan("r_end", 1, "_behind", points.select("session_id", key, "at")))
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("at")).alias("d"), F.col(f"{c}.k").alias("k")))
    best = F.array_min(F.array_compact(F.array(far("_behind"), far("_ahead"))))["k"]
    return found.join(inside, ["session_id", key], "left").select("session_id", key, F.coalesce("_in", best).cast("int").alias(idx))
