"""Ordered-sequence operators as scans and window functions: islands, padding, lag features, renumbering, depth scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round2
from . import scans

GAP = 0.5
PADDING = 0.15


def islands(rows: DataFrame, keys: list[str], order: list[str], starts: Callable[[Callable[[str], Column]], Column], name: str) -> DataFrame:
    """Numbers runs of rows from 0; starts(before) is true where a run begins, before(column) being the value of the row before (the first
    row always begins one)."""
    asked: list[str] = []

    def before(column: str) -> Column:
        asked.append(column)
        return F.col("_before")[column]

    begins = starts(before)
    cut = scans.Sliced(rows, keys, order).add("_before", scans.previous(F.struct(F.lit(1).alias("_"), *dict.fromkeys(asked))))
    cut.with_column("_begins", F.when(F.col("_before").isNull(), 0).when(begins, 1).otherwise(0))
    return cut.add(name, scans.running_sum(F.col("_begins"))).result().withColumn(name, F.col(name).cast("int")).drop("_before", "_begins")


def differs(column: str) -> Callable[[Callable[[str], Column]], Column]:
    """For islands(): the column differs from that of the row before, null being a value of its own."""
    return lambda before: ~before(column).eqNullSafe(F.col(column))


def utterance_islands(words: DataFrame, gap: float | None = GAP) -> DataFrame:
    """A new utterance on a change of speaker or, unless gap is None, after a silence of at least gap seconds."""

    def starts(before: Callable[[str], Column]) -> Column:
        new = before("speaker") != F.col("speaker")
        return new if gap is None else new | (F.col("start_sec") - before("end_sec") >= gap)

    return islands(words, ["session_id"], ["word_idx"], starts, "utt_idx")


def rolled_up(words: DataFrame, padding: float = PADDING, total: Column | None = None) -> DataFrame:
    """One row per utterance: bounds from its first and last word, padded bounds, and the padded length."""
    first, last = F.min(F.struct("word_idx", "start_sec")), F.max(F.struct("word_idx", "end_sec"))
    u = words.groupBy("session_id", "utt_idx", "speaker").agg(first.alias("f"), last.alias("l"), F.count("*").alias("n_words"))
    u = u.select("session_id", "utt_idx", "speaker", "n_words", F.col("f.start_sec").alias("s"), F.col("l.end_sec").alias("e"))
    ends = F.max("e").over(Window.partitionBy("session_id")) if total is None else total
    ps, pe = F.greatest(F.lit(0.0), F.col("s") - padding), F.least(ends, F.col("e") + padding)
    return u.select("session_id", "utt_idx", "speaker", "n_words", round2(F.col("s")).alias("start_sec"), round2(F.col("e")).alias("end_sec"), round2(ps).alias("padded_start_sec"), round2(pe).alias("padded_end_sec"), round2(pe - ps).alias("duration_sec"))


def silence_before(rows: DataFrame, order: str) -> DataFrame:
    """Seconds since the previous row's end, at least 0; null for the first row."""
    cut = scans.Sliced(rows, ["session_id"], [order]).add("_end", scans.previous(F.col("end_sec")))
    gap = F.col("start_sec") - F.col("_end")
    return cut.result().withColumn("silence_before_sec", F.when(gap.isNotNull(), round2(F.greatest(F.lit(0.0), gap)))).drop("_end")


def speaker_fallback(words: DataFrame, default: str = "SPEAKER_00") -> DataFrame:
    """Fills missing speakers: from the previous word; a single missing first word takes the next one's, a longer
    missing start the default."""
    cut = scans.Sliced(words, ["session_id"], ["word_idx"]).add("_known", scans.last_known(F.col("speaker")))
    cut.add("_first", scans.previous(F.lit(1))).add("_next", scans.following(F.col("speaker")))
    return cut.result().withColumn("filled", F.coalesce("_known", F.when(F.col("_first").isNull(), F.col("_next")), F.lit(default))).drop("_known", "_first", "_next")


def smoothed(words: DataFrame, gap: float) -> DataFrame:
    """A label between two equal other labels becomes theirs if both gaps are small; reads the labels as they were."""
    cut = scans.Sliced(words, ["session_id"], ["word_idx"]).add("_p", scans.previous(F.struct("speaker", "end_sec"))).add("_f", scans.following(F.struct("speaker", "start_sec")))
    p = F.col("_p.speaker")
    near = (F.col("start_sec") - F.col("_p.end_sec") < gap) & (F.col("_f.start_sec") - F.col("end_sec") < gap)
    between = (p == F.col("_f.speaker")) & (p != F.col("speaker")) & near
    return cut.result().withColumn("smoothed", F.when(between, p).otherwise(F.col("speaker"))).drop("_p", "_f")


def renumbered(words: DataFrame) -> DataFrame:
    """Speakers as SPEAKER_nn by first appearance."""
    first = words.groupBy("session_id", "speaker").agg(F.min("word_idx").alias("first"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("first")) - 1
    return words.join(first.select("session_id", "speaker", F.format_string("SPEAKER_%02d", number).alias("label")), ["session_id", "speaker"])


def previous_turn(rows: DataFrame, keep: int = 60) -> DataFrame:
    """The last row of the other speaker before each row's run, shortened; null for the first run."""
    ran = islands(rows, ["session_id"], ["sequence_order"], differs("speaker"), "run")
    last = ran.groupBy("session_id", "run").agg(F.max(F.struct("sequence_order", "text")).alias("l")).select("session_id", (F.col("run") + 1).alias("run"), F.left(F.col("l.text"), F.lit(keep)).alias("gist"))
    return ran.join(last, ["session_id", "run"], "left").select("session_id", "sequence_order", "run", "gist")


def depth_scores(sims: DataFrame, window: int, keys=("session_id",), order: str = "pos") -> DataFrame:
    """TextTiling depth: mean of up to window similarities on each side (own value where there is none) minus own."""
    w = Window.partitionBy(*keys).orderBy(order)
    left = F.coalesce(F.avg("sim").over(w.rowsBetween(-window, -1)), F.col("sim"))
    right = F.coalesce(F.avg("sim").over(w.rowsBetween(1, window)), F.col("sim"))
    return sims.withColumn("depth", F.greatest(F.lit(0.0), (left - F.col("sim")) + (right - F.col("sim"))))


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def first_of_equal(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Keeps the first row of each key in the given order, unlike dropDuplicates."""
    kept = rows.withColumn("_k", key)
    best = kept.groupBy("_k").agg(F.min(F.struct(*order)).alias("_b"))  # aggregated before anything meets: no hot group
    same = [F.col(f"_b.{c}") == F.col(c) for c in order]
    on = kept.join(best, "_k")
    for s in same:
        on = on.where(s)
    return on.drop("_k", "_b")
