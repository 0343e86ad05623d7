"""Anchored diarization once embeddings, pitch and outer turns are columns: the nearer of two anchors, corrections of the opening, labels of the
body by pitch, labels written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dot
from . import intervals as I

# The deeper and the higher voice.
LOW, HIGH = "SPEAKER_01", "SPEAKER_00"
ENCLOSED = 0.12
IVR, ABSENT, APART = "SPEAKER_IVR", 0.5, 8.0  # announcements: the label, and by what share of a call they are over; Hz between two voices


def nearest_anchor(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """words(session_id, word_idx, embedding), anchors(session_id, low, high), unit vectors: the label of the nearer one and by how much; no
    label and 0 without an embedding."""
    to_low, to_high = dot(F.col("embedding"), F.col("low")), dot(F.col("embedding"), F.col("high"))
    known = F.col("embedding").isNotNull() & F.col("low").isNotNull()
    label = F.when(known, F.when(to_low >= to_high, LOW).otherwise(HIGH))
    return words.join(anchors, "session_id", "left").select("session_id", "word_idx", label.alias("label"), F.when(known, F.abs(to_low - to_high)).otherwise(0.0).alias("margin"))


def corrected_opening(words: DataFrame, turns: DataFrame, intro: float, least: float = ENCLOSED) -> DataFrame:
    """words(session_id, word_idx, start_sec, end_sec, role), turns(session_id, turn_idx, start_sec, end_sec, label): a labelled word of the opening
    that encloses a turn of another label takes that label, of the first such turn. Adds new_role."""
    asked = words.where((F.col("start_sec") < intro) & F.col("role").isNotNull()).select("session_id", "word_idx", "start_sec", F.coalesce("end_sec", "start_sec").alias("end_sec"), "role")
    right = I.as_right(turns.where((F.col("end_sec") - F.col("start_sec") >= least) & F.col("label").isNotNull()), ["session_id"])
    inside = (F.col("r_start") >= F.col("start_sec")) & (F.col("r_end") <= F.col("end_sec")) & (F.col("r_label") != F.col("role"))
    met = I.overlap_join(asked, right, ["session_id"], inside).groupBy("session_id", "word_idx").agg(F.min(F.struct("r_turn_idx", "r_label"))["r_label"].alias("_new"))
    return words.join(met, ["session_id", "word_idx"], "left").withColumn("new_role", F.coalesce("_new", "role")).drop("_new")


def pinned_body(words: DataFrame, intro: float) -> DataFrame:
    """words(session_id, word_idx, start_sec, role, f0): where the body has both labels and the one of the deeper voice is the higher by
    its median pitch, the body's labels are swapped. Adds pinned_role."""
    body = (F.col("start_sec") >= intro) & F.col("role").isNotNull()
    of = lambda label: F.percentile(F.when(F.col("role") == label, F.col("f0")), F.lit(0.5))
    sides = words.where(body).groupBy("session_id").agg(of(LOW).alias("low"), of(HIGH).alias("high"), F.array_sort(F.collect_set("role")).alias("labels"))
    turned = sides.where((F.col("labels") == F.array(*map(F.lit, sorted((LOW, HIGH))))) & (F.col("low") > F.col("high"))).select("session_id", F.lit(True).alias("_turn"))
    swapped = F.when(F.col("role") == LOW, HIGH).when(F.col("role") == HIGH, LOW).otherwise(F.col("role"))
    return words.join(turned, "session_id", "left").withColumn("pinned_role", F.when(F.col("_turn") & body, swapped).otherwise(F.col("role"))).drop("_turn")


def rediarized(words: DataFrame, turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """words(session_id, word_idx, start_sec, speaker), turns(session_id, turn_idx, speaker, start_sec, end_sec, f0) of a second diarization, lengths(session_id, duration): the
    words' speakers anew. Of more than two speakers, those that are over by half of the call are announcements. If two speakers are left, whose pitches differ (or
    announcements were found), they get the labels of the deeper and the higher voice; a word goes with the turn it begins in, or the nearest one, and
    words of announcements or before their end are announcements. Other sessions stay as they are."""
    voices = turns.groupBy("session_id", F.col("speaker").alias("voice")).agg(F.max("end_sec").alias("last"), F.percentile("f0", F.lit(0.5)).alias("f0"))
    few = voices.groupBy("session_id").agg(F.count("*").alias("n"))  # a session has few voices, so counts and sides are aggregates
    voices = voices.join(few, "session_id").join(lengths, "session_id").withColumn("ivr", (F.col("n") > 2) & (F.col("last") < ABSENT * F.col("duration")))
    person = F.when(~F.col("ivr") & F.col("f0").isNotNull(), F.struct("f0", "voice"))
    sides = voices.groupBy("session_id").agg(F.max(F.when(F.col("ivr"), F.col("last"))).alias("cut"), F.count_if(~F.col("ivr")).alias("people"), F.count(person).alias("known"), F.min(person).alias("low"), F.max(person).alias("high"))
    sides = sides.where((F.col("people") == 2) & (F.col("known") == 2) & (F.col("cut").isNotNull() | (F.col("high.f0") - F.col("low.f0") >= APART)))
    points = words.where("start_sec is not null").select("session_id", F.col("word_idx").cast("long").alias("word_idx"), F.col("start_sec").alias("at"))
    near = I.nearest_edge(points, I.as_right(turns, ["session_id"]).withColumnRenamed("r_turn_idx", "turn_idx"), "word_idx", "turn_idx")
    said = near.join(turns.select("session_id", "turn_idx", F.col("speaker").alias("voice")), ["session_id", "turn_idx"])
    said = said.join(sides, "session_id").join(voices.select("session_id", "voice", "ivr"), ["session_id", "voice"]).select("session_id", "word_idx", "voice", "ivr", "cut", F.col("low.voice").alias("low"), F.col("high.voice").alias("high"))
    met = words.join(said, ["session_id", "word_idx"], "left")
    announced = F.col("ivr") | (F.col("start_sec") < F.col("cut"))
    new = F.when(announced, IVR).when(F.col("voice") == F.col("low"), LOW).when(F.col("voice") == F.col("high"), HIGH).otherwise(F.col("speaker"))
    return met.withColumn("speaker", new).drop("voice", "ivr", "cut", "low", "high")


def written_back(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """segments(session_id, segment_idx, speaker, words array<struct<word, start, end, speaker>>), labels(session_id, segment_idx, word_idx, speaker): words take
    the label at their place, a segment that of most of its words (the first of equals); places without a label stay as they are."""
    w = segments.select("session_id", "segment_idx", F.posexplode("words").alias("word_idx", "w")).join(labels.withColumnRenamed("speaker", "_new"), ["session_id", "segment_idx", "word_idx"], "left")
    w = w.withColumn("w", F.col("w").withField("speaker", F.coalesce("_new", "w.speaker")))
    votes = w.where("w.speaker is not null").groupBy("session_id", "segment_idx", F.col("w.speaker").alias("s")).agg(F.count("*").alias("n"), F.min("word_idx").alias("first"))
    most = votes.groupBy("session_id", "segment_idx").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "s"))["s"].alias("_most"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "w"))), lambda x: x["w"])
    words = w.groupBy("session_id", "segment_idx").agg(listed.alias("_words"))
    out = segments.join(words, ["session_id", "segment_idx"], "left").join(most, ["session_id", "segment_idx"], "left")
    return out.withColumn("words", F.coalesce("_words", "words")).withColumn("speaker", F.coalesce("_most", "speaker")).drop("_words", "_most")


def changed_words(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per session how many words have another label after than before: all, and by the pair of labels most of them moved between."""
    met = before.select("session_id", "word_idx", F.col("speaker").alias("a")).join(after.select("session_id", "word_idx", F.col("speaker").alias("b")), ["session_id", "word_idx"])
    pairs = met.groupBy("session_id", "a", "b").agg(F.count("*").alias("n"))
    moved = ~F.col("a").eqNullSafe(F.col("b"))
    # labels that were only renamed count once more under the best name: the one most words of a label have now
    named = Window.partitionBy("session_id", "a").orderBy(F.desc("n"), "b")
    best = pairs.withColumn("_k", F.row_number().over(named))
    return best.groupBy("session_id").agg(F.sum("n").alias("words"), F.sum(F.when(moved, F.col("n")).otherwise(0)).alias("raw_changed"), F.sum(F.when(F.col("_k") > 1, F.col("n")).otherwise(0)).alias("semantic_changed"))
