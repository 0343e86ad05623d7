"""Row cleaning: words and turns out of nested utterances, rows that people have touched, rows that a shorter rerun leaves behind, the
opening of a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import SURNAMES
from ..functions.numbers import round2
from . import sequences as S

# Words that call and that answer at the start of a call, and the labels of both sides.
CALLS, ANSWERS = ("여보세요", "안녕하세요"), ("네", "넵", "넹", "예", "옙", "어", "응")
OTHER_SIDE, OWN_SIDE = "SPEAKER_00", "SPEAKER_01"
INTRO = 5.0
DEFAULT_SPEAKER = "SPEAKER_00"
PREFIX = r"^[^:：]{1,12}\s*[:：]\s*"


def clean_word(word: Column) -> Column:
    """word: struct(word, start, end, speaker, speaker_source): text and rounded times without nulls; a missing speaker stays missing."""
    time = lambda c: round2(F.coalesce(word[c].cast("double"), F.lit(0.0)))
    return F.struct(F.coalesce(word["word"], F.lit("")).alias("word"), time("start").alias("start"), time("end").alias("end"), word["speaker"].alias("speaker"), word["speaker_source"].alias("speaker_source"))


def _given(*columns: Column) -> Column:
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def flattened(utterances: DataFrame) -> DataFrame:
    """utterances(session_id, index, speaker_id, speaker, words array<struct<word, text, start, end, speaker, speaker_id>>) -> one row per
    word in order, with the speaker of the word, else of the utterance, else the default."""
    rows = utterances.select("session_id", "index", _given(F.col("speaker_id"), F.col("speaker"), F.lit(DEFAULT_SPEAKER)).alias("whole"), F.posexplode("words").alias("word_idx", "w"))
    time = lambda c: F.coalesce(F.col(f"w.{c}").cast("double"), F.lit(0.0)).alias(c)
    return rows.select("session_id", "index", "word_idx", F.coalesce(_given(F.col("w.word"), F.col("w.text")), F.lit("")).alias("word"), time("start"), time("end"), _given(F.col("w.speaker"), F.col("w.speaker_id"), F.col("whole")).alias("speaker_id"), _given(F.col("w.speaker"), F.col("whole")).alias("speaker"))


def segment_turns(segments: DataFrame) -> DataFrame:
    """Segments with a speaker and both times."""
    return segments.where("speaker <> '' and start_sec is not null and end_sec is not null")


def curated(rows: DataFrame) -> DataFrame:
    """Keys of rows that somebody has reviewed or masked."""
    touched = F.col("pii_reviewed_at").isNotNull() | F.col("pii_masked_at").isNotNull()
    return rows.where(touched & F.col("sequence_order").isNotNull()).select("session_id", "sequence_order")


def orphans(rows: DataFrame, runs: DataFrame, labelled: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows that a run with fewer utterances leaves behind and that may go. rows(id, session_id, sequence_order, pii_reviewed_at,
    pii_masked_at, quality_reviewed_by, updated_at); runs(session_id, new_count, run_start); labelled(id). A session keeps all of them if the
    run has less than `least` of what was there; rows that people have touched or labelled, or that the run itself wrote, stay."""
    late = rows.join(runs, "session_id").where(F.col("sequence_order") > F.col("new_count"))
    ratio = late.groupBy("session_id", "new_count").agg(F.count("*").alias("n")).where(F.col("new_count") / (F.col("new_count") + F.col("n")) >= least).select("session_id")
    untouched = F.col("pii_reviewed_at").isNull() & F.col("pii_masked_at").isNull() & F.col("quality_reviewed_by").isNull()
    old = F.col("updated_at").isNull() | (F.col("updated_at") < F.col("run_start"))
    return late.where(untouched & old).join(ratio, "session_id", "left_semi").join(labelled.select("id").distinct(), "id", "left_anti").select("id", "session_id", "sequence_order")


def split_openings(words: DataFrame, intro: float = INTRO, call_is_other: bool = True) -> DataFrame:
    """words(session_id, word_idx, start_sec, word, role): a run of one role within the intro that holds a word that calls and, behind the
    last of these, one that answers, was two people: up to the answer one side, from there on the other. Adds split_role."""
    opening = (F.col("start_sec") < intro) & F.col("role").isNotNull()
    w = words.withColumn("_open", F.coalesce(opening, F.lit(False)))
    new = lambda before: (before("_open") != F.col("_open")) | ~before("role").eqNullSafe(F.col("role"))
    w = S.islands(w, ["session_id"], ["word_idx"], new, "_run")
    says = lambda these: F.col("word").rlike("|".join(these))
    run = Window.partitionBy("session_id", "_run")
    w = w.withColumn("_call", F.max(F.when(F.col("_open") & says(CALLS), F.col("word_idx"))).over(run))
    w = w.withColumn("_answer", F.min(F.when((F.col("word_idx") > F.col("_call")) & says(ANSWERS), F.col("word_idx"))).over(run))
    sides = (OTHER_SIDE, OWN_SIDE) if call_is_other else (OWN_SIDE, OTHER_SIDE)
    role = F.when(F.col("_answer").isNull(), F.col("role")).when(F.col("word_idx") < F.col("_answer"), sides[0]).otherwise(sides[1])
    return w.withColumn("split_role", role).drop("_open", "_run", "_call", "_answer")


def without_prefix(text: Column) -> Column:
    """The text behind a speaker's name and a colon."""
    return F.regexp_replace(F.regexp_replace(text, PREFIX, ""), r"(?U)^\s+|\s+$", "")


def is_person_name(noun: Column) -> Column:
    return noun.rlike("^[가-힣]{2,4}$") & F.left(noun, F.lit(1)).isin(*SURNAMES)
