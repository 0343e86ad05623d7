"""Speakers of a call: who they are, which words are theirs, and where they talk at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.numbers import cosine
from . import clustering
from . import intervals as I
from . import sequences as S
from .graph import checkpointed

# Labels that are no persons, likeness to a profile, shortest speech with a usable voice, window lengths.
NO_PERSON = ("SPEAKER_IVR",)
LIKE = 0.75
VOICED = 0.5
SHORTEST, LONGEST, PAUSE = 1.0, 4.0, 0.5


def analysed(segments: DataFrame, voices: DataFrame, profiles: DataFrame, least: float = LIKE) -> DataFrame:
    """segments(session_id, idx, speaker, start_sec, end_sec, text, speech_age), voices(session_id, speaker, embedding, f0, f0_std, relation)
    and profiles(session_id, profile) -> one row per speaker: role and where it comes from, gender, voice_age, speech_age, relation.

    The caller's own voice is the person most like the profile (ties: first label) if at least `least`; else the person who speaks
    longest (ties: who speaks first). Relations are only given to other persons: as inferred, else by salutation. The speech age is
    what most segments say (ties: said first). Segments without a speaker are left out; a session without persons has no self.
    Two partial aggregates over segments; texts are reduced to the number of their first rule before the shuffle."""
    named = segments.where(F.coalesce("speaker", F.lit("")) != "")
    length = F.col("end_sec") - F.col("start_sec")
    per = named.groupBy("session_id", "speaker").agg(F.round(F.sum(length), 6).alias("spoken"), F.min("idx").alias("first"), F.min(L.salutation_rule(F.col("text"))).alias("rule"))
    said = named.where("speech_age is not null").groupBy("session_id", "speaker", "speech_age").agg(F.count("*").alias("n"), F.min("idx").alias("at"))
    ages = said.groupBy("session_id", "speaker").agg(F.min(F.struct((-F.col("n")).alias("n"), "at", "speech_age"))["speech_age"].alias("speech_age"))
    met = per.join(voices.withColumnRenamed("relation", "inferred"), ["session_id", "speaker"], "left").join(profiles, "session_id", "left")
    person = ~F.col("speaker").isin(*NO_PERSON)
    like = F.when(person & (F.col("spoken") >= VOICED) & F.col("profile").isNotNull() & F.col("embedding").isNotNull(), cosine(F.col("profile"), F.col("embedding"), 0.0))
    met = met.withColumn("like", like).drop("profile", "embedding")
    best = met.groupBy("session_id").agg(
        F.min(F.when(F.col("like").isNotNull(), F.struct((-F.col("like")).alias("d"), "speaker"))).alias("near"),
        F.min(F.when(person, F.struct((-F.col("spoken")).alias("d"), "first", "speaker"))).alias("long"),
    )
    known = F.coalesce(-F.col("near.d") >= least, F.lit(False))
    own = best.select("session_id", F.when(known, F.col("near.speaker")).otherwise(F.col("long.speaker")).alias("self"), known.alias("matched"))
    is_self = F.col("speaker").eqNullSafe(F.col("self"))
    out = met.join(own, "session_id").join(ages, ["session_id", "speaker"], "left")
    return out.select(
        "session_id",
        "speaker",
        F.when(is_self, "self").otherwise("other").alias("role"),
        F.when(is_self & F.col("matched"), "profile_match").otherwise("heuristic").alias("role_source"),
        L.gender(F.col("f0")).alias("gender"),
        L.voice_age(F.col("f0"), F.col("f0_std")).alias("voice_age"),
        "speech_age",
        F.when(~is_self & person, F.coalesce("inferred", L.relation_of_rule(F.col("rule")))).alias("relation"),
    )


def by_overlap(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Words to the speaker whose turns share most time with them, summed over turns (ties: first label); null where none does."""
    lo, hi = F.greatest("start_sec", "r_start"), F.least("end_sec", "r_end")
    met = I.overlap_join(words.select("session_id", "word_idx", "start_sec", "end_sec"), I.as_right(turns, ["session_id"]), ["session_id"], hi > lo)
    shared = met.where("r_speaker is not null").groupBy("session_id", "word_idx", F.col("r_speaker").alias("name")).agg(F.round(F.sum(hi - lo), 9).alias("s"))
    best = shared.groupBy("session_id", "word_idx").agg(F.min(F.struct((-F.col("s")).alias("s"), "name"))["name"].alias("mapped_speaker"))
    return words.select("session_id", "word_idx").join(best, ["session_id", "word_idx"], "left")


def assigned(words: DataFrame, turns: DataFrame, mode: str = "raw_direct") -> DataFrame:
    """(session_id, word_idx, mapped_speaker, speaker_source): by midpoint with "raw_direct", by shared time with any other mode."""
    if mode == "raw_direct":
        return I.map_speakers(words, turns)
    return by_overlap(words, turns).withColumn("speaker_source", F.lit("overlap"))


def timeline_regions(timeline: DataFrame, cutoff: float = 0.2) -> DataFrame:
    """Overlaps that a diarizer found by itself, those of at least cutoff seconds."""
    return timeline.where(F.col("end_sec") - F.col("start_sec") >= cutoff).select("session_id", "start_sec", "end_sec")


def with_overlap(utterances: DataFrame, turns: DataFrame | None, key: str, cutoff: float = 0.2) -> DataFrame:
    """Utterances(session_id, key, start_sec, end_sec, ...) with overlap_count, overlap_total, overlap_ratio, is_overlapping and overlap_intervals
    from the turns' own overlaps; without turns they stay as they are, as nothing is known then."""
    if turns is None:
        return utterances
    regions = I.overlap_regions(turns, cutoff)
    lo, hi = F.greatest("start_sec", "r_start"), F.least("end_sec", "r_end")
    milli = lambda c: F.rint(c * 1000) / 1000
    spans = utterances.select("session_id", key, F.coalesce("start_sec", F.lit(0.0)).alias("start_sec"), F.coalesce("end_sec", F.lit(0.0)).alias("end_sec"))
    cut = I.overlap_join(spans.where("end_sec > start_sec"), I.as_right(regions, ["session_id"]), ["session_id"], hi - lo > 0.001)
    listed = cut.groupBy("session_id", key).agg(F.array_sort(F.collect_list(F.struct(milli(lo).alias("start_sec"), milli(hi).alias("end_sec")))).alias("overlap_intervals"))  # regions of one utterance
    parts = F.aggregate("overlap_intervals", F.lit(0.0), lambda s, x: s + (x["end_sec"] - x["start_sec"]))
    listed = listed.withColumn("_total", parts)
    length = F.coalesce("end_sec", F.lit(0.0)) - F.coalesce("start_sec", F.lit(0.0))
    total = F.coalesce("_total", F.lit(0.0))
    out = utterances.join(listed, ["session_id", key], "left")
    none = F.array().cast("array<struct<start_sec:double,end_sec:double>>")
    out = out.withColumn("overlap_intervals", F.coalesce("overlap_intervals", none)).withColumn("overlap_count", F.size("overlap_intervals")).withColumn("is_overlapping", F.col("overlap_count") > 0)
    return out.withColumn("overlap_total", milli(total)).withColumn("overlap_ratio", F.when(length > 0, F.rint(total / length * 10000) / 10000).otherwise(0.0)).drop("_total")


def embedding_windows(words: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """words(session_id, word_idx, speaker, start_sec, end_sec) -> (session_id, window_idx, win_start, win_end, utt_idx, part): runs of one speaker without
    a pause over PAUSE, of SHORTEST and more, in equal parts: one up to LONGEST + 1, another for each LONGEST more. lengths(session_id, seconds) cut
    windows at the end of the audio. Windows are numbered by time."""
    new = lambda before: ~before("speaker").eqNullSafe(F.col("speaker")) | (F.col("start_sec") - before("end_sec") > PAUSE)
    ran = S.islands(words, ["session_id"], ["word_idx"], new, "utt_idx")
    runs = ran.groupBy("session_id", "utt_idx").agg(F.min(F.struct("word_idx", "start_sec"))["start_sec"].alias("a"), F.max(F.struct("word_idx", "end_sec"))["end_sec"].alias("b"))
    k = runs.where(F.col("b") - F.col("a") >= SHORTEST).withColumn("n", F.floor((F.col("b") - F.col("a") + LONGEST - 1) / LONGEST).cast("int"))
    k = k.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    step = (F.col("b") - F.col("a")) / F.col("n")
    k = k.withColumn("win_start", F.col("a") + F.col("part") * step).withColumn("win_end", F.least(F.col("b"), F.col("a") + (F.col("part") + 1) * step))
    if lengths is not None:
        k = k.join(lengths, "session_id", "left").withColumn("win_end", F.least("win_end", "seconds"))
    k = k.where(F.col("win_end") - F.col("win_start") >= SHORTEST)
    cut = S.scans.Sliced(k, ["session_id"], ["utt_idx", "part"]).add("window_idx", S.scans.row_number()).result()
    return cut.select("session_id", (F.col("window_idx") - 1).cast("long").alias("window_idx"), "win_start", "win_end", "utt_idx", "part")


def reclustered_words(words: DataFrame, embedded: DataFrame, least: float = 0.30) -> DataFrame:
    """words(session_id, word_idx, speaker, start_sec, end_sec) and embedded, some of embedding_windows(words) with an embedding each -> session_id, word_idx, new_speaker, confidence.

    Words in a window take its cluster's name (in two windows: the later one's), others keep theirs. Sessions whose clusters are no clearer than
    `least`, or without embeddings, stay as they are; where a label changed all are numbered anew by first appearance. Clusters are keyed by window, so a
    window without an embedding shifts nothing. Windows, clusters and new labels are read several times and checkpointed, which keeps the plan small."""
    embedded = checkpointed(embedded)
    clear = checkpointed(clustering.reclustered(embedded.select("session_id", "window_idx", "embedding"), least).where(F.col("confidence") >= least))
    new = lambda before: ~before("speaker").eqNullSafe(F.col("speaker")) | (F.col("start_sec") - before("end_sec") > PAUSE)
    ran = S.islands(words.select("session_id", "word_idx", "speaker", "start_sec", "end_sec"), ["session_id"], ["word_idx"], new, "utt_idx")
    spans = embedded.select("session_id", "utt_idx", "part", "window_idx", F.col("win_start").alias("r_start"), F.col("win_end").alias("r_end")).join(clear.select("session_id", "window_idx", F.col("speaker").alias("cluster"), "confidence"), ["session_id", "window_idx"])
    inside = (F.col("end_sec") > F.col("r_start")) & (F.col("start_sec") < F.col("r_end"))
    met = I.overlap_join(ran.drop("speaker"), spans, ["session_id", "utt_idx"], inside)
    last = met.groupBy("session_id", "word_idx").agg(F.max(F.struct("window_idx", "cluster"))["cluster"].alias("cluster"))
    sure = clear.groupBy("session_id").agg(F.max("confidence").alias("confidence"))
    named = words.select("session_id", "word_idx", F.col("speaker").alias("_old")).join(last, ["session_id", "word_idx"], "left").withColumn("speaker", F.coalesce("cluster", "_old")).drop("cluster")
    named = checkpointed(named)
    changed = named.groupBy("session_id").agg(F.bool_or(~F.col("speaker").eqNullSafe(F.col("_old"))).alias("changed"))
    firsts = named.where("speaker is not null").groupBy("session_id", "speaker").agg(F.min("word_idx").alias("first"))
    listed = firsts.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "speaker"))), lambda x: x["speaker"]).alias("names"))  # a session has few speakers
    out = named.join(changed.join(listed, "session_id", "left"), "session_id").join(sure, "session_id", "left")
    number = F.format_string("SPEAKER_%02d", F.array_position("names", F.col("speaker")) - 1)
    return out.select("session_id", "word_idx", F.when(F.col("changed") & F.col("speaker").isNotNull(), number).otherwise(F.col("speaker")).alias("new_speaker"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def routed(words: DataFrame, lengths: DataFrame, whole: DataFrame, anchored: DataFrame, threshold: float) -> DataFrame:
    """words(session_id, word_idx, speaker) relabelled by the route of their session: up to `threshold` seconds by whole(session_id, word_idx, speaker), beyond by
    anchored (same columns). Words that their route says nothing of keep their label, and so do all words of a session whose route failed."""
    route = lengths.select("session_id", F.when(F.col("seconds") <= threshold, "full").otherwise("anchor").alias("route"))
    told = whole.withColumn("route", F.lit("full")).unionByName(anchored.withColumn("route", F.lit("anchor"))).withColumnRenamed("speaker", "told")
    return words.join(route, "session_id", "left").join(told, ["session_id", "word_idx", "route"], "left").select("session_id", "word_idx", F.coalesce("told", "speaker").alias("new_speaker"), "route")


def segment_rows(segments: DataFrame, source: str, least: int = 3) -> DataFrame:
    """segments(seg_id, label, texts) of at least `least` texts of two characters and more -> one row per such text: text, label, label_group, seg_id, source."""
    real = F.filter("texts", lambda t: F.length(t) >= 2)
    kept = segments.select("seg_id", "label", real.alias("texts")).where(F.size("texts") >= least)
    return kept.select(F.explode("texts").alias("text"), "label", F.col("label").alias("label_group"), "seg_id", F.lit(source).alias("source"))


# The switches a result's lineage records.
GATES = ("preprocess_gain", "preprocess_denoise", "preprocess_silence", "preprocess_dedup", "speaker_mapping_mode", "overlap_detection", "hybrid_diarization", "loudness_norm", "loudness_local_gate")


def gates(options: dict) -> Column:
    """The switches' values as a struct of strings; what the options don't name is null."""
    return F.struct(*(F.lit(None if options.get(g) is None else str(options[g]).lower()).cast("string").alias(g) for g in GATES))


def pending(rows: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """Rows that still want a label: none yet, and a text that is not blank."""
    return rows.where(F.col(label).isNull() & F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S"))
