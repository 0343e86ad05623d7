"""Reports and selections: bench summaries, relation reports, eligible sessions, run records, review sheets, corrections by domain, dummy rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import names
from . import relations, scans

# Fixed value: raw numbers that a masked text should not hold.
RAW_NUMBER = r"01[016-9][-\s]?\d{3,4}[-\s]?\d{4}|\d{6}[-\s]?[1-4]\d{6}"


def bench_summary(samples: DataFrame, threshold: float) -> DataFrame:
    """samples(wer_pct, cer_pct) -> one row: means, the worst, and whether the mean stays within the threshold."""
    mean = F.avg("wer_pct")
    return samples.agg(F.round(mean, 2).alias("avg_wer_pct"), F.round(F.avg("cer_pct"), 2).alias("avg_cer_pct"), F.round(F.max("wer_pct"), 2).alias("max_wer_pct"), F.when(mean <= threshold, "ACCEPT").otherwise("REJECT").alias("verdict"))


def relation_report(peers: DataFrame, least: float) -> DataFrame:
    """peers(relation, confidence) -> per relation its peers, and of all peers the mean confidence and how many are below `least`."""
    n = peers.groupBy("relation").agg(F.count("*").alias("peers"))
    whole = peers.agg(F.round(F.avg("confidence"), 2).alias("mean_confidence"), F.count_if(F.col("confidence") < least).alias("unsure"))
    return n.crossJoin(F.broadcast(whole))  # one row


def eligible(sessions: DataFrame, least: int = 3) -> DataFrame:
    """Consented and approved sessions of enough utterances that have no summary yet."""
    return sessions.where("consent_status = 'both_agreed' and review_status = 'approved' and session_topic_summary is null").where(F.coalesce("utterance_count", F.lit(0)) >= least)


def run_records(results: DataFrame, utterances: DataFrame, **constants: str) -> DataFrame:
    """results(session_id, task_id, duration_seconds, pii_mask_version), utterances(session_id, index, auto_label_model_version) -> one record
    per result: the first version that its utterances name, the versions given as constants, and the duration where it is known."""
    named = F.col("auto_label_model_version")
    first = utterances.where(named.isNotNull() & (named != "")).groupBy("session_id").agg(F.min(F.struct("index", named.alias("v"))).alias("f"))
    versions = F.struct(*(F.lit(v).alias(k) for k, v in constants.items()), F.col("f.v").alias("auto_label"), F.col("pii_mask_version").alias("pii_mask"))
    audio = F.when(F.col("duration_seconds").isNotNull(), F.create_map(F.lit("duration_sec"), F.col("duration_seconds"))).otherwise(F.create_map().cast("map<string,double>"))
    return results.join(first, "session_id", "left").select("session_id", "task_id", versions.alias("model_versions"), audio.alias("audio_info"))


def sampled_split(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """part train or val by a seeded hash: floor(n * share) rows are val, but at least one."""
    ranked = relations._ranked(rows.withColumn("_all", F.lit(0)), "_all", key, seed)
    n = rows.agg(F.count("*").alias("_n"))  # one row
    val = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return ranked.crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col("_rank") <= val, "val").otherwise("train")).select(*rows.columns, "part")


def review_sheet(utterances: DataFrame) -> DataFrame:
    """utterances(id, text) -> how many masks the text holds and what may have been missed: full names, then raw numbers."""
    t = F.coalesce("text", F.lit(""))
    full = F.transform(F.filter(names.name_hits(t), lambda h: h["kind"] == "full"), lambda h: h["name"])
    return utterances.select("id", F.regexp_count(t, F.lit(r"\[PII_")).alias("masked"), F.concat(full, F.regexp_extract_all(t, F.lit(RAW_NUMBER), F.lit(0))).alias("suspects"))


def corrected_by_domain(segments: DataFrame, pairs: list[tuple[str, str]], keywords: list[str], least: int) -> DataFrame:
    """segments(session_id, idx, text, words array<string>): pairs are corrected, in texts and words, only in sessions that name at least so
    many of the domain's keywords; n counts the texts' corrections."""
    said = [F.max(F.coalesce(F.col("text").contains(k), F.lit(False)).cast("int")) for k in keywords]
    inside = segments.groupBy("session_id").agg(sum(said, F.lit(0)).alias("_k")).where(F.col("_k") >= least).select("session_id", F.lit(True).alias("_in"))
    fixed = L.corrected(F.col("text"), pairs)
    s = segments.join(inside, "session_id", "left").withColumn("_fixed", F.when(F.col("_in"), fixed))
    words = F.when(F.col("_in"), F.transform("words", lambda w: L.corrected(w, pairs)["text"])).otherwise(F.col("words"))
    return s.select("session_id", "idx", F.when(F.col("_fixed.n") > 0, F.col("_fixed.text")).otherwise(F.col("text")).alias("text"), words.alias("words"), F.coalesce("_fixed.n", F.lit(0)).alias("n"))


def result_segments(segments: DataFrame) -> DataFrame:
    """segments(start, end, text, speaker): those with a text, stripped; missing times are 0, a missing speaker is '?'."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    time = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    others = [c for c in segments.columns if c not in ("start", "end", "text", "speaker")]
    return segments.select(*others, time("start"), time("end"), text.alias("text"), F.coalesce(F.when(F.col("speaker") != "", F.col("speaker")), F.lit("?")).alias("speaker")).where("text <> ''")


def dummy_rows(rows: DataFrame, key: str, templates: list[tuple[str, str]], label: str) -> DataFrame:
    """A row of text and label from the templates in turn for each of rows, in the order of a numeric key, which stands behind the text."""
    pick = lambda k: F.element_at(F.array(*(F.lit(t[k]) for t in templates)), (F.col("_at") % len(templates) + 1).cast("int"))
    numbered = scans.Sliced(rows.select(key).withColumn("_all", F.lit(0)), ["_all"], [key]).add("_at", scans.row_number()).result().withColumn("_at", F.col("_at") - 1)
    return numbered.select(F.concat_ws(" ", pick(0), F.col(key).cast("string")).alias("text"), pick(1).alias(label), F.lit("dummy").alias("source"))
