"""Adaptors: the engine's entities over the parquet tables at hand.

words    one row per event: session = user, speaker = event type, time in seconds on a compressed axis
turns    the view and click events, with longer spans, as speaker turns
utterances  conversation turns: session = conversation, sequence_order = turn, speaker = role
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans

AXIS = 2e10  # microseconds of an event's time in one second of the compressed axis


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(AXIS)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a session numbered from 0 in the order of their times."""
    return scans.Sliced(rows, ["session_id"], ["ts", "event_id"]).add(name, scans.row_number()).result().withColumn(name, (F.col(name) - 1).cast("int"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts", F.col("event_type").alias("speaker"), _seconds().alias("start_sec"), (_seconds() + F.col("value") / 100).alias("end_sec"))
    return _numbered(events, "word_idx").select("session_id", "word_idx", "event_id", "speaker", "start_sec", "end_sec")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    shown = shown.select(F.col("user_id").alias("session_id"), "event_id", "ts", F.concat(F.lit("S"), F.col("event_id") % 3).alias("speaker"), _seconds().alias("start_sec"), (_seconds() + F.col("value") / 20).alias("end_sec"))
    return _numbered(shown, "turn_idx").select("session_id", "turn_idx", "speaker", "start_sec", "end_sec")


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are no turns themselves."""
    return words(spark, sf_dir).where(~F.col("speaker").isin("view", "click"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence_order"), F.col("role").alias("speaker"), "text")


# The same adaptors for the SQL side.
SQL_WORDS = """words AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS word_idx, event_id,
         event_type AS speaker, CAST(epoch_us(ts) AS DOUBLE) / 2e10 AS start_sec, CAST(epoch_us(ts) AS DOUBLE) / 2e10 + value / 100 AS end_sec
  FROM events)"""
SQL_TURNS = """turns AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_idx,
         'S' || (event_id % 3) AS speaker, CAST(epoch_us(ts) AS DOUBLE) / 2e10 AS start_sec, CAST(epoch_us(ts) AS DOUBLE) / 2e10 + value / 20 AS end_sec
  FROM events WHERE event_type IN ('view', 'click'))"""
SQL_SPOKEN = SQL_WORDS + ", spoken AS (SELECT * FROM words WHERE speaker NOT IN ('view', 'click'))"
SQL_UTTERANCES = "utterances AS (SELECT conv_id AS session_id, turn AS sequence_order, role AS speaker, text FROM conversations)"
