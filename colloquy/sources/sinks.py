"""Sinks: last-writer-wins upserts, append-only runs with a latest pointer, training files, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both; of equal keys the one with the latest order stays, new before old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_new", "_rank")


def latest_run(runs: DataFrame, key: str = "session_id", created: str = "created_at", run: str = "run_id") -> DataFrame:
    return runs.groupBy(key).agg(F.max(F.struct(created, run)).alias("l")).select(key, F.col(f"l.{run}").alias("latest_run_id"))


def without_binary(df: DataFrame) -> DataFrame:
    """df without binary columns at the top level."""
    return df.select(*(f.name for f in df.schema.fields if not isinstance(f.dataType, T.BinaryType)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def label_statistics(df: DataFrame, label: str, source: str) -> DataFrame:
    return df.groupBy(label, source).agg(F.count("*").alias("n"))
