"""Connected components of identities."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _with_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where the session says. Only on this machine alone (tests) is a folder of its own set where it says nothing."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(base or os.path.join(tempfile.gettempdir(), "colloquy-checkpoints"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that checkpoints go to."""
    _with_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there: what follows neither recomputes it nor sees another run of it."""
    _with_checkpoints(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges(u, v) of longs, loops allowed -> (node, root), root the smallest node reachable.

    Labels pass along edges and then to the label's own label (pointer jumping), so the number of rounds grows
    with the logarithm of a component's width. Each round's labels are checkpointed. Joins are merges: labels and edges are as many as there are
    nodes, and a broadcast would send them through the driver each round.
    """
    _with_checkpoints(edges.sparkSession)
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root")).checkpoint()
    for _ in range(max_rounds):
        seen = both.join(labels.hint("merge"), both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(seen.hint("merge"), "node").select("node", F.least("root", "near").alias("root"))
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = low.join(jump.hint("merge"), "root").select("node", F.least("root", "up").alias("root")).checkpoint()
        old = labels.select("node", F.col("root").alias("old"))
        if new.join(old.hint("merge"), "node").where("root <> old").isEmpty():
            return new
        labels = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
