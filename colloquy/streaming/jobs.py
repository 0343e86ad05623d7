"""Structured Streaming: job states, chunk offsets, utterance islands over an arriving word stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("done", "failed")


def _job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first terminal event wins; transient failures don't count as retries."""
    status, retries = state.get if state.exists else ("pending", 0)
    changed = False
    for b in batches:
        for event, transient in b.sort_values("ts")[["event", "transient"]].itertuples(index=False):
            if status in TERMINAL:
                break
            if event == "error":
                retries += 0 if transient else 1
                status = "failed" if retries >= 3 else "pending"
            else:
                status = event
            changed = True
    state.update((status, retries))
    if changed:
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "retries": [retries]})


def job_states(events: DataFrame) -> DataFrame:
    """events(task_id, ts, event, transient) -> each job's state after every batch that changed it."""
    return events.groupBy("task_id").applyInPandasWithState(_job, "task_id string, status string, retries int", "status string, retries int", "update", GroupStateTimeout.NoTimeout)


def _offsets(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    offset, count = state.get if state.exists else (0.0, 0)
    rows = []
    for b in batches:
        for chunk, duration, n in b.sort_values("chunk")[["chunk", "duration_sec", "n_utterances"]].itertuples(index=False):
            rows.append((key[0], int(chunk), offset, count))
            offset, count = offset + float(duration), count + int(n)
    state.update((offset, count))
    yield pd.DataFrame(rows, columns=["session_id", "chunk", "offset_sec", "first_index"])


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """chunks(session_id, chunk, duration_sec, n_utterances), in order -> start offset and first utterance index."""
    return chunks.groupBy("session_id").applyInPandasWithState(_offsets, "session_id long, chunk int, offset_sec double, first_index int", "offset_sec double, count int", "append", GroupStateTimeout.NoTimeout)


def stuck(sessions: DataFrame, now: str, minutes: int = 10) -> DataFrame:
    """Running sessions without an update for so many minutes, as the rows to write."""
    limit = F.to_timestamp(F.lit(now)) - F.expr(f"interval {minutes} minutes")
    return sessions.where((F.col("status") == "running") & (F.col("updated_at") < limit)).withColumn("status", F.lit("failed"))


def activity(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions per user with a watermark; beyond the batch operators: gaps only, speakers don't matter."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
