"""Sessions worked off by a stream: arrivals are taken in, due sessions are processed, their states are published.

Each micro-batch is one transaction: its arrivals and the outcomes of what it processed become one manifest of the sessions' table, under
the batch's number. A batch that is run again after a failure finds its number there and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.published import Published

SESSIONS = "session_id long, status string, consent string, audio string, retries int, started_at timestamp, not_before timestamp, error string, n_utterances int, quality string, updated_at timestamp"
OUTCOMES = "session_id long, outcome string, n_utterances int, n_speakers int, message string"
MAX_RETRIES, BACKOFF, STUCK = 3, "60 seconds", "10 minutes"
REQUEUED, LEAST_UTTERANCES, MESSAGE = "SPEAKER_REQUEUE:", 6, 2000
MISSING_AUDIO = 5


def due(sessions: DataFrame, now: Column) -> DataFrame:
    """Pending sessions that all have agreed to, with audio, and whose pause is over."""
    return sessions.where((F.col("status") == "pending") & (F.col("consent") == "both_agreed") & F.col("audio").isNotNull() & (F.col("not_before").isNull() | (F.col("not_before") <= now)))


def after(sessions: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The sessions' rows after processing. outcomes(OUTCOMES): done, unavailable (the service is busy or down: a pause, but no retry is counted) or
    error (the third one is final). A call of two people with one speaker and some utterances is put back once."""
    s = sessions.join(outcomes.select("session_id", "outcome", F.col("n_utterances").alias("n"), "n_speakers", F.left("message", F.lit(MESSAGE)).alias("message")), "session_id")
    done, busy, error = (F.col("outcome") == o for o in ("done", "unavailable", "error"))
    again = done & (F.col("consent") == "both_agreed") & (F.col("n") >= LEAST_UTTERANCES) & (F.col("n_speakers") == 1) & ~F.startswith(F.coalesce("error", F.lit("")), F.lit(REQUEUED))
    retries = F.when(again, 0).when(error, F.col("retries") + 1).otherwise(F.col("retries"))
    finished = done & ~again
    status = F.when(finished, "done").when(error & (retries >= MAX_RETRIES), "failed").otherwise("pending")
    return s.select(
        "session_id",
        status.alias("status"),
        "consent",
        "audio",
        retries.cast("int").alias("retries"),
        F.when(finished, F.col("started_at")).alias("started_at"),
        F.when(busy, now + F.expr(f"interval {BACKOFF}")).alias("not_before"),
        F.when(again, F.concat(F.lit(f"{REQUEUED} 1 speaker, "), F.col("n"), F.lit(" utterances"))).when(finished, F.lit(None)).otherwise(F.col("message")).alias("error"),
        F.when(done, F.col("n")).otherwise(F.col("n_utterances")).alias("n_utterances"),
        F.when(finished, F.when(F.col("n") > 0, "done").otherwise("skipped")).otherwise(F.col("quality")).alias("quality"),
        now.alias("updated_at"),
    )


def swept(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that have been running for too long, as failed."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {STUCK}"))
    return sessions.where(stuck).withColumn("status", F.lit("failed")).withColumn("error", F.lit("worker timeout (stuck > 10min)")).withColumn("updated_at", now)


def missing_audio(sessions: DataFrame) -> DataFrame:
    """One row: how many sessions that all agreed to have no audio and are not finished, and whether that is an alert."""
    waits = (F.col("consent") == "both_agreed") & F.col("audio").isNull() & ~F.coalesce(F.col("status").isin("done", "skipped"), F.lit(False))
    return sessions.agg(F.count_if(waits).alias("n")).select("n", (F.col("n") > MISSING_AUDIO).alias("alert"))


@dataclass
class Worker:
    """process: due sessions -> OUTCOMES, as a DataFrame. alert: called with the number of sessions that miss audio. now: a column, for tests."""

    table: Published
    process: Callable[[DataFrame], DataFrame]
    alert: Callable[[int], None] | None = None
    name: str = "worker"
    now: Callable[[], Column] = F.current_timestamp

    def batch(self, arrivals: DataFrame, number: int) -> None:
        """arrivals(SESSIONS): new or changed sessions; they need not be due. Arrivals of sessions that the table has are taken as they are."""
        if self.table.seen(self.name, number):
            return
        spark, now = self.table.spark, F.lit(self.table.spark.range(1).select(self.now()).first()[0])
        known = self.table.read()
        latest = arrivals.groupBy("session_id").agg(F.max_by(F.struct(*arrivals.columns), F.struct("updated_at", F.hash(*arrivals.columns))).alias("s")).select("s.*")
        sessions = known.join(latest.select("session_id"), "session_id", "left_anti").unionByName(latest)
        stuck = swept(sessions, now)
        ready = due(sessions, now).withColumn("started_at", now).cache()  # processed and joined to its outcomes
        try:
            changed = after(ready, self.process(ready.withColumn("status", F.lit("running"))), now)
            quiet = latest.join(ready.select("session_id"), "session_id", "left_anti").join(stuck.select("session_id"), "session_id", "left_anti")
            self.table.upsert(changed.unionByName(stuck).unionByName(quiet).select(*self._columns(spark)), "updated_at", self.name, number)
        finally:
            ready.unpersist()
        if self.alert:
            told = missing_audio(self.table.read()).first()
            if told.alert:
                self.alert(told.n)

    def _columns(self, spark) -> list[str]:
        return spark.createDataFrame([], SESSIONS).columns

    def start(self, arrivals: DataFrame, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
        """arrivals: a stream of SESSIONS. every: None works off what is there and ends. A stream of ticks may be united with it (ticks() below), so that
        paused sessions are looked at without arrivals."""
        writer = arrivals.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def ticks(spark) -> DataFrame:
    """A stream of no sessions, once a second: a batch runs although nothing has arrived."""
    columns = [(f.name, f.dataType) for f in spark.createDataFrame([], SESSIONS).schema.fields]
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0").select(*(F.lit(None).cast(t).alias(n) for n, t in columns))
