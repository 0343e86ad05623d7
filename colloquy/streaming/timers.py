"""Jobs watched by timers: state per store of jobs, bounded, with deadlines in processing time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FINISHED = ("completed", "failed")
STUCK, EXPIRY, MOST = 1800.0, 3600.0, 100
OUT = "store string, task_id string, status string, reason string"


class JobStore(StatefulProcessor):
    """The jobs of one store: task_id -> status and the time of its last change. A job that is not finished after `stuck` seconds fails, a finished one goes
    after `expiry` seconds, and of more than `most` jobs the oldest finished ones go; unfinished jobs are never evicted, so the store holds `most` jobs and
    what is being worked on."""

    def __init__(self, stuck: float = STUCK, expiry: float = EXPIRY, most: int = MOST):
        self.stuck, self.expiry, self.most = stuck, expiry, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "task_id string", "status string, at double")

    def _all(self) -> list[tuple[str, str, float]]:
        return sorted(((k[0], v[0], v[1]) for k, v in self.jobs.iterator()), key=lambda j: (j[2], j[0]))

    def _settle(self, now: float) -> list[tuple[str, str, str]]:
        """Fails, expires and evicts what is due, and sets the timer for what comes next."""
        told, jobs = [], []
        for task, status, at in self._all():
            if status not in FINISHED and now - at > self.stuck:
                status = "failed"
                self.jobs.updateValue((task,), (status, at))
                told.append((task, status, "processing_timeout"))
            if status in FINISHED and now - at > self.expiry:
                self.jobs.removeKey((task,))
                told.append((task, status, "expired"))
            else:
                jobs.append((task, status, at))
        finished = [j for j in jobs if j[1] in FINISHED]
        for task, status, _ in finished[: max(0, len(jobs) - self.most)]:
            self.jobs.removeKey((task,))
            told.append((task, status, "evicted"))
            jobs = [j for j in jobs if j[0] != task]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if jobs:
            deadline = min(at + (self.expiry if status in FINISHED else self.stuck) for _, status, at in jobs)
            self.handle.registerTimer(int(max(deadline, now) * 1000) + 1)
        return told

    def _rows(self, store: str, told: list[tuple[str, str, str]]) -> pd.DataFrame:
        return pd.DataFrame([(store, *t) for t in told], columns=["store", "task_id", "status", "reason"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, told = timerValues.getCurrentProcessingTimeInMs() / 1000, []
        for b in rows:
            for task, status in b.sort_values("ts")[["task_id", "status"]].itertuples(index=False):
                before = self.jobs.getValue((task,)) if self.jobs.containsKey((task,)) else None
                if before is None or before[0] not in FINISHED:  # the first end of a job stands
                    self.jobs.updateValue((task,), (status, now))
                    told.append((task, status, "event"))
        yield self._rows(key[0], told + self._settle(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows(key[0], self._settle(timerValues.getCurrentProcessingTimeInMs() / 1000))

    def close(self) -> None:
        pass


def watched(events: DataFrame, stuck: float = STUCK, expiry: float = EXPIRY, most: int = MOST) -> DataFrame:
    """events(store, task_id, ts, status), a stream -> each change of a job: its status and why (event, processing_timeout, expired, evicted). Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    return events.groupBy("store").transformWithStateInPandas(statefulProcessor=JobStore(stuck, expiry, most), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")
