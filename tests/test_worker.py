"""Published tables, the sessions' worker and jobs watched by timers."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from colloquy.sources.published import Conflict, Published
from colloquy.streaming import timers, worker

ROWS = "session_id long, q int, v string, t int"


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROWS)


def content(df):
    return sorted((r.session_id, r.q, r.v) for r in df.collect())


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    table = Published(spark, f"{tmp_path}/t", ROWS, ["session_id", "q"], buckets=4)
    assert table.read().count() == 0 and table.manifest().number == 0
    table.upsert(rows(spark, (1, 1, "a", 1), (2, 1, "b", 1), (3, 1, "c", 1)), "t")
    before = table.read()  # a reader that began earlier
    monkeypatch.setattr(table, "_commit", lambda new: (_ for _ in ()).throw(OSError("lost between write and swap")))
    with pytest.raises(OSError):
        table.upsert(rows(spark, (1, 1, "x", 2), (4, 1, "y", 2)), "t")
    monkeypatch.undo()
    assert content(table.read()) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")] and table.manifest().number == 1
    table.upsert(rows(spark, (1, 1, "x", 2), (1, 1, "late", 1), (4, 1, "y", 2)), "t")
    assert content(table.read()) == [(1, 1, "x"), (2, 1, "b"), (3, 1, "c"), (4, 1, "y")]
    assert content(before) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]
    assert table.clean(keep=1) >= 1 and content(table.read()) == [(1, 1, "x"), (2, 1, "b"), (3, 1, "c"), (4, 1, "y")]
    assert sum(table.manifest().rows.values()) == 4


def test_only_one_of_two_runs_wins(spark, tmp_path):
    table = Published(spark, f"{tmp_path}/t", ROWS, ["session_id", "q"], buckets=2)
    table.upsert(rows(spark, (1, 1, "a", 1)), "t")
    stale = table.manifest()
    table.upsert(rows(spark, (1, 1, "b", 2)), "t")
    with pytest.raises(Conflict):
        table._publish(stale, rows(spark, (1, 1, "lost", 3)), [0, 1], None, 0)
    assert content(table.read()) == [(1, 1, "b")]


def test_rerun_leaves_no_orphans(spark, tmp_path):
    table = Published(spark, f"{tmp_path}/t", ROWS, ["session_id"], buckets=3)
    table.replace(rows(spark, (1, 0, "a", 1), (1, 1, "b", 1), (1, 2, "c", 1), (2, 0, "d", 1)), ["session_id"], "w", 0)
    for _ in range(2):  # the second one is a replay
        m = table.replace(rows(spark, (1, 0, "new", 2)), ["session_id"], "w", 1)
    assert content(table.read()) == [(1, 0, "new"), (2, 0, "d")] and m.number == 2


NOW = dt.datetime(2024, 1, 1, 12)


def session(i, status="pending", consent="both_agreed", audio="a.wav", retries=0, started=None, not_before=None, error=None):
    return (i, status, consent, audio, retries, started, not_before, error, None, None, NOW)


OUTCOME = {1: ("done", 9, 2), 2: ("unavailable", 0, 0), 3: ("error", 0, 0), 4: ("done", 7, 1), 5: ("done", 0, 0)}


def processing(spark, calls):
    def process(ready):
        ids = sorted(r.session_id for r in ready.collect())
        calls.append(ids)
        return spark.createDataFrame([(i, *OUTCOME[i], "why") for i in ids], worker.OUTCOMES)

    return process


def states(table):
    return {r.session_id: (r.status, r.retries) for r in table.read().collect()}


def test_worker(spark, tmp_path):
    table, calls, alerts, at = Published(spark, f"{tmp_path}/t", worker.SESSIONS, ["session_id"], buckets=2), [], [], [NOW]
    w = worker.Worker(table, processing(spark, calls), alerts.append, now=lambda: F.lit(at[0]))
    first = [session(i) for i in (1, 2, 3, 4, 5)] + [session(6, consent="one"), session(7, "running", started=NOW - dt.timedelta(minutes=11)), session(8, "running", started=NOW - dt.timedelta(minutes=9))]
    w.batch(spark.createDataFrame(first, worker.SESSIONS), 0)
    assert calls == [[1, 2, 3, 4, 5]] and not alerts
    got = {r.session_id: r for r in table.read().collect()}
    assert {i: r.status for i, r in got.items()} == {1: "done", 2: "pending", 3: "pending", 4: "pending", 5: "done", 6: "pending", 7: "failed", 8: "running"}
    assert got[2].not_before == NOW + dt.timedelta(seconds=60) and got[2].retries == 0 and got[3].retries == 1
    assert got[4].error.startswith("SPEAKER_REQUEUE:") and got[1].error is None and (got[1].quality, got[5].quality) == ("done", "skipped")
    w.batch(spark.createDataFrame(first, worker.SESSIONS), 0)  # replayed: nothing is processed or written
    assert len(calls) == 1 and table.manifest().number == 1
    none = spark.createDataFrame([], worker.SESSIONS)
    w.batch(none, 1)  # the pause of 2 is not over; 4 is put back only once
    assert calls[1] == [3, 4] and states(table)[4] == ("done", 0)
    at[0] = NOW + dt.timedelta(seconds=61)
    w.batch(spark.createDataFrame([session(i, audio=None) for i in range(20, 26)], worker.SESSIONS), 2)
    assert calls[2] == [2, 3] and states(table)[3] == ("failed", 3) and alerts == [6]


def test_worker_restarts_from_its_checkpoint(spark, tmp_path):
    arrive = lambda i, n: spark.createDataFrame([session(i)], worker.SESSIONS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    table, calls, fail = Published(spark, f"{tmp_path}/t", worker.SESSIONS, ["session_id"], buckets=2), [], [True]
    base = processing(spark, calls)

    def process(ready):
        out = base(ready)
        if calls[-1] == [5] and fail:
            fail.clear()
            raise RuntimeError("the worker dies")
        return out

    w = worker.Worker(table, process, now=lambda: F.lit(NOW))
    stream = lambda: w.start(spark.readStream.schema(worker.SESSIONS).json(f"{tmp_path}/in"), f"{tmp_path}/check", None)
    arrive(1, 0)
    stream().awaitTermination()
    arrive(5, 1)
    with pytest.raises(Exception, match="the worker dies"):
        stream().awaitTermination()
    assert states(table) == {1: ("done", 0)}
    stream().awaitTermination()  # runs the failed batch again
    assert states(table) == {1: ("done", 0), 5: ("done", 0)} and calls == [[1], [5], [5]] and table.manifest().writers == {"worker": 1}


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_timers(spark, tmp_path, rocks):
    schema = "store string, task_id string, ts long, status string"
    events = [("a", "t1", 1, "pending"), ("a", "t1", 2, "processing"), ("a", "t2", 1, "completed"), ("a", "t2", 2, "failed"), ("b", "u1", 1, "completed"), ("b", "u2", 2, "completed"), ("b", "u3", 3, "completed"), ("b", "u4", 4, "processing")]
    spark.createDataFrame(events, schema).coalesce(1).write.json(f"{tmp_path}/in")
    q = timers.watched(spark.readStream.schema(schema).json(f"{tmp_path}/in"), stuck=4.0, expiry=9.0, most=3).writeStream.outputMode("update").format("memory").queryName("watched").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        end, got = time.time() + 90, set()
        while time.time() < end and sum(r[2] == "expired" for r in got) < 5:
            time.sleep(1)
            got = {(r.task_id, r.status, r.reason) for r in spark.table("watched").collect()}
    finally:
        q.stop()
    assert {g for g in got if g[2] == "event"} == {("t1", "pending", "event"), ("t1", "processing", "event"), ("t2", "completed", "event"), ("u1", "completed", "event"), ("u2", "completed", "event"), ("u3", "completed", "event"), ("u4", "processing", "event")}
    assert {g for g in got if g[2] == "evicted"} == {("u1", "completed", "evicted")}  # the oldest finished job of more than three
    assert {g for g in got if g[2] == "processing_timeout"} == {("t1", "failed", "processing_timeout"), ("u4", "failed", "processing_timeout")}
    assert {g[0] for g in got if g[2] == "expired"} == {"t1", "t2", "u2", "u3", "u4"}
