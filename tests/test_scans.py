"""Scans over sliced keys against plain windows, with one session that holds a third of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import intervals, reports, scans, sequences

LIMIT = 40


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(scans, "LIMIT", LIMIT)
    monkeypatch.setattr(scans, "QUANTILES", 4)


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(6), []
    for s in [None, *range(12)]:
        n, t = (900 if s == 3 else 150 if s is None else rng.randint(1, 39)), 0.0
        for k in range(n):
            t += rng.choice([0.1, 0.2, 0.3, 1.0])
            out.append((s, k, t, t + rng.choice([0.1, 0.2, 3.0]), rng.choice(["A", "B", None]), rng.choice([None, None, 1, 2, 5])))
    return spark.createDataFrame(out, "session_id long, word_idx int, start_sec double, end_sec double, speaker string, x int").repartition(7).checkpoint()


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, a.select(sorted(a.columns)).collect()), key=key) == sorted(map(tuple, b.select(sorted(b.columns)).collect()), key=key)


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_against_windows(rows, small):
    cut = scans.Sliced(rows, ["session_id"], ["word_idx"])
    assert cut.cut and cut.rows.where("session_id = 3").select("_slice").distinct().count() > 8
    assert cut.rows.where("_n is not null").select("session_id").distinct().count() == 2
    got = (
        cut.add("p", scans.previous(F.col("speaker"))).add("f", scans.following(F.col("x"))).add("s", scans.running_sum(F.col("x"))).add("n", scans.row_number())
        .add("h", scans.highest_before(F.col("end_sec"))).add("k", scans.last_known(F.col("x"))).result()
    )
    w = Window.partitionBy("session_id").orderBy("word_idx")
    before, to = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*", F.lag("speaker").over(w).alias("p"), F.lead("x").over(w).alias("f"), F.sum("x").over(to).alias("s"), F.row_number().over(w).cast("long").alias("n"),
        F.max("end_sec").over(before).alias("h"), F.last("x", True).over(to).alias("k"),
    )
    assert same(got, want)


def test_no_task_holds_the_hot_session(spark, rows, small):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = scans.Sliced(rows, ["session_id"], ["word_idx"]).add("n", scans.row_number()).result()
        most = got.where("session_id = 3").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert most < 300


@pytest.mark.parametrize("name", ["utterances", "speakers", "merged", "silence", "fallback", "smoothed", "nearest"])
def test_operators_are_the_same_when_cut(rows, name, monkeypatch):
    turns = rows.where("x is not null").select("session_id", F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end"), F.col("word_idx").alias("turn_idx"))
    points = rows.select("session_id", F.col("word_idx").cast("long").alias("word_idx"), F.col("start_sec").alias("at"))
    run = {
        "utterances": lambda: sequences.utterance_islands(rows),
        "speakers": lambda: sequences.islands(rows, ["session_id"], ["word_idx"], sequences.differs("speaker"), "run"),
        "merged": lambda: intervals.merged(rows.where("x = 1"), ["session_id"]),
        "silence": lambda: sequences.silence_before(rows, "word_idx"),
        "fallback": lambda: sequences.speaker_fallback(rows),
        "smoothed": lambda: sequences.smoothed(rows, 2.0),
        "nearest": lambda: intervals.nearest_start(points, turns, "word_idx", "turn_idx"),
    }[name]
    whole = run()
    monkeypatch.setattr(scans, "LIMIT", LIMIT)
    monkeypatch.setattr(scans, "QUANTILES", 8)
    assert same(run(), whole)


def test_one_value_and_no_rows(spark, small):
    equal = spark.createDataFrame([(1, 5, k) for k in range(100)], "session_id int, t int, k int")
    got = scans.Sliced(equal, ["session_id"], ["t", "k"]).add("n", scans.row_number()).result()
    assert all(r.n == r.k + 1 for r in got.collect())
    assert scans.Sliced(equal.limit(0), ["session_id"], ["t", "k"]).add("n", scans.row_number()).result().count() == 0


def test_names_of_callers_do_not_meet_its_own(spark, small):
    """Keys and columns named as a slice's inner columns are, and queries that number all rows under one key."""
    taken = spark.createDataFrame([(1, 1, k, k) for k in range(200)], "at int, all int, _sum int, _own int").withColumnRenamed("all", "_all")
    cut = scans.Sliced(taken, ["at", "_all"], ["_own"]).add("_at", scans.row_number()).add("_carried", scans.running_sum(F.col("_at")))
    assert cut.cut
    assert all(r["_at"] == r["_own"] + 1 and r["_carried"] == r["_at"] * (r["_at"] + 1) // 2 for r in cut.result().collect())


def test_dummy_rows_when_cut(spark, small):
    orders = spark.range(500).select((F.col("id") * 3).alias("k"))
    got = reports.dummy_rows(orders, "k", [("a", "x"), ("b", "y"), ("c", "z")], "label").collect()
    assert sorted((r.text, r.label, r.source) for r in got) == sorted((f"{'abc'[i % 3]} {i * 3}", "xyz"[i % 3], "dummy") for i in range(500))
