import json

from pyspark.sql import functions as F

from colloquy.sources import files, sinks
from colloquy.streaming import jobs


def drained(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_job_states(spark, tmp_path):
    rows = [("a", 1, "running", False), ("a", 2, "done", False), ("a", 3, "failed", False), ("b", 1, "error", False), ("b", 2, "error", True), ("b", 3, "error", False), ("c", 1, "error", False), ("c", 2, "error", False), ("c", 3, "error", False), ("c", 4, "done", False)]
    schema = "task_id string, ts long, event string, transient boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    out = drained(jobs.job_states(spark.readStream.schema(schema).json(f"{tmp_path}/in")), "job_states", "update")
    assert {r.task_id: (r.status, r.retries) for r in out.collect()} == {"a": ("done", 0), "b": ("pending", 2), "c": ("failed", 3)}


def test_chunk_offsets(spark, tmp_path):
    schema = "session_id long, chunk int, duration_sec double, n_utterances int"
    spark.createDataFrame([(1, 0, 10.0, 3), (1, 1, 5.5, 2), (1, 2, 1.0, 1), (2, 0, 7.0, 4)], schema).coalesce(1).write.json(f"{tmp_path}/in")
    out = drained(jobs.chunk_offsets(spark.readStream.schema(schema).json(f"{tmp_path}/in")), "chunk_offsets", "append")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 0.0, 0), (1, 1, 10.0, 3), (1, 2, 15.5, 5), (2, 0, 0.0, 0)]


def test_activity(spark, tmp_path):
    schema = "user_id long, ts timestamp, value double"
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:05:00", 2.0), (1, "2024-01-01 01:00:00", 4.0), (9, "2024-01-03 00:00:00", 0.0)]
    spark.createDataFrame(rows, "user_id long, ts string, value double").coalesce(1).write.json(f"{tmp_path}/in")
    out = drained(jobs.activity(spark.readStream.schema(schema).json(f"{tmp_path}/in")), "activity", "append")
    assert sorted((r.user_id, r.n, r.value) for r in out.collect()) == [(1, 1, 4.0), (1, 2, 3.0)]


def test_stuck(spark):
    df = spark.createDataFrame([(1, "running", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:19:00"), (3, "done", "2024-01-01 00:00:00")], "id long, status string, u string").withColumn("updated_at", F.to_timestamp("u"))
    assert [(r.id, r.status) for r in jobs.stuck(df, "2024-01-01 00:20:00").collect()] == [(1, "failed")]


def test_files(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER call 1 2.0 1.5 <NA> <NA> s1 <NA> <NA>\nSPEAKER call 1 0.5 1.0 <NA> <NA> s0 <NA> <NA>\n;; comment\n")
    got = [(r.turn_idx, r.speaker, r.start_sec, r.end_sec) for r in files.rttm_turns(spark, str(tmp_path / "a.rttm")).orderBy("turn_idx").collect()]
    assert got == [(0, "s0", 0.5, 1.5), (1, "s1", 2.0, 3.5)]
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("ok.json", json.dumps({"text": "a"}))
        z.writestr("bad.json", "{")
        z.writestr("x.txt", "x")
    assert [(r.member, r.value) for r in files.zipped_json(spark, str(tmp_path / "z.zip")).collect()] == [("ok.json", '{"text": "a"}')]
    (tmp_path / "l.json").write_text(json.dumps([{"text": "one"}, {"utterance": "two"}, {"none": 1}]))
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"form": "three"}]}))
    assert sorted(r.text for r in files.json_texts(spark, str(tmp_path / "*.json")).collect()) == ["one", "three", "two"]
    lines = spark.createDataFrame([("f", 1, "RMS level dB: -21.5"), ("f", 2, "Peak level dB: -3.0"), ("f", 3, "silence_duration: 1.25"), ("f", 4, "silence_duration: 2"), ("g", 1, "nothing")], "file string, line_no int, value string")
    assert {r.file: (r.rms_db, r.peak_db, r.silence_sec) for r in files.audio_statistics(lines).collect()} == {"f": (-21.5, -3.0, 3.25), "g": (-60.0, -60.0, 1.0)}


def test_sinks(spark):
    old = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 5)], "s int, q int, v string, t int")
    new = spark.createDataFrame([(1, 2, "c", 6), (1, 3, "d", 6), (1, 3, "e", 7)], "s int, q int, v string, t int")
    assert sorted((r.q, r.v) for r in sinks.upserted(old, new, ["s", "q"], "t").collect()) == [(1, "a"), (2, "c"), (3, "e")]
    runs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "session_id int, run_id int, created_at int")
    assert sorted(tuple(r) for r in sinks.latest_run(runs).collect()) == [(1, 11), (2, 12)]
    assert sinks.without_binary(old.withColumn("b", F.lit(b"x"))).columns == old.columns
