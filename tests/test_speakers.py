"""Speaker analysis, reclustered words against a plain version, labels that are taken up again."""

import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import clustering
from colloquy.operators import speakers as P
from colloquy.plans import models
from colloquy.plans import speakers as Q
from colloquy.sources import tables as T

DATA = "/root/testdata/sf0.001"

SEGMENT = "session_id long, idx int, speaker string, start_sec double, end_sec double, text string, speech_age string"
VOICE = "session_id long, speaker string, embedding array<float>, f0 double, f0_std double, relation string"


def analysed(spark, segments, voices=(), profiles=()):
    out = P.analysed(spark.createDataFrame(segments, SEGMENT), spark.createDataFrame(list(voices), VOICE), spark.createDataFrame(list(profiles), "session_id long, profile array<float>"))
    return {(r.session_id, r.speaker): r for r in out.collect()}


def test_analysis_by_profile(spark):
    segments = [(1, 0, "SPEAKER_IVR", 0.0, 90.0, "안내", None), (1, 1, "A", 90.0, 91.0, "엄마", "20s"), (1, 2, "B", 91.0, 99.0, "그래 엄마야", "40s"), (1, 3, "A", 99.0, 99.2, None, "30s"), (1, 4, None, 0.0, 5.0, "x", None)]
    voices = [(1, "SPEAKER_IVR", [1.0, 0.0], 200.0, 1.0, None), (1, "A", [0.9, 0.1], 120.0, 1.0, None), (1, "B", [0.0, 1.0], None, None, None)]
    got = analysed(spark, segments, voices, [(1, [1.0, 0.0])])
    assert len(got) == 3  # a segment without speaker is nobody's
    assert (got[1, "A"].role, got[1, "A"].role_source, got[1, "A"].relation) == ("self", "profile_match", None)
    assert (got[1, "B"].role, got[1, "B"].role_source, got[1, "B"].relation, got[1, "B"].gender, got[1, "B"].voice_age) == ("other", "heuristic", "부모", None, None)
    assert (got[1, "SPEAKER_IVR"].role, got[1, "SPEAKER_IVR"].relation) == ("other", None)
    assert got[1, "A"].speech_age == "20s" and got[1, "B"].speech_age == "40s"  # a tie goes to what is said first


def test_analysis_by_length(spark):
    segments = [(1, 0, "SPEAKER_IVR", 0.0, 90.0, "", None), (1, 1, "B", 0.0, 2.0, "", None), (1, 2, "A", 2.0, 4.0, "", None), (2, 0, "SPEAKER_IVR", 0.0, 9.0, "여보", None)]
    got = analysed(spark, segments, [(1, "A", [1.0], 100.0, 0.0, "친구")], [(2, [1.0])])
    assert got[1, "B"].role == "self" and got[1, "B"].role_source == "heuristic"  # equally long: who speaks first
    assert got[1, "A"].relation == "친구" and got[1, "A"].voice_age == "40대"
    assert got[2, "SPEAKER_IVR"].role == "other"  # no person, so no self
    assert analysed(spark, []) == {}


def test_analysis_of_short_voice(spark):
    """A voice of under half a second is not held against the profile, nor is an unlike one taken."""
    segments = [(1, 0, "A", 0.0, 0.4, "", None), (1, 1, "B", 1.0, 9.0, "", None)]
    got = analysed(spark, segments, [(1, "A", [1.0, 0.0], 100.0, 0.0, None), (1, "B", [0.0, 1.0], 100.0, 0.0, None)], [(1, [1.0, 0.0])])
    assert got[1, "B"].role == "self" and got[1, "B"].role_source == "heuristic"


def plain_windows(words):
    runs, begin = [], 0
    for i in range(1, len(words) + 1):
        if i == len(words) or words[i][0] != words[i - 1][0] or words[i][1] - words[i - 1][2] > 0.5:
            runs.append((begin, i))
            begin = i
    out = []
    for a, b in runs:
        start, end = words[a][1], words[b - 1][2]
        if end - start < 1:
            continue
        n = int((end - start + 3) // 4)
        for k in range(n):
            lo, hi = start + k * (end - start) / n, min(end, start + (k + 1) * (end - start) / n)
            if hi - lo >= 1:
                out.append((lo, hi, [i for i in range(a, b) if words[i][2] > lo and words[i][1] < hi]))
    return out


def test_reclustered_words(spark):
    rng = np.random.default_rng(3)
    rows, embedded, want = [], [], {}
    for session in range(6):
        at, words = 0.0, []
        for i in range(60):
            at += rng.choice([0.0, 0.1, 0.8], p=[0.6, 0.3, 0.1])
            end = at + rng.uniform(0.1, 1.2)
            words.append((f"X{rng.integers(3) if rng.random() < 0.15 or not words else words[-1][0][1:]}", round(float(at), 3), round(float(end), 3)))
            at = round(end, 3)
        rows += [(session, i, *w) for i, w in enumerate(words)]
        windows = plain_windows(words)
        vectors = {k: rng.normal(size=4) * 0.3 + ([3, 0, 0, 0] if k % 3 else [0, 3, 0, 0]) for k in range(len(windows)) if k != 2}  # window 2 has none
        if session == 5:
            vectors = {}
        embedded += [(session, k, [float(x) for x in v]) for k, v in vectors.items()]
        new = [w[0] for w in words]
        if vectors:
            labels = dict(zip(vectors, clustering.two_clusters(np.stack(list(vectors.values())).astype(np.float32).astype(float))))
            if session < 5:
                for k, (_, _, inside) in enumerate(windows):
                    for i in inside if k in labels else []:
                        new[i] = f"SPEAKER_{labels[k]:02d}"
                names = list(dict.fromkeys(new))
                new = [f"SPEAKER_{names.index(x):02d}" for x in new]
        want |= {(session, i): x for i, x in enumerate(new)}
    words = spark.createDataFrame(rows, "session_id long, word_idx int, speaker string, start_sec double, end_sec double")
    vectors = spark.createDataFrame(embedded, "session_id long, window_idx long, embedding array<float>")
    windows = P.embedding_windows(words)
    assert windows.count() == sum(len(plain_windows([r[2:] for r in rows if r[0] == s])) for s in range(6))
    got = P.reclustered_words(words, windows.join(vectors, ["session_id", "window_idx"])).collect()
    assert len(got) == len(rows) and {(r.session_id, r.word_idx): r.new_speaker for r in got} == want
    unclear = P.reclustered_words(words, windows.join(vectors, ["session_id", "window_idx"]), 1.1).collect()
    assert {(r.session_id, r.word_idx): r.new_speaker for r in unclear} == {(r[0], r[1]): r[2] for r in rows}


def test_windows_are_cut_at_the_end(spark):
    words = spark.createDataFrame([(1, 0, "A", 0.0, 4.5), (2, 0, "A", 0.0, 5.0)], "session_id long, word_idx int, speaker string, start_sec double, end_sec double")
    bounds = lambda df: sorted((r.session_id, r.window_idx, r.win_start, r.win_end) for r in df.collect())
    assert bounds(P.embedding_windows(words)) == [(1, 0, 0.0, 4.5), (2, 0, 0.0, 2.5), (2, 1, 2.5, 5.0)]
    lengths = spark.createDataFrame([(1, 4.0), (2, 3.0)], "session_id long, seconds double")
    assert bounds(P.embedding_windows(words, lengths)) == [(1, 0, 0.0, 4.0), (2, 0, 0.0, 2.5)]


def test_analysis_query_has_all_roles(spark):
    got = Q.dz6_speaker_analysis(spark, DATA).groupBy("role_source").count().collect()
    assert {r.role_source for r in got} == {"profile_match", "heuristic"}
    assert T.turns(spark, DATA).select("session_id").distinct().count() >= Q.dz6_speaker_analysis(spark, DATA).where("role = 'self'").count() > 0


def test_overlap_without_turns(spark):
    u = spark.createDataFrame([(1, 0, 0.0, 2.0)], "session_id long, k int, start_sec double, end_sec double")
    assert P.with_overlap(u, None, "k") is u
    turns = spark.createDataFrame([(1, 0, "A", 0.0, 1.5), (1, 1, "B", 1.0, 3.0), (1, 2, "A", 2.9, 4.0)], "session_id long, turn_idx int, speaker string, start_sec double, end_sec double")
    odd = u.union(spark.createDataFrame([(1, 1, None, None), (1, 2, 5.0, 6.0)], u.schema))
    got = {r.k: (r.overlap_count, r.overlap_total, r.overlap_ratio, r.is_overlapping) for r in P.with_overlap(odd, turns, "k").collect()}
    assert got == {0: (1, 0.5, 0.25, True), 1: (0, 0.0, 0.0, False), 2: (0, 0.0, 0.0, False)}  # 0.1 s at 2.9 is under the cutoff


def test_routes(spark):
    words = spark.createDataFrame([(s, i, "S") for s in (1, 2, 3) for i in (0, 1)], "session_id long, word_idx int, speaker string")
    lengths = spark.createDataFrame([(1, 100.0), (2, 101.0)], "session_id long, seconds double")
    told = lambda name: words.where("word_idx = 0").withColumn("speaker", F.lit(name))
    got = {(r.session_id, r.word_idx): r.new_speaker for r in P.routed(words, lengths, told("F"), told("A"), 100).collect()}
    assert got == {(1, 0): "F", (1, 1): "S", (2, 0): "A", (2, 1): "S", (3, 0): "S", (3, 1): "S"}


class Labels:
    """Answers texts of an even length only, as a service that fails at times."""

    def load(self):
        return lambda texts: [("even", 0.9) if len(t) % 2 == 0 else (None, None) for t in texts]


def test_labels_are_taken_up_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "aa", None), (2, "abc", None), (3, " \t", None), (4, None, None), (5, "xx", "done")], "id long, text string, label string")
    assert {r.id for r in P.pending(rows).collect()} == {1, 2}
    said = models.predicted(P.pending(rows).select("id", "text"), Labels()).where("label is not null").select("id", F.col("label").alias("new"))
    after = rows.join(said, "id", "left").withColumn("label", F.coalesce("label", "new")).drop("new")
    after.write.parquet(str(tmp_path / "after"))
    again = spark.read.parquet(str(tmp_path / "after"))
    assert {r.id: r.label for r in again.collect()} == {1: "even", 2: None, 3: None, 4: None, 5: "done"}
    assert {r.id for r in P.pending(again).collect()} == {2}  # what is labelled stays, what failed comes again


def test_segment_rows(spark):
    s = spark.createDataFrame([(1, "a", ["ab", "x", None, "cd", "ef"]), (2, "b", ["ab", "cd"]), (3, "c", None)], "seg_id long, label string, texts array<string>")
    assert sorted(tuple(r) for r in P.segment_rows(s, "q").collect()) == [(t, "a", "a", 1, "q") for t in ("ab", "cd", "ef")]


def test_gates(spark):
    g = spark.range(1).select(P.gates({"preprocess_gain": False, "loudness_norm": None}).alias("g")).first().g
    assert g.preprocess_gain == "false" and g.loudness_norm is None and g.hybrid_diarization is None


def test_reclustered_words_read_events_once(spark):
    """What is left to run after the checkpoints scans no table again."""
    plan = Q.vec8_reclustered_words(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan
