import json
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from colloquy import catalog
from colloquy.functions import audio, labels, names
from colloquy.operators import clustering
from colloquy.plans import joins, models

from .conftest import DATA


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values()) or ("x",)], list(values) or ["x"])
    return row.select(expr.alias("r")).first().r


def test_rules(spark):
    t = F.col("t")
    assert one(spark, labels.relation_by_salutation(t), t="우리 엄마 친구") == "부모"
    assert one(spark, labels.relation(F.lit("동료"), t), t="형") == "동료"
    assert one(spark, labels.relation_by_salutation(t), t="없음") is None
    assert [one(spark, labels.emotion_of_code(t), t=x) for x in ("E12", "E65", "E99", "x")] == ["부정", "긍정", None, None]
    assert [one(spark, labels.emotion_of_name(t), t=x) for x in (" 기쁨", "분노", "?")] == ["긍정", "부정", "중립"]
    assert [one(spark, labels.age_range(t), t=x) for x in ("10대", "50대이상", "35", "71", "?")] == ["20s", "50s+", "30s", "50s+", "unknown"]
    tags = F.array(*map(F.lit, ["Speech", "Inside", "Car", "Music"]))
    assert one(spark, labels.noise_category(tags)) == "street" and one(spark, labels.noise_category(F.array(F.lit("Speech")))) == "clean"
    assert one(spark, labels.valence(F.lit(0.75))) == 0.5
    f0 = lambda v: F.lit(float(v))
    assert [one(spark, labels.gender(f0(v))) for v in (120, 165, 230)] == ["male", "female", "female"]
    assert [one(spark, labels.voice_age(f0(v), f0(s))) for v, s in ((140, 5), (140, 40), (90, 5), (230, 5), (180, 50))] == ["20대", "30대", "50대+", "20대", "40대"]


def test_discourse_role(spark):
    kind = "struct<is_greeting:boolean,is_closing:boolean,is_backchannel:boolean,is_short_response:boolean,turn_type:string,utterance_type:string>"
    cases = [(None, "default_context"), ({"is_greeting": True}, "opening"), ({"is_backchannel": True}, "backchannel"), ({"turn_type": "closing"}, "closing"), ({"utterance_type": "question"}, "question"), ({"is_short_response": True}, "response"), ({"turn_type": "middle"}, "statement"), ({}, "default_context")]
    df = spark.createDataFrame([(i, None if f is None else json.dumps(f)) for i, (f, _) in enumerate(cases)], "i int, j string").select("i", F.from_json("j", kind).alias("f"))
    got = [r.d for r in df.orderBy("i").select(labels.discourse_role(F.col("f")).alias("d")).collect()]
    assert got == [w for _, w in cases]


def test_extended_spans(spark):
    spans = lambda t: [(s.type, s.matched_text) for s in one(spark, labels.extended_spans(F.col("t")), t=t)]
    assert ("credential_like", "ABC123") in spans("비밀번호 ABC123") and spans("ABC123") == []
    assert ("foreign_id_like", "900101-5234567") in spans("900101-5234567")
    assert ("payment_like", "1234567") in spans("송금 1234567") and spans("1234567") == [("numeric_sensitive_like", "1234567")]


def test_corrections(spark):
    got = one(spark, labels.corrected(F.col("t"), [("선생님", "수석님"), ("a.b", "c$d")]), t="선생님이 큰선생님 a.b axb")
    assert (got.text, got.n) == ("수석님이 큰선생님 c$d axb", 2)
    assert one(spark, labels.in_domain(F.col("t"), ["서버", "배포", "장애"], 2), t="서버 장애")


def test_names(spark):
    t = F.col("t")
    hits = lambda text: [tuple(h) for h in one(spark, names.name_hits(t), t=text)]
    assert hits("김현정이 왔다, 현정아!") == [("김현정", 0, 4, "full"), ("현정아", 9, 13, "vocative")]
    assert hits("준호야 현정야 준호아") == [("준호야", 0, 3, "vocative")] and hits("김현정들이 x") == [] and hits("") == []
    assert one(spark, names.masked(t), t="김현정이  왔다, (박성민)") == "[PII_이름]이  왔다, ([PII_이름])"
    spans = lambda text, *out: [s.matched_text for s in one(spark, names.surname_spans(t, out), t=text)]
    assert spans("김철 씨") == ["김철"] and spans("김철 가다") == [] and spans("정말로 박수현", "정말") == ["박수현"] and spans("정말로") == ["정말로"]
    assert spans("내김철수") == [] and spans("(류하)과장 오 구하나씨") == ["구하나"]
    got = names.masked_rows(spark.createDataFrame([(1, "김현정이 현정아"), (2, None)], "k long, text string"), "k").orderBy("k").collect()
    assert [(r.masked, r.n_full, r.priority) for r in got] == [("[PII_이름]이 현정아", 1, 1), ("", 0, 0)]


def test_clusters(spark):
    r = np.random.default_rng(1)
    e = np.r_[r.normal([5, 0, 0], 0.3, (6, 3)), r.normal([0, 5, 0], 0.3, (5, 3))]
    assert list(clustering.two_clusters(e)) == [0] * 6 + [1] * 5
    df = spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(e)], "session_id long, window_idx long, embedding array<double>")
    out = clustering.reclustered(df).orderBy("window_idx").collect()
    assert [x.speaker for x in out] == ["SPEAKER_00"] * 6 + ["SPEAKER_01"] * 5
    pairs = spark.createDataFrame([("a", "1")] * 3 + [("b", "2")] * 2 + [("a", "2")], "a string, b string")
    assert clustering.permutation_accuracy(pairs, "a", "b") == 5 / 6
    assert clustering.greedy_mapping([("a", "x", 3.0), ("b", "x", 2.0), ("b", "y", 1.0)]) == {"a": "x", "b": "y"}
    assert clustering.greedy_split([("a", 70), ("b", 15), ("c", 15)]) == {"a": "train", "b": "val", "c": "test"}


def test_audio(spark):
    quiet = np.full(16000, 0.02, np.float32)
    assert abs(audio.rms(audio.normalized(quiet)) - 0.1) < 1e-6 and audio.normalized(np.ones(10)).max() == 1
    gap = np.r_[np.ones(16000) * 0.5, np.zeros(48000), np.ones(16000) * 0.5]
    assert len(audio.silence_compressed(gap, 16000)) == 32000 + 8000
    assert len(audio.locally_normalized(gap, 16000)) == len(gap)
    hidden = audio.masked(quiet, [(0.25, 0.5)], 16000, beep=False)
    assert (hidden[4000:8000] == 0).all() and hidden[0] == quiet[0]
    assert audio.segmental_snr(np.zeros(0)) is None
    got = spark.createDataFrame([([0.01] * 320,)], "s array<float>").select(audio.normalize_gain("s").alias("s")).first().s
    assert abs(got[0] - 0.1) < 1e-6


def test_audio_windows():
    r = np.random.default_rng(2)
    rate, n = 400, 1000
    w = [r.normal(0, 0.2, n).astype(np.float32) for _ in range(4)]
    quiet, tail = np.zeros(n, np.float32), np.ones(7, np.float32)
    shifted = np.r_[w[0][20:], w[0][:20] * 0]
    got = audio.without_duplicates(np.r_[w[0], w[1], shifted, quiet, quiet, w[2], w[3], w[1], tail], rate)
    assert (got == np.r_[w[0], w[1], quiet, quiet, w[2], w[3], w[1], tail]).all()  # the last copy lies too far behind
    assert (audio.without_duplicates(np.r_[w[0], w[0], w[0]], rate) == w[0]).all() and len(audio.without_duplicates(w[0], rate)) == n
    a = np.arange(1000, dtype=np.float32)
    assert (audio.spans_of(a, [(0.5, 0.75), (0.7, 0.8), (2.4, 9.0), (-1, 0.01)], rate) == np.r_[a[:4], a[200:320], a[960:]]).all()
    assert audio.speaker_audio(a, [(0, 0.4)], rate) is None and len(audio.speaker_audio(a, [(0, 0.5)], rate)) == 200
    out = audio.reassembled([(0.0, a[:4]), (0.005, a[10:14]), (2.495, a[:50])], 2.5, rate)
    assert len(out) == 1000 and list(out[:7]) == [0, 1, 10, 11, 12, 13, 0] and list(out[-3:]) == [0, 0, 1]


class Upper:
    def load(self):
        return lambda texts: [(t.upper(), len(t) / 3) for t in texts]


def test_model_boundary(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "i long, text string")
    assert [(r.label, r.confidence) for r in models.predicted(df, Upper()).orderBy("i").collect()] == [("AB", 0.6667), ("", 0.0)]
    assert [r.label for r in models.predicted(df, None).collect()] == [None, None]
    ok = lambda j: one(spark, models.validated(F.col("j"), ["a"]), j=j)
    assert ok('{"label": "a", "confidence": 0.9}').label == "a" and ok('{"label": "b", "confidence": 0.9}') is None and ok("no json") is None


def test_best_assignment():
    r = np.random.default_rng(3)
    for n, m in [(1, 1), (1, 4), (3, 3), (4, 6), (6, 6)] * 8:
        gain = r.integers(0, 9, (n, m)) * r.integers(0, 2, (n, m))
        assert clustering.best_assignment(gain) == max(sum(gain[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n))


def test_whole_embeddings(spark):
    """Accuracy and clusters take in every label and row."""
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    labels = e.label.to_numpy()
    shifted = np.where(e.vec_id % 7 == 0, (labels + 1) % 10, labels)
    gain = np.zeros((10, 10), int)
    np.add.at(gain, (labels, shifted), 1)
    # best sums over sets of columns, row by row
    best = {0: 0}
    for row in gain:
        best = {s: max(best[s ^ 1 << j] + int(row[j]) for j in range(10) if s >> j & 1) for s in range(1 << 10) if s.bit_count() == next(iter(best)).bit_count() + 1}
    got = catalog.QUERIES["agg20_permutation_accuracy"](spark, DATA).first().accuracy
    assert got == round(best[(1 << 10) - 1] / len(e), 6)
    windows = catalog.QUERIES["vec7_recluster"](spark, DATA).toPandas()
    assert sorted(windows.window_idx) == sorted(e.vec_id)
    for session, part in e.sort_values("vec_id").groupby(e.vec_id // 100):
        x = np.stack(part.embedding.to_list()).astype(float)
        found = clustering.two_clusters(x)
        sure = clustering.confidence(x, found)
        want = [f"SPEAKER_{k:02d}" for k in (found if sure >= 0.30 else found * 0)]
        mine = windows[windows.session_id == session].sort_values("window_idx")
        assert list(mine.speaker) == want and set(mine.confidence) == {round(sure, 6)}


def test_mutual_map(spark):
    def run(cells):
        return sorted((r.la, r.lb) for r in clustering.mutual_map(spark.createDataFrame(cells, "la string, lb string, c double")).collect())

    clear = [("a", "x", 0.9), ("a", "y", 0.2), ("b", "x", 0.1), ("b", "y", 0.8)]
    assert run(clear) == [("a", "x"), ("b", "y")]
    assert run([*clear[:3], ("b", "y", 0.12)]) == []  # a label that leads by too little
    assert run([("a", "x", 0.9), ("a", "y", 0.2), ("b", "x", 0.8), ("b", "y", 0.3)]) == []  # two labels with one best
    assert run([("a", "x", 0.9)]) == [("a", "x")] and run([("a", "x", -0.97)]) == []


def test_best_matches_keep_every_label(spark):
    """An unclear map hides no match, equal likeness goes to the first label, and the query's vectors are the table's."""
    cells = [("a", "x", 0.9), ("a", "y", 0.9), ("b", "x", 0.1), ("b", "y", 0.12)]
    got = {r.la: (r.lb, r.mutual, r.ok, r.clear) for r in clustering.best_matches(spark.createDataFrame(cells, "la string, lb string, c double")).collect()}
    assert got == {"a": ("x", True, False, False), "b": ("y", False, False, False)}
    pairs = joins.QUERIES["jn24_mutual_best"](spark, "/root/testdata/sf0.001").collect()
    assert len(pairs) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 2 = 0").select("label").distinct().count() and any(r.mutual for r in pairs)


def test_names_in_words(spark):
    w = "array<struct<word:string,start:double>>"
    rows = [(1, "김현정이 왔다", [("김현정이", 0.0), ("왔다", 1.0), ("(김·현정)", 2.0), (None, 3.0)]), (2, "아무도", [("김현정", 0.0)]), (3, None, None)]
    got = {r.id: r for r in names.masked_in_step(spark.createDataFrame(rows, f"id int, text string, words {w}")).collect()}
    # the word's Hangul holds the name, but the name itself doesn't stand in it: it stays
    assert got[1].masked == "[PII_이름]이 왔다" and [tuple(x) for x in got[1].words] == [("[PII_이름]이", 0.0), ("왔다", 1.0), ("(김·현정)", 2.0), (None, 3.0)] and got[1].n_masked == 1
    assert [tuple(x) for x in got[2].words] == [("김현정", 0.0)] and got[2].n_masked == 0 and got[3].words is None and got[3].n_masked == 0


def test_review_flags(spark):
    m = "array<struct<form:string,tag:string>>"
    nim = ("님", "XSN")
    rows = [(1, "현정아 와라", [("인증서", "NNG"), nim, ("고객", "NNP"), nim]), (2, "", [("선생", "NNG"), nim, ("김현정", "NNP"), nim, ("가", "VV"), nim]), (3, None, [nim]), (4, "x", None)]
    df = spark.createDataFrame(rows, f"id int, t string, m {m}")
    got = {r.id: r.r for r in df.select("id", names.review_flags(F.col("t"), F.col("m")).alias("r")).collect()}
    assert [(f.type, f.severity, f.char_start) for f in got[1].flags][:2] == [("vocative", "low", 0), ("object_nim", "med", None)] and got[1].priority >= 4
    assert got[2].flags == [] and got[2].priority == 0 and got[3].flags == []
    assert [r.p for r in df.select(names.review_flags(F.col("t"))["priority"].alias("p")).collect()] == [1, 0, 0, 0]
