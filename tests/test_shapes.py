"""Nested values, JSON of any shape, clusters, anchors and splits against plain versions."""

import json
import math
import random
import time
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions import nested
from colloquy.operators import clustering, relations
from colloquy.sources import files


def test_nested(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [(nan, {"a": [1.0, inf]}), (2.0, None), None], {"k": nan, "j": 3.0}, None, b"x", "NaN"), (2, None, {}, (1.5, nan), None, None), (3, [], None, (-inf, 0.0), None, None)]
    df = spark.createDataFrame(rows, "id int, l array<struct<v:double,m:map<string,array<double>>>>, m map<string,float>, s struct<a:double,`b.c`:float>, raw binary, t string")
    out = {r.id: r for r in nested.finite_everywhere(df).collect()}
    assert nested.finite_everywhere(df).schema.simpleString() == df.schema.simpleString()
    one = out[1]
    assert one.l[0].v is None and one.l[0].m == {"a": [1.0, None]} and one.l[1].v == 2.0 and one.l[1].m is None and one.l[2] is None
    assert one.m == {"k": None, "j": 3.0} and one.s is None and one.raw == b"x" and one.t == "NaN"
    assert out[2].l is None and out[2].m == {} and tuple(out[2].s) == (1.5, None) and tuple(out[3].s) == (None, 0.0) and out[3].l == []


def texts_in(obj, aliases=files.ALIASES):
    if isinstance(obj, str):
        return [obj] if len(obj) > 1 else []
    if isinstance(obj, dict):
        for a in aliases:
            if isinstance(obj.get(a), str) and obj[a].strip():
                return [obj[a].strip()]
        obj = list(obj.values())
    return [t for x in obj for t in texts_in(x)] if isinstance(obj, list) else []


def test_found_texts(spark):
    rng = random.Random(4)

    def made(depth):
        k = rng.random()
        if depth == 0 or k < 0.25:
            return rng.choice(["x", "a text", "  ", "", 5, 1.5, True, None, "두 글자", ' "quoted" \n'])
        if k < 0.55:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["text", "utterance", "발화", "other", "meta", "sentence", "k.e'y"]): made(depth - 1) for _ in range(rng.randint(0, 4))}

    docs = [(k, json.dumps(made(5), ensure_ascii=False)) for k in range(300)] + [(900, "{broken"), (901, ""), (902, None), (903, '{"text": 5, "content": "c c"}')]
    got = {}
    for r in files.found_texts(spark.createDataFrame(docs, "file int, value string")).collect():
        got.setdefault(r.file, []).append(r.text)
    want = {k: sorted(texts_in(json.loads(v))) for k, v in docs if k < 900 or k == 903}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_transcripts(spark):
    audio = spark.createDataFrame([("/d/wav/a.wav",), ("/d/wav/b.wav",), ("/d/wav/c.wav",), ("/d/wav/e.wav",)], "path string")
    given = [
        ("/d/wav/a.json", '{"text": "beside"}'), ("/d/wav/a.txt", "not read"), ("/d/label/a.txt", "not read"), ("/d/wav/b.json", '{"n": 1}'), ("/d/wav/b.txt", "  "), ("/d/labels/b.txt", "later folder"),
        ("/d/label/b.json", '{"data": [{"utterance": " from the label "}]}'), ("/d/transcript/c.txt", "last\n"), ("/x/label/e.txt", "elsewhere"),
    ]
    got = {r.path[-5]: r.text for r in files.transcripts_beside(audio, spark.createDataFrame(given, "path string, value string")).collect()}
    assert got == {"a": "beside", "b": "from the label", "c": "last", "e": ""}


def greedy_by_distances(e):
    """Average linkage over all pairs of clusters."""
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    d, clusters = 1 - u @ u.T, [[k] for k in range(len(e))]
    while len(clusters) > 2:
        i, j = min(((i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters))), key=lambda p: d[np.ix_(clusters[p[0]], clusters[p[1]])].mean())
        clusters[i] += clusters.pop(j)
    labels = np.zeros(len(e), int)
    for k, c in enumerate(sorted(clusters, key=min)):
        labels[c] = k
    return labels


def test_two_clusters():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 5, 20, 40):
        for _ in range(6):
            e = rng.normal(size=(n, 6)) + np.where(rng.random((n, 1)) < 0.4, 2.0, 0.0)
            got = clustering.two_clusters(e)
            assert list(got) == list(greedy_by_distances(e))
    e = rng.normal(size=(5000, 64)) + np.where(rng.random((5000, 1)) < 0.5, 1.5, -1.5)
    start = time.time()
    got = clustering.two_clusters(e)
    assert time.time() - start < 30 and set(got) == {0, 1} and len({tuple(x) for x in zip(got, e.mean(1) > 0)}) == 2


def test_confidences(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for s, n in enumerate((1, 2, 7, 30)):
        e, labels = rng.normal(size=(n, 5)), rng.integers(0, 2, n)
        u = e / np.linalg.norm(e, axis=1, keepdims=True)
        inner = [u[i] @ u[j] for i in range(n) for j in range(i) if labels[i] == labels[j]]
        outer = [u[i] @ u[j] for i in range(n) for j in range(i) if labels[i] != labels[j]]
        want[s] = min(1.0, max(0.0, (np.mean(inner) if inner else 1.0) - (np.mean(outer) if outer else 0.0)))
        assert math.isclose(clustering.confidence(e, labels), want[s], abs_tol=1e-9)
        rows += [(s, int(k), v.tolist()) for k, v in zip(labels, e)]
    got = {r.session_id: r.confidence for r in clustering.confidences(spark.createDataFrame(rows, "session_id int, label int, embedding array<double>")).collect()}
    assert all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_anchors(spark):
    t = [(1, "a", 0.0, 1.0, 100.0, [3.0, 0.0]), (1, "a", 2.0, 2.5, 110.0, [0.0, 9.0]), (1, "b", 3.0, 4.0, 200.0, [0.0, 2.0]), (1, "b", 5.0, 6.0, 210.0, None)]
    t += [(2, "a", 0.0, 1.0, 100.0, [1.0, 0.0]), (2, "b", 0.0, 1.0, 105.0, [0.0, 1.0])]  # pitches too near
    t += [(3, "a", 0.0, 1.0, 100.0, [1.0, 0.0])] + [(4, s, 0.0, 1.0, f, [1.0, 0.0]) for s, f in (("a", 90.0), ("b", 150.0), ("c", 250.0))]
    t += [(5, "a", 0.0, 1.0, 100.0, [1.0, 0.0]), (5, "b", 0.0, 0.5, 200.0, [0.0, 1.0])]  # no turn is long enough
    got = clustering.anchors(spark.createDataFrame(t, "session_id int, speaker string, start_sec double, end_sec double, f0 double, embedding array<double>")).collect()
    assert [(r.session_id, r.low, r.high) for r in got] == [(1, [1.0, 0.0], [0.0, 1.0])]


def greedy(sizes):
    total = sum(sizes)
    lack = {p: Fraction(str(share)) * total for p, share in clustering.PARTS}
    out = {}
    for s in sorted(sizes, reverse=True):
        p = max(lack, key=lambda k: (lack[k], -[q for q, _ in clustering.PARTS].index(k)))
        lack[p] -= s
        out[s, p] = out.get((s, p), 0) + 1
    return out


def test_greedy_counts():
    rng = random.Random(8)
    for _ in range(400):
        sizes = [rng.choice([1, 1, 1, 2, 3, 7, 50]) for _ in range(rng.randint(1, 120))]
        plan = clustering.greedy_counts([(s, sizes.count(s)) for s in set(sizes)])
        assert {(s, p): z - a + 1 for s, p, a, z in plan} == greedy(sizes)
        assert sum(z - a + 1 for _, _, a, z in plan) == len(sizes)
    start = time.time()
    assert sum(z - a + 1 for _, _, a, z in clustering.greedy_counts([(1, 10**12), (5, 10**9)])) == 10**12 + 10**9
    assert time.time() - start < 1


def test_component_split(spark):
    rng = random.Random(5)
    members = [(f"c{k}", i) for k in range(90) for i in range(rng.choice([1, 1, 2, 5, 20]))]
    got = clustering.component_split(spark.createDataFrame(members, "c string, i int"), "c").collect()
    counts = {}
    for r in got:
        counts[r["size"], r.part] = counts.get((r["size"], r.part), 0) + 1
    assert len(got) == 90 and counts == greedy([sum(m[0] == c for m in members) for c in {m[0] for m in members}])


def test_stratified_groups(spark):
    rows = [(g, f"s{g % 3}" if g % 4 else None, i) for g in range(240) for i in range(1 + g % 3)] + [(None, "s0", 1)]
    df = spark.createDataFrame(rows, "g int, s string, i int")
    got = relations.group_split(df, "g", (0.8, 0.1, 0.1), stratum="s").collect()
    assert len(got) == len(rows) and len({(r.g, r.part) for r in got}) == 241
    strata = {g: s for g, s, _ in rows}
    for s in {"s0", "s1", "s2", None}:
        parts = [p for g, p in {(r.g, r.part) for r in got} if strata[g] == s]
        n = len(parts)
        assert [parts.count(p) for p in ("train", "val", "test")] == [int(n * 0.8 + 1e-9), int(n * 0.9 + 1e-9) - int(n * 0.8 + 1e-9), n - int(n * 0.9 + 1e-9)]
    assert df.select(F.lit(1)).count() == len(rows)


def test_nearest_edge(spark):
    from colloquy.operators import intervals

    rng = random.Random(3)
    spans = [(s, k, a := rng.randint(0, 60) / 2, a + rng.choice([0.5, 1, 4])) for s in range(3) for k in range(8)]
    points = [(s, i, rng.randint(-4, 90) / 2) for s in range(4) for i in range(40)]
    got = intervals.nearest_edge(spark.createDataFrame(points, "session_id int, i long, at double"), spark.createDataFrame([(s, k, float(a), float(b)) for s, k, a, b in spans], "session_id int, k int, r_start double, r_end double"), "i", "k")

    def nearest(s, t):
        own = [(k, a, b) for x, k, a, b in spans if x == s]
        held = [k for k, a, b in own if a <= t <= b]
        return held[0] if held else min(own, key=lambda x: (min(abs(t - x[1]), abs(t - x[2])), x[0]))[0] if own else None

    assert {(r.session_id, r.i): r.k for r in got.collect()} == {(s, i): nearest(s, t) for s, i, t in points}
