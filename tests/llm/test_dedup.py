"""Exact and near duplicates, substrings, components: brute force and awkward tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from ..conftest import DATA
from pyspark.sql import functions as F

from colloquy.llm import exact, graph, queries, simhash, substring

from .conftest import AWKWARD, table


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed,nodes,edges", [(1, 80, 60), (2, 300, 310), (3, 40, 0)])
def test_components(spark, seed, nodes, edges):
    r = random.Random(seed)
    pairs = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {x.node: x.root for x in graph.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    apart = [e for e in pairs if e[0] != e[1]]
    want = brute_components(apart, {n for e in apart for n in e})
    assert got == want


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("words,radius", [(1, 3), (4, 44)])
def test_bit_sliced_distances(words, radius):
    r = np.random.default_rng(words)
    fps = np.repeat(r.integers(0, 2**63, (1, words)).astype(np.uint64), 130, 0)
    for i in range(130):
        for b in r.choice(64 * words, int(r.integers(0, 2 * radius)), replace=False):
            fps[i, b // 64] ^= np.uint64(1) << np.uint64(int(b) % 64)
    plane = simhash.planes(fps[:128].reshape(2, 64, words))
    q, c = np.repeat(np.arange(130), 2), np.tile([0, 1], 130)
    left, near = simhash.within_radius(fps, q, plane, c, radius, [0] * words)
    got = np.zeros((130, 128), bool)
    for k, lanes in zip(left, near):
        got[q[k], 64 * c[k] : 64 * c[k] + 64] = [int(lanes) >> j & 1 for j in range(64)]
    apart = np.unpackbits(np.ascontiguousarray(fps[:, None] ^ fps[None, :128]).view(np.uint8), axis=2).sum(2)
    assert (got == (apart <= radius)).all()


def brute_near(rows):
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    pairs = [(rows[a][0], rows[b][0]) for n, a in enumerate(known) for b in known[:n] if bin(fps[a] ^ fps[b]).count("1") <= 3]
    root = brute_components(pairs, {rows[k][0] for k in known})
    return {(i, f"{fp:016x}", root.get(i)) for (i, _), fp in zip(rows, fps)}


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op1_simhash(spark, DATA).collect()} == brute_near(rows)


@pytest.mark.parametrize("spread,size", [(7, 400), (2, 900)])
def test_simhash_large_bucket(spark, monkeypatch, spread, size):
    """Both steps over large buckets together lose no link."""
    r = random.Random(4)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(40, 58), r.randint(0, spread))) for _ in range(size)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    monkeypatch.setattr(simhash, "CHUNK", 32)
    reps = spark.createDataFrame([(f, i, i) for i, f in enumerate(signed)], "f0 long, node long, root long")
    tables = simhash.Tables(simhash.saved(reps, "test"), simhash.MASKS, simhash.RADIUS)
    got = {x.node: x.root for x in simhash._components([tables], spark.createDataFrame([], "u long, v long")).collect()}
    assert tables.large.count() > 0
    flat = sorted(fps)
    pairs = [(a, b) for a in range(len(flat)) for b in range(a) if bin(flat[a] ^ flat[b]).count("1") <= 3]
    assert got == brute_components(pairs, {n for p in pairs for n in p})


def test_simhash_awkward(spark, awkward, nothing):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {tuple(r) for r in got} == {x if x[0] is not None else (None, x[1], None) for x in brute_near(AWKWARD)}
    assert simhash.near_duplicates(nothing).count() == 0


def test_keep_one_near(spark, nothing):
    r = random.Random(8)
    vocabulary = [f"word{i}" for i in range(500)]
    rows, groups = [], defaultdict(list)
    for g in range(12):
        text = [r.choice(vocabulary) for _ in range(220)]
        for _ in range(4):
            copy = list(text)
            for _ in range(2):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            groups[g].append(len(rows))
            rows.append((len(rows), " ".join(copy)))
    kept = {x.doc_id for x in simhash.keep_one(table(spark, rows)).collect()}
    assert kept == {min(g) for g in groups.values()}
    assert simhash.keep_one(nothing).count() == 0


def family(siblings, copies, seed):
    """Independent edits of one template (J = 0.74) and, of some of them, near copies (J = 0.82)."""
    r = random.Random(seed)
    template = [f"word{i}" for i in range(600)]

    def edited(ws, n):
        ws = list(ws)
        for k in r.sample(range(len(ws)), n):
            ws[k] = f"own{r.getrandbits(40)}"
        return ws

    texts = [edited(template, 9) for _ in range(siblings)]
    texts += [edited(t, 12) for t in texts[:copies]]
    r.shuffle(texts)
    return [(i, " ".join(ws)) for i, ws in enumerate(texts)]


def shingle_set(text):
    ws = text.split()
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}


def linked_by_similarity(rows):
    """(pairs that have to be linked, pairs of similarity 0.8 or more that no table brings together)."""
    sets, fps = [shingle_set(t) for _, t in rows], np.array([simhash.wide_fingerprint(t) for _, t in rows])
    short = [simhash.fingerprint(t) for _, t in rows]
    masks, pairs, missed = np.array(simhash.WIDE_MASKS, np.uint64), [], 0
    for a in range(len(rows)):
        apart = fps[a] ^ fps[:a]
        met = (np.bitwise_count(apart).sum(1) <= simhash.WIDE_RADIUS) & ~(apart[:, None] & masks).any(2).all(1)
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and same >= 0.8 * (len(sets[a]) + len(sets[b]) - same):
                ok = met[b] or max(len(sets[a]), len(sets[b])) <= simhash.SHORT
                missed += not ok
                if ok:
                    pairs.append((a, b))
            elif bin(short[a] ^ short[b]).count("1") <= 3:
                pairs.append((a, b))
    return pairs, missed


@pytest.mark.parametrize("chunk", [1024, 64])
def test_keep_one_family(spark, monkeypatch, chunk):
    """Near copies in a family of related texts: siblings that are closer by fingerprint take no one's place, nor do chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = family(300, 30, 6)
    pairs, missed = linked_by_similarity(rows)
    assert len(pairs) >= 28 and missed <= 2
    root = brute_components(pairs, range(len(rows)))
    kept = {x.doc_id for x in simhash.keep_one(table(spark, rows)).collect()}
    assert kept == set(root.values())


def test_keep_one_large_group(spark, monkeypatch):
    """One group of near copies with a third of all rows, dealt into many chunks, beside others in the same buckets."""
    monkeypatch.setattr(simhash, "CHUNK", 24)
    r = random.Random(5)
    base = [f"word{i}" for i in range(150)]
    rows = [" ".join(f"own{r.getrandbits(40)}" if r.random() < 0.01 else w for w in base) for _ in range(200)] + [t for _, t in family(180, 20, 9)]
    rows += [" ".join(r.choice("abcdefg") * 3 for _ in range(60)) for _ in range(200)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    pairs, missed = linked_by_similarity(rows)
    assert missed <= 0.02 * len(pairs)
    kept = {x.doc_id for x in simhash.keep_one(table(spark, rows)).collect()}
    assert kept == set(brute_components(pairs, range(len(rows))).values())


def test_keep_one_short_texts(spark):
    r = random.Random(12)
    rows = []
    for _ in range(60):
        ws = [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(4, 40))]
        for _ in range(3):
            ws = list(ws)
            ws[-1 if r.random() < 0.7 else r.randrange(len(ws))] += "x"
            rows.append(" ".join(ws))
    rows = list(enumerate(rows))
    pairs, missed = linked_by_similarity(rows)
    assert missed == 0 and len(pairs) > 40
    kept = {x.doc_id for x in simhash.keep_one(table(spark, rows)).collect()}
    assert kept == set(brute_components(pairs, range(len(rows))).values())


def test_keep_one_awkward(spark, awkward):
    """Rows that share a doc_id are apart if their texts are; of linked ones the smallest doc_id stays."""
    a = " ".join(f"alpha{i}" for i in range(60))
    got = {(x.doc_id, x.text) for x in simhash.keep_one(table(spark, [(5, a + " end"), (11, a), (11, "something else altogether, of its own")])).collect()}
    assert got == {(5, a + " end"), (11, "something else altogether, of its own")}
    kept = sorted(((x.doc_id or 0), x.text or "") for x in simhash.keep_one(awkward).collect())
    want = [(i or 0, t or "") for i, t in AWKWARD if i not in (2, 4, 5, 9)]
    assert kept == sorted(want) and simhash.keep_one(awkward).columns == awkward.columns


def test_key_set(spark, monkeypatch):
    from colloquy.llm import common

    r = np.random.default_rng(5)
    ids = np.r_[r.integers(-(2**63), 2**63 - 1, 500), np.arange(500)]
    assert [x.h for x in spark.createDataFrame([(int(i),) for i in ids], "i long").select(F.xxhash64("i").alias("h")).collect()] == common.spark_hash(ids).tolist()
    texts = [f"text {i} é" for i in range(50)] + [""]
    assert [x.h & (2**64 - 1) for x in spark.createDataFrame([(t,) for t in texts], "t string").select(common.text_key("t").alias("h")).collect()] == [common.text_key_of(t.encode()) for t in texts]
    monkeypatch.setattr(common, "KEYS_IN_FILE", 40)
    keys = r.integers(-(2**63), 2**63 - 1, len(ids))
    members = common.KeySet(spark.createDataFrame([(int(i), int(k)) for i, k in zip(ids[::2], keys[::2])], "doc_id long, key long"), "test")
    assert members.parts > 10 and list(members.find(ids, keys)) == [k % 2 == 0 for k in range(len(ids))]
    assert not members.find(ids, keys + 1).any() and not common.KeySet(spark.createDataFrame([], "doc_id long, key long"), "test").find(ids, keys).any()


def test_keys_of_equal_hash(spark, monkeypatch):
    """Any number of members may share a hash."""
    from colloquy.llm import common

    monkeypatch.setattr(common, "_pair_hash", lambda ids, keys: np.full(len(ids), 7, np.uint64))
    ids = np.arange(9, dtype=np.int64)
    known = common.KeySet.__new__(common.KeySet)
    known.parts, known.there, known.files = 1, frozenset([0]), {0: np.array([[7] * 6, [0, 2, 4, 6, 8, 8], [1, 1, 1, 1, 1, 3]], "<u8")}
    assert list(known.find(ids, np.ones(9, np.int64))) == [True, False, True, False, True, False, True, False, True]
    assert not known.find(ids, np.full(9, 2, np.int64)).any() and known.find(ids, np.full(9, 3, np.int64)).sum() == 1


def test_minimal_perfect_hash():
    r = np.random.default_rng(0)
    digests = r.integers(0, 256, (5000, 32)).astype(np.uint8)
    digests[1, :8] = digests[0, :8]  # equal keys, different digests
    levels, slot = exact.build_hash(digests)
    assert sorted(slot) == list(range(5000))
    shard = exact.Shard(exact.pack_shard(digests, np.arange(5000), np.arange(5000) * 2))
    at = shard.find(digests)
    assert (shard.winners[at] == np.arange(5000)).all() and (shard.copies[at] == 2 * np.arange(5000)).all()
    strange = digests.copy()
    strange[:, 31] ^= 1
    assert (shard.find(strange) == -1).all()


def test_exact_awkward(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(exact, "SHARD", 4)
    monkeypatch.setattr(exact, "DEALT", 3)
    groups = defaultdict(list)
    for i, t in AWKWARD:
        groups[t or ""].append(i)
    keep = lambda ids: max((i for i in ids if i is not None), default=-(2**63))
    want = sorted((i if i is not None else -1, keep(groups[t or ""]), len(groups[t or ""]), i is not None and i == keep(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in AWKWARD)
    got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in exact.exact_duplicates(awkward).collect())
    assert got == want
    assert exact.exact_duplicates(nothing).count() == 0
    kept = sorted((r.doc_id or 0, r.text or "") for r in exact.keep_one(awkward).collect())
    unique = {t or "": keep([i for i in ids if i is not None] or [None]) for t, ids in groups.items() if any(i is not None for i in ids)}
    assert kept == sorted([(i, t) for t, i in unique.items()] + [(0, "a row without an id")])
    assert exact.keep_one(awkward).columns == awkward.columns


def test_exact_both_branches(spark, monkeypatch):
    """Members and nonmembers of the table's own first half, with hot groups in either."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "DEALT", 50)
    r = random.Random(3)
    texts = [r.choice(["hot one", "hot two", *(f"text {k}" for k in range(200))]) if r.random() < 0.7 else "hot one" for _ in range(900)]
    docs = table(spark, list(enumerate(texts)))
    keep, size = {t: i for i, t in enumerate(texts)}, defaultdict(int)
    for t in texts:
        size[t] += 1
    want = {(i, keep[t], size[t], keep[t] == i) for i, t in enumerate(texts)}
    for old in (exact.historic, lambda: F.col("doc_id") < 40, lambda: F.lit(False), lambda: F.lit(True)):
        monkeypatch.setattr(exact, "historic", old)
        assert {tuple(x)[:4] for x in exact.exact_duplicates(docs).collect()} == want


def test_exact_with_history(spark):
    history, new = table(spark, [(1, "a"), (2, "a"), (3, "b")]), table(spark, [(10, "a"), (11, "c"), (12, "c"), (13, "d")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(new, history).collect()}
    assert got == {10: (2, 2, False), 11: (12, 2, False), 12: (12, 2, True), 13: (13, 1, True)}


def brute_substring(rows):
    first = {}
    for i, t in rows:
        ws = (t or "").encode().split()
        for k in range(len(ws) - 12):
            g = tuple(ws[k : k + 13])
            first[g] = min(first.get(g, 1 << 62), -(2**63) if i is None else i)
    out = []
    for i, t in rows:
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for k in range(len(ws) - 12):
            if first[tuple(ws[k : k + 13])] < (-(2**63) if i is None else i):
                gone[k : k + 13] = [True] * 13
        out.append((i or 0, len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone) if not g)).hexdigest()))
    return sorted(out)


def test_ranks_by_doubling():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 13, 16):
        ids = r.integers(0, 3, 400)
        rank = substring.ranked(ids, n)
        seen = {}
        for k in range(len(ids) - n + 1):
            assert seen.setdefault(tuple(ids[k : k + n]), rank[k]) == rank[k]
        assert len(set(seen.values())) == len(seen)


def test_equal_keys_do_not_cover():
    """Pieces that share a key by chance are told apart by their words."""
    a, b = (" ".join(f"{x}{i}" for i in range(14)).encode() for x in "ab")
    rows = pd.DataFrame({"key": [5, 5, 5, 9], "doc_id": [1, 2, 3, 4], "text_key": [0, 0, 0, 0], "pos": [0, 7, 3, 0], "run": 0, "line": [a, b, b"x " + a, a]})
    assert substring._subtree(rows).values.tolist() == [[3, 0, 4, 2]]


def test_substring_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op9_substring(spark, DATA).collect()) == brute_substring(rows)


@pytest.mark.parametrize("hot", [10_000, 1])
def test_substring_awkward(spark, awkward, nothing, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "PIECES", 50)
    assert sorted((r[0] or 0, *r[1:]) for r in substring.repeats(awkward).collect()) == brute_substring(AWKWARD)
    r = random.Random(2)
    passage = [r.choice("abcd") for _ in range(40)]
    rows = [(i, " ".join([r.choice("abcdefgh") for _ in range(r.randint(0, 50))] + passage[r.randint(0, 9) : r.randint(20, 40)] + [r.choice("ab") for _ in range(r.randint(0, 60))])) for i in range(60)]
    assert sorted(tuple(x) for x in substring.repeats(table(spark, rows).repartition(7)).collect()) == brute_substring(rows)
    assert substring.repeats(nothing).count() == 0
    texts = {x.doc_id: x.text for x in substring.without_repeats(table(spark, rows)).collect()}
    assert hashlib.sha256(texts[59].encode()).hexdigest() == dict((x[0], x[3]) for x in brute_substring(rows))[59]
