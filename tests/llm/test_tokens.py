"""Packing, token files, fingerprints, language-model scores."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from ..conftest import DATA
from tokenizers import Tokenizer

from colloquy.llm import bitpack, multihash, ngrams, packing, queries
from colloquy.llm.tokens import Encoder, default_path

from .conftest import AWKWARD, table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def ids_of(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_encoder_equals_tokenizer(tokenizer):
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "　", "a", "Don't", "'s", "'ll", "é", "1", "²", "½", "23", "!!", "<|endoftext|>", "日本", "​", "😀", "x" * 70, "\r\n", "_", "ß", "Ж", "\xad", "\xa0", "̈"]
    encoder = Encoder(default_path())
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert encoder.ids(text) == ids_of(tokenizer, text, 0)[:-1].tobytes(), repr(text)


def check_packing(rows, got, tokenizer, length=2048):
    ids = [ids_of(tokenizer, t, 0) for _, t in rows]
    by_bin = collections.defaultdict(list)
    for r in got:
        by_bin[r.sequence_id].append(r)
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    want = collections.Counter()
    for (i, _), x in zip(rows, ids):
        cuts = [0, *range(len(x) % length or length, len(x), length), len(x)] if len(x) > length else [0, len(x)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(by_bin), sum(map(len, ids)) / length


def test_plain_texts_by_words(tokenizer):
    """Plain texts are split as the tokenizer splits them, and a word is encoded once whatever stands beside it."""
    encoder, rng = Encoder(default_path()), random.Random(3)
    letters = [chr(k) for k in range(0x500)]
    for k in range(3000):
        text = "".join(rng.choice(letters if rng.random() < 0.3 else "ab '\t\n st1é  .-_\x1c\x85\xa0") for _ in range(rng.randrange(20))) + ("가" if k % 9 == 0 else "")
        assert encoder.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert k % 9 == 0 or encoder.plain(text) == encoder.split(text)
    encoder.forget()
    encoder.ids(" ".join(f"{a}word{b}" for a in "([{<" for b in ".,;:!?)]}>"))
    assert len(encoder.cache) < 30


def test_packing_query(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    bins, least = check_packing(rows, queries.op7_packing(spark, DATA).collect(), tokenizer)
    assert bins <= least * 1.02 + 1


def test_packing_awkward(spark, awkward, nothing, tokenizer):
    check_packing(AWKWARD, packing.pack(awkward).collect(), tokenizer)
    assert packing.pack(nothing).count() == 0


def plain_best_fit(counts, length):
    """Longest first, each to the fullest bin that takes it."""
    free = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(length - n)
    return len(free)


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"max_docs": 5}, {"max_cost": 300_000, "max_docs": 9}])
def test_plan_keeps_every_capacity(score, limits):
    r = random.Random(7)
    counts = {n: r.randint(1, 40) for n in r.sample(range(1, 513), 120)}
    runs = packing.plan(counts, 512, score=score, **limits)
    bins = collections.defaultdict(list)
    seen = collections.Counter()
    for q in runs.itertuples():
        for k in range(q.n):
            bins[q.bin + k].append((q.offset, q.length))
        seen[q.length] += q.n
    assert seen == counts
    for members in bins.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 512 and len(members) <= limits.get("max_docs", 512) and sum(n * n for _, n in members) <= limits.get("max_cost", 512 * 512)
    if not limits and score == "norm":
        assert len(bins) == plain_best_fit(counts, 512)
    firsts = runs.sort_values(["length", "first"])
    for _, g in firsts.groupby("length"):
        assert list(g["first"]) == [0, *g.n.cumsum()[:-1]]


def test_ranked_places_for_plan_of_many():
    runs = packing.plan({n: 10**9 // n for n in range(1, 257)}, 256)
    assert len(runs) < 60_000 and (runs["bin"] + runs.n).max() <= 1.001 * sum(n * (10**9 // n) for n in range(1, 257)) / 256


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 12, 16, 17, 25, 32])
def test_bits(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    packed = np.frombuffer(bitpack.pack_ids(x, bits), np.uint8)
    assert len(packed) == -(-1003 // 8) * bits
    assert (bitpack.unpack_ids(packed, bits, 1003) == x).all()


def test_file_random_access(tmp_path):
    r = np.random.default_rng(3)
    docs = [r.integers(0, 50257, int(n)).astype("<u4") for n in [0, 5, 70_000, 1, 140_000, 3]]
    w = bitpack.Writer(f"file://{tmp_path}/x.ids", bitpack.bits_for(50257))
    for i, x in enumerate(docs):
        w.add(i, x.tobytes())
    w.close()
    f, flat = bitpack.Reader(f"file://{tmp_path}/x.ids"), np.concatenate(docs)
    assert f.bits == 16 and f.n == len(flat) and list(f.starts) == [0, *np.cumsum([len(x) for x in docs])]
    for _ in range(60):
        a = int(r.integers(0, len(flat)))
        n = int(r.integers(0, len(flat) - a + 1))
        assert (f.ids(a, n) == flat[a : a + n]).all()


def brute_files(rows, tokenizer):
    out, at = [], 0
    signed = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (h >> 63 << 64)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        x = ids_of(tokenizer, t, 2)
        out.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    return out


def test_bitpack_query(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op8_bitpack(spark, DATA).collect()) == brute_files(rows, tokenizer)


def test_bitpack_awkward(spark, awkward, nothing, tokenizer):
    got = sorted((tuple(r) for r in bitpack.round_trip(awkward).collect()), key=lambda r: r[1])
    assert got == brute_files(AWKWARD, tokenizer)
    assert bitpack.round_trip(nothing).count() == 0


def test_multihash_is_homomorphic():
    m = multihash.Multihash
    a, b = "first line of it\nsecond line here\nthird", "third\nfirst line of it\nsecond line here"
    assert m.of(a).hex() == m.of(b).hex() != m.of(a + "\n").hex()
    assert m.of("x y z w").change(["one more line"], 1).hex() == m.of("one more line\nx y z w").hex()
    assert m.of("one more line\nx y z w").change(["one more line"], -1).hex() == m.of("x y z w").hex()
    assert m.of("").likeness(m.of("")) == 1.0 and m.of("").likeness(m.of("some words here now")) == 0.0
    assert m.of("a b c d").likeness(m.of("a b c d")) == 1.0


def plain_multihash(text):
    """(hex, sketch) from whole numbers, lane by lane."""
    digest, sketch = [0] * 16, [0] * 128
    for line in text.split("\n"):
        raw = line.encode()
        shake = hashlib.shake_128(raw).digest(128)
        for k in range(16):
            digest[k] = (digest[k] + int.from_bytes(shake[8 * k : 8 * k + 8], "little")) % 2**64
        ws = raw.split()
        for g in [ws[k : k + 3] for k in range(len(ws) - 2)] or ([ws] if ws else []):
            h = xxhash.xxh64_intdigest(b" ".join(g))
            sketch[h % 128] += 1 if h >> 32 & 1 else -1
    raw = b"".join(x.to_bytes(8, "little") for x in digest) + b"".join((x % 2**32).to_bytes(4, "little") for x in sketch)
    return raw.hex(), sketch


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    norm = math.sqrt(dot(a[1], a[1]) * dot(b[1], b[1]))
    return min(1.0, max(0.0, dot(a[1], b[1]) / norm)) if norm else 0.0


def brute_multihash(rows):
    out = {}
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        e = t[: len(t) - k] + following[:k]
        a, b, c = map(plain_multihash, (t, e, following))
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), a[0], b[0], pytest.approx(plain_likeness(a, b)), pytest.approx(plain_likeness(a, c)))
    return out


def test_multihash_of_many_equal_shingles():
    long = "a b c " * 65536
    assert multihash.Multihash.of(long).likeness(multihash.Multihash.of(long + "d")) > 0.99


@pytest.mark.parametrize("part", [2000, 7])
def test_multihash_query(spark, monkeypatch, part):
    monkeypatch.setattr(multihash, "PART", part)
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = queries.op10_multihash(spark, DATA).collect()
    want = brute_multihash(rows)
    assert len(got) == len(rows) and all(tuple(r[1:]) == want[r[0]] for r in got)
    near = [r.near_edited > r.near_next for r in got if r.n_chars > 40]
    assert sum(near) >= 0.97 * len(near)


def test_multihash_awkward(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(multihash, "PART", 2)
    got = multihash.fingerprints(awkward).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in AWKWARD)
    assert multihash.fingerprints(nothing).count() == 0
    alone = multihash.fingerprints(table(spark, [(4, "only one here")])).first()
    assert alone.near_next == 1.0


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 5), (1000, 10**3), (5000, 10**12), (30000, 2**60), (10, 0)):
        v = np.sort(r.integers(0, top + 1, n)).astype(np.uint64)
        about, parts = ngrams.EliasFano.encode(v, top)
        e = ngrams.EliasFano(about["n"], about["l"], *(np.frombuffer(x, np.uint8) for x in parts))
        assert (e.access(np.arange(n)) == v).all()
        q = np.concatenate([v[r.integers(0, n, 300)], r.integers(0, top + 1, 300).astype(np.uint64)])
        at = e.find(q, np.zeros(len(q), np.int64), np.full(len(q), n))
        assert ((at >= 0) == np.isin(q, v)).all() and (v[at[at >= 0]] == q[at >= 0]).all()


def brute_scores(rows):
    ws = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = [collections.Counter() for _ in range(3)]
    for w, h in zip(ws, held):
        if not h:
            c[0].update(w)
            c[1].update(zip(w, w[1:]))
            c[2].update(zip(w, w[1:], w[2:]))
    total, kinds = sum(c[0].values()), len(c[0])
    kept = [{g: n for g, n in x.items() if n > 1} for x in c[1:]]
    first = [collections.defaultdict(float), collections.defaultdict(float)]
    for (a, b), n in kept[0].items():
        first[0][a] += (n - ngrams.DISCOUNT) / (c[0][a] + ngrams.MASS)
    for (a, b, d), n in kept[1].items():
        first[1][a, b] += (n - ngrams.DISCOUNT) / (c[1][a, b] + ngrams.MASS)
    out = []
    for w, h in zip(ws, held):
        base = score = 0.0
        for k, x in enumerate(w):
            p = (c[0][x] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            if k and c[0][w[k - 1]]:
                u = w[k - 1]
                p = ((kept[0][u, x] - ngrams.DISCOUNT) / (c[0][u] + ngrams.MASS) if (u, x) in kept[0] else 0) + (1 - first[0][u]) * p
                if k > 1 and (w[k - 2], u) in kept[0]:
                    g = (w[k - 2], u)
                    p = ((kept[1][*g, x] - ngrams.DISCOUNT) / (c[1][g] + ngrams.MASS) if (*g, x) in kept[1] else 0) + (1 - first[1][g]) * p
            score += math.log10(p)
        out.append((h, len(w), sum(c[0][x] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize("size", [1 << 18, 300])
def test_ngram_query(spark, monkeypatch, size):
    monkeypatch.setattr(ngrams, "FILE", size)
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = sorted(tuple(r) for r in queries.op3_ngrams(spark, DATA).collect())
    for (i, _), g, w in zip(rows, got, brute_scores(rows), strict=True):
        assert g[:5] == (i, *w[:4])
        assert g[5] == pytest.approx(w[4], abs=1e-6) and g[6] == pytest.approx(w[5], abs=3e-4 * w[1])
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_ngrams_frequent_context(spark):
    """Behind a very frequent word with one continuation, what is left for all others is small but right."""
    rows = [(0, "a b " * 20_000), (2, "a c"), (3, "c a d"), (7, "x y z")]
    got = {r.doc_id: r.score for r in ngrams.lm_scores(table(spark, rows)).collect()}
    for (i, _), w in zip(rows, brute_scores(rows)):
        assert got[i] == pytest.approx(w[5], abs=3e-4 * w[1]), i


def test_ngrams_awkward(spark, awkward, nothing):
    got = collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in ngrams.lm_scores(awkward).collect())
    assert got == collections.Counter((i, w[1], w[2], round(w[4], 4)) for (i, _), w in zip(AWKWARD, brute_scores(AWKWARD)))
    assert ngrams.lm_scores(nothing).count() == 0
