"""Personal data, conversation repair and runs against independent versions."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from colloquy.llm import crf, periodic, turns

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def right(kind, found):
    digits = [int(c) for c in re.sub("[^0-9]", "", found)]
    doubled = [d if k % 2 == 0 else (2 * d) % 10 + (2 * d) // 10 for k, d in enumerate(digits[::-1])]
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
        "card": lambda: len(digits) in range(16, 20) and sum(doubled) % 10 == 0,
        "phone": lambda: len(digits) in range(8, 16),
    }[kind]()


def base(text):
    return [(k, *m.span()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if right(kind, m[0])]


@pytest.fixture(scope="module")
def field():
    return crf.fit(crf.composed())


def test_base_spans_by_brute_force():
    rng = random.Random(3)
    parts = ["a.b", "@", "x-y", ".", "1", "23", "255", "256", " ", "-", "+", "(", ")", "4111111111111111", "+1 (555) 123-4567", "é", "\n", "00"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert crf.base_spans(text) == base(text), text
    assert crf.base_spans("1" * 60_000) == [] and len(crf.base_spans("a" * 60_000 + "@b.c")) == 1


def test_field_by_held_out_rows(field):
    rows = crf.composed(300, seed=99)
    found = [t for t, _ in rows]
    known = [crf.base_spans(t) for t in found]
    added = crf.added_spans(found, field, known)
    gold = [set(s) for _, s in rows]
    got = [set(b) | set(a) for b, a in zip(known, added)]
    hits = sum(len(g & x) for g, x in zip(gold, got))
    assert hits >= 0.95 * sum(map(len, gold))
    assert sum(len(set(a) - g) for g, a in zip(gold, added)) <= 0.02 * hits
    assert sum(map(len, added)) > 100


def test_viterbi_by_brute_force(field):
    text = "mail jo (at) ka (dot) org"
    s = crf.Stretch(text, 0, len(text))
    [e] = field.rows([s.features()])
    e = e[:5]

    def value(path):
        if not crf.FIRST[path[0]] or not all(crf.ALLOWED[a, b] for a, b in zip(path, path[1:])):
            return -1e9
        return sum(e[k, y] for k, y in enumerate(path)) + sum(field.t[a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product(range(crf.LABELS), repeat=5), key=value)
    longer = crf.Stretch("x 10[.]1[.]2[.]3 y and 4 more 555 words 12", 0, 40)
    assert tuple(field.decode([field.rows([longer.features()])[0], e])[1]) == best


def test_gradient_by_differences():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(4)
    data = [([[0, 1], [2], [1, 3]], np.array([1, 2, 0])), ([[3], [0]], np.array([0, 3]))]
    w, t = rng.normal(size=(5, crf.LABELS)), rng.normal(size=(crf.LABELS, crf.LABELS))
    w[-1] = 0

    def loss(w, t):
        total = 0.0
        for x, y in data:
            paths = [p for p in itertools.product(range(crf.LABELS), repeat=len(y)) if crf.FIRST[p[0]] and all(crf.ALLOWED[a, b] for a, b in zip(p, p[1:]))]
            score = lambda p: sum(w[f].sum(0)[b] for f, b in zip(x, p)) + sum(t[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            total += np.log(sum(np.exp(score(p)) for p in paths)) - score(tuple(y))
        return total / len(data)

    gw, gt = crf._gradient(data, w, t)
    for m, g, at in ((w, gw, (0, 1)), (w, gw, (3, 0)), (t, gt, (1, 2)), (t, gt, (0, 3))):
        m[at] += 1e-5
        high = loss(w, t)
        m[at] -= 2e-5
        low = loss(w, t)
        m[at] += 1e-5
        assert abs((high - low) / 2e-5 - g[at]) < 1e-6


def test_personal_data_query(spark, sf, awkward, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = crf.labelled_table(spark)
    got = {r.doc_id: r for r in crf.personal_data_digests(docs, labelled).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        own = [f"{PATTERNS[k][0]}:{a}:{b}" for k, a, b in base(r.text or "")]
        spans = got[r.doc_id].spans.split(",") if got[r.doc_id].spans else []
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert set(own) <= set(spans) and len(set(spans)) == len(spans)
        assert [got[r.doc_id][f"n_{k}"] for k, _ in PATTERNS] == [sum(s.startswith(k) for s in spans) for k, _ in PATTERNS]
    rows = crf.personal_data_digests(awkward, labelled).collect()
    assert len(rows) == awkward.count() and {r.spans for r in rows} == {""}
    assert crf.personal_data_digests(nothing, labelled).count() == 0
    [r] = crf.personal_data(spark.createDataFrame([(1, "Write to jo (at) kami (dot) org or +1 (555) 123-4567 now")], "doc_id long, text string"), crf.train(labelled)).collect()
    assert [(s.kind, s.text) for s in r.spans] == [("email", "jo (at) kami (dot) org"), ("phone", "+1 (555) 123-4567")]


# ---- conversations ----


def solve(rows):
    """Least (cost, audit, lines) over all edits; rows: (role, text)."""
    judged, seen = [], set()
    for role, text in rows:
        fault = "blank" if not text.strip(" \t\n\v\f\r") else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(" \t\n\v\f\r")[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    fits = re.compile("(s?(ua)+)?")
    prefixes = re.compile("(s?(ua)*u?)?")
    best = []

    def walk(k, initials, cost, audit, lines):
        if best and cost > best[0][0] or not prefixes.fullmatch(initials):
            return
        if k == len(judged) and fits.fullmatch(initials):
            best[:] = [min([*best, (cost, audit, lines)])]
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                walk(k, initials + role[0], cost + 5, audit + "I", (*lines, f"{role}:"))
        if k < len(judged):
            role, text, fault = judged[k]
            walk(k + 1, initials, cost + 2, audit + "D", lines)
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if role:
                    walk(k + 1, initials + role[0], cost + more, audit + "K", (*lines, f"{role}:{text}"))
                for new in ("user", "assistant"):
                    walk(k + 1, initials + new[0], cost + more + 1, audit + "R", (*lines, f"{new}:{text}"))

    walk(0, "", 0, "", ())
    return (*best[0], judged)


def expected(conv_id, rows):
    """rows: (turn, role, text) before damage."""
    spaced = lambda x: " " if x is None else x
    after = []
    for turn, role, text in rows:
        role, text, k = spaced(role), spaced(text), zlib.crc32(f"{spaced(conv_id)}:{spaced(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        after += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    if not after:
        return (conv_id, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    cost, audit, lines, judged = solve([r[1:] for r in after])
    at = [r[0] for r in after if r[0] is not None]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    faults = [sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    return (conv_id, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(n, seed):
    rng, rows = random.Random(seed), []
    for c in [*range(n), None]:
        for _ in range(rng.randint(1, 6)):
            turn = rng.choice([*range(7), None])
            rows.append((c, turn, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "cut off", " \n", "", None, "Ünïcode? \t", "Well. And"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("long", [1000, 2])
def test_repair_by_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(turns, "LONG", long)
    monkeypatch.setattr(turns, "SEGMENT", 2)
    rows = made(150, 5)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as key", "1 as seg", "2 as n", "3 as copies")
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r[1:])
    got = {r.conv_id: tuple(r) for r in turns.damaged_report(frame).collect()}
    assert got == {c: expected(c, own) for c, own in want.items()}


def test_repair_whole_turns(spark, monkeypatch):
    rows = [(1, k, ("user", "assistant")[k % 2], f"Sentence {k}.") for k in range(4000)] + [(2, 0, "assistant", "Hello."), (2, 1, "user", "Hello.")]
    rows[17] = (1, 17, "user", "An interruption.")
    frame = turns.plain(spark.createDataFrame(rows, SCHEMA))
    monkeypatch.setattr(turns, "LONG", 100)
    whole = [(r.role, r.text, r.edit) for r in turns.repair(frame).where("conv_id = 1").orderBy("place").collect()]
    assert len(whole) == 4000 and [w for w in whole if w[2] != "K"] == [("assistant", "An interruption.", "R")]
    got = {r.conv_id: r for r in turns.report(frame).collect()}
    assert got[1].cost == 1 and got[1].illegal == 2 and got[1].audit == "K" * 17 + "R" + "K" * 3982
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in whole).encode()).hexdigest()
    assert got[2].audit == "RR" or got[2].cost == 2


def test_repair_awkward(spark):
    assert turns.damaged_report(spark.createDataFrame([], SCHEMA)).count() == 0
    copies = spark.createDataFrame([(7, 0, "user", "Same.")] * 3000 + [(7, 1, "assistant", "x" * 300_000 + ".")], SCHEMA)
    [r] = turns.report(turns.plain(copies)).collect()
    assert r.duplicate == 2999 and r.audit == "K" + "D" * 2999 + "K" and r.cost == 5998 and r.illegal == 2999


def test_repair_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = sorted(tuple(r) for r in turns.damaged_report(spark.read.parquet(f"{sf}/conversations.parquet")).collect())
    assert got == sorted(db.execute(turns.SQL).fetchall())


# ---- runs ----


def all_runs(w, least=4, shortest=6):
    out = set()
    for p in range(1, len(w) // least + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i + p - s
            if i > s and n >= max(shortest, least * p) and all(any(w[s + k] != w[s + k + q] for k in range(n - q)) for q in range(1, p)):
                out.add((s, n, p))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    rng = random.Random(2)
    for _ in range(6000):
        n, letters = rng.randint(0, 70), rng.choice(["a", "ab", "ab", "abc"])
        w = [rng.choice(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            if rng.random() < 0.3:
                w[rng.randrange(n)] = "b"
        least = rng.choice([3, 4])
        assert periodic.runs(w, least) == all_runs(w, least), w


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_in_linear_time():
    rng = random.Random(1)
    for w in (
        ["a"] * 30_000, fibonacci(30_000), ["a", "b"] * 15_000, (["a"] * 20 + ["b"]) * 1400, [rng.choice("ab") for _ in range(30_000)],
        sum((["a"] * k + ["b"] for k in range(1, 240)), []), sum((["a"] * k + ["b"] for k in range(240, 0, -1)), []), fibonacci(300) * 100,
    ):
        for turned in (False, True):
            counter = [0]
            periodic.edges(w, turned, counter=counter)
            assert counter[0] <= 2.1 * len(w)


def looped(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark, sf, awkward, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in periodic.looped_runs(docs).collect()}
    assert len(got) == docs.count()
    some = 0
    for r in docs.collect():
        w = looped([x for x in re.split(r"[\x20\x09-\x0D]+", r.text or "") if x], r.doc_id)
        g = got[r.doc_id]
        if len(w) > 3000:
            continue  # the quadratic version
        found = all_runs(w)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert g.n_runs == len(found) and g.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert (g.start, g.length, g.period, g.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert g.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        some += bool(found)
    assert some > 5
    rows = periodic.looped_runs(awkward).collect()
    assert len(rows) == awkward.count() and all(r.runs_sha256 and r.collapsed_sha256 for r in rows)
    assert periodic.looped_runs(nothing).count() == 0
    [r] = periodic.find_runs(spark.createDataFrame([(1, "so " + "ha ho " * 5 + "end")], "doc_id long, text string")).collect()
    assert r.collapsed == "so ha ho end" and [tuple(x) for x in r.runs] == [(1, 10, 2)]


def test_whole_texts_are_decoded(field):
    """Spans of whole texts are those of plain Viterbi over all tokens, also far from digits, at signs and words for dots."""
    rng = random.Random(11)
    odd = ["m² ² ① ٣٤٥ 5", "| _|_ || a|b 10[.]1[.]2[.]3", "", " \n", "+1 (555) 123-4567 at", "jo (at) kami.org", "word " * 200 + "write jo (at) kami.org soon" + " word" * 200]
    texts = odd + [" ".join(crf._word(rng) for _ in range(rng.randint(0, 60))) + " " + t for t, _ in crf.composed(80, seed=5)]
    some = 0
    for text in texts:
        s = crf.Stretch(text, 0, len(text))
        starts, ends, e = field.tables().scores(text)
        assert list(zip(starts.tolist(), ends.tolist())) == s.spans
        if not s.words:
            continue
        [whole] = field.rows([s.features()])
        assert np.allclose(e, whole)
        [want] = field.decode([whole])
        got = np.zeros(len(want), int)
        parts = list(field.tables().parts(e))
        for (first, own), path in zip(parts, field.decode([p[1] for p in parts])):
            got[first : first + len(own)] = np.where(path > 0, path, got[first : first + len(own)])
        assert got.tolist() == want.tolist(), text
        some += bool(got.any())
    assert some > 40
    far = odd[-1]
    assert [far[a:b] for _, a, b in crf.added_spans([far], field, [[]])[0]] == ["jo (at) kami.org"]
