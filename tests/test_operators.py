"""Worked cases and brute force for operators without SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import numbers as N
from colloquy.functions import pii as P
from colloquy.functions import texts as X
from colloquy.operators import graph, intervals, memory, relations, repetition, sequences
from colloquy.plans import segmentation


def one(spark, expr, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("r")).first().r


def mapped(spark, turns, word):
    t = spark.createDataFrame([(1, i, s, float(a), float(b)) for i, (s, a, b) in enumerate(turns)], "session_id long, turn_idx int, speaker string, start_sec double, end_sec double")
    w = spark.createDataFrame([(1, 0, float(word[0]), float(word[1]))], "session_id long, word_idx int, start_sec double, end_sec double")
    r = intervals.map_speakers(w, t).first()
    return r.mapped_speaker, r.speaker_source


def test_map_speakers_cases(spark):
    a = [("A", 0, 5)]
    assert mapped(spark, a, (1, 2)) == ("A", "exact")
    assert mapped(spark, [("A", 0, 5), ("B", 2, 7)], (3, 4)) == (None, "overlap_A_B")
    who, how = mapped(spark, a, (5.05, 5.15))
    assert who == "A" and how.startswith("tolerance_")
    who, how = mapped(spark, a, (5.2, 5.3))
    assert who == "A" and how.startswith("backchannel_")
    assert mapped(spark, a, (4.75, 5.75)) == (None, "ambiguous")


def regions(spark, turns):
    t = spark.createDataFrame([(1, i, s, float(a), float(b)) for i, (s, a, b) in enumerate(turns)], "session_id long, turn_idx int, speaker string, start_sec double, end_sec double")
    return [(r.start_sec, r.end_sec) for r in intervals.overlap_regions(t).collect()]


def test_overlap_regions_cases(spark):
    assert regions(spark, [("A", 0, 3), ("B", 2, 5)]) == [(2.0, 3.0)]
    assert regions(spark, [("A", 0, 3), ("A", 2, 5)]) == []
    assert regions(spark, [("A", 0, 2.1), ("B", 2, 4)]) == []


def test_overlap_join_meets_each_pair_once(spark):
    r = random.Random(3)
    span = lambda: (a := r.uniform(-20, 50), a + r.choice([0, 0.1, 3, 30]))
    left, right = [(1, i, *span()) for i in range(60)], [(1, i, *span()) for i in range(60)]
    l = spark.createDataFrame(left, "session_id long, a int, start_sec double, end_sec double")
    q = spark.createDataFrame(right, "session_id long, b int, r_start double, r_end double")
    on = (F.col("start_sec") <= F.col("r_end")) & (F.col("end_sec") >= F.col("r_start"))
    got = sorted((x.a, x.b) for x in intervals.overlap_join(l, q, ["session_id"], on).collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[2] <= y[3] and x[3] >= y[2])


def test_repetition(spark):
    c = repetition.collapse
    assert c("하는지 하는지 하는지 하는지") == ("하는지", 3) and c("맞아 맞아 맞아 그래") == ("맞아 그래", 2)
    assert c("네 네 네 네") == ("네 네 네 네", 0) and c("아 아 아 아 아") == ("아 아 아 아 아", 0) and c("진짜 진짜") == ("진짜 진짜", 0)
    assert c("그 다음 그 다음 그 다음 끝") == ("그 다음 끝", 2) and c("") == ("", 0)
    assert c("가나 " * 6) == ("가나 가나", 2)  # as a pair, three times
    assert c("x 그 다음 그 다음 그 다음 다음 다음 다음") == ("x 그 다음 다음", 4)  # what follows a pair counts from its end


def test_repetition_in_step(spark):
    rows = [(1, "하는지 하는지 하는지 맞아요", ["하는지", " 하는지", "하는지 ", "맞아요"]), (2, "그 다음 그 다음 그 다음", ["그", "다음"] * 3), (3, "하는지  하는지 하는지", None), (4, "a  b", []), (5, None, None)]
    df = spark.createDataFrame([(i, t, None if w is None else [(x, float(k), k + 1.0) for k, x in enumerate(w)]) for i, t, w in rows], "i long, text string, words array<struct<word:string,start_sec:double,end_sec:double>>")
    got = {r.i: (r.text, [w.word.strip() for w in r.words], r.collapsed) for r in repetition.collapsed_segments(df, "i").collect()}
    assert got == {1: ("하는지 맞아요", ["하는지", "맞아요"], 2), 2: ("그 다음", ["그", "다음"] * 3, 0), 3: ("하는지", [], 2), 4: ("a  b", [], 0), 5: ("", [], 0)}


def test_number_shapes(spark):
    r = random.Random(11)
    parts = ["010-1234-5678", "12 34", "1a2b", "12가34", "2024/01/15", "3,000", "90.5평", "7", "12-3", "x", " ", "가", "1234567890123", "12/3"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(300)]
    known = [p for _, p in (*P.RULES, *P.CANDIDATES)]
    count, first, shown = {}, {}, {}
    for i, t in enumerate(texts):
        taken = {k for p in known for m in re.finditer(p, t) for k in range(*m.span())}
        for m in re.finditer(P.NUMBER, t):
            if not taken & set(range(*m.span())):
                shape = re.sub(r"\s+", "_", re.sub("[가-힣]", "H", re.sub("[0-9]", "N", re.sub("[A-Za-z]", "L", m[0]))))
                count[shape] = count.get(shape, 0) + 1
                first.setdefault(shape, (i, m.start()))
                shown.setdefault(shape, []).append(m[0])
    best = sorted(count, key=lambda s: (-count[s], first[s]))[:5]
    got = P.number_shapes(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 5).collect()
    assert {(x.shape, x.n, x.examples) for x in got} == {(s, count[s], "|".join(shown[s][:3])) for s in best}


def test_balanced_and_capped(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "ab"[i % 3 > 0]) for i in range(90)], "k long, label string")
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    kept = {r.label: r["count"] for r in relations.balanced(rows, "label", "k").groupBy("label").count().collect()}
    assert kept == dict.fromkeys(n, min(n.values()))
    capped = relations.majority_capped(rows, "label", "b", 0.25, "k")
    assert capped.distinct().count() == capped.count() and capped.columns == rows.columns
    assert {r.label: r["count"] for r in capped.groupBy("label").count().collect()} == n | {"b": (n["a"] + n[None]) // 3}


@pytest.mark.parametrize("rule", range(len(P.RULES)))
def test_spans_equal_regular_expressions(spark, rule):
    label, pattern = P.RULES[rule]
    r = random.Random(rule)
    parts = ["010-1234-5678", "02 123 4567", "01012345678", "900101-1234567", "12-34-567890-12", "M12345678", "1234-5678-9012-3456", "a.b@c.org", "10.0.0.255", "12345678901234", "가나다", "é", "😀", "\n", " ", "x", "7"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {x.i: [(s.char_start, s.char_end, s.matched_text) for s in x.m] for x in df.select("i", P.matches(F.col("t"), pattern, label, rule).alias("m")).collect()}
    assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_masking(spark):
    assert one(spark, P.masked(F.col("t")), "전화 010-1234-5678 메일 a@b.org") == "전화 [PII_전화번호] 메일 [PII_이메일]"
    assert one(spark, P.masked(F.col("t")), None) == ""
    s = one(spark, P.scored(P.pii_spans(F.col("t"))), "010-1234-5678")
    assert len(s) == 1 and s[0].confidence_tier == "auto_confirmed" and "matched_text" not in s[0].asDict()


def test_text_labels(spark):
    case = lambda f, t: one(spark, f(F.col("t")), t)
    assert case(X.honorific_level, "안녕하세요. 뭐해 그랬어.") == "mixed"
    assert case(X.honorific_level, "감사합니다") == "honorific"
    assert case(X.honorific_level, None) is None
    assert case(X.question_type, "어디 가?") == "wh"
    assert case(X.question_type, "가나요") == "yes_no"
    assert case(X.language_mix, "OK 좋아 yes") == "mixed"
    assert case(X.filler_count, "음 그 사람") == 2
    assert one(spark, X.words_per_minute(F.col("t"), F.lit(0.0)), "a b") is None


def test_word_accuracy(spark):
    d = spark.createDataFrame([("a b c d", "a x c"), ("", ""), ("a", "")], "r string, h string")
    got = [x.v for x in d.select(X.word_accuracy(X.all_tokens(F.col("r")), X.all_tokens(F.col("h"))).alias("v")).collect()]
    assert got == [0.5, 1.0, 0.0]


def test_characters_of_many_kinds(spark):
    ks = [1, 2, 0xD7FE, 0xD7FF, 0xD800, 0xD801, 0xFFFF, 60_000, 500_000]
    line = F.array_join(F.transform(F.array(*map(F.lit, ks)), X.character), "")
    r = spark.range(1).select(line.alias("a"), F.levenshtein(line, F.concat(X.character(F.lit(0xD800)), line)).alias("d")).first()
    assert len(r.a) == len(set(r.a)) == len(ks) and r.d == 1


def test_cosine_policies(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert [one(spark, N.cosine(zero, unit, z)) for z in (1.0, 0.0, None)] == [1.0, 0.0, None]
    assert one(spark, N.cosine(unit, unit)) == 1.0


def utterances(spark, sessions, dynamic=False):
    """sessions: lists of (start, end, word, speaker) -> lists of (speaker, words, seconds)."""
    rows = [(n, i, float(a), float(b), s, w) for n, ws in enumerate(sessions) for i, (a, b, w, s) in enumerate(ws)]
    df = spark.createDataFrame(rows, "session_id long, word_idx int, start_sec double, end_sec double, speaker string, w string")
    got = segmentation.utterances(df, dynamic=dynamic, text="w").orderBy("session_id", "utt_idx").collect()
    return [[x for x in got if x.session_id == n] for n in range(len(sessions))]


@pytest.mark.parametrize("dynamic", [False, True])
def test_segmentation_keeps_all_words(spark, dynamic):
    r, sessions = random.Random(5), []
    for _ in range(40):
        at, words = 0.0, []
        for _ in range(r.randint(1, 120)):
            at += r.choice([0, 0.1, 0.2, 0.6, 1.5])
            end = at + r.uniform(0.05, 0.9)
            words.append((at, end, r.choice(["네", "응", "말을", "합니다.", "정말?"]), r.choice(["A", "B"]) if r.random() < 0.2 else "A"))
            at = end
        sessions.append(words)
    for words, found in zip(sessions, utterances(spark, [*sessions, [(0, 1, "x", "None")]], dynamic)):
        assert [u.utt_idx for u in found] == list(range(len(found)))
        assert " ".join(u.transcript for u in found) == " ".join(w[2] for w in words)
        assert sum(u.n_words for u in found) == len(words)
        assert all(u.end_sec - u.start_sec <= 30.01 or u.n_words == 1 for u in found)
    assert utterances(spark, [[(0, 1, "x", "None")]], dynamic) == [[]]


def test_segmentation_rules(spark):
    said = lambda sessions, **k: [[(u.speaker, u.transcript) for u in found] for found in utterances(spark, sessions, **k)]
    long = (0, 6, "x", "A")
    cases = [
        [(0, 5, "a", "A"), (5.4, 6, "b", "A"), (6.6, 12, "c", "A")],  # b hangs behind a pause and opens the next run
        [(0, 5, "a", "A"), (5.4, 6, "b", "A"), (6.6, 7, "c", "A"), (8, 14, "d", "A")],  # c is given b and moves on itself; b stays alone, short
        [long, (6, 6.2, "네", "B")],  # nods
        [long, (6, 6.2, "말", "B")],  # short, but says something
        [long, (6, 6.5, "네", "B")],  # an answer of its own
        [long, (6, 7, "y", "B"), (8, 15, "z", "B")],  # a short start goes on into the next run
        [(0, 1, "a", "A"), (2, 3, "b", "A")],  # short ones join
        [long, (7, 8, "b", "A")],  # but not one that is long enough
        [(0, 10, "a", "A"), (10, 21, "b", "A"), (21.4, 40, "c", "A")],  # halved at the pause
    ]
    want = [[("A", "a"), ("A", "b c")], [("A", "a"), ("A", "b"), ("A", "c d")], [("A", "x 네")], [("A", "x"), ("B", "말")], [("A", "x"), ("B", "네")], [("A", "x"), ("B", "y z")], [("A", "a b")], [("A", "x"), ("A", "b")], [("A", "a b"), ("A", "c")]]
    assert said(cases) == want
    word = lambda k, w="w", gap=0.0: (k + gap, k + 1, w, "A")
    dynamic = [
        [word(k, "끝." if k == 16 else "w") for k in range(20)],  # a sentence ends behind 15 seconds
        [word(k) for k in range(40)],  # nothing ends: the last word before 30 seconds
        [word(k, gap=0.5 if k == 18 else 0.0) for k in range(22)],  # a pause
        [word(k, "끝." if k == 3 else "w") for k in range(10)],  # too early to cut
    ]
    assert [[u.n_words for u in found] for found in utterances(spark, dynamic, True)] == [[17, 3], [29, 11], [18, 4], [10]]


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_consolidated_relations(spark):
    calls = [(1, "부모", 1), (1, "자녀", 2), (1, "자녀", 3), (2, "친구", 1), (3, "기타", 1), (4, "친구", 1), (4, "부모", 2), (5, "친구", 1), (5, "친구", 2), (5, "친구", 3), (5, "부모", 4)]
    got = {r.peer_id: (r.relation, r.confidence, r.source) for r in relations.consolidated(spark.createDataFrame(calls, "peer_id long, relation string, call long")).collect()}
    assert got == {1: ("자녀", 0.9, "cross_call_consistent"), 2: ("친구", 0.5, "single_call"), 3: (None, 0.0, "no_signal"), 4: (None, 0.0, "conflict"), 5: ("친구", 0.8, "cross_call_dominant")}


def test_split_sizes(spark):
    rows = spark.range(1003).withColumnRenamed("id", "k")
    parts = {r.part: r["count"] for r in relations.split(rows, "k", 0.2).groupBy("part").count().collect()}
    assert parts == {"train": 802, "val": 201}


def test_speaker_fallback(spark):
    def fill(speakers):
        df = spark.createDataFrame([(1, i, s) for i, s in enumerate(speakers)], "session_id long, word_idx int, speaker string")
        return [r.filled for r in sequences.speaker_fallback(df).orderBy("word_idx").collect()]

    assert fill([None, "A", None, "B"]) == ["A", "A", "A", "B"]
    assert fill([None, None, "A"])[:1] == ["SPEAKER_00"]


def test_clipped_overlap_rounds_halves_up(spark):
    """As the SQL of jn6_overlap_features says it: 0.004 of 16 seconds are 0.00025, a half of the last place."""
    spans = spark.createDataFrame([(1, 0, 0.0, 16.0)], "session_id long, turn_idx int, start_sec double, end_sec double")
    inside = spark.createDataFrame([(1, 0.0, 0.004)], "session_id long, start_sec double, end_sec double")
    r = intervals.clipped_overlap(spans, inside, "turn_idx").first()
    assert (r.overlap_count, r.overlap_total, r.overlap_ratio) == (1, 0.004, 0.0003)


def test_components_broadcast_nothing(spark, monkeypatch):
    """Labels and edges stay with the executors, however small they look."""
    kind, plans = type(spark.range(1)), []
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, *a))[1])
    edges = spark.range(1, 40).selectExpr("id u", "id - id % 13 - 1 v")
    got = {r.node: r.root for r in graph.components(edges.where("v >= 0")).collect()}
    assert len(set(got.values())) == 1 and len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_phrase_boost_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab😀é ") for _ in range(n))
    texts = [(k, rng.choice([None, "u", "v", "w"]), rng.choice([None, word(rng.randint(0, 30))])) for k in range(120)] + [(998, "u", ""), (999, "v", "a\nb")]
    kept = [(rng.choice([None, "u", "v"]), rng.choice([None, "?", word(rng.randint(0, 4))]), float(rng.randint(-2, 3))) for _ in range(80)] + [("v", "a\nb", 5.0), ("u", "", 7.0)]
    want = {k: sum(w for u, p, w in kept if u is not None and u == user and p is not None and t is not None and p in t and w > 0) for k, user, t in texts}
    t, m = spark.createDataFrame(texts, "k int, user_id string, text string"), spark.createDataFrame(kept, "user_id string, phrase string, weight double")
    for most in (memory.BROADCAST_ROWS, 0):
        got = memory.phrase_boost(t, m, ["k"], most)
        assert {r.k: r.boost for r in got.collect()} == want and got.count() == len(texts)
        assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()  # no user's memory travels as one array
