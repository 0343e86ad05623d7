from pyspark.sql import functions as F

from colloquy.plans import composites as C


WORDS = "array<struct<word:string,start_sec:double,end_sec:double>>"


def test_word_offsets(spark):
    rows = spark.createDataFrame([("Call me, call ME", ["call", "me", "Call", "x", "me", ""])], "t string, w array<string>")
    got = rows.select(C.word_offsets(F.col("t"), F.col("w")).alias("p")).first().p
    assert [tuple(x) if x else None for x in got] == [(0, 4), (5, 7), (9, 13), None, (14, 16), None]


def test_time_ranges_and_words(spark):
    text, words = "전화 010 1234 5678 입니다", [("전화", 0.0, 1.0), ("010", 1.0, 2.0), ("1234", 2.0, 3.0), ("5678", 3.0, 4.0), ("입니다", 4.0, 5.0)]

    def run(spans):
        df = spark.createDataFrame([(1, text, words, spans)], f"id long, t string, words {WORDS}, spans array<struct<a:int,b:int,k:string>>")
        df = df.withColumn("places", C.word_offsets(F.col("t"), F.transform("words", lambda x: x["word"])))
        touched = C.touched_words(df)
        ranges = [(r.start_sec, r.end_sec, r.type) for r in C.time_ranges(touched).orderBy("j").collect()]
        return ranges, [tuple(x) for x in C.masked_words(df, touched).first().words]

    span = [(3, 16, "전화번호")]
    assert run(span) == ([(0.85, 4.15, "전화번호")], [words[0], ("[PII_전화번호]", 1.0, 4.0), words[4]])
    assert run(span * 2)[0] == [(0.85, 4.15, "전화번호")]
    assert run([]) == ([], words) and run([(0, 0, "x")]) == ([], words)
    assert run([(0, 4, "a"), (5, 12, "b")])[1] == [("[PII_a]", 0.0, 2.0), words[3], words[4]]  # 010 goes with the first span, so the second has no token


def test_masked_utterances(spark):
    w = [{"word": "mail", "start_sec": 0.0, "end_sec": 1.0}, {"word": "a@b.org", "start_sec": 1.0, "end_sec": 2.0}]
    rows = spark.createDataFrame([(1, "mail a@b.org", w), (2, None, None)], "id long, text string, words array<struct<word:string,start_sec:double,end_sec:double>>")
    a, b = C.masked_utterances(rows).orderBy("id").collect()
    assert a.masked == "mail [PII_이메일]" and [x.word for x in a.words] == ["mail", "[PII_이메일]"] and [tuple(r) for r in a.ranges] == [(0.85, 2.15, "이메일")]
    assert b.masked == "" and b.words == [] and b.ranges == []


def test_masked_utterances_in_their_rows(spark):
    """No word is shuffled or checkpointed, and the marks equal the join of all spans and words, on words that are missing, empty, null, of several spans, without times."""
    import random

    rng, nan = random.Random(5), float("nan")
    kinds = ["a@b.org", "a@b.org,c@d.org", "x:a@b.org", "010-1234-5678", "010 1234 5678", "İ", "ok", "", None, "Wörter"]
    rows = []
    for k in range(80):
        ws = [rng.choice(kinds) for _ in range(rng.randrange(12))]
        parts = [p for w in ws if w and rng.random() < 0.9 for p in w.split(" " if rng.random() < 0.5 else "#")]
        time = lambda i: rng.choice([None, nan, 0.0, 0.1, float(i), float(i)])
        rows.append((k, " ".join(w for w in ws if w and rng.random() < 0.9), [(w, time(i), time(i + 1)) for i, w in enumerate(parts + ws[:2])]))
    df = spark.createDataFrame([*rows, (80, None, None), (81, "a@b.org", None), (82, "a@b.org", []), (83, None, [("a", 0.0, 1.0)]), (84, "", [(None, 0.0, 1.0)])], f"id long, text string, words {WORDS}")
    out = C.masked_utterances(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "Exchange")
    got = {r.id: r for r in out.collect()}
    assert len(got) == 85
    found = C._located(df, C.P.RULES).withColumn("places", C.word_offsets(F.col("text"), F.transform("words", lambda w: w["word"])))
    touched = C.touched_words(found)
    words = {r.id: r.words for r in C.masked_words(found, touched).collect()}
    ranges = {}
    for r in C.time_ranges(touched).orderBy("id", "j").collect():
        ranges.setdefault(r.id, []).append((r.start_sec, r.end_sec, r.type))
    spans = {r.id for r in found.collect()}
    assert len(spans) > 30 and spans == {k for k, r in got.items() if "[PII_" in r.masked}
    for k, r in got.items():
        if k < 80:
            given = words.get(k, []) if k in spans else [[w or "", s, e] for w, s, e in rows[k][2]]
            assert repr([list(w) for w in r.words]) == repr([list(w) for w in given])
            assert repr([tuple(x) for x in r.ranges]) == repr(ranges.get(k, []))
    assert [w.word for w in got[84].words] == [""] and got[80].masked == "" and got[80].words == [] and got[82].words == []


def test_long_text(spark):
    """Words, cursor and spans of 20,000 words, against a plain version; the time must not grow with the square."""
    import random
    import re
    import time

    rng = random.Random(1)
    ws = [f"m{k}@x.org" if k % 50 == 7 else "010-1234-5678" if k % 90 == 3 else "missing" if k % 41 == 5 else rng.choice(["Yes", "no", "word", "Wörter", "가나"]) for k in range(20_000)]
    text = " ".join(w for w in ws if w != "missing")
    timed = [(w, float(k), k + 0.5) for k, w in enumerate(ws)]
    df = spark.createDataFrame([(1, text, timed)], f"id long, text string, words {WORDS}")
    start = time.time()
    [r] = C.masked_utterances(df).collect()
    took = time.time() - start
    at, want, ranges = 0, [], []
    for w, s, e in timed:
        k = text.lower().find(w.lower(), at)
        at = k + len(w) if k >= 0 else at
        kind = "이메일" if "@" in w else "전화번호" if w.startswith("010") else None
        want.append((f"[PII_{kind}]" if kind else w, s, e))
        if kind:
            ranges.append((max(0.0, s - 0.15), e + 0.15, kind))
    assert [tuple(w) for w in r.words] == want and [tuple(x) for x in r.ranges] == ranges
    assert r.masked == re.sub(r"010-1234-5678", "[PII_전화번호]", re.sub(r"m[0-9]+@x[.]org", "[PII_이메일]", text))
    assert took < 30


def test_has_span(spark):
    """The rows that are looked at are those that hold a span, private-use characters inside a match or not."""
    texts = [None, "", "nothing", "@", "a@b", "a@b.org", "a@b.or\ue000g", "a\ue001@b.org", "1", "010-1234-5678", "٠10-1234-5678", "1.2.3.4 x", "M12345678"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules in (C.P.RULES, [C._EMAIL]):
        assert all(r.a == r.b for r in df.select(C.P.has_span(F.col("t"), rules).alias("a"), (F.size(C.P.pii_spans(F.col("t"), rules)) > 0).alias("b")).collect())


def test_summary(spark):
    w = [{"word": "a@b.org", "start_sec": 0.0, "end_sec": 1.0}]
    rows = spark.createDataFrame([(1, "a@b.org and c@d.org", w), (2, "c@d.org", None), (3, "nothing", w)], f"id long, text string, words {WORDS}")
    assert sorted(tuple(r) for r in C.pii_summary(rows).collect()) == [(1, "이메일", 2, 1), (2, "이메일", 1, 0)]


def test_topic_segments(spark):
    e = [[1.0, 0.0]] * 5 + [[0.0, 1.0]] * 5
    rows = [(1, i, float(i), i + 0.5, "A" if i < 5 else "B", "축구 경기" if i < 5 else "병원 예약", v) for i, v in enumerate(e)] + [(2, 0, 0.0, 1.0, "A", "x", None), (2, 1, 1.0, 2.0, "A", "y", None)]
    u = spark.createDataFrame(rows, "session_id long, index int, start_sec double, end_sec double, speaker string, text string, embedding array<double>")
    got = C.topic_segments(u, topics=(("스포츠", ["축구"]), ("건강", ["병원"]))).orderBy("session_id", "segment_index").collect()
    assert [(r.session_id, r.segment_index, r.start_ms, r.end_ms, r.topic, len(r.utterance_indices)) for r in got] == [(1, 0, 0, 4500, "스포츠", 5), (1, 1, 5000, 9500, "건강", 5), (2, 0, 0, 2000, "기타", 2)]


def test_hybrid_intro(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    words = t([(1, 0, 0.5, 1.0, "A"), (1, 1, 2.0, 2.5, "A"), (1, 2, 3.2, 3.4, "A"), (1, 3, 50.0, 51.0, "A")], "session_id long, word_idx int, start_sec double, end_sec double, speaker string")
    outer = t([(1, 0, "x", 0.0, 1.5), (1, 1, "y", 1.6, 60.0)], "session_id long, turn_idx int, speaker string, start_sec double, end_sec double")
    names = t([(1, "x", "A"), (1, "y", "B")], "session_id long, outer string, speaker string")
    overlaps = t([(1, 3.0, 3.5)], "session_id long, start_sec double, end_sec double")
    assert [r.speaker for r in C.hybrid_intro(words, outer, names, 30.0, overlaps).orderBy("word_idx").collect()] == ["A", "B", "A", "A"]
