"""Corpus loaders on documents of every shape, and row cleaning."""

import json
import zipfile

from pyspark.sql import functions as F

from colloquy.functions import names
from colloquy.functions import pii as P
from colloquy.operators import cleaning as C
from colloquy.sources import corpora, files


def documents(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False),) for v in values], "value string")


ODD = ("no json", "[]", "{}", "null", [1, "x"], {"Conversation": None, "utterances": "x", "data": {}})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_emotion_dialogs(spark):
    one = lambda code, **said: {"profile": {"emotion": {"type": code}}, "talk": {"content": said}}
    d = documents(spark, [one("E18", HS01=" 속상해 ", HS02="", HS03="정말"), one("E65", HS01="좋아"), one("E99", HS01="x"), {}], *ODD)
    assert rows(corpora.emotion_dialogs(d)) == sorted((t, e, "기타", "aihub_dialog") for t, e in (("속상해", "부정"), ("정말", "부정"), ("좋아", "긍정")))


def test_free_and_empathy_dialogs(spark):
    d = documents(spark, {"Conversation": [{"Text": "a", "VerifyEmotionCategory": "중립"}, {"Text": " ", "VerifyEmotionCategory": "긍정"}, {"Text": "b", "VerifyEmotionCategory": "?"}, {"Text": "c"}]}, *ODD)
    assert rows(corpora.free_dialogs(d, "s")) == [("a", "중립", "기타", "s")]
    d = documents(spark, {"info": {"speaker_emotion": " 분노"}, "utterances": [{"text": "a"}, {"text": None}, {}]}, {"info": {}, "utterances": [{"text": "b"}]}, {"info": {"speaker_emotion": "평온"}, "utterances": [{"text": "c"}]}, *ODD)
    assert rows(corpora.empathy_dialogs(d)) == [("a", "부정", "기타", "empathy_dialog"), ("c", "중립", "기타", "empathy_dialog")]


def test_age_speech(spark):
    d = documents(
        spark,
        {"Category": "40대", "Speakers": [{"Speaker": "1", "AgeGroup": "20"}, {"Speaker": "2", "AgeGroup": "?"}, {"Speaker": "1", "AgeGroup": "33"}], "Dialogs": [{"Speaker": "1", "TextConvert": "가나"}, {"Speaker": "2", "SpeakerText": "다라"}, {"Speaker": "3", "TextConvert": "", "SpeakerText": "마바"}, {"Speaker": "3", "TextConvert": "x"}]},
        {"Category": "없음", "Dialogs": [{"Speaker": "1", "TextConvert": "가나"}]},
        *ODD,
    )
    assert rows(corpora.age_speech(d)) == [("가나", "30s", "age_speech"), ("마바", "40s", "age_speech")]


def test_topics_and_subjects(spark):
    cases = {"건강/의료": "건강/의료", "건강 의료": "건강/의료", "IT": "IT/기술", "요즘 여행 이야기": "여행/외출", "집": "식사/음식", "??": "기타", "자녀양육": "자녀양육", "부동산 투자": "부동산"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", corpora.topic_of(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases
    cases = {"상거래전반": "상거래 전반", "사회이슈": "시사/뉴스", " 교통 ": "교통", "x": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", corpora.subject_of(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases
    d = documents(spark, [{"topic": "가족", "text": "a"}, {"category": "음식", "utterance": "b"}, {"topic": "가족"}], {"data": [{"topic": "날씨", "conversations": [{"text": "c"}], "utterances": [{"text": "x"}]}, {"topic": "일", "utterances": [{"utterance": "d"}]}]}, {"dialogues": [{"category": "모름", "utterances": [{"text": "e"}, {"text": " "}]}]}, *ODD)
    assert rows(corpora.topic_dialogs(d)) == [(t, k, "aihub_topic_dialog") for t, k in (("a", "가족"), ("b", "식사/음식"), ("c", "날씨/계절"), ("d", "직장/업무"), ("e", "기타"))]


def test_speech_ages(spark, tmp_path):
    d = documents(spark, [{"text": "a", "age": "20대 초반"}, {"발화": "b", "연령대": "70대 이상"}], {"data": [{"utterances": [{"content": "c", "AgeGroup": "30"}, {"text": "x", "age": "몰라"}]}, {"text": "d", "age": "40s"}]}, {"utterances": [], "dataset": [{"utterance": "e", "speaker_age": "60대"}]}, *ODD)
    want = [("a", "20대"), ("b", "50대+"), ("c", "30대"), ("d", "40대"), ("e", "50대+")]
    assert rows(corpora.speech_ages(d)) == [(*w, "aihub_speech_age") for w in want]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.csv").write_text('﻿text,age_group\n"f, g",50대이상\n ,20대\nh,?\n', encoding="utf-8")
    csv = corpora.speech_ages_csv(spark, str(tmp_path))
    assert rows(csv) == [("f, g", "50대+", "aihub_speech_age")]
    assert corpora.all_speech_ages(d, csv).count() == 6


def test_zipped_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "TL_a.zip", "w") as z:
        z.writestr("a.json", json.dumps({"Conversation": [{"Text": "안녕", "VerifyEmotionCategory": "긍정"}]}))
        z.writestr("b.json", "{broken")
        z.writestr("c.txt", "x")
    found = files.zipped_json(spark, str(tmp_path)).select("value")
    assert rows(corpora.free_dialogs(found, "z")) == [("안녕", "긍정", "기타", "z")]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.json").write_text('{"Conversation":\n [{"Text": "b", "VerifyEmotionCategory": "부정"}]}', encoding="utf-8")
    assert rows(corpora.free_dialogs(corpora.json_files(spark, str(tmp_path / "plain")), "p")) == [("b", "부정", "기타", "p")]


def test_split_openings(spark):
    def run(said, **k):
        df = spark.createDataFrame([(1, i, float(s), w, r) for i, (s, w, r) in enumerate(said)], "session_id long, word_idx int, start_sec double, word string, role string")
        return [x.split_role for x in C.split_openings(df, **k).orderBy("word_idx").collect()]

    said = [(0, "여보세요", "A"), (1, "저기", "A"), (2, "네", "A"), (3, "말씀하세요", "A"), (4, "네", "B"), (6, "여보세요", "B"), (7, "네", "B")]
    a, b = C.OTHER_SIDE, C.OWN_SIDE
    assert run(said) == [a, a, b, b, "B", "B", "B"] and run(said, call_is_other=False) == [b, b, a, a, "B", "B", "B"]
    assert run([(0, "네", "A"), (1, "여보세요", "A")]) == ["A", "A"]  # nothing answers behind the call
    assert run([(0, "여보세요", "A"), (1, "네", "B"), (2, "네", None)]) == ["A", "B", None]
    assert run([(0, "여보세요", "A"), (1, "네", "A"), (2, "안녕하세요", "A"), (3, "예", "A")]) == [a, a, a, b]  # the last call counts


def test_small_rules(spark):
    df = spark.createDataFrame([("화자1: 안녕 ", "김철수"), ("아무 말", "철수"), ("a：b", "김a")], "t string, n string")
    got = df.select(C.without_prefix(F.col("t")).alias("t"), C.is_person_name(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("안녕", True), ("아무 말", False), ("b", False)]
    seg = spark.createDataFrame([("A", 0.0, 1.0), (None, 0.0, 1.0), ("", 0.0, 1.0), ("B", None, 1.0)], "speaker string, start_sec double, end_sec double")
    assert [r.speaker for r in C.segment_turns(seg).collect()] == ["A"]


def test_detection_by_grade(spark):
    text = "김철수 고객님 010-1234-5678"
    df = spark.createDataFrame([(1, text, "premium"), (2, text, "standard"), (3, text, None), (4, text, "excluded"), (5, None, "standard")], "id long, text string, grade string")
    spans = names.surname_spans(F.col("text"), ("고객",))
    for asked, ids in ((False, {2, 4}), (True, {1, 2, 3, 4})):
        got = {r.id: [s.type for s in r.spans] for r in P.detected_batch(df, spans, asked).collect()}
        assert got == {i: ["전화번호", *(["이름"] if i in ids else [])] if i < 5 else [] for i in range(1, 6)}
    assert [s.confidence_tier for s in P.detected_batch(df, spans).where("id = 1").first().spans] == ["auto_confirmed", "needs_human_decision"]
