"""Labelled corpora: JSON documents of several shapes as rows of text and label.

Each loader takes files(value): one JSON document per row, from json_files() or files.zipped_json(). A document of another shape, or one
that is no JSON, gives no row. All of it is from_json and explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L

# Labels, topics and their aliases in order, ages and subjects.
FREE = ("긍정", "중립", "부정")
ACTS = ("진술", "질문", "요청", "감사", "인사", "사과", "동의", "반대", "확인", "부정", "응답", "제안", "명령", "감탄", "기타")
OTHER = "기타"
TOPICS = (
    "건강/의료 식사/음식 날씨/계절 직장/업무 가족 여행/외출 쇼핑/소비 금융/돈 교육/공부 취미/여가 연애/관계 집/생활 교통/이동 뉴스/시사 스포츠 "
    "IT/기술 문화/예술 반려동물 종교/신앙 환경/자연 경조사 친목/모임 갈등/고민 감사/칭찬 안부/인사 계획/약속 추억/과거 자녀양육 부동산 기타"
).split()
ALIASES = (
    ("건강", "건강/의료"), ("의료", "건강/의료"), ("병원", "건강/의료"), ("건강의료", "건강/의료"), ("건강 의료", "건강/의료"),
    ("음식", "식사/음식"), ("식사", "식사/음식"), ("요리", "식사/음식"), ("맛집", "식사/음식"), ("음식음료", "식사/음식"),
    ("날씨", "날씨/계절"), ("계절", "날씨/계절"), ("기후", "날씨/계절"),
    ("직장", "직장/업무"), ("업무", "직장/업무"), ("일", "직장/업무"), ("회사", "직장/업무"), ("직업", "직장/업무"),
    ("가족", "가족"), ("육아", "자녀양육"), ("자녀", "자녀양육"),
    ("여행", "여행/외출"), ("여행외출", "여행/외출"),
    ("쇼핑", "쇼핑/소비"), ("소비", "쇼핑/소비"),
    ("금융", "금융/돈"), ("경제", "금융/돈"), ("돈", "금융/돈"),
    ("교육", "교육/공부"), ("공부", "교육/공부"), ("학업", "교육/공부"),
    ("취미", "취미/여가"), ("여가", "취미/여가"), ("레저", "취미/여가"),
    ("연애", "연애/관계"), ("관계", "연애/관계"),
    ("주거", "집/생활"), ("집", "집/생활"),
    ("교통", "교통/이동"), ("이동", "교통/이동"),
    ("뉴스", "뉴스/시사"), ("시사", "뉴스/시사"), ("정치", "뉴스/시사"),
    ("스포츠", "스포츠"),
    ("it", "IT/기술"), ("기술", "IT/기술"), ("디지털", "IT/기술"),
    ("문화", "문화/예술"), ("예술", "문화/예술"), ("엔터테인먼트", "문화/예술"),
    ("반려동물", "반려동물"), ("동물", "반려동물"),
    ("종교", "종교/신앙"),
    ("환경", "환경/자연"), ("자연", "환경/자연"),
    ("경조사", "경조사"), ("결혼", "경조사"),
    ("친목", "친목/모임"), ("모임", "친목/모임"),
    ("갈등", "갈등/고민"), ("고민", "갈등/고민"),
    ("감사", "감사/칭찬"), ("칭찬", "감사/칭찬"),
    ("안부", "안부/인사"), ("인사", "안부/인사"),
    ("계획", "계획/약속"), ("약속", "계획/약속"),
    ("추억", "추억/과거"), ("과거", "추억/과거"),
    ("부동산", "부동산"),
)
AGES = (
    ("20대", "20대"), ("20s", "20대"), ("20", "20대"), ("30대", "30대"), ("30s", "30대"), ("30", "30대"), ("40대", "40대"), ("40s", "40대"), ("40", "40대"),
    ("50대", "50대+"), ("50s", "50대+"), ("50", "50대+"), ("60대", "50대+"), ("60s", "50대+"), ("60", "50대+"), ("70대", "50대+"), ("70대 이상", "50대+"), ("50대+", "50대+"), ("50대이상", "50대+"),
)
SUBJECTS = ("가족", "건강", "게임", "계절/날씨", "교육", "교통", "군대", "미용", "반려동물", "방송/연예", "사회이슈", "상거래 전반", "스포츠/레저", "식음료", "여행", "연애/결혼", "영화/만화", "주거와 생활", "타 국가 이슈", "회사/아르바이트")
RENAMED, MERGED = {"상거래전반": "상거래 전반"}, {"사회이슈": "시사/뉴스", "타 국가 이슈": "시사/뉴스"}
FILE_AGES = {"10대": "20s", "20대": "20s", "30대": "30s", "40대": "40s", "50대이상": "50s+"}


def json_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value")


def stripped(c: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty, stripped."""
    return stripped(F.coalesce(*(F.when(c != "", c) for c in columns)))


def _items(files: DataFrame, path: str, item: str) -> DataFrame:
    """One row per element of the list under path of an object, as columns."""
    return files.select(F.explode(F.from_json("value", f"struct<{path}: array<struct<{item}>>>")[path]).alias("i")).select("i.*")


def _listed(files: DataFrame, item: str) -> DataFrame:
    """One row per element of documents that are a list themselves."""
    listed = files.where(F.ltrim("value").startswith("["))
    return listed.select(F.explode(F.from_json("value", f"array<struct<{item}>>")).alias("i")).select("i.*")


def _picked(mapping: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def emotion_dialogs(files: DataFrame) -> DataFrame:
    """Lists of {profile.emotion.type, talk.content.HS01 .. HS03}: each human turn with the emotion of the code; codes without one
    are left out."""
    rows = _listed(files, "profile: struct<emotion: struct<type: string>>, talk: struct<content: struct<HS01: string, HS02: string, HS03: string>>")
    texts = F.explode(F.array(*(F.col(f"talk.content.HS0{k}") for k in (1, 2, 3))))
    rows = rows.select(L.emotion_of_code(F.col("profile.emotion.type")).alias("emotion"), texts.alias("text"))
    return rows.select(stripped(F.col("text")).alias("text"), "emotion", F.lit(OTHER).alias("dialog_act"), F.lit("aihub_dialog").alias("source")).where("text <> '' and emotion is not null")


def free_dialogs(files: DataFrame, source: str) -> DataFrame:
    """{Conversation: [{Text, VerifyEmotionCategory}]}; turns without one of the three categories are left out."""
    rows = _items(files, "Conversation", "Text: string, VerifyEmotionCategory: string")
    rows = rows.select(stripped(F.col("Text")).alias("text"), stripped(F.col("VerifyEmotionCategory")).alias("emotion"), F.lit(OTHER).alias("dialog_act"), F.lit(source).alias("source"))
    return rows.where((F.col("text") != "") & F.col("emotion").isin(*FREE))


def empathy_dialogs(files: DataFrame) -> DataFrame:
    """{info.speaker_emotion, utterances: [{text}]}: the dialogue's emotion stands beside each utterance."""
    d = files.select(F.from_json("value", "struct<info: struct<speaker_emotion: string>, utterances: array<struct<text: string>>>").alias("d"))
    rows = d.select(stripped(F.col("d.info.speaker_emotion")).alias("named"), F.explode("d.utterances.text").alias("text")).where("named <> ''")
    return rows.select(stripped(F.col("text")).alias("text"), L.emotion_of_name(F.col("named")).alias("emotion"), F.lit(OTHER).alias("dialog_act"), F.lit("empathy_dialog").alias("source")).where("text <> ''")


def age_speech(files: DataFrame) -> DataFrame:
    """{Category, Speakers: [{Speaker, AgeGroup}], Dialogs: [{Speaker, SpeakerText, TextConvert}]}: the speaker's age decides, else the
    document's; unknown ages and texts under two characters are left out. A speaker listed twice has the last age."""
    kind = "struct<Category: string, Speakers: array<struct<Speaker: string, AgeGroup: string>>, Dialogs: array<struct<Speaker: string, SpeakerText: string, TextConvert: string>>>"
    d = files.select(F.from_json("value", kind).alias("d")).select(stripped(F.col("d.Category")).alias("category"), "d.Speakers", F.explode("d.Dialogs").alias("t"))
    known = F.filter(F.coalesce("Speakers", F.array().cast("array<struct<Speaker:string,AgeGroup:string>>")), lambda s: (stripped(s["Speaker"]) == stripped(F.col("t.Speaker"))) & (stripped(s["Speaker"]) != "") & (stripped(s["AgeGroup"]) != ""))
    own = L.age_range(F.try_element_at(known, F.lit(-1))["AgeGroup"])
    rows = d.select(_first(F.col("t.TextConvert"), F.col("t.SpeakerText")).alias("text"), F.when(F.size(known) > 0, own).otherwise(_picked(FILE_AGES, F.col("category"))).alias("age_range"), F.lit("age_speech").alias("source"))
    return rows.where((F.length("text") >= 2) & F.col("age_range").isNotNull() & (F.col("age_range") != "unknown"))


def topic_of(raw: Column) -> Column:
    """The topic whose name this is, without case, blanks and strokes; else that of the first alias that holds it or is held by it."""
    low = F.replace(F.lower(stripped(raw)), F.lit(" "), F.lit(""))
    out = F.lit(OTHER)
    for alias, topic in reversed(ALIASES):
        out = F.when(low.contains(alias.lower()) | F.lit(alias.lower()).contains(low), topic).otherwise(out)
    for topic in reversed(TOPICS):
        out = F.when(low == topic.lower().replace(" ", "").replace("/", ""), topic).otherwise(out)
    return out


def subject_of(raw: Column) -> Column:
    """One of the known subjects, merged where two are one; else null."""
    s = stripped(raw)
    s = F.coalesce(_picked(RENAMED, F.replace(s, F.lit(" "), F.lit(""))), s)
    return F.when(s.isin(*SUBJECTS), F.coalesce(_picked(MERGED, s), s))


def topic_dialogs(files: DataFrame) -> DataFrame:
    """Three shapes: a list of {topic, text}; {data: [{topic, conversations or utterances}]}; {dialogues: [{topic, utterances}]}."""
    said = "array<struct<text: string, utterance: string>>"
    flat = _listed(files, "text: string, utterance: string, topic: string, category: string")
    parts = [flat.select(_first(F.col("text"), F.col("utterance")).alias("text"), _first(F.col("topic"), F.col("category")).alias("raw"))]
    for path, lists in (("data", ("conversations", "utterances")), ("dialogues", ("utterances",))):
        rows = _items(files, path, f"topic: string, category: string, {', '.join(f'{x}: {said}' for x in lists)}")
        chosen = F.coalesce(*(F.when(F.size(x) > 0, F.col(x)) for x in lists))
        rows = rows.select(_first(F.col("topic"), F.col("category")).alias("raw"), F.explode(chosen).alias("u"))
        parts.append(rows.select(_first(F.col("u.text"), F.col("u.utterance")).alias("text"), "raw"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("text <> '' and raw <> ''")
    return rows.select("text", topic_of(F.col("raw")).alias("topic"), F.lit("aihub_topic_dialog").alias("source"))


def age_group_of(raw: Column) -> Column:
    """The group of a label, else of the first label that this one begins with, else null."""
    s = stripped(raw)
    out = F.lit(None).cast("string")
    for label, group in reversed(AGES):
        out = F.when(s.startswith(label), group).otherwise(out)
    return F.coalesce(_picked(dict(AGES), s), out)


def _aged(rows: DataFrame) -> DataFrame:
    named = rows.where("text <> '' and raw <> ''").select("text", age_group_of(F.col("raw")).alias("age_group"), F.lit("aihub_speech_age").alias("source"))
    return named.where("age_group is not null")


def speech_ages(files: DataFrame) -> DataFrame:
    """A list of utterances, or such a list under utterances, data or dataset (the first that holds any), whose items may hold utterances
    themselves. Text and age go by several names."""
    plain = "text: string, utterance: string, content: string, `발화`: string, age: string, speaker_age: string, age_group: string, `연령대`: string, AgeGroup: string"
    text = _first(*(F.col(f"i.`{c}`") for c in ("text", "utterance", "content", "발화")))
    raw = _first(*(F.col(f"i.`{c}`") for c in ("age", "speaker_age", "age_group", "연령대", "AgeGroup")))
    lists = ("utterances", "data", "dataset")
    nested = ", ".join(f"{x}: array<struct<{plain}, utterances: array<struct<{plain}>>>>" for x in lists)
    d = files.where(F.ltrim("value").startswith("{")).select(F.from_json("value", f"struct<{nested}>").alias("d"))
    outer = d.select(F.explode(F.coalesce(*(F.when(F.size(F.col(f"d.{x}")) > 0, F.col(f"d.{x}")) for x in lists))).alias("o"))
    own = F.struct(*(F.col(f"o.`{c.split(':')[0].strip('` ')}`") for c in plain.split(", ")))
    inner = outer.select(F.explode(F.when(F.col("o.utterances").isNotNull(), F.col("o.utterances")).otherwise(F.array(own))).alias("i"))
    listed = _listed(files, plain).select(F.struct("*").alias("i"))
    return _aged(listed.select(text.alias("text"), raw.alias("raw")).unionByName(inner.select(text.alias("text"), raw.alias("raw"))))


def speech_ages_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, which may begin with a byte order mark."""
    rows = spark.read.option("header", True).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    pick = lambda *names: _first(*(F.col(f"`{c}`") for c in names if c in rows.columns), F.lit(""))
    return _aged(rows.select(pick("text", "발화").alias("text"), pick("age_group", "age", "연령대").alias("raw")))


def all_speech_ages(files: DataFrame, csv: DataFrame) -> DataFrame:
    return speech_ages(files).unionByName(csv)
