"""Rule labels: relations by salutation, emotion and age classes, discourse roles, extended personal data, corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pii as P

# Rules in their order.
SALUTATIONS = (
    ("엄마|어머니|어머님|모친", "부모"),
    ("아빠|아버지|아버님|부친", "부모"),
    ("자기야|여보|당신|오빠야|언니야", "배우자"),
    ("형|누나|언니|오빠|남동생|여동생", "형제자매"),
    ("사장님|대표님|회장님", "직장상사"),
    ("부장님|과장님|팀장님|차장님|실장님|본부장님", "직장상사"),
    ("선생님|교수님|교수|선생", "교사"),
    ("친구야|친구|야|어이", "친구"),
)
POSITIVE = ("기쁨", "설렘", "사랑", "행복", "즐거움", "희망", "만족", "감사", "편안")
NEGATIVE = ("슬픔", "분노", "혐오", "공포", "불안", "우울", "절망", "외로움", "당황", "상처")
AGES = (("10대", "20s"), ("20대", "20s"), ("30대", "30s"), ("40대", "40s"), ("50대이상", "50s+"))
NOISE = {"Babble": "babble", "Crowd": "babble", "Hubbub, speech noise": "babble", "Traffic noise, roadway noise": "street", "Vehicle": "street", "Car": "street", "White noise": "static", "Pink noise": "static", "Static": "static", "Noise": "static", "Music": "music"}
CREDENTIAL_WORDS = ("비밀번호", "패스워드", "암호", "로그인 정보", "계정 정보", "계정번호", "password", "passwd", "login", "credentials")
PAYMENT_WORDS = ("전자결제", "이체", "송금", "입금", "출금", "출국정산", "CVC", "CVV", "승인번호")
EXTENDED = (
    ("credential_like", r"(?=[A-Za-z])(?=.*\d)[A-Za-z0-9]{4,}"),
    ("foreign_id_like", r"\b\d{6}[-_\s][5-8]\d{6}\b"),
    ("payment_like", r"\b\d{6,16}\b"),
    ("numeric_sensitive_like", r"(?<![\d.])\d{6,}(?![\d.])"),
)
CANDIDATES = ("credential_like", "korean_name_like_candidate")
DEFAULT = "default_context"
MALE_MAX, FEMALE_MIN = 180.0, 165.0


def relation_by_salutation(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, relation in reversed(SALUTATIONS):
        out = F.when(text.rlike(pattern), relation).otherwise(out)
    return out


def salutation_rule(text: Column) -> Column:
    """Number of the first rule that the text meets; the least over several texts is that of all of them together."""
    return F.coalesce(*(F.when(text.rlike(pattern), i) for i, (pattern, _) in enumerate(SALUTATIONS)))


def relation_of_rule(rule: Column) -> Column:
    return F.get(F.array(*(F.lit(relation) for _, relation in SALUTATIONS)), rule)


def relation(inferred: Column, text: Column) -> Column:
    return F.coalesce(inferred, relation_by_salutation(text))


def emotion_of_code(code: Column) -> Column:
    n = F.regexp_replace(code, "^E+", "").try_cast("int")
    return F.when(n.between(10, 59), "부정").when(n.between(60, 69), "긍정")


def emotion_of_name(name: Column) -> Column:
    e = F.trim(name)
    return F.when(e.isin(*POSITIVE), "긍정").when(e.isin(*NEGATIVE), "부정").otherwise("중립")


def age_range(group: Column) -> Column:
    s = F.trim(group)
    n = s.try_cast("int")
    out = F.when(n < 30, "20s").when(n < 40, "30s").when(n < 50, "40s").when(n.isNotNull(), "50s+").otherwise("unknown")
    for name, value in AGES:
        out = F.when(s == name, value).otherwise(out)
    return out


def discourse_role(form: Column) -> Column:
    """form: struct(is_greeting, is_closing, is_backchannel, is_short_response, turn_type, utterance_type) or null."""
    yes = lambda c: F.coalesce(form[c], F.lit(False))
    turn, kind = form["turn_type"], form["utterance_type"]
    return F.coalesce(
        F.when(form.isNull(), DEFAULT)
        .when(yes("is_greeting"), "opening")
        .when(yes("is_closing"), "closing")
        .when(yes("is_backchannel"), "backchannel")
        .when(turn.isin("opening", "closing"), turn)
        .when(kind == "question", "question")
        .when(kind.isin("response", "answer") | yes("is_short_response"), "response")
        .when(kind == "statement", "statement")
        .when(F.coalesce(turn, F.lit("")) != "", "statement"),
        F.lit(DEFAULT),
    )


def noise_category(tags: Column) -> Column:
    """tags: array of labels by falling score; the first known one among five decides."""
    table = F.create_map(*(F.lit(x) for kv in NOISE.items() for x in kv))
    return F.coalesce(F.get(F.array_compact(F.transform(F.slice(tags, 1, 5), lambda t: F.element_at(table, t))), F.lit(0)), F.lit("clean"))


def valence(unit: Column) -> Column:
    return 2 * unit - 1


def gender(f0: Column) -> Column:
    return F.when((f0 < MALE_MAX) & (f0 < FEMALE_MIN), "male").when(f0 >= FEMALE_MIN, "female")


def voice_age(f0: Column, f0_std: Column) -> Column:
    jitter = F.when(f0 > 0, f0_std / f0).otherwise(0.0)
    male = F.when((f0 > 130) & (jitter < 0.08), "20대").when(f0 > 110, "30대").when(f0 > 95, "40대").otherwise("50대+")
    female = F.when((f0 > 220) & (jitter < 0.08), "20대").when(f0 > 195, "30대").when(f0 > 175, "40대").otherwise("50대+")
    g = gender(f0)
    return F.when(g == "male", male).when(g == "female", female)


def extended_spans(text: Column) -> Column:
    """Further personal data; credentials and payments only in texts that hold one of their words."""
    t = P.plain(text)
    spans = []
    for i, (label, pattern) in enumerate(EXTENDED):
        found = P.matches(t, pattern, label, 100 + i)
        words = {"credential_like": CREDENTIAL_WORDS, "payment_like": PAYMENT_WORDS}.get(label)
        if words:
            said = F.lower(t) if label == "credential_like" else t
            gate = F.lit(False)
            for w in words:
                gate = gate | said.contains(w.lower() if label == "credential_like" else w)
            found = F.when(gate, found).otherwise(F.array().cast(P.SPAN))
        spans.append(found)
    return F.concat(*spans)


def suggested_confidence(kind: Column) -> Column:
    return F.when(kind.isin("credential_like", "foreign_id_like", "payment_like"), "high").when(kind.isin("numeric_sensitive_like", "korean_name_like_candidate"), "medium").otherwise("low")


def is_candidate(kind: Column) -> Column:
    return kind.isin(*CANDIDATES)


def corrected(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """struct(text, n): known confusions replaced in order where no Hangul syllable stands before them."""
    out, n = F.coalesce(text, F.lit("")), F.lit(0)
    for wrong, right in pairs:
        pattern = "(?<![가-힣])" + "".join("\\" + c if not c.isalnum() else c for c in wrong)
        n = n + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, right.replace("\\", "\\\\").replace("$", "\\$"))
    return F.struct(out.alias("text"), n.alias("n"))


def in_domain(text: Column, keywords: list[str], least: int) -> Column:
    """At least so many different keywords occur in the whole call's text."""
    return sum((F.when(text.contains(k), 1).otherwise(0) for k in keywords), F.lit(0)) >= least
