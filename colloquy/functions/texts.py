"""Text functions over columns: tokens, rates, politeness, questions, accuracy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns whose members decide the results.
CONTENT = "[0-9A-Za-z가-힣]"
LATIN = "[A-Za-z]{2,}"
HANGUL = "[가-힣]"
WH = ("뭐", "무엇", "무슨", "누구", "언제", "어디", "왜", "어떻게", "어떤", "얼마", "몇")
FILLERS = ("음", "어", "그", "저", "저기", "뭐", "막", "인제", "이제", "그니까", "그러니까", "아", "에", "거시기", "그게", "뭐랄까")
FORMAL = ("요", "니다", "세요", "셔요", "까요", "데요", "구요", "네요", "지요", "시죠", "ㅂ니다")
INFORMAL = ("어", "아", "지", "야", "거든", "자", "냐", "니", "대", "걸", "군")
ASKING = ("까", "나요", "까요", "죠", "니", "냐")
QUALITY = {"A": "excellent", "B": "good", "C": "fair"}
SPACES = r"(?U)\s+"


def once(f, **inputs: Column) -> Column:
    """f of a struct of the inputs, each of them evaluated once a row: lambdas inside f evaluate anew what they capture, except
    fields of this struct."""
    return F.transform(F.array(F.struct(*(c.alias(name) for name, c in inputs.items()))), f)[0]


def squeezed(text: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def all_tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Tokens with at least one letter, digit or Hangul syllable."""
    return F.filter(all_tokens(text), lambda t: t.rlike(CONTENT))


def content_length(token: Column) -> Column:
    return F.regexp_count(token, F.lit(CONTENT))


def words_per_minute(text: Column, seconds: Column) -> Column:
    n = F.size(tokens(text))
    return F.when((seconds > 0) & (n > 0), F.rint(n / (seconds / 60.0) * 10) / 10)


def _hangul(t: Column) -> Column:
    return F.regexp_replace(t, "[^가-힣]", "")


def filler_count(text: Column) -> Column:
    return F.size(F.filter(tokens(text), lambda t: _hangul(t).isin(*FILLERS)))


def _ends(t: Column, endings: tuple[str, ...]) -> Column:
    return t.rlike("(" + "|".join(endings) + ")$")


def honorific_level(text: Column) -> Column:
    """Politeness by how sentences end: formal endings are looked for before informal ones."""
    last = F.transform(F.split(F.coalesce(text, F.lit("")), "[.?!]"), lambda s: _hangul(F.coalesce(F.get(F.slice(tokens(s), -1, 1), F.lit(0)), F.lit(""))))
    kinds = F.transform(last, lambda t: F.when(t == "", "").when(_ends(t, FORMAL), "f").when(_ends(t, INFORMAL), "i").otherwise(""))
    formal, informal = F.array_contains(kinds, "f"), F.array_contains(kinds, "i")
    return F.when(formal & informal, "mixed").when(formal, "honorific").when(informal, "casual")


def question_type(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    asked = t.contains("?") | F.exists(tokens(t), lambda w: _ends(_hangul(w), ASKING))
    return F.when(asked, F.when(t.rlike("|".join(WH)), "wh").otherwise("yes_no"))


def language_mix(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    latin, hangul = t.rlike(LATIN), t.rlike(HANGUL)
    return F.when(t.rlike(CONTENT), F.when(latin & hangul, "mixed").when(latin, "english").otherwise("korean"))


def quality_class(grade: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in QUALITY.items():
        out = F.when(grade == k, v).otherwise(out)
    return out


def redacted(surface: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), F.length(surface), F.lit("]"))


def char_accuracy(reference: Column, hypothesis: Column) -> Column:
    """1 - character error rate, not below 0; an empty reference is right only if nothing was heard."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(reference, hypothesis) / F.when(n > 0, n)))


def character(k: Column) -> Column:
    """A code point of its own for each number from 1 on: k itself, or past the surrogates."""
    return F.decode(F.unhex(F.lpad(F.hex(F.when(k < 0xD800, k).otherwise(k + 0x2800)), 8, "0")), "UTF-32")


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of token arrays: each distinct token becomes one code point."""

    def distance(s: Column) -> Column:
        coded = lambda ts: F.array_join(F.transform(ts, lambda t: character(F.array_position(s["kinds"], t))), "")
        return F.levenshtein(coded(s["r"]), coded(s["h"]))

    return once(distance, kinds=F.array_distinct(F.concat(reference, hypothesis)), r=reference, h=hypothesis)


def word_accuracy(reference: Column, hypothesis: Column) -> Column:
    n = F.size(reference)
    return F.when(n == 0, F.when(F.size(hypothesis) == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - word_distance(reference, hypothesis) / F.when(n > 0, n)))


def keyword_argmax(text: Column, labels: list[tuple[str, list[str]]], default: str) -> Column:
    """The label with most of its keywords in the text; the first of equals, default without any."""
    hits = [F.struct(sum((F.when(text.contains(k), 1).otherwise(0) for k in ks), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(label).alias("label")) for i, (label, ks) in enumerate(labels)]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["label"]).otherwise(default)
