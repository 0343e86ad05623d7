"""Personal data: spans, tiers, masking.

Spark has no function that returns the offsets of all matches. Each match is wrapped in two private-use characters by
regexp_replace and offsets are summed over the pieces, all on the JVM. Texts must not hold these two characters; they
are dropped first.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import checkpointed
from .texts import once

OPEN, CLOSE = "\ue000", "\ue001"
# The rules in their order, patterns that may become rules, any run with digits, and the tiers' bounds.
RULES = (
    ("주민등록번호", r"\d{6}\s*[-]\s*[1-4]\d{6}"),
    ("운전면허번호", r"\d{2}-\d{2}-\d{6}-\d{2}"),
    ("여권번호", r"[A-Z]\d{8}"),
    ("카드번호", r"\d{4}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}"),
    ("이메일", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("전화번호", r"0\d{1,2}[\s.-]\d{3,4}[\s.-]\d{4}"),
    ("전화번호", r"01[0-9]\d{3,4}\d{4}"),
    ("계좌번호", r"\b\d{3}\d{8,11}\b"),
    ("IP주소", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)
CANDIDATES = (
    ("사업자등록번호", r"\b\d{3}-\d{2}-\d{5}\b"),
    ("법인번호", r"\b\d{6}-\d{7}\b"),
    ("우편번호", r"\b\d{5}\b"),
    ("날짜_슬래시", r"\b\d{2,4}/\d{1,2}/\d{1,2}\b"),
    ("날짜_점", r"\b\d{2,4}\.\d{1,2}\.\d{1,2}\b"),
    ("날짜_한국어", r"\d{4}년\s*\d{1,2}월\s*\d{1,2}일"),
    ("시각_한국어", r"\d{1,2}시\s*\d{2}분"),
    ("은행코드_포함", r"\b\d{3}-\d{6,}-\d{2,}\b"),
    ("부동산_면적", r"\d+\.?\d*\s*(?:평|㎡|m²)"),
    ("금액_만원", r"\d[\d,]*\s*만\s*원"),
    ("금액_억원", r"\d[\d,]*\s*억\s*원?"),
    ("외국번호", r"\+\d{1,3}[\s-]\d{2,4}[\s-]\d{3,4}[\s-]\d{4}"),
    ("차량번호_신형", r"\b\d{2,3}[가-힣]\d{4}\b"),
    ("차량번호_구형", r"\b[가-힣]{2}\d{2}[가-힣]\d{4}\b"),
    ("건물동호수", r"\d+\s*동\s*\d+\s*호"),
)
MAIL = dict(RULES)["이메일"]
NUMBER = r"[\d][\d\s가-힣A-Za-z.,/-]{1,30}[\d]"
HIGH_PRECISION = tuple(dict.fromkeys(label for label, _ in RULES))
AMBIGUOUS = ("이름",)
HIGH, MIDDLE, WEAK = 0.95, 0.70, 0.40
CONFIRMED, HUMAN = 0.90, 0.50
SPAN = "array<struct<type:string,char_start:int,char_end:int,matched_text:string,rule_idx:int>>"


def plain(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "")


def holds(text: Column, pattern: str) -> Column:
    """Whether the pattern matches anywhere. Without an at sign no mail address is tried at each letter."""
    found = text.rlike("(?U)" + pattern)
    return text.contains("@") & found if pattern == MAIL else found


def matches(text: Column, pattern: str, label: str, rule: int) -> Column:
    """All non-overlapping matches of one pattern, leftmost first."""
    pieces = F.split(F.regexp_replace(text, "(?U)" + pattern, OPEN + "$0" + CLOSE), OPEN)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        cut = F.instr(piece, CLOSE)
        inner = F.when(cut > 0, F.substring(piece, F.lit(1), cut - 1)).otherwise("")
        span = F.struct(F.lit(label).alias("type"), acc["at"].alias("char_start"), (acc["at"] + F.length(inner)).alias("char_end"), inner.alias("matched_text"), F.lit(rule).alias("rule_idx"))
        return F.struct((acc["at"] + F.length(piece) - F.when(cut > 0, 1).otherwise(0)).cast("int").alias("at"), F.when(cut > 0, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).cast(SPAN).alias("found"))

    # Most texts match no pattern: the fold runs only where a match was marked.
    return F.when(holds(text, pattern), F.aggregate(pieces, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(SPAN))


def may_hold(text: Column, rules) -> Column:
    """The rules and candidates above all need a digit or an at sign: one look at a text spares most of them all others."""
    if all(pattern == MAIL for _, pattern in rules):
        return text.contains("@")
    return text.rlike(r"(?U)[\d@]") if set(rules) <= {*RULES, *CANDIDATES} else F.lit(True)


def has_span(text: Column, rules=RULES) -> Column:
    """Whether pii_spans finds any, by the same matches."""
    return once(lambda s: may_hold(s["t"], rules) & reduce(or_, (holds(s["t"], pattern) for _, pattern in rules), F.lit(False)), t=plain(text))


def pii_spans(text: Column, rules=RULES) -> Column:
    """Spans of all rules, in rule order, then by position."""

    def found(s: Column) -> Column:
        all_ = F.concat(*(matches(s["t"], pattern, label, i) for i, (label, pattern) in enumerate(rules)))
        return F.when(may_hold(s["t"], rules), all_).otherwise(F.array().cast(SPAN))

    return once(found, t=plain(text))


def has_pii(text: Column, rules=RULES) -> Column:
    t = F.coalesce(text, F.lit(""))
    return may_hold(t, rules) & t.rlike("(?U)" + "|".join(f"(?:{pattern})" for _, pattern in rules))


def confidence_of(kind: Column) -> Column:
    return F.when(kind.isin(*HIGH_PRECISION), HIGH).when(kind.isin(*AMBIGUOUS), MIDDLE).otherwise(WEAK)


def tier(confidence: Column, precise: Column, ambiguous: Column | None = None) -> Column:
    ambiguous = F.lit(False) if ambiguous is None else ambiguous
    return (
        F.when((confidence >= CONFIRMED) & precise, "auto_confirmed")
        .when(ambiguous, "needs_human_decision")
        .when((confidence < HUMAN) & ~precise, "auto_rejected")
        .otherwise("needs_human_decision")
    )


def scored(spans: Column) -> Column:
    """Candidates without the matched text."""

    def one(s: Column) -> Column:
        precise = s["type"].isin(*HIGH_PRECISION)
        c = confidence_of(s["type"])
        return F.struct(s["type"].alias("type"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end"), c.alias("confidence"), precise.alias("high_precision_pattern"), tier(c, precise, s["type"].isin(*AMBIGUOUS)).alias("confidence_tier"))

    return F.transform(spans, one)


def without_overlaps(spans: Column) -> Column:
    """By start, longer first, earlier rule first; a span that begins inside the one taken before is left out."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["char_start"].alias("char_start"), (s["char_start"] - s["char_end"]).alias("minus_length"), s["rule_idx"].alias("rule_idx"), s["char_end"].alias("char_end"), s["type"].alias("type"))))
    kind = "array<struct<char_start:int,minus_length:int,rule_idx:int,char_end:int,type:string>>"
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(kind).alias("taken"))

    def step(acc: Column, s: Column) -> Column:
        fits = s["char_start"] >= acc["end"]
        return F.struct(F.when(fits, s["char_end"]).otherwise(acc["end"]).alias("end"), F.when(fits, F.concat(acc["taken"], F.array(s))).otherwise(acc["taken"]).cast(kind).alias("taken"))

    return F.aggregate(ordered, start, step, lambda acc: acc["taken"])


def masked(text: Column, spans: Column | None = None) -> Column:
    """The text with each span replaced by [PII_type]."""
    t = plain(text)
    taken = without_overlaps(pii_spans(text) if spans is None else spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(t, acc["at"] + 1, s["char_start"] - acc["at"])
        return F.struct(s["char_end"].alias("at"), F.concat(acc["out"], gap, F.lit("[PII_"), s["type"], F.lit("]")).alias("out"))

    return F.aggregate(taken, start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))


def uncovered_numbers(text: Column) -> Column:
    """Runs with digits that touch no match of a rule or candidate, as matches()."""
    t = plain(text)
    known = F.concat(*(matches(t, p, label, i) for i, (label, p) in enumerate((*RULES, *CANDIDATES))))
    touched = lambda n, bounds: F.exists(bounds, lambda s: (s["char_start"] < n["char_end"]) & (s["char_end"] > n["char_start"]))
    return once(lambda s: F.filter(s["numbers"], lambda n: ~touched(n, s["known"])), numbers=matches(t, NUMBER, "숫자", -1), known=known)


def number_shapes(rows: DataFrame, top: int = 20, examples: int = 3) -> DataFrame:
    """rows(id, text) -> the most frequent shapes of uncovered runs (letters L, digits N, Hangul H, white space _), how often each
    occurs, and its first examples by id and place. Ties go to the shape that occurs first. The runs are checkpointed: texts are
    searched once."""
    has_digit = F.coalesce(F.col("text"), F.lit("")).rlike("(?U)" + NUMBER)
    spans = rows.where(has_digit).select("id", F.explode(uncovered_numbers(F.col("text"))).alias("s")).select("id", F.col("s.char_start").alias("at"), F.col("s.matched_text").alias("raw"))
    shape = F.col("raw")
    for pattern, letter in (("[A-Za-z]", "L"), ("[0-9]", "N"), ("[가-힣]", "H"), (r"(?U)\s+", "_")):
        shape = F.regexp_replace(shape, pattern, letter)
    spans = checkpointed(spans.withColumn("shape", shape))
    best = spans.groupBy("shape").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first")).orderBy(F.desc("n"), "first").limit(top)
    met = spans.join(F.broadcast(best.select("shape")), "shape")  # top rows
    # first within slices of a shape, then among those: no task gets all rows of a shape
    for slices in (64, 1):
        part = Window.partitionBy("shape", F.pmod(F.xxhash64("id"), F.lit(slices))).orderBy("id", "at")
        met = met.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= examples).drop("_k")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "at", "raw"))), lambda x: x["raw"]), "|")
    return best.join(met.groupBy("shape").agg(told.alias("examples")), "shape").select("shape", "n", "examples")


def masks_names(wanted: Column, grade: Column) -> Column:
    """Whether names are masked: always in calls of grade standard or excluded, else as wanted."""
    return F.when(grade.isin("standard", "excluded"), True).otherwise(F.coalesce(wanted, F.lit(False)))


def detected(text: Column, names: Column, grade: Column, name_spans: Column) -> Column:
    """Spans of all rules and, where the call's grade or `names` asks for it, name_spans of the same text."""
    asked = masks_names(names, grade)
    return F.concat(pii_spans(text), F.when(asked, name_spans).otherwise(F.array().cast(SPAN)))


def detected_batch(rows: DataFrame, name_spans: Column, names: bool = True) -> DataFrame:
    """rows(id, text, grade) -> id and the scored candidates of each text; names are looked for unless the caller says otherwise."""
    return rows.select("id", scored(detected(F.col("text"), F.lit(names), F.col("grade"), name_spans)).alias("spans"))
