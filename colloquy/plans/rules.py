"""Small rules behind the row queries, and rescoring, whose text is a state that runs along a user's corrections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ALPHA_MAX, BETA_MAX, MARGIN, WEIGHT_MIN = 0.6, 0.4, 0.20, 2.0
MACHINE = "SPEAKER_IVR"


def speaker_id(given: Column) -> Column:
    """Null for a missing speaker and for the text none in any case."""
    return F.when(F.lower(F.trim(given)) != "none", given)


def is_human(label: Column) -> Column:
    return label.isNotNull() & (label != MACHINE)


def graded(text: Column) -> Column:
    """For grading: masks become one token, other signs blanks."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[PII_[^\]]*\]", "<PII>")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^0-9A-Za-z가-힣<> ]", " "), r"\s+", " "))


def bare(text: Column) -> Column:
    """Letters, digits and Hangul only, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z가-힣]", ""))


def protected(surface: Column, before: Column, after: Column, words: list[str]) -> Column:
    """A correction beside one of these words is never applied by itself."""
    around = F.concat_ws(" ", surface, before, after)
    out = F.lit(False)
    for w in words:
        out = out | around.contains(w)
    return out


def split_points(words: DataFrame, target: float, margin: float, pause: float = 0.3) -> DataFrame:
    """Cuts of a session about every target seconds: at the pause nearest to it within margin, else at the target."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        zero = float(pdf.start_sec.min())
        gaps = [(e - zero + s - zero) / 2 for e, s in zip(pdf.end_sec, pdf.start_sec.iloc[1:]) if s - e >= pause]
        total, at, cuts = float(pdf.end_sec.max()) - zero, 0.0, []
        while at + target < total:
            near = [g for g in gaps if abs(g - at - target) <= margin]
            at = min(near, key=lambda g: abs(g - at - target)) if near else at + target
            cuts.append(round(at, 6))
        return pd.DataFrame({"session_id": pdf.session_id.iloc[0], "cut": pd.Series(cuts, dtype=float)})

    return words.select("session_id", "word_idx", "start_sec", "end_sec").groupBy("session_id").applyInPandas(one, "session_id long, cut double")


def rescore(text: str, corrections: list[tuple[str, str, float, float]], phrase_boost: float, heard: float, language: float, alpha: float, beta: float, regression: bool | None = None) -> dict:
    """corrections (wrong, right, weight, margin) that passed their guards, in order; each replaces its first occurrence
    in the text as it stands then. regression: whether a golden set objects."""
    alpha, beta = min(max(alpha, 0.0), ALPHA_MAX), min(max(beta, 0.0), BETA_MAX)
    alpha = min(alpha, 1.0 - beta)
    margin, applied = 0.0, 0
    for wrong, right, weight, gain in corrections:
        if weight >= WEIGHT_MIN and wrong and wrong in text:
            changed = text.replace(wrong, right, 1)
            if changed != text:
                text, margin, applied = changed, margin + gain, applied + 1
    boost = min(1.0, phrase_boost / 10)
    margin += alpha * boost / 2
    doubt = applied > 0 and (margin < MARGIN or regression is True)
    return {"corrected": text, "n_applied": applied, "final_score": (1 - alpha - beta) * heard + alpha * boost + beta * language, "margin": margin, "safe": applied > 0 and not doubt, "needs_review": doubt}


def rescored_conversations(conversations: DataFrame) -> DataFrame:
    """Each turn rescored with the corrections its role keeps."""
    kept = {"user": [("the", "a", 3.0, 0.15), ("der", "das", 2.0, 0.1)], "assistant": [("que", "qui", 2.5, 0.3), ("and", "or", 1.0, 0.5)]}

    def run(batches):
        for b in batches:
            out = [rescore(t or "", kept.get(r, []), float(n), 0.8, 0.6, 0.3, 0.2) for t, r, n in zip(b["text"], b["role"], b["turn"])]
            yield pd.DataFrame({"conv_id": b["conv_id"], "turn": b["turn"], **{k: [o[k] for o in out] for k in ("n_applied", "final_score", "margin", "safe", "needs_review")}})

    return conversations.select("conv_id", "turn", "role", "text").mapInPandas(run, "conv_id long, turn long, n_applied int, final_score double, margin double, safe boolean, needs_review boolean")
