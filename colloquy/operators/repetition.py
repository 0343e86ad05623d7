"""Collapse of words and two-word phrases that repeat side by side.

A text's words become numbers; how often a pair or a word repeats from each place on is known for all places at once, and
only the places where something repeats often enough are visited, from left to right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTENT = re.compile("[0-9A-Za-z가-힣]")


def _run_to(same: np.ndarray) -> np.ndarray:
    """For each place the first place from there on where `same` is false."""
    ends = np.where(same, len(same), np.arange(len(same)))
    return np.minimum.accumulate(ends[::-1])[::-1]


def kept_words(ws: list[str], least: int = 3, keep: int = 1, pairs: bool = True) -> tuple[list[int], int]:
    """Numbers of the words that stay, and how many repeats went. A pair that repeats comes before a single word; what
    repeats must hold two content characters or more, so one-syllable nods stay."""
    n = len(ws)
    code = pd.factorize(np.array(ws, object))[0] if n else np.zeros(0, np.int64)
    one = _run_to(np.r_[code[1:] == code[:-1], False]) + 1 if n else code  # end of the run of equal words
    times = one - np.arange(n)
    twice = np.zeros(n, np.int64)
    if pairs and n > 1:
        again = np.r_[code[2:] == code[:-2], False, False]
        twice = (_run_to(again) - np.arange(n)) // 2 + 1
        twice[-1] = 0
    many = np.flatnonzero((times >= least) | (twice >= least))
    if not len(many):
        return list(range(n)), 0
    content = {k: len(CONTENT.findall(ws[k])) for k in {x for m in many.tolist() for x in (m, min(m + 1, n - 1))}}
    begins = np.r_[True, code[1:] != code[:-1]]
    out: list[int] = []
    gone = at = 0
    for k in many.tolist():
        if k < at or k > at and not begins[k]:  # inside what has been taken, or of a run that began before
            continue
        pair = twice[k] >= least and content[k] + content[min(k + 1, n - 1)] >= 2
        if not pair and not (times[k] >= least and content[k] >= 2):
            continue
        width, count = (2, int(twice[k])) if pair else (1, int(times[k]))
        out += [*range(at, k), *(k + i for _ in range(keep) for i in range(width))]
        gone += count - keep
        at = k + width * count
    return out + list(range(at, n)), gone


def collapse(text: str, least: int = 3, keep: int = 1) -> tuple[str, int]:
    ws = text.split()
    stay, gone = kept_words(ws, least, keep)
    return " ".join(ws[k] for k in stay), gone


def _collapsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        done = [collapse(t) for t in b["text"]]
        yield pd.DataFrame({"id": b["id"], "text": [t for t, _ in done], "collapsed": [n for _, n in done]})


def collapsed(rows: DataFrame, key: str) -> DataFrame:
    named = rows.select(F.col(key).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInPandas(_collapsed, "id long, text string, collapsed int").withColumnRenamed("id", key)


_WORDS = "array<struct<word:string,start_sec:double,end_sec:double>>"


def _collapsed_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for text, words in zip(b["text"], b["words"]):
            ws = list(words) if words is not None else []
            stay, n_words = kept_words([(w["word"] or "").strip() for w in ws], pairs=False)
            line, n_text = collapse(text)
            out.append((line if n_text else text, [ws[k] for k in stay], n_words if ws else n_text))
        yield pd.DataFrame({"id": b["id"], "text": [t for t, _, _ in out], "words": [w for _, w, _ in out], "collapsed": [n for _, _, n in out]})


def collapsed_segments(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, text, words): text and timed words in step. Words repeat singly only; the count is that of the words where there are any,
    and a text in which nothing repeats stays as it was."""
    named = rows.select(F.col(key).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("words").cast(_WORDS).alias("words"))
    return named.mapInPandas(_collapsed_segments, f"id long, text string, words {_WORDS}, collapsed int").withColumnRenamed("id", key)
