"""Runs of repeated word sequences by Lyndon arrays.

A run with root length p holds, in one of the two orders of the alphabet (words as they compare, or turned around), an
edge from each start of its Lyndon root to the next smaller suffix, p words on. One scan from left to right keeps the
chain of previous smaller suffixes. Two suffixes are compared by their longest common extension, and an extension is
never matched again: the furthest match seen so far makes a stretch the copy of an earlier one, so a pair inside the copy
takes over the extension of the pair it mirrors, and letters are compared from the end of that match on only. Words
are compared with each other, as an ordered alphabet; there is no suffix structure, and nothing is hashed.

An edge whose extension is at least `least - 2` periods long belongs to a run of `least` - 1 or more periods; it is
extended to the left by less than one period, as the edge one period before it tells the same run.

Defined results: null and empty texts have no words, no runs, and collapse to the empty text; repeated rows are treated one
by one; rows without doc_id are never made periodic; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import texts, tidy, words

LEAST, SHORTEST = 4, 6  # a run counts from so many periods and so many words on


def edges(w: list, turned: bool, least: int = LEAST, counter: list | None = None) -> list[tuple[int, int, int]]:
    """(i, j, extension): j starts the next smaller suffix after i, and both match over at least least - 2 times j - i words.

    w: words, none of them empty. turned: the order of the alphabet is turned around. counter[0] grows by the letters matched.
    """
    n, times, found = len(w), least - 2, []
    w = [*w, b"" if not w or isinstance(w[0], bytes) else ""]  # the end differs from all words
    following, before = [n] * n, [-1] * n  # next and previous smaller suffix
    to_following, to_before = [0] * n, [0] * n  # and the extensions with them
    shift = end = start = 0  # w[start:end] equals what stands shift places before it, w[end] doesn't
    for i in range(1, n):
        j, letter = i - 1, w[i]
        while True:
            if w[j] != letter:
                if (letter < w[j]) == turned:
                    before[i] = j
                    break
                following[j] = i
            else:
                # what is known: the pair mirrored by the match, or that pair whose right side is mirrored
                length, exact = 1, False
                if i < end:
                    left = end - i
                    a, b = (j - shift if j >= start else j), i - shift
                    mirrored = to_following[a] if 0 <= a < b and following[a] == b else to_before[b] if before[b] == a else -1
                    if a == b:  # j is the place that i mirrors
                        length, exact = left, True
                    elif mirrored >= 0:
                        length, exact = min(mirrored, left), mirrored != left
                if not exact:
                    x, y = j + length, i + length
                    while w[x] == w[y]:
                        x += 1
                        y += 1
                    if counter is not None:
                        counter[0] += y - i - length + 1
                    length = y - i
                    if y > end:
                        shift, end, start = i - j, y, i
                if (w[i + length] < w[j + length]) == turned:
                    before[i], to_before[i] = j, length
                    break
                following[j], to_following[j] = i, length
                if length >= times * (i - j):
                    found.append((j, i, length))
            j = before[j]
            if j < 0:
                break
    return [(i, j, length) for i, j, length in found if not (2 * i >= j and following[2 * i - j] == i and to_following[2 * i - j] == length + j - i)]


def runs(w: list, least: int = LEAST, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least `least` (3 or more) periods and `shortest` words, by start, then period."""
    out = []
    if len(w) >= shortest:
        for turned in (False, True):
            for i, j, right in edges(w, turned, least):
                period, left = j - i, 0
                while left < i and w[i - 1 - left] == w[j - 1 - left]:
                    left += 1
                length = left + period + right
                if length >= max(shortest, least * period):
                    out.append((i - left, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(w: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    out, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in found):
        if a > at:
            out += w[at:a]
        at = max(at, b)
    return out + w[at:] if found else w


def longest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; ties: the smallest start, then the smallest period."""
    best = None
    for r in found:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def looped(w: list, doc_id: int | None) -> list:
    """The words with, in every tenth document by the checksum of its doc_id, a loop from some word on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = w[a : a + p]
    return w[:a] + (root * ((n - a) // p + 1))[: n - a]


def _runs_of(make, least: int, shortest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.doc_id, b.text):
                w = words(text)
                if make:
                    w = make(w, None if pd.isna(doc_id) else int(doc_id))
                found = runs(w, least, shortest)
                collapsed = b" ".join(kept(w, found)).decode("utf-8", "surrogatepass")
                out.append((doc_id, [dict(zip(("start", "length", "period"), r)) for r in found], collapsed))
            d = pd.DataFrame(out, columns=["doc_id", "runs", "collapsed"])
            yield d.assign(doc_id=d.doc_id.astype("Int64"))

    return run


def find_runs(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """One row per row of docs: doc_id, runs (start, length, period), collapsed: the text with one period of each run left, its words
    joined by one space."""
    return texts(docs).mapInPandas(tidy(_runs_of(None, least, shortest)), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha = hashlib.sha256
    for b in batches:
        out = []
        for doc_id, text in zip(b.doc_id, b.text):
            w = looped(words(text), None if pd.isna(doc_id) else int(doc_id))
            found = runs(w)
            best = longest(found)
            of_best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
            out.append((doc_id, len(found), *of_best, sha(listed.encode()).hexdigest(), sha(b" ".join(kept(w, found))).hexdigest()))
        d = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        yield d.astype({c: "Int64" for c in ("doc_id", "start", "length", "period", "exponent_milli")})


def looped_runs(docs: DataFrame) -> DataFrame:
    """One row per row of docs, loops put into every tenth document: digests of its runs and of the collapsed text."""
    return texts(docs).mapInPandas(tidy(_digests), _OUT)
