"""Exact substring dedup over prefix-partitioned suffix trees of words.

A window of WINDOW words repeats if a node of the suffix tree at that depth has leaves of several documents. The tree is cut
into subtrees by prefixes, and each is built from the words themselves, so no hash decides what is equal:

1. Seeds. The prefix that a window is filed under is the one of its SEED-word grams with the least hash: equal windows have equal
   seeds, and neighbours mostly share one. Seeds of at least two documents are aggregated and written as sorted
   files; windows with another seed cannot repeat.
2. Suffixes. Neighbouring windows with one seed travel as one piece of text, filed under their seed, or under the whole window
   where the seed occurs over HOT times, so no subtree outgrows memory. A subtree's suffixes are ranked by
   prefix doubling (1, 2, 4, 8 words, then the window): places with equal ranks share the prefix, which makes them the leaves of one internal
   node. Of a node's leaves the smallest doc_id stays and the others are covered. Each task builds the tree of its own suffixes
   first and sends on only leaves of each node's smallest document, so a passage that very many documents share reaches its
   subtree once per task.
3. Covered windows are gathered per document and the words they cover leave. Side by side they are the maximal repeats.

Defined results: null texts have no words; a row without doc_id counts as smaller than any; rows that repeat a doc_id
don't cover each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OPEN, chunks, hashes, map_shared, mix64, saved, texts, tidy, words, work_dir, write_shared

WINDOW = 13
SEED = 5
HOT = 10_000  # occurrences of a seed beyond which its windows are filed under all of their words
FILE = 1 << 16  # seeds in a file, about
PIECES = 1 << 14  # pieces of text whose subtrees are built together
NO_ID = -(2**63)
_M = np.uint64(0x9E3779B97F4A7C15)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _M + b)


def ranked(ids: np.ndarray, n: int) -> np.ndarray:
    """Numbers that are equal for places from which on the same n words stand, by doubling prefixes. Only places that n words follow
    count."""
    rank, size = ids.astype(np.int64), 1
    while size < n:
        step = min(size, n - size)
        later = np.r_[rank[step:], np.zeros(step, np.int64)][: len(rank)]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + later, return_inverse=True)[1]
        size += step
    return rank


def covered(rank: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a leaf's node (leaves of equal rank) has a leaf of a smaller document."""
    order = np.lexsort((ids, rank))
    first = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]]) if len(rank) else np.zeros(0, np.int64)
    low = np.repeat(ids[order][first], np.diff(np.r_[first, len(rank)]))
    out = np.zeros(len(rank), bool)
    out[order] = ids[order] > low
    return out


class Windows:
    """The joined words of a batch's documents; ok marks places where a window starts, seed is its prefix."""

    def __init__(self, batch_texts):
        lists = [words(t) for t in batch_texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        self.words = [w for x in lists for w in x]
        self.n = n = len(self.words)
        flat = np.empty(n, object)
        flat[:] = self.words
        self.ids, kinds = pd.factorize(flat)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.pos = np.arange(n) - (np.cumsum(sizes) - sizes)[self.doc]
        self.ok = self.pos + WINDOW <= sizes[self.doc]
        w = np.r_[hashes(list(kinds))[self.ids] if n else np.zeros(0, np.uint64), np.zeros(WINDOW + 8, np.uint64)]  # padding keeps the slices below in range
        two = _join(w[:-1], w[1:])
        four = _join(two[:-2], two[2:])
        gram = mix64(_join(four[:-1], w[4 : 4 + len(four) - 1]) + np.uint64(17))  # SEED words
        low = gram
        for step in (1, 2, 4):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[:-1], gram[8 : 8 + len(low) - 1])  # of WINDOW - SEED + 1 grams
        self.seed = mix64(low[:n])  # least hashes crowd at the low end; spread again
        eight = _join(four[:-4], four[4:])
        self.whole = _join(_join(eight[: len(four) - 8], four[8:])[:n], w[12 : 12 + n])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in chunks(batches):
        g, ids = Windows(b.text), b.doc_id.to_numpy(np.int64)
        at = np.flatnonzero(g.ok)
        if not len(at):
            continue
        seed, doc = g.seed[at], g.doc[at]
        change = np.r_[True, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])]
        seed, of = seed[change], ids[doc[change]]
        order = np.argsort(seed, kind="stable")
        seed, of = seed[order], of[order]
        starts = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
        yield pd.DataFrame({"seed": _signed(seed[starts]), "low": np.minimum.reduceat(of, starts), "high": np.maximum.reduceat(of, starts), "n": np.diff(np.r_[starts, len(seed)])})


def _file_writer(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf.part.iloc[0])
        order = np.argsort(pdf.seed.to_numpy(np.int64).view(np.uint64))
        seeds = pdf.seed.to_numpy(np.int64).view(np.uint64)[order]
        hot = (pdf.n.to_numpy() > HOT)[order].astype(np.uint8)
        write_shared(f"{folder}/{part}", [seeds.astype("<u8").tobytes(), hot.tobytes()])
        return pd.DataFrame({"part": [part], "n": [len(seeds)]})

    return run


class SeedSet:
    """Sorted seeds in files by their leading bits, mapped into memory as they are asked for."""

    def __init__(self, folder: str, bits: int, there: frozenset):
        self.folder, self.bits, self.there, self.files = folder, bits, there, {}

    def _file(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        if part not in self.files:
            if len(self.files) >= OPEN:
                self.files.pop(next(iter(self.files)))
            raw = map_shared(f"{self.folder}/{part}")
            n = len(raw) // 9
            self.files[part] = (raw[: 8 * n].view("<u8"), raw[8 * n :])
        return self.files[part]

    def find(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(member, hot) of each seed."""
        found, back = np.unique(seeds, return_inverse=True)
        member, hot = np.zeros(len(found), bool), np.zeros(len(found), bool)
        part = (found >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(found), np.int64)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(cuts, [*cuts[1:], len(part)]):
            if int(part[a]) in self.there:
                keys, flags = self._file(int(part[a]))
                k = np.minimum(np.searchsorted(keys, found[a:b]), len(keys) - 1)
                member[a:b] = keys[k] == found[a:b]
                hot[a:b] = member[a:b] & (flags[k] > 0)
        return member[back], hot[back]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


_ROW = "key long, doc_id long, text_key int, pos int, run int, line binary"


def _suffixes_of(folder: str, bits: int, there: frozenset):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = SeedSet(folder, bits, there)
        for b in chunks(batches):
            g, ids, text_key = Windows(b.text), b.doc_id.to_numpy(np.int64), b.text_key.to_numpy(np.int32)
            at = np.flatnonzero(g.ok)
            if len(at):
                member, hot = seeds.find(g.seed[at])
                at, hot = at[member], hot[member]
            if not len(at):
                continue
            # the words of all stretches of windows that may repeat, one after the other
            follows = np.r_[False, (at[1:] == at[:-1] + 1) & (g.doc[at[1:]] == g.doc[at[:-1]])]
            begin = np.flatnonzero(~follows)
            sizes = np.diff(np.r_[begin, len(at)])
            rank = ranked(g.ids[_places(at[begin], sizes + WINDOW - 1)], WINDOW)
            own = ids[g.doc[at]]
            done = covered(rank[_places(np.cumsum(sizes + WINDOW - 1) - sizes - WINDOW + 1, sizes)], own)
            # covered here: runs of windows
            c = np.flatnonzero(done)
            if len(c):
                start = np.flatnonzero(np.r_[True, ~(follows[c[1:]] & (c[1:] == c[:-1] + 1))])
                k = at[c[start]]
                d = g.doc[k]
                yield pd.DataFrame({"key": _signed(mix64(ids[d].view(np.uint64) ^ k.astype(np.uint64))), "doc_id": ids[d], "text_key": text_key[d], "pos": g.pos[k], "run": np.diff(np.r_[start, len(c)]), "line": None})
            c = np.flatnonzero(~done)
            same = follows[c[1:]] & (c[1:] == c[:-1] + 1) & ~hot[c[1:]] & ~hot[c[:-1]] & (g.seed[at[c[1:]]] == g.seed[at[c[:-1]]])
            start = np.flatnonzero(np.r_[True, ~same])
            n = np.diff(np.r_[start, len(c)])
            for p in range(0, len(start), PIECES):
                k = at[c[start[p : p + PIECES]]]
                d = g.doc[k]
                key = np.where(hot[c[start[p : p + PIECES]]], mix64(g.whole[k] + np.uint64(1)), g.seed[k])
                line = [b" ".join(g.words[x : x + m + WINDOW - 1]) for x, m in zip(k.tolist(), n[p : p + PIECES].tolist())]
                yield pd.DataFrame({"key": _signed(key), "doc_id": ids[d], "text_key": text_key[d], "pos": g.pos[k], "run": 0, "line": line})

    return run


def _subtree(b: pd.DataFrame) -> pd.DataFrame:
    """Covered runs of the pieces of whole groups, which come sorted by key."""
    split = [line.split(b" ") for line in b.line]
    sizes = np.array([len(x) for x in split], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for x in split for w in x]
    starts = np.cumsum(sizes) - sizes
    windows = sizes - WINDOW + 1
    key = b.key.to_numpy(np.int64)
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    rank = ranked(pd.factorize(flat)[0], WINDOW)[_places(starts, windows)]
    of = np.repeat(np.arange(len(b)), windows)
    done = covered(rank * (int(group[-1]) + 1) + group[of], b.doc_id.to_numpy(np.int64)[of])
    c = np.flatnonzero(done)
    first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1] + 1) | (of[c[1:]] != of[c[:-1]])]) if len(c) else c
    k = of[c[first]]
    inside = c[first] - (np.cumsum(windows) - windows)[k]
    return pd.DataFrame({"doc_id": b.doc_id.to_numpy()[k], "text_key": b.text_key.to_numpy()[k], "pos": b.pos.to_numpy()[k] + inside, "run": np.diff(np.r_[first, len(c)])})


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key; a group is never cut."""
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        ready = b.run > 0
        if ready.any():
            yield b.loc[ready, ["doc_id", "text_key", "pos", "run"]]
        b = b[~ready]
        if not len(b):
            continue
        held.append(b)
        n += len(b)
        if n >= PIECES:
            b = pd.concat(held, ignore_index=True)
            last = int(np.searchsorted(b.key.to_numpy(), b.key.iloc[-1]))
            if last:
                yield _subtree(b.iloc[:last])
                b = b.iloc[last:]
            held, n = [b], len(b)
    if n:
        yield _subtree(pd.concat(held, ignore_index=True))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text, at, runs in zip(b["text"], b["at"], b["runs"]):
            ws = words(text)
            if at is not None and len(at):
                ends = np.zeros(len(ws) + 1, np.int64)
                np.add.at(ends, np.asarray(at), 1)
                np.add.at(ends, np.minimum(np.asarray(at) + np.asarray(runs) + WINDOW - 1, len(ws)), -1)
                gone = np.cumsum(ends)[:-1] > 0
                kept = [w for w, x in zip(ws, gone) if not x]
            else:
                kept = ws
            rows.append((len(ws), len(ws) - len(kept), b" ".join(kept)))
        yield pd.DataFrame({"doc_id": b.doc_id, "n_words": [r[0] for r in rows], "n_removed": [r[1] for r in rows], "kept": [r[2] for r in rows]})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _cut(batches):
        yield b.drop(columns="kept").assign(kept_sha256=[hashlib.sha256(k).hexdigest() for k in b.kept])


def _texts_kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _cut(batches):
        yield b.drop(columns="kept").assign(text=[k.decode("utf-8", "replace") for k in b.kept])


def _with_covered(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.hash("text").alias("text_key"))
    seeds = rows.mapInPandas(tidy(_seeds), "seed long, low long, high long, n long").groupBy("seed").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    seeds = saved(seeds.where("low < high").select("seed", "n"), "substring")
    bits = max(0, int(seeds.count() // FILE).bit_length())
    folder = work_dir(spark, "substring-seeds")
    part = F.shiftrightunsigned("seed", 64 - bits).cast("int") if bits else F.lit(0)
    files = seeds.withColumn("part", part).groupBy("part").applyInPandas(_file_writer(folder), "part int, n long").collect()  # one row per file
    there = frozenset(r.part for r in files)
    pieces = rows.mapInPandas(tidy(_suffixes_of(folder, bits, there)), _ROW)
    gone = pieces.repartition("key").sortWithinPartitions("key").mapInPandas(tidy(_subtrees), "doc_id long, text_key int, pos int, run int")
    by_doc = gone.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("pos", "run")).alias("c"))  # at most a document's own windows
    return rows.join(by_doc, ["doc_id", "text_key"], "left").select("doc_id", "text", F.col("c.pos").alias("at"), F.col("c.run").alias("runs"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed and text, the kept words joined by one space."""
    return _named(_with_covered(docs).mapInPandas(tidy(_texts_kept), "doc_id long, n_words long, n_removed long, text string"))


def repeats(docs: DataFrame) -> DataFrame:
    """As without_repeats, with kept_sha256 instead of the text."""
    return _named(_with_covered(docs).mapInPandas(tidy(_digests), "doc_id long, n_words long, n_removed long, kept_sha256 string"))
