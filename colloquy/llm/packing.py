"""Packing token sequences by vector best-fit.

Every bin has three capacities: tokens, documents and attention cost (the sum of squared lengths). A piece goes
to the bin that keeps within all three and scores best, either by the norm of what stays free ("norm") or by the weighted
dot product of its demand with what is free ("dot"); longest pieces first. Bins with the same free amounts are
alike, and pieces of one length too, so the plan is made over counts: for each length, runs of pieces meet runs of
bins. Its size depends on the sequence length, not on the number of documents. A piece then finds its bin and place
from its length and its rank among the pieces of that length; ranks come from counts per part and length.

Defined results: null and empty texts are one piece that holds the separator alone; repeated rows are pieces of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, texts, tidy
from .tokens import Encoder, default_path

LENGTH = 2048
SEPARATOR = 0


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than length."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((at, length) for at in range(first, n, length))]


def _pieces_of(path: str, length: int, separator: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder.of(path), np.array([separator], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, row, text in zip(b.doc_id, b.row, b.text):
                ids = encoder.ids(text) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    rows.append((doc_id, row, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            out = pd.DataFrame(rows, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})
        encoder.forget()

    return run


def plan(counts: dict[int, int], length: int = LENGTH, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.02, 0.02), score: str = "norm") -> pd.DataFrame:
    """counts: pieces per length. Returns runs (length, first, n, bin, offset): pieces with ranks first .. first+n-1 go
    to bins bin .. bin+n-1, each at offset."""
    max_docs, max_cost = max_docs or length, max_cost or length * length
    if any(x * x > max_cost for x in counts) or max_docs < 1:
        raise ValueError("a piece alone exceeds a capacity")
    full = np.array([length, max_docs, max_cost], float)
    w = np.array(weights)
    state: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # free amounts -> runs of bins (first, n)
    runs, bins = [], 0
    for size in sorted(counts, reverse=True):
        todo, rank, demand = counts[size], 0, np.array([size, 1, size * size])
        while todo:
            free = np.array(list(state) or np.zeros((0, 3), int)).reshape(-1, 3)
            fits = np.flatnonzero((free >= demand).all(1)) if len(free) else []
            if len(fits):
                left = (free[fits] - demand) / full
                value = (w * left * left).sum(1) if score == "norm" else -(w * (demand / full) * (free[fits] / full)).sum(1)
                best = tuple(int(x) for x in free[fits[np.lexsort((*free[fits].T, value))[0]]])
                start, n = state[best].pop()
                if not state[best]:
                    del state[best]
                if n > todo:
                    state.setdefault(best, []).append((start + todo, n - todo))
                    n = todo
            else:
                each = min(length // size, max_docs, max_cost // (size * size))
                best, start, n = (length, max_docs, max_cost), bins, -(-todo // each)
                bins += n
                for k in range(each):  # bins are filled in turn with as many of this length as fit
                    m = min(n, todo)
                    if not m:
                        break
                    runs.append((size, rank, m, start, k * size))
                    after = (length - (k + 1) * size, max_docs - k - 1, max_cost - (k + 1) * size * size)
                    rank, todo = rank + m, todo - m
                    last = k + 1 == each or not todo
                    if last:
                        if m:
                            state.setdefault(after, []).append((start, m))
                        if m < n:
                            before = (length - k * size, max_docs - k, max_cost - k * size * size)
                            state.setdefault(before, []).append((start + m, n - m))
                continue
            runs.append((size, rank, n, start, length - best[0]))
            after = (best[0] - size, best[1] - 1, best[2] - size * size)
            if min(after) > 0:
                state.setdefault(after, []).append((start, n))
            rank, todo = rank + n, todo - n
    return pd.DataFrame(runs, columns=["length", "first", "n", "bin", "offset"]).sort_values(["length", "first"])


def _places_of(runs: pd.DataFrame):
    key = runs.length.to_numpy(np.int64) << 44
    first, start, offset = (runs[c].to_numpy(np.int64) for c in ("first", "bin", "offset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = np.searchsorted(key + first, (b.length.to_numpy(np.int64) << 44) + b["rank"].to_numpy(np.int64), side="right") - 1
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "piece": b.piece, "start": b.start, "length": b.length, "ids_crc32": b.ids_crc32, "sequence_id": start[k] + b["rank"] - first[k], "offset": offset[k]})

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, separator: int = SEPARATOR, **capacities) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    capacities: max_docs, max_cost, weights and score of plan(). By default documents and attention cost bind no
    earlier than the tokens do.
    """
    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
    pieces = saved(rows.mapInPandas(tidy(_pieces_of(tokenizer or default_path(), length, separator)), schema), "packing")
    part = F.shiftright("row", 33)  # the task that cut the piece
    counted = saved(pieces.groupBy(part.alias("part"), "length").count(), "packing")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = saved(counted.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "packing")
    totals = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("count").alias("n")).toLocalIterator()}  # length rows at most
    runs = plan(totals, length, **capacities)
    order = Window.partitionBy("part", "length").orderBy("row", "piece")
    ranked = pieces.withColumn("part", part).join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.row_number().over(order) - 1)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(tidy(_places_of(runs)), out)
