"""Exact duplicates through a minimal perfect hash over the digests seen before.

The index is cut into shards of about SHARD distinct digests. A shard's hash is built level by level: on each level
the digests that have a cell to themselves are placed, the others go on to the next; a digest's slot is the number of
set cells before its own, so n digests fill exactly n slots. A slot holds the whole SHA-256 and the winner (largest
doc_id, number of copies); a lookup counts only if all 32 bytes agree. Rows that aren't in the index are
grouped by digest apart.

Without a history of its own a table is split: half of its doc_ids, by hash, count as seen before. The index holds the distinct digests of
that half; lookups of the other half move the winners and counts of the slots they hit, then all rows look up theirs, and
nonmembers, texts that the first half lacks, group among themselves. The result does not depend on the split.

Defined results: null text is the empty text; repeated rows count as copies; rows without doc_id are compared as if
their doc_id were smaller than any; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeySet, mix64, rows_by_key, saved, texts

SHARD = 2048  # distinct digests in a shard of the index
DEALT = 4096  # rows that look up a shard in one task
LEVELS = 48


def _cells(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    return (mix64(keys + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) % np.uint64(m)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """digests: (n, 32) bytes, distinct. Returns the levels' cells and the slot of each digest."""
    keys, left = digests[:, :8].copy().view("<u8").reshape(-1), np.arange(len(digests))
    levels: list[np.ndarray] = []
    slot, base = np.zeros(len(digests), np.int64), 0
    while len(left) and len(levels) < LEVELS:
        m = max(8, 2 * len(left))
        cell = _cells(keys[left], len(levels), m)
        alone = np.bincount(cell, minlength=m) == 1
        placed = alone[cell]
        slot[left[placed]] = base + np.cumsum(alone)[cell[placed]] - 1
        base += int(alone.sum())
        levels.append(alone)
        left = left[~placed]
    slot[left] = base + np.arange(len(left))  # equal 8-byte keys: searched one by one
    return levels, slot


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def pack_shard(digests: np.ndarray, winners: np.ndarray, copies: np.ndarray) -> bytes:
    levels, slot = build_hash(digests)
    order = np.argsort(slot)
    return _packed(sizes=np.array([len(x) for x in levels], np.int64), cells=np.packbits(np.concatenate([*levels, np.zeros(0, bool)])), digests=digests[order], winners=winners[order], copies=copies[order])


class Shard:
    def __init__(self, blob: bytes):
        z = np.load(io.BytesIO(blob))
        self.sizes, self.packed, self.digests, self.winners, self.copies = z["sizes"], z["cells"], z["digests"], z["winners"], z["copies"]
        cells = np.unpackbits(self.packed)[: self.sizes.sum()].astype(bool)
        self.levels, at, base = [], 0, 0
        for m in self.sizes:
            level = cells[at : at + m]
            self.levels.append((level, base + np.cumsum(level) - 1))
            at, base = at + m, base + int(level.sum())
        self.placed = base

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where it isn't a member."""
        keys, found = digests[:, :8].copy().view("<u8").reshape(-1), np.full(len(digests), -1)
        left = np.arange(len(digests))
        for k, (level, rank) in enumerate(self.levels):
            cell = _cells(keys[left], k, len(level))
            hit = level[cell]
            found[left[hit]] = rank[cell[hit]]
            left = left[~hit]
        good = found >= 0
        good[good] = (self.digests[found[good]] == digests[good]).all(1)
        found[~good] = -1
        for s in range(self.placed, len(self.digests)):
            found[(digests == self.digests[s]).all(1)] = s
        return found


    def merge(self, digests: np.ndarray, winners: np.ndarray, copies: np.ndarray) -> bytes:
        """The shard with further copies of members counted in; digests are distinct and all members."""
        at = self.find(digests)
        self.winners[at] = np.maximum(self.winners[at], winners)
        self.copies[at] += copies
        return _packed(sizes=self.sizes, cells=self.packed, digests=self.digests, winners=self.winners, copies=self.copies)


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the whole text in UTF-8."""
    return texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))


def _shard_of(digest: str, shards: int):
    return F.pmod(F.conv(F.hex(F.substring(digest, 9, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    blob = pack_shard(_bytes(pdf.digest), pdf.winner.to_numpy(np.int64), pdf.copies.to_numpy(np.int64))
    return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "blob": [blob]})


def build_index(history: DataFrame) -> tuple[DataFrame, int]:
    """history(doc_id, digest) -> (shard, blob) and the number of shards. Copies are aggregated before anything is gathered."""
    seen = saved(history.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(-(2**63))).alias("winner"), F.count("*").alias("copies")), "exact")
    shards = max(1, -(-seen.count() // SHARD))
    blobs = seen.withColumn("shard", _shard_of("digest", shards)).groupBy("shard").applyInPandas(_build, "shard int, blob binary")
    return saved(blobs, "exact"), shards


_FOUND = "doc_id long, digest binary, keep_id long, group_size long, member boolean"


def _lookup(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    n = len(rows)
    found = Shard(index.blob.iloc[0]).find(_bytes(rows.digest)) if n and len(index) else np.full(n, -1)
    keep, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    hit = found >= 0
    if hit.any():
        shard = Shard(index.blob.iloc[0])
        keep[hit], size[hit] = shard.winners[found[hit]], shard.copies[found[hit]]
    return pd.DataFrame({"doc_id": rows.doc_id.astype("Int64"), "digest": rows.digest, "keep_id": keep, "group_size": size, "member": hit})


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """rows(doc_id, digest) -> also keep_id, group_size of the index and member. A shard that many rows ask for
    (one text may be a third of all) is read by several tasks, each with about DEALT of them."""
    rows = rows.withColumn("shard", _shard_of("digest", shards))
    deals = saved(rows.groupBy("shard").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("deals")), "exact")
    dealt = rows.join(deals, "shard").withColumn("deal", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("deals")).cast("int")).drop("deals")
    copies = index.join(deals, "shard").select("shard", "blob", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    return dealt.groupBy("shard", "deal").cogroup(copies.groupBy("shard", "deal")).applyInPandas(_lookup, _FOUND)


def _moved(index: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
    blobs = list(index.blob)
    if len(index) and len(more):
        blobs = [Shard(blobs[0]).merge(_bytes(more.digest), more.winner.to_numpy(np.int64), more.copies.to_numpy(np.int64))]
    return pd.DataFrame({"shard": index.shard, "blob": blobs})


def with_copies(index: DataFrame, shards: int, rows: DataFrame) -> DataFrame:
    """The index with rows(doc_id, digest) counted in where their digests are members."""
    hit = look_up(rows, index, shards).where("member")
    more = hit.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(-(2**63))).alias("winner"), F.count("*").alias("copies"))
    more = saved(more.withColumn("shard", _shard_of("digest", shards)), "exact")
    return saved(index.groupBy("shard").cogroup(more.groupBy("shard")).applyInPandas(_moved, "shard int, blob binary"), "exact")


def historic():
    """Which rows count as seen before where no history is given."""
    return F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(2)) == 0


def exact_duplicates(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    history: documents seen before (default: half of docs themselves, see above). A row whose text is in a history of its own
    belongs to the group of its winner there; the others are grouped among themselves. Of equal texts the row with the
    largest doc_id stays.
    """
    rows = saved(digests(docs), "exact")
    index, shards = build_index(rows.where(historic()) if history is None else digests(history))
    if history is None:
        index = with_copies(index, shards, rows.where(~historic()))
    found = saved(look_up(rows, index, shards), "exact")
    fresh = found.where("not member")
    groups = saved(fresh.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(-(2**63))).alias("keep_id"), F.count("*").alias("group_size")), "exact")
    found = found.where("member").select("doc_id", "digest", "keep_id", "group_size").union(fresh.select("doc_id", "digest").join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _digest_key(raw: bytes) -> int:
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "big")


def keep_one(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """docs without exact duplicates, all columns. Rows without doc_id stay; of rows that repeat a winner's doc_id and
    text one stays."""
    found = saved(exact_duplicates(docs.where("doc_id is not null"), history).select("doc_id", F.conv(F.substring("text_sha256", 1, 16), 16, -10).cast("long").alias("key"), "kept"), "exact")
    drop = found.where("not kept").select("doc_id", "key")
    twice = saved(found.where("kept").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "exact")
    out = rows_by_key(docs, KeySet(drop.union(twice), "exact"), _digest_key, False)
    if twice.isEmpty():
        return out
    return out.union(rows_by_key(docs, KeySet(twice, "exact"), _digest_key, True).dropDuplicates(["doc_id", "text"]))
