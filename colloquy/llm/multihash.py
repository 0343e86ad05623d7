"""Homomorphic multiset fingerprints of documents.

A paragraph (line) hashes to a wide vector: DIGEST lanes modulo 2^64 from an extendable hash of the whole paragraph, and
SKETCH lanes modulo 2^32, into which each 3-word shingle of the paragraph adds or subtracts one at a hashed lane. A
document's fingerprint is the lane-wise sum over its paragraphs, so the order of paragraphs does not matter, and
paragraphs are inserted or deleted by adding or subtracting their vectors. Equal fingerprints mean equal multisets
of paragraphs (up to collisions of the wide sum); the sketch lanes, read as signed numbers, give by their
cosine the share of shingles that two documents have in common; a lane would wrap beyond 2^31 equal
shingles of one document.

Defined results: null and empty texts are one empty paragraph; two texts without words are alike (1) if their
fingerprints are equal, else 0; a single document is its own next one; rows that repeat a doc_id follow in the
order of their texts' hashes; rows without doc_id come first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tidy

DIGEST, SKETCH = 16, 128
PART = 2000  # documents in a stretch of ascending doc_ids, about
MAX_PARTS = 20_000
NO_ID = -(2**63)


class Multihash:
    """A fingerprint that paragraphs can be added to and taken from."""

    __slots__ = ("digest", "sketch")

    def __init__(self, digest: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.digest = np.zeros(DIGEST, np.uint64) if digest is None else digest
        self.sketch = np.zeros(SKETCH, np.uint32) if sketch is None else sketch

    @classmethod
    def of(cls, text: str) -> Multihash:
        return cls().change(text.split("\n"), 1)

    def change(self, paragraphs: list[str], sign: int) -> Multihash:
        """A fingerprint with these paragraphs inserted (sign 1) or deleted (sign -1)."""
        shake, h = hashlib.shake_128, xxhash.xxh64_intdigest
        wide, grams = [], []
        for p in paragraphs:
            raw = p.encode("utf-8", "surrogatepass")
            wide.append(shake(raw).digest(8 * DIGEST))
            ws = raw.split()
            if len(ws) > 2:
                grams += [h(b" ".join(g)) for g in zip(ws, ws[1:], ws[2:])]
            elif ws:
                grams.append(h(b" ".join(ws)))
        digest = np.frombuffer(b"".join(wide), "<u8").reshape(-1, DIGEST).sum(0, dtype=np.uint64)
        x = np.array(grams, np.uint64)
        lane = (x & np.uint64(SKETCH - 1)).astype(np.int64)
        up = ((x >> np.uint64(32)) & np.uint64(1)).astype(np.int64)
        sketch = 2 * np.bincount(lane, up, SKETCH).astype(np.int64) - np.bincount(lane, minlength=SKETCH)
        if sign < 0:
            return Multihash(self.digest - digest, self.sketch - sketch.astype(np.uint32))
        return Multihash(self.digest + digest, self.sketch + sketch.astype(np.uint32))

    def hex(self) -> str:
        return (self.digest.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).hex()

    def likeness(self, other: Multihash) -> float:
        if (self.digest == other.digest).all() and (self.sketch == other.sketch).all():
            return 1.0
        a, b = self.sketch.view(np.int32).astype(np.float64), other.sketch.view(np.int32).astype(np.float64)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edited_hash(text: str, own: Multihash, changed: str) -> Multihash:
    """The edited text's fingerprint from that of the text: only paragraphs from the cut on are deleted and inserted."""
    cut = text.rfind("\n", 0, len(text) - len(text) // 4) + 1
    return own.change(text[cut:].split("\n"), -1).change(changed[cut:].split("\n"), 1)


def _stretches_of(bounds: np.ndarray, firsts: dict[int, int]):
    """Each row with its stretch; the first rows of a stretch also go to the end of the one before."""
    known = sorted(firsts)
    before = {s: known[k - 1] for k, s in enumerate(known)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = np.searchsorted(bounds, b.doc_id.to_numpy(np.int64), side="right")
            b = b.assign(part=part, tail=False)
            head = b[[firsts[int(p)] == i for p, i in zip(part, b.doc_id)]]
            yield pd.concat([b, head.assign(part=[before[int(p)] for p in head.part], tail=True)])[["part", "tail", "doc_id", "text_key", "text"]]

    return run


def _parts_of(bounds: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b.doc_id.to_numpy(np.int64)
            yield pd.DataFrame({"part": np.searchsorted(bounds, ids, side="right"), "doc_id": ids}).groupby("part", as_index=False).min()

    return run


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (part, tail, doc_id, text_key); each is done once the next one is known."""
    held: tuple | None = None
    ended = None  # the part whose tail has been used
    for b in batches:
        out = []
        for part, tail, doc_id, text in zip(b["part"], b["tail"], b["doc_id"], b["text"]):
            if tail and ended == part:
                continue
            own = Multihash.of(text)
            if held is not None:
                i, before, fp = held
                new = edited(before, text)
                changed = edited_hash(before, fp, new)
                out.append((i, len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp.hex(), changed.hex(), fp.likeness(changed), fp.likeness(own)))
            held, ended = (None, part) if tail else ((doc_id, text, own), ended)
        if out:
            d = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
            yield d.assign(doc_id=d.doc_id.astype("Int64").mask(d.doc_id == NO_ID))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts move once, to stretches of ascending doc_ids; a stretch ends with a copy of the next one's first row.
    """
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    ids = rows.select("doc_id")
    parts = max(1, min(MAX_PARTS, ids.count() // PART))
    cuts = ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))
    heads = {r.part: r.doc_id for r in ids.mapInPandas(tidy(_parts_of(bounds)), "part int, doc_id long").groupBy("part").agg(F.min("doc_id").alias("doc_id")).collect()}  # one row per stretch
    dealt = rows.mapInPandas(tidy(_stretches_of(bounds, heads)), "part int, tail boolean, doc_id long, text_key long, text string")
    return dealt.repartition("part").sortWithinPartitions("part", "tail", "doc_id", "text_key").mapInPandas(tidy(_in_order), _OUT)
