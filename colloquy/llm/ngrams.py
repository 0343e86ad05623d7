"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 holds the vocabulary: the sorted 64-bit hashes of the training words, so a word's id is its rank. A higher level
holds the n-grams seen at least MIN_COUNT times as children of the nodes one level down. Its levels are monotone
sequences in Elias-Fano form: a pointer sequence gives each parent's range, and children are kept context-relative, each
id added to the last value of the range before, so a child is found by one successor search for id plus base inside
its parent's range. Beside a child stands its discounted probability, beside a parent its back-off weight, both
quantised to 16 bits on a logarithmic scale. Levels are cut into files of about FILE nodes by ranges of (parent,
child), so a parent with very many children spans several files and none is built in one task. Executors map the files
of the shared folder into memory and read the pages they touch.

Counting covers every training document (crc32 of doc_id as text, mod 5, is not 1; rows without doc_id train). A
level's candidates are n-grams whose first and last n-1 words are nodes already, which loses none that is frequent enough.

    P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    Pk(w | h) = max(c(hw) - D, 0) / (c(h) + M) + B(h) P(k-1)(w | h'),  B(h) = 1 - sum of the first terms

Defined results: null and empty texts are the end token alone; with no training document N = V = 0 and every
token is unknown; repeated rows count and are scored as often as they are there; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hashes, map_shared, mix64, saved, texts, tidy, work_dir, write_shared

FOLDS, HELD_OUT = 5, 1
ORDER = 3
MIN_COUNT = 2
DISCOUNT = 0.75  # D
MASS = 4.0  # M
FILE = 1 << 18
COUNTS = "-counts"
CHARS = 3 << 20  # characters that a task looks at together
IDS = 2 << 20  # bytes of word ids that it does
BUCKET = 1 << 20  # training tokens for each bucket in which pairs are counted
HELD = 3_000_000  # distinct pairs that a task holds before it sends them on
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line feed
PROB, BACK = 4096.0, 4096.0  # steps per power of ten; 16 powers fit
_ALL, _L8, _H8 = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class EliasFano:
    """A monotone sequence of unsigned numbers: low bits packed side by side, high parts in a unary bit vector."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        """ranks: set bits, then clear bits before each 64-bit word of high and in all, stored beside it."""
        self.n, self.l, self.low, self.high = n, low_bits, low, high
        self.words = high.view("<u8")
        self.ones, self.zeros = np.split(ranks.view("<u4"), [len(self.words) + 1])

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[dict, list[bytes]]:
        n = len(values)
        low_bits = max(0, min(56, (universe // max(1, n)).bit_length() - 1))
        values = values.astype(np.uint64)
        if low_bits:
            bits = np.empty((n, low_bits), np.uint8)
            for k in range(low_bits):
                bits[:, k] = (values >> np.uint64(k)) & np.uint64(1)
            low = np.packbits(bits.reshape(-1), bitorder="little").tobytes() + b"\0" * 8
        else:
            low = b"\0" * 8
        low += b"\0" * (-len(low) % 8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = int(universe >> low_bits) + n + 2
        high = np.zeros(-(-size // 64) * 64, np.uint8)
        high[at] = 1
        high = np.packbits(high, bitorder="little")
        ones = np.r_[0, np.cumsum(np.bitwise_count(high.view("<u8")), dtype=np.int64)]
        if ones[-1] + 64 * len(ones) >= 1 << 32:
            raise ValueError("a sequence is too long for 32-bit ranks")
        ranks = np.r_[ones, 64 * np.arange(len(ones)) - ones].astype("<u4").tobytes()
        return {"n": n, "l": low_bits, "low": len(low), "high": len(high), "ranks": len(ranks)}, [low, high.tobytes(), ranks]

    def _select(self, before: np.ndarray, i: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Position of the i-th (from 0) set bit; with flip all ones, of the i-th clear one. Within a 64-bit word the
        eight bytes' running counts are compared at once."""
        i = np.asarray(i).astype("<u4")  # the ranks' own type, so that they are searched where they lie
        word = np.searchsorted(before, i, side="right") - 1
        left = (i - before[word]).astype(np.uint64)
        x = self.words[np.minimum(word, len(before) - 2)] ^ flip
        s = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
        s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
        s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _L8
        place = (((((left * _L8) | _H8) - s) & _H8) >> np.uint64(7)) * _L8 >> np.uint64(56) << np.uint64(3)
        place = np.minimum(place, np.uint64(56))
        left = left - (((s << np.uint64(8)) >> place) & np.uint64(255))
        byte = (x >> place) & np.uint64(255)
        return 64 * word + place.astype(np.int64) + _SELECT[byte.astype(np.int64), np.minimum(left, np.uint64(7)).astype(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        bit = i * self.l
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        x = np.zeros(len(i), np.uint64)
        for b in range((self.l + 14) // 8):
            x |= self.low[byte + b].astype(np.uint64) << np.uint64(8 * b) if b < 8 else np.uint64(0)
        return (x >> shift) & np.uint64((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(self.ones, i, np.uint64(0)) - i).astype(np.uint64)
        return (high << np.uint64(self.l)) | self._low(i)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each value in its own range begin .. end-1, or -1: the successors that share its high part
        are known from two selections of clear bits; their low bits are compared."""
        h = (value >> np.uint64(self.l)).astype(np.int64)
        known = h < int(self.zeros[-1])
        h = np.where(known, h, 0)
        first = np.where(h > 0, self._select(self.zeros, np.maximum(h - 1, 0), _ALL) - h + 1, 0)
        last = self._select(self.zeros, h, _ALL) - h
        at = np.maximum(first, begin)
        stop = np.minimum(last, end)
        want = value & np.uint64((1 << self.l) - 1)
        # Parents with very many children crowd their successors: those that share a high part are halved, not scanned.
        out = np.full(len(value), -1, np.int64)
        k = np.flatnonzero(known & (at < stop))
        low, high, want = at[k], stop[k], want[k]
        open_ = np.arange(len(k))
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            x = self._low(middle)
            below = x < want[open_]
            same = x == want[open_]
            out[k[open_[same]]] = middle[same]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[~same & (low[open_] < high[open_])]
        return out


def _pack_file(parts: list[tuple[dict | int, list[bytes]]]) -> list[bytes]:
    """Header of 32 numbers, then the parts."""
    head, body = [], []
    for about, data in parts:
        head += [about[k] for k in ("n", "l", "low", "high", "ranks")] if isinstance(about, dict) else [about]
        body += data
    return [np.array(head + [0] * (32 - len(head)), "<u8").tobytes(), *body]


class _File:
    def __init__(self, uri: str):
        self.raw = map_shared(uri)
        self.head = [int(x) for x in self.raw[:256].copy().view("<u8")]
        self.at, self.k = 256, 0

    def numbers(self, n: int) -> list[int]:
        self.k += n
        return self.head[self.k - n : self.k]

    def take(self, size: int) -> np.ndarray:
        self.at += size
        return self.raw[self.at - size : self.at]

    def sequence(self) -> EliasFano:
        n, low_bits, low, high, ranks = self.numbers(5)
        return EliasFano(n, low_bits, self.take(low), self.take(high), self.take(ranks))


# ---- level 1


def _vocabulary_writer(folder: str, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf.part.iloc[0])
        h = pdf.h.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        h, c = h[order], pdf.c.to_numpy(np.int64)[order]
        relative = h & np.uint64((1 << (64 - bits)) - 1)
        sequence = EliasFano.encode(relative, (1 << (64 - bits)) - 1)
        write_shared(f"{folder}/v{part}", _pack_file([sequence, (len(h), [c.astype("<u8").tobytes()])]))
        return pd.DataFrame({"part": [part], "n": [len(h)], "tokens": [int(c.sum())]})

    return run


class Vocabulary:
    def __init__(self, folder: str, bits: int, sizes: dict[int, int]):
        self.folder, self.bits = folder, bits
        self.base, at = {}, 0
        for part in sorted(sizes):
            self.base[part], at = at, at + sizes[part]
        self.files: dict[int, tuple[EliasFano, np.ndarray]] = {}

    def _open(self, part: int) -> tuple[EliasFano, np.ndarray]:
        if part not in self.files:
            f = _File(f"{self.folder}/v{part}")
            sequence = f.sequence()
            self.files[part] = (sequence, f.take(8 * f.numbers(1)[0]).view("<u8"))
        return self.files[part]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(cuts, [*cuts[1:], len(part)]):
            p = int(part[a])
            if p in self.base:
                sequence, c = self._open(p)
                at = sequence.find(hashes[a:b] & np.uint64((1 << (64 - self.bits)) - 1), np.zeros(b - a, np.int64), np.full(b - a, sequence.n))
                there = at >= 0
                ids[a:b][there] = self.base[p] + at[there]
                counts[a:b][there] = c[at[there]]
        return ids, counts

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        parts = sorted(self.base)
        starts = np.array([self.base[p] for p in parts])
        of = np.searchsorted(starts, ids, side="right") - 1
        out = np.zeros(len(ids), np.int64)
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(ids) else []
        for a, b in zip(cuts, [*cuts[1:], len(ids)]):
            out[a:b] = self._open(parts[of[a]])[1][ids[a:b] - starts[of[a]]]
        return out


# ---- higher levels


def _level_writer(folder: str, level: int, below, last_level: bool):
    """Each task gets a sorted range of (parent, child, c, kept, kinds) and writes it as one file; its counts, which only the next level's building needs, as another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]  # about FILE rows by the choice of partitions
        if not held:
            return
        b = pd.concat(held, ignore_index=True)
        parent, child, c = (b[x].to_numpy(np.int64) for x in ("parent", "child", "c"))
        context = below().count_of(parent)
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        pa, pb = int(parent[0]), int(parent[-1])
        pointers = np.searchsorted(parent, np.arange(pa, pb + 2))
        base = np.zeros(len(first), np.int64)
        last = np.r_[first[1:], len(parent)] - 1
        base[1:] = np.cumsum(child[last] + 0)[:-1]
        values = child + np.repeat(base, np.diff(np.r_[first, len(parent)]))
        p = (c - DISCOUNT) / (context + MASS)
        back = 1 - (b.kept.to_numpy(float) - DISCOUNT * b.kinds.to_numpy(float))[first] / (context[first] + MASS)
        code = np.clip(np.rint(-np.log10(p) * PROB), 0, 65535).astype("<u2")
        weight = np.zeros(pb - pa + 1, "<u2")
        weight[parent[first] - pa] = np.clip(np.rint(-np.log10(np.maximum(back, 1e-15)) * BACK), 0, 65535)
        name = f"{level}-{pa}-{int(child[0])}"
        write_shared(f"{folder}/{name}", _pack_file([(pa, []), (pb, []), EliasFano.encode(pointers, len(parent)), EliasFano.encode(values, int(values[-1])), (len(c), [code.tobytes(), b"\0" * (-2 * len(c) % 8)]), (len(weight), [weight.tobytes()])]))
        if not last_level:
            write_shared(f"{folder}/{name}{COUNTS}", c.astype("<u8").tobytes())
        yield pd.DataFrame({"name": [name], "parent": [pa], "child": [int(child[0])], "n": [len(c)]})

    return run


class _LevelFile:
    def __init__(self, uri: str):
        f = _File(uri)
        self.pa, self.pb = f.numbers(2)
        self.pointers, self.children = f.sequence(), f.sequence()
        n = f.numbers(1)[0]
        self.code = f.take(2 * n + -2 * n % 8)[: 2 * n].view("<u2")
        self.weight = f.take(2 * f.numbers(1)[0]).view("<u2")
        self.uri, self._count = uri, None

    @property
    def count(self) -> np.ndarray:
        if self._count is None:
            self._count = map_shared(f"{self.uri}{COUNTS}").view("<u8")
        return self._count

    def find(self, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, whether the parent has children here)."""
        # Pairs come sorted, so each parent's range and base are looked up once.
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(parent)]))
        one = parent[first]
        inside = (one >= self.pa) & (one <= self.pb)
        q = np.where(inside, one - self.pa, 0)
        begin, end = self.pointers.access(q).astype(np.int64), self.pointers.access(q + 1).astype(np.int64)
        there = inside & (end > begin)
        base = np.zeros(len(one), np.uint64)
        later = np.flatnonzero(there & (begin > 0))
        base[later] = self.children.access(begin[later] - 1)
        at = np.full(len(parent), -1, np.int64)
        k = np.flatnonzero(there[of])
        g = of[k]
        at[k] = self.children.find(base[g] + child[k].astype(np.uint64), begin[g], end[g])
        return at, there[of]


class Level:
    def __init__(self, folder: str, files: list[tuple[str, int, int, int]]):
        self.folder, self.names = folder, [f[0] for f in files]
        self.first_parent = np.array([f[1] for f in files], np.int64)
        self.starts = np.cumsum([0, *(f[3] for f in files)])
        self.rank = np.searchsorted(self.first_parent, self.first_parent)
        self.bound = (self.rank << 40) + np.array([f[2] for f in files], np.int64)
        self.files: dict[int, _LevelFile] = {}

    def _open(self, k: int) -> _LevelFile:
        if k not in self.files:
            self.files[k] = _LevelFile(f"{self.folder}/{self.names[k]}")
        return self.files[k]

    def find(self, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs sorted by (parent, child): (node or -1, first term, back-off weight of the parent)."""
        n = len(parent)
        node, p, back = np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
        if not n or not len(self.names):
            return node, p, back
        low = np.searchsorted(self.first_parent, parent)
        exact = (low < len(self.names)) & (self.first_parent[np.minimum(low, len(self.names) - 1)] == parent)
        of = np.searchsorted(self.bound, (low << 40) + np.where(exact, child, -1), side="right") - 1
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
        for a, b in zip(edges, [*edges[1:], n]):
            k, rows = int(of[order[a]]), order[a:b]
            there = np.zeros(len(rows), bool)
            if k >= 0:
                f = self._open(k)
                at, there = f.find(parent[rows], child[rows])
                hit = at >= 0
                node[rows[hit]] = self.starts[k] + at[hit]
                p[rows[hit]] = 10.0 ** (-f.code[at[hit]].astype(float) / PROB)
                back[rows[there]] = 10.0 ** (-f.weight[parent[rows[there]] - f.pa].astype(float) / BACK)
            # a parent whose children all lie after this pair begins in the next file
            rest = rows[~there]
            if k + 1 < len(self.names) and len(rest):
                f = self._open(k + 1)
                mine = rest[(parent[rest] >= f.pa) & (parent[rest] <= f.pb)]
                if len(mine):
                    q = parent[mine] - f.pa
                    some = f.pointers.access(q + 1) > f.pointers.access(q)
                    back[mine[some]] = 10.0 ** (-f.weight[q[some]].astype(float) / BACK)
        return node, p, back

    def count_of(self, nodes: np.ndarray) -> np.ndarray:
        """Counts of sorted nodes."""
        of = np.searchsorted(self.starts, nodes, side="right") - 1
        out = np.zeros(len(nodes), np.int64)
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(nodes) else []
        for a, b in zip(cuts, [*cuts[1:], len(nodes)]):
            out[a:b] = self._open(int(of[a])).count[nodes[a:b] - self.starts[of[a]]]
        return out


class Trie:
    """What a worker needs to open the files; it is pickled into tasks and holds one entry per file."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int], tokens: int):
        self.folder, self.bits, self.sizes, self.tokens = folder, bits, sizes, tokens
        self.kinds = sum(sizes.values())
        self.id_type = np.dtype("<u4" if self.kinds < (1 << 32) - 1 else "<u8")  # its greatest number: unknown
        self.levels: list[list[tuple[str, int, int, int]]] = []
        self._vocabulary, self._levels = None, {}

    def __getstate__(self):
        return {**self.__dict__, "_vocabulary": None, "_levels": {}}

    @property
    def vocabulary(self) -> Vocabulary:
        self._vocabulary = self._vocabulary or Vocabulary(self.folder, self.bits, self.sizes)
        return self._vocabulary

    def level(self, k: int) -> Level:
        """Level k, from 2."""
        if k not in self._levels:
            self._levels[k] = Level(self.folder, self.levels[k - 2])
        return self._levels[k]


def pair_order(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Order by (parent, child), children from -1."""
    width = int(child.max()) + 2 if len(child) else 1
    if len(child) and (int(parent.max()) + 1) * width < 1 << 63:
        return np.argsort(parent * width + child + 1)
    return np.lexsort((child, parent))


def token_hashes(batch_texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the joined tokens of texts, and how many each text has."""
    parts = []
    for t in batch_texts:
        parts += [hashes(t.encode("utf-8", "surrogatepass").lower().split()), END.reshape(1)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array([len(p) + 1 for p in parts[::2]], np.int64)


class Tokens:
    """The joined tokens of a batch of coded texts: document numbers, ids (-1: unknown) and counts."""

    def __init__(self, rows: list[bytes], trie: Trie):
        kind = trie.id_type
        self.sizes = np.array([len(r) // kind.itemsize for r in rows], np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        found, back = np.unique(np.frombuffer(b"".join(rows), kind), return_inverse=True)
        known = found != np.iinfo(kind).max
        ids, counts = np.where(known, found, 0).astype(np.int64), np.zeros(len(found), np.int64)
        counts[known] = trie.vocabulary.count_of(ids[known])
        self.ids, self.counts = np.where(known, ids, -1)[back], counts[back]
        self.follows = np.r_[False, self.doc[1:] == self.doc[:-1]] if len(self.doc) else np.zeros(0, bool)

    def look_up(self, level: Level, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: (node of parents' n-gram and this token, first term, weight); equal pairs are asked for once."""
        n = len(parents)
        node, p, back = np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
        ask = np.flatnonzero(parents >= 0)
        if len(ask):
            child = self.ids[ask]
            order = pair_order(parents[ask], child)
            ask, child = ask[order], child[order]
            parent = parents[ask]
            new = np.r_[True, (parent[1:] != parent[:-1]) | (child[1:] != child[:-1])]
            k = np.cumsum(new) - 1
            # an unknown token is no child, but its parent's weight counts
            a, b, c = level.find(parent[new], np.where(child[new] < 0, (1 << 40) - 1, child[new]))
            node[ask], p[ask], back[ask] = a[k], b[k], c[k]
        return node, p, back

    def parents(self, nodes: np.ndarray) -> np.ndarray:
        """For each token the node that ends at the token before it in its document, or -1."""
        return np.where(self.follows, np.r_[-1, nodes[:-1]], -1) if len(nodes) else nodes


def _unigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in chunks(batches, CHARS):
        h, c = np.unique(token_hashes(b.text)[0], return_counts=True)
        yield pd.DataFrame({"h": h.view(np.int64), "c": c})


def _coded_of(trie: Trie):
    """Texts as the ids of their tokens, side by side in bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = trie.id_type
        for b in chunks(batches, CHARS):
            h, sizes = token_hashes(b.text)
            found, back = np.unique(h, return_inverse=True)
            ids = trie.vocabulary.find(found)[0]
            raw = np.where(ids < 0, np.iinfo(kind).max, ids).astype(kind)[back]
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "ids": [x.tobytes() for x in np.split(raw, np.cumsum(sizes)[:-1])]})

    return run


def coded(docs: DataFrame, trie: Trie) -> DataFrame:
    """docs(doc_id, text) as (doc_id, ids): words are split and hashed once, all further passes read ids."""
    return docs.mapInPandas(tidy(_coded_of(trie)), "doc_id long, ids binary")


def _candidates_of(trie: Trie, level: int, least: int):
    """Pairs parent * words + child of the next level, both of whose n-1 word parts are nodes; a task counts its own
    pairs before it sends them on, dealt into buckets."""
    buckets = max(1, trie.tokens // BUCKET)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in chunks(batches, IDS, "ids"):
            t = Tokens(b.ids.to_list(), trie)
            nodes = t.ids
            for k in range(2, level):
                nodes = t.look_up(trie.level(k), t.parents(nodes))[0]
            parents = t.parents(nodes)
            take = (parents >= 0) & (nodes >= 0)
            if level == 2:  # words that are too rare are in no n-gram that is frequent enough
                take &= (t.counts >= least) & np.r_[False, t.counts[:-1] >= least]
            key, c = np.unique(parents[take] * np.int64(trie.kinds) + t.ids[take], return_counts=True)
            held.append((key, c))
            n += len(key)
            if n >= HELD:
                key, c = _summed(held)
                held, n = [(key, c)], len(key)
                if n > HELD // 2:
                    yield _dealt(key, c, buckets)
                    held, n = [], 0
        if n:
            yield _dealt(*_summed(held), buckets)

    return run


def _dealt(key: np.ndarray, c: np.ndarray, buckets: int) -> pd.DataFrame:
    """Pairs and counts side by side in bytes, one row for each bucket that has some."""
    bucket = (mix64(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket)
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    parts = list(zip(cuts, [*cuts[1:], len(key)]))
    key, c = key[order].astype("<i8"), c[order].astype("<u4")  # a task has fewer tokens than that
    return pd.DataFrame({"bucket": bucket[order][cuts], "pairs": [key[a:z].tobytes() for a, z in parts], "counts": [c[a:z].tobytes() for a, z in parts]})


def _merged_of(kinds: int, least: int):
    """All of a bucket's pairs: there are as many as BUCKET tokens make at most, on average, whatever the corpus' size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, c = _summed([(np.frombuffer(b"".join(pdf.pairs), "<i8"), np.frombuffer(b"".join(pdf.counts), "<u4").astype(np.int64))])
        key, c = key[c >= least], c[c >= least]
        return pd.DataFrame({"parent": key // kinds, "child": key % kinds, "c": c})

    return run


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, c = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(c[order], first)


def vocabulary_of(training: DataFrame) -> Trie:
    """Counts the words of training(doc_id, text): a trie of one level."""
    folder = work_dir(training.sparkSession, "ngrams")
    words = saved(training.mapInPandas(tidy(_unigrams), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "ngrams")
    bits = max(0, int(words.count() // FILE).bit_length())
    part = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    about = words.withColumn("part", part).groupBy("part").applyInPandas(_vocabulary_writer(folder, bits), "part int, n long, tokens long").toPandas()  # one row per file
    return Trie(folder, bits, dict(zip(about.part.tolist(), about.n.tolist())), int(about.tokens.sum()))


def grow(trie: Trie, training: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> Trie:
    """Adds the levels up to order, counted over all rows of training(doc_id, ids)."""
    folder = trie.folder
    for level in range(2, order + 1):
        nodes = trie.kinds if level == 2 else int(trie.level(level - 1).starts[-1])
        if nodes * trie.kinds >= 1 << 63:
            raise ValueError("the pairs of this level do not fit into 64 bits")
        pairs = training.mapInPandas(tidy(_candidates_of(trie, level, min_count)), "bucket long, pairs binary, counts binary")
        grams = saved(pairs.groupBy("bucket").applyInPandas(_merged_of(max(1, trie.kinds), min_count), "parent long, child long, c long"), "ngrams")
        sums = saved(grams.groupBy("parent").agg(F.sum("c").alias("kept"), F.count("*").alias("kinds")), "ngrams")
        rows = saved(grams.join(sums, "parent").select("parent", "child", "c", "kept", "kinds"), "ngrams")
        files = max(1, -(-rows.count() // FILE))
        below = (lambda t=trie: t.vocabulary) if level == 2 else (lambda t=trie, k=level - 1: t.level(k))
        ranged = rows.repartitionByRange(files, "parent", "child").sortWithinPartitions("parent", "child")
        written = ranged.mapInPandas(tidy(_level_writer(folder, level, below, level == order)), "name string, parent long, child long, n long").toPandas()
        written = written.sort_values(["parent", "child"])
        trie.levels.append(list(written.itertuples(index=False, name=None)))
    return trie


def build(training: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> Trie:
    """Counts all rows of training(doc_id, text) and writes the trie to the shared folder."""
    trie = vocabulary_of(training)
    return grow(trie, saved(coded(training, trie), "ngrams-ids"), order, min_count)


def _scores_of(trie: Trie):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = trie.tokens + 0.5 * (trie.kinds + 1)
        for b in chunks(batches, IDS, "ids"):
            t = Tokens(b.ids.to_list(), trie)
            p = (t.counts + 0.5) / whole
            n = len(b)
            base = np.bincount(t.doc, np.log10(p), n)
            nodes = t.ids
            for k in range(2, 2 + len(trie.levels)):
                nodes, term, back = t.look_up(trie.level(k), t.parents(nodes))
                p = term + back * p
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "n_tokens": t.sizes, "n_known": np.bincount(t.doc, t.counts > 0, n).astype(np.int64), "base_score": base, "score": np.bincount(t.doc, np.log10(p), n)})

    return run


def scored(rows: DataFrame, trie: Trie) -> DataFrame:
    """rows(doc_id, ids): doc_id, n_tokens, n_known, base_score, score of each."""
    return rows.mapInPandas(tidy(_scores_of(trie)), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, base_score, score."""
    return scored(coded(texts(docs), trie), trie)


def lm_scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """Learns from the training fold of docs and scores all rows. min_count: how often an n-gram of two words or more has to
    occur to be a node; what rarer ones would say comes from the words' own level."""
    rows = texts(docs)
    trie = vocabulary_of(rows.where(~held_out()))
    ids = saved(coded(rows, trie), "ngrams-ids")
    out = scored(ids, grow(trie, ids.where(~held_out()), order, min_count))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")
