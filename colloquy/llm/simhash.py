"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: lower-case A-Z, words [^\\x20\\x09-\\x0D]+, 3-word shingles with repeats; bit i is set when it is set in
over half of the shingles' XXH64 (seed 42). Equal fingerprints collapse first. The 64 bits are cut into five blocks;
3 differing bits touch three blocks at most, so each linked pair agrees on two whole blocks and meets in one of ten
tables (keys of 24 to 26 bits). Inside a bucket fingerprints are compared in bit-sliced form: 64 of them are
one column of vertical planes, differences go into carry-save counters, and a column is abandoned as soon as all of
its lanes are over the radius.

Large buckets are dealt in two steps, so that a group of M near copies costs work in proportion to M. First each is dealt
into chunks of a bounded size by a hash that differs from table to table, and only rows of one chunk meet; chunks of
different tables overlap, so this joins a group of near copies nearly always. Then the components so far are known,
and pairs of chunks meet except those whose rows all belong to one component. Nothing is left out: after
both steps every two rows of a bucket have met or are in one component. A task sends on one spanning forest of all the links
it has found, not its pairs.

Radius 3 finds copies that are very close. keep_one() also links texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Wide fingerprints of 256 bits meet in tables of sampled bits and are compared in the same
bit-sliced way; every pair within WIDE_RADIUS bits that isn't in one component yet is held against its shingle sets, which lie
in files of the shared folder, where the pair is found. At a similarity of 0.8 the vectors' angle is 27 degrees: 39 bits differ on average
(standard deviation 6), and all tables miss such a pair once or twice in a hundred. Fingerprints of few shingles spread more; texts
of SHORT shingles or fewer meet in one table more, by the rarest of their shingles: two such sets of similarity 0.8 share one
of these, so no pair among them is missed.

Defined results: null and empty texts have fingerprint 0 and link like any other; repeated rows with one doc_id share
its component in near_duplicates(); rows without doc_id have their component's id, or null where all of it lacks one; an empty table
gives an empty result; other columns are ignored. keep_one() takes rows that share a doc_id for different
documents if their texts differ, and for one document (they stay or go together) if not; rows without doc_id stay.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedFile, chunks, mix64, saved, shared_fs, text_key, texts, tidy, without, work_dir
from .graph import connected_components

RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SIMILARITY = 0.8
WIDE, WIDE_RADIUS = 4, 56  # 64-bit words of a wide fingerprint; bits within which pairs are looked at
TABLES, SAMPLED = 40, 14  # tables of wide fingerprints, bits in a key
SHORT = 40  # shingles of a text up to which its rarest ones are keys
SETS_AT_ONCE = 1 << 20  # shingles that are compared at once
CHUNK = 1024  # fingerprints in a chunk of a large bucket
PAIRS = 1 << 14  # fingerprint-column pairs that are compared at once
HELD = 1 << 20  # links that a task holds before it reduces them to a forest
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _block(i: int) -> int:
    at, n = BLOCKS[i]
    return ((1 << n) - 1) << at


MASKS = [[_block(i) | _block(j)] for i, j in combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)]


def _sampled(seed: int) -> list[list[int]]:
    r, out = random.Random(seed), []
    for _ in range(TABLES):
        masks = [0] * WIDE
        for bit in r.sample(range(64 * WIDE), SAMPLED):
            masks[bit // 64] |= 1 << bit % 64
        out.append(masks)
    return out


WIDE_MASKS = _sampled(5)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of (n, words) hashes, as words."""
    n, words = hashes.shape
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, n, 1 << 13):
        part = np.ascontiguousarray(hashes[at : at + (1 << 13)]).astype("<u8").view(np.uint8).reshape(-1, 8 * words)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8").astype(np.uint64)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str) -> int:
    return _narrow(_words(text))


def _narrow(ws: list[bytes]) -> int:
    if not ws:
        return 0
    h = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(ws, ws[1:], ws[2:])) if len(ws) > 2 else [b" ".join(ws)]
    return int(_majority(np.array([h(g, 42) for g in grams], np.uint64)[:, None])[0])


def wide_fingerprint(text: str) -> np.ndarray:
    """256 bits over the set of five-word shingles; without words all clear."""
    return _wide(_shingles(_words(text)))


def _wide(x: np.ndarray) -> np.ndarray:
    return _majority(np.stack([mix64(x + np.uint64(k + 1)) for k in range(WIDE)], 1)) if len(x) else np.zeros(WIDE, np.uint64)


def _shingles(ws: list[bytes]) -> np.ndarray:
    """Sorted distinct XXH64 of the five-word shingles; without words none."""
    if not ws:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(ws, ws[1:], ws[2:], ws[3:], ws[4:])) if len(ws) > 4 else [b" ".join(ws)]
    return np.unique(np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64))


def _fingerprints_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fp = np.fromiter(map(fingerprint, b.text), np.uint64, len(b))
        yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "f0": fp.view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0): the 64 bits as a signed long."""
    return texts(docs).mapInPandas(tidy(_fingerprints_of), "doc_id long, f0 long")


_SKETCH = "doc_id long, text_key long, s0 long, " + ", ".join(f"f{k} long" for k in range(WIDE)) + ", file long, at long, size long, short array<long>"


def _sketches_of(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sets of a task's texts go into one file; its name is the attempt's own, and only rows of finished attempts name it."""
        name, at, out = uuid.uuid4().int >> 65, 0, None
        for b in chunks(batches):
            small, wide, where, sizes, short = [], [], [], [], []
            for text in b.text:
                ws = _words(text)
                x = _shingles(ws)
                small.append(_narrow(ws))
                wide.append(_wide(x))
                grams = np.unique((x >> np.uint64(32)).astype("<u4"))
                short.append(grams.astype(np.int64).tolist() if len(grams) <= SHORT else None)
                if out is None:
                    store, path = shared_fs(f"{folder}/{name}")
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(path)
                where.append(at)
                sizes.append(len(grams))
                out.write(grams.tobytes())
                at += 4 * len(grams)
            fp = np.array(wide, np.uint64).reshape(len(b), WIDE).view(np.int64)
            rows = {"doc_id": b.doc_id.astype("Int64"), "text_key": b.text_key, "s0": np.array(small, np.uint64).view(np.int64)}
            yield pd.DataFrame(rows | {f"f{k}": fp[:, k] for k in range(WIDE)} | {"file": name, "at": where, "size": sizes, "short": short})
        if out is not None:
            out.close()

    return run


def planes(fps: np.ndarray) -> np.ndarray:
    """(columns, 64 lanes, words) fingerprints -> (bits, columns) vertical bit planes."""
    n, _, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(n, 64, 8 * words), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(64 * words, n).astype(np.uint64)


def within_radius(queries: np.ndarray, q: np.ndarray, plane: np.ndarray, c: np.ndarray, radius: int, known: list[int], outside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of queries[q] and columns c: (numbers of the pairs left, lanes at radius or fewer differing bits).

    Counters stand so that they run over at radius + 1. Four planes at a time go through full adders into the
    two lowest counters, one carry into the others; pairs whose lanes have all run over are abandoned.
    known: masks of the bits that agree. outside: lanes of each pair that don't count.
    """
    size = radius.bit_length()
    start = (1 << size) - 1 - radius
    left = np.arange(len(q))
    counter = [np.full(len(q), ALL if start >> k & 1 else 0, np.uint64) for k in range(size)]
    over = np.zeros(len(q), np.uint64) if outside is None else outside.copy()
    todo = [b for b in range(64 * queries.shape[1]) if not known[b // 64] >> b % 64 & 1]
    todo += [-1] * (-len(todo) % 4)
    nothing = None
    for n in range(0, len(todo), 4):
        d = []
        for bit in todo[n : n + 4]:
            if bit < 0:
                nothing = np.zeros(len(q), np.uint64) if nothing is None or len(nothing) != len(q) else nothing
                d.append(nothing)
            else:
                d.append(plane[bit][c] ^ (np.uint64(0) - ((queries[q, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1))))
        a = counter[0] ^ d[0]
        two = (counter[0] & d[0]) | (a & d[1])
        a ^= d[1]
        b = a ^ d[2]
        other = (a & d[2]) | (b & d[3])
        counter[0] = b ^ d[3]
        a = counter[1] ^ two
        carry = (counter[1] & two) | (a & other)
        counter[1] = a ^ other
        for k in range(2, size):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if n % 16 == 12:
            alive = over != ALL
            if not alive.all():
                left, q, c, over = left[alive], q[alive], c[alive], over[alive]
                counter = [x[alive] for x in counter]
            if not len(left):
                break
    return left, ~over


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (node, smallest node) for each component of the links u-v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


class Similar:
    """Whether pairs of rows are similar enough, by their shingle sets in files of the shared folder."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def __getstate__(self):
        return {"folder": self.folder, "files": {}}

    def _set(self, file: int, at: int, size: int) -> np.ndarray:
        if file not in self.files:
            if len(self.files) >= 256:
                self.files.clear()
            self.files[file] = SharedFile(f"{self.folder}/{file}")
        return self.files[file].read(at, 4 * size).view("<u4")

    def __call__(self, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """at: (rows, 3) file, place and size of each row's set; a, b: numbers of the pairs' rows."""
        n, m = at[a, 2], at[b, 2]
        out = n == m
        # sets of too different sizes can't be similar enough; two empty ones are equal
        todo = np.flatnonzero((np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)) & (n > 0))
        out &= n == 0
        todo = todo[np.argsort(a[todo], kind="stable")]
        starts = np.flatnonzero(np.r_[True, a[todo][1:] != a[todo][:-1]]) if len(todo) else []
        for s, e in zip(starts, [*starts[1:], len(todo)]):
            x = self._set(*at[a[todo[s]]].tolist())
            step = max(1, SETS_AT_ONCE // len(x))
            for p in range(s, e, step):
                k = todo[p : min(e, p + step)]
                others = [self._set(*r) for r in at[b[k]].tolist()]
                all_ = np.concatenate(others)
                hit = x[np.minimum(np.searchsorted(x, all_), len(x) - 1)] == all_
                same = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(m[k])[:-1]])
                out[k] = same >= SIMILARITY * (n[k] + m[k] - same) - 1e-9
        return out


class Forest:
    """Labels of components that links join."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.label = np.arange(len(names))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """a, b: current labels."""
        if len(a):
            u, v = stars(a, b)
            to = np.arange(len(self.names))
            to[u] = v
            self.label = to[self.label]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        k = np.flatnonzero(self.label != np.arange(len(self.names)))
        return self.names[k], self.names[self.label[k]]


def _pairs(fp: np.ndarray, group: np.ndarray, second: np.ndarray, table_of: np.ndarray, masks: list[list[int]], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (rows come sorted by it) within radius bits, each pair at least once, as a < b. second: the row
    belongs to the pair's second chunk; in a group with second rows, first rows meet second rows only."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    n_second = np.add.reduceat(second.astype(np.int64), starts)
    crossed = n_second > 0
    t_from = np.where(crossed, starts + sizes - n_second, starts)  # targets; queries are the rows before them, or all
    t_end = starts + sizes
    q_size = np.where(crossed, sizes - n_second, sizes)
    # Rows fill the lanes of columns in their order, small groups side by side; a query meets the columns of its group.
    padded = np.zeros((-(-len(fp) // 64) * 64, fp.shape[1]), np.uint64)
    padded[: len(fp)] = fp
    plane = planes(padded.reshape(-1, 64, fp.shape[1]))
    col_from = t_from // 64
    cols = (t_end - 1) // 64 - col_from + 1
    work = np.where(q_size * (t_end - t_from) > 1, q_size * cols, 0)
    for table in np.unique(table_of[starts]):
        of = np.flatnonzero((table_of[starts] == table) & (work > 0))
        ends = np.cumsum(work[of])
        total = int(ends[-1]) if len(of) else 0
        for at in range(0, total, PAIRS):
            k = np.arange(at, min(total, at + PAIRS))
            g = of[np.searchsorted(ends, k, side="right")]
            inner = k - (ends - work[of])[np.searchsorted(of, g)]
            q, c = starts[g] + inner // cols[g], col_from[g] + inner % cols[g]
            first = np.maximum(np.maximum(t_from[g], q + 1) - 64 * c, 0)  # a pair is met from its first row
            last = np.minimum(t_end[g] - 64 * c, 64)
            some = first < last
            q, c, first, last = q[some], c[some], first[some].astype(np.uint64), last[some].astype(np.uint64)
            if not len(q):
                continue
            outside = ~((ALL << first) & (ALL >> (np.uint64(64) - last)))
            # a table beyond the masks has keys that say more than the bits do
            left, near = within_radius(fp, q, plane, c, radius, masks[table], outside) if table < len(masks) else (np.arange(len(q)), ~outside)
            hit = np.flatnonzero(near)
            if len(hit):
                i, lane = np.nonzero(np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield q[left[hit[i]]], 64 * c[left[hit[i]]] + lane


def _settle(forest: Forest, comp: np.ndarray, fp: np.ndarray, at: np.ndarray, similar: Similar, a: np.ndarray, b: np.ndarray) -> None:
    """Holds all pairs a-b that the forest doesn't join against their sets: of each component the nearest first, then more and
    more, as most pairs of a group are joined by a few of them."""
    k = 1
    bits = None
    while True:
        ca, cb = forest.label[comp[a]], forest.label[comp[b]]
        open_ = ca != cb
        a, b, ca, cb, bits = a[open_], b[open_], ca[open_], cb[open_], None if bits is None else bits[open_]
        if not len(a):
            return
        if bits is None:
            bits = np.concatenate([np.bitwise_count(fp[a[i : i + PAIRS]] ^ fp[b[i : i + PAIRS]]).sum(1, dtype=np.int64) for i in range(0, len(a), PAIRS)])
        order = np.argsort(ca * 512 + bits, kind="stable")
        a, b, ca, cb, bits = a[order], b[order], ca[order], cb[order], bits[order]
        take = np.arange(len(a)) - np.searchsorted(ca, ca) < k
        good = similar(at, a[take], b[take])
        forest.join(ca[take][good], cb[take][good])
        a, b, bits = a[~take], b[~take], bits[~take]
        k *= 4


def _links_of(masks: list[list[int]], radius: int, words: int, similar: Similar | None):
    key = ["t", "m", "i"]

    def flush(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        keys = b[key].to_numpy()
        group = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(1)])
        fp = b[[f"f{k}" for k in range(words)]].to_numpy(np.int64).view(np.uint64)
        names, comp = np.unique(b.root.to_numpy(np.int64), return_inverse=True)
        forest = Forest(names)
        at = b[["file", "at", "size"]].to_numpy(np.int64) if similar else None
        for x, y in _pairs(fp, group, b.second.to_numpy(bool), b.t.to_numpy(), masks, radius):
            if similar:
                _settle(forest, comp, fp, at, similar, x, y)
            else:
                forest.join(forest.label[comp[x]], forest.label[comp[y]])
        return forest.links()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group, groups have 2 * CHUNK rows or so; a group is never cut."""
        rows: list[pd.DataFrame] = []
        n, links, found = 0, [], 0
        for b in batches:
            if not len(b):
                continue
            rows.append(b)
            n += len(b)
            if n >= 1 << 15:
                b = pd.concat(rows, ignore_index=True)
                other = (b[key] != b[key].iloc[-1]).any(axis=1).to_numpy()
                cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
                if cut:
                    links.append(flush(b.iloc[:cut]))
                    found += len(links[-1][0])
                    b = b.iloc[cut:].reset_index(drop=True)
                rows, n = [b], len(b)
            if found > HELD:
                links = [stars(*map(np.concatenate, zip(*links)))]
                found = 0
        if n:
            links.append(flush(pd.concat(rows, ignore_index=True)))
        if links:
            u, v = stars(*map(np.concatenate, zip(*links)))
            yield pd.DataFrame({"u": u, "v": v})

    return run


class Tables:
    """reps: one row per distinct fingerprint, with node, root (node at first), f0 .. of the fingerprint and, with similar,
    file, at, size and short of its shingle set."""

    def __init__(self, reps: DataFrame, masks: list[list[int]], radius: int, similar: Similar | None = None):
        self.reps, self.masks, self.radius, self.similar = reps, masks, radius, similar
        self.words = len(masks[0])
        self.columns = ["node", *(f"f{k}" for k in range(self.words)), *(["file", "at", "size"] if similar else [])]
        if similar:  # by how many short texts hold a shingle, the rarest first
            held = reps.where("short is not null and size > 0").select("node", "size", F.explode("short").alias("m"))
            rare = held.groupBy("m").agg(F.count("*").alias("n"))
            ranked = held.join(rare, "m").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "m"))).alias("s"))  # SHORT items at most
            # of two sets with similarity s, the larger of size n, one of the n - ceil(s n) + 1 rarest of each is shared
            first = (F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1).cast("int")
            self.rarest = saved(ranked.select("node", F.explode(F.slice("s", F.lit(1), first)).alias("s")).select("node", F.col("s.m").alias("m")), "simhash")

    def keys(self, reps: DataFrame) -> DataFrame:
        """(t, m, root, columns) of each row in each table."""

        def long(m: int):
            return F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")

        def key(ms: list[int]):
            parts = [F.col(f"f{k}").bitwiseAND(long(m)) for k, m in enumerate(ms)]
            return parts[0] if len(parts) == 1 else F.xxhash64(*parts)

        tables = F.array(*(F.struct(F.lit(t).alias("t"), key(ms).alias("m")) for t, ms in enumerate(self.masks)))
        keyed = reps.select("root", *self.columns, F.explode(tables).alias("k")).select("k.t", "k.m", "root", *self.columns)
        if self.similar:
            more = reps.select("root", *self.columns).join(self.rarest, "node").select(F.lit(len(self.masks)).alias("t"), "m", "root", *self.columns)
            keyed = keyed.unionByName(more)
        return keyed

    def _run(self, dealt: DataFrame) -> DataFrame:
        ordered = dealt.repartition("t", "m", "i").sortWithinPartitions("t", "m", "i", "second")
        return saved(ordered.mapInPandas(tidy(_links_of(self.masks, self.radius, self.words, self.similar)), "u long, v long"), "simhash")

    def first_links(self) -> DataFrame:
        """Links between rows of one chunk, and the list of large buckets."""
        keyed = self.keys(self.reps)
        counts = keyed.groupBy("t", "m").count()
        # wide tables have few empty buckets: only large ones are looked up
        counts = saved(counts.where(F.col("count") > (CHUNK if self.similar else 1)), "simhash")
        self.large = saved(counts.where(F.col("count") > CHUNK), "simhash")
        met = keyed.join(counts, ["t", "m"], "left" if self.similar else "inner")
        chunk = F.pmod(F.xxhash64("node", "t"), F.ceil(F.coalesce("count", F.lit(1)) / CHUNK))
        return self._run(met.withColumn("i", chunk).withColumn("second", F.lit(False)).drop("count"))

    def other_links(self, roots: DataFrame) -> DataFrame | None:
        """Links between rows of different chunks of large buckets, apart from those that roots(node, root) joins already."""
        if self.large.isEmpty():
            return None
        known = self.reps.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = self.keys(known).join(self.large.select("t", "m"), ["t", "m"])
        sizes = saved(rows.groupBy("t", "m", "root").count(), "simhash")
        apart = sizes.groupBy("t", "m").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("count") < CHUNK // 2, F.col("count"))).alias("small")).where("roots > 1")
        # a component with many rows has chunks of its own, which don't meet each other; the rest share chunks
        big = F.col("count") >= CHUNK // 2
        sizes = saved(sizes.join(apart, ["t", "m"]).select("t", "m", "root", F.when(big, F.col("root")).alias("own"), F.ceil(F.when(big, F.col("count")).otherwise(F.col("small")) / CHUNK).alias("chunks")), "simhash")
        spread = sizes.select("t", "m", "own", "chunks").distinct().select("t", "m", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("no")).select("t", "m", F.struct("own", "no").alias("c"))
        spread = saved(spread, "simhash")
        a, b = spread.select("t", "m", F.col("c").alias("a")), spread.select("t", "m", F.col("c").alias("b"))
        apart = F.coalesce(F.col("a.own") != F.col("b.own"), F.lit(True))
        met = saved(a.join(b, ["t", "m"]).where((F.col("a") <= F.col("b")) & apart).withColumn("pair", F.monotonically_increasing_id()), "simhash")
        own = rows.join(sizes, ["t", "m", "root"])
        own = own.withColumn("c", F.struct("own", F.pmod(F.when(F.col("own").isNull(), F.xxhash64("root")).otherwise(F.xxhash64("node")), F.col("chunks")).alias("no")))
        sides = met.select("t", "m", "pair", F.inline(F.array(F.struct(F.col("a").alias("c"), F.lit(False).alias("second")), F.struct(F.col("b").alias("c"), F.lit(True).alias("second")))).alias("c", "second"), (F.col("a") == F.col("b")).alias("same"))
        sides = sides.where("not (same and second)").select("t", "m", "pair", "second", F.col("c.own").alias("own"), F.col("c.no").alias("no"))
        dealt = own.select("t", "m", "root", F.col("c.own").alias("own"), F.col("c.no").alias("no"), *self.columns).alias("r").join(sides.alias("s"), F.expr("r.t = s.t and r.m = s.m and r.own <=> s.own and r.no = s.no"))
        return self._run(dealt.select("r.t", F.col("s.pair").alias("m"), F.lit(0).cast("long").alias("i"), "s.second", "r.root", *(f"r.{c}" for c in self.columns)))


def _components(tables: list[Tables], edges: DataFrame) -> DataFrame:
    """(node, root) over edges(u, v) and all links of tables."""
    for t in tables:
        edges = edges.union(t.first_links())
    roots = saved(connected_components(edges), "simhash")
    more = [x for x in (t.other_links(roots) for t in tables) if x is not None]
    if not more:
        return roots
    edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    for x in more:
        edges = edges.union(x)
    return saved(connected_components(edges), "simhash")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = saved(fingerprints(docs), "simhash")
    # a fingerprint that only rows without doc_id have is a component of its own, without an id
    reps = saved(fps.where("doc_id is not null").groupBy("f0").agg(F.min("doc_id").alias("node")).withColumn("root", F.col("node")), "simhash")
    roots = _components([Tables(reps, MASKS, RADIUS)], docs.sparkSession.createDataFrame([], "u long, v long"))
    of = reps.drop("root").join(roots, "node", "left").select("f0", F.coalesce("root", "node").alias("component_id"))
    return fps.join(saved(of, "simhash"), "f0", "left").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with doc_id: (node, doc_id, text_key), one node per document, and the (node, root) of those that are linked within
    RADIUS bits or by a similarity of SIMILARITY."""
    folder = work_dir(docs.sparkSession, "simhash-sets")
    rows = texts(docs.where("doc_id is not null")).withColumn("text_key", text_key())
    sketch = saved(rows.mapInPandas(tidy(_sketches_of(folder)), _SKETCH).withColumn("node", F.monotonically_increasing_id()), "simhash")
    wide = [f"f{k}" for k in range(WIDE)]
    narrow = saved(sketch.groupBy("s0").agg(F.min("node").alias("node"), F.count("*").alias("n")).withColumn("root", F.col("node")), "simhash")
    first = F.min(F.struct("node", "file", "at", "size", "short"))
    sets = saved(sketch.groupBy(*wide).agg(first.alias("r"), F.count("*").alias("n")).select(*wide, "r.*", "n").withColumn("root", F.col("node")), "simhash")
    own = [sketch.select(F.col("node").alias("u"), *k).join(r.where("n > 1").select(F.col("node").alias("v"), *k), k).where("u <> v").select("u", "v") for k, r in ((["s0"], narrow), (wide, sets))]
    same = sketch.groupBy("doc_id", "text_key").agg(F.min("node").alias("v"), F.max("node").alias("u")).where("u <> v").select("u", "v")
    tables = [Tables(narrow.withColumnRenamed("s0", "f0"), MASKS, RADIUS), Tables(sets, WIDE_MASKS, WIDE_RADIUS, Similar(folder))]
    roots = _components(tables, saved(own[0].union(own[1]).union(same), "simhash"))
    return sketch.select("node", "doc_id", "text_key"), roots


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each group of linked documents the one with the smallest doc_id (then
    the smallest hash of its text) stays. All columns return; rows without doc_id stay."""
    nodes, roots = near_groups(docs)
    linked = saved(nodes.join(roots, "node"), "simhash")
    best = linked.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    drop = linked.join(best, "root").where(F.struct("doc_id", "text_key") != F.col("best")).select("doc_id", "text_key").distinct()
    return without(docs, drop, "simhash")
