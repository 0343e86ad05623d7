"""What the operators of this subpackage share: the shared work folder, files in it, words."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from functools import wraps

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on this machine alone (tests) is a folder of this machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "colloquy-work")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut and lost executors cost no recomputation."""
    spark = df.sparkSession
    schema, path = df.schema, work_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def texts(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Only key and text (null: empty), so that no other column's name can clash."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))


def text_key(column: str = "text"):
    """A 64-bit hash of a text (null: empty); with doc_id it tells rows apart that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def text_key_of(raw: bytes) -> int:
    """text_key() of a text's UTF-8 bytes, in Python."""
    return xxhash.xxh64_intdigest(raw, 42)


def _pair_hash(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix64(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys.view(np.uint64))


KEYS_IN_FILE = 1 << 18
OPEN = 16  # files that a task holds open


def spark_hash(x: np.ndarray) -> np.ndarray:
    """F.xxhash64 of a column of longs, in numpy."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turned(x.view(np.uint64) * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _keys_writer(folder: str):
    def run(pdf):
        import pandas as pd

        ids, keys = pdf.doc_id.to_numpy(np.int64), pdf.key.to_numpy(np.int64)
        h = _pair_hash(ids, keys)
        order = np.argsort(h)
        part = int(pdf.part.iloc[0])
        write_shared(f"{folder}/{part}", [x[order].astype("<u8").tobytes() for x in (h, ids.view(np.uint64), keys.view(np.uint64))])
        return pd.DataFrame({"part": [part]})

    return run


class KeySet:
    """A set of (doc_id, key) pairs in sorted files of the shared folder, mapped into memory by whoever asks."""

    def __init__(self, pairs: DataFrame, tag: str):
        """pairs(doc_id, key): longs."""
        pairs = saved(pairs.select("doc_id", "key").where("doc_id is not null").distinct(), tag)
        self.n = pairs.count()
        self.parts = max(1, -(-self.n // KEYS_IN_FILE))
        self.folder = work_dir(pairs.sparkSession, f"{tag}-keys")
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int"))
        done = dealt.groupBy("part").applyInPandas(_keys_writer(self.folder), "part int").collect()  # one row per file
        self.there = frozenset(r.part for r in done)
        self.files: dict = {}

    def __getstate__(self):
        return {**self.__dict__, "files": {}}

    def find(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether each pair is a member; all three columns have to agree."""
        out = np.zeros(len(ids), bool)
        part = np.mod(spark_hash(ids), self.parts) if len(ids) else ids
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(ids) else []
        for a, b in zip(edges, [*edges[1:], len(ids)]):
            rows, p = order[a:b], int(part[order[a]])
            if p not in self.there:
                continue
            if p not in self.files:
                if len(self.files) >= OPEN:
                    self.files.pop(next(iter(self.files)))
                self.files[p] = map_shared(f"{self.folder}/{p}").view("<u8").reshape(3, -1)
            known, known_ids, known_keys = self.files[p]
            i, k = ids[rows], keys[rows]
            h = _pair_hash(i, k)
            at = np.searchsorted(known, h)
            asked = np.flatnonzero(at < len(known))
            while len(asked):  # equal hashes stand side by side
                n = at[asked]
                same = known[n] == h[asked]
                asked, n = asked[same], n[same]
                out[rows[asked]] |= (known_ids[n] == i[asked].view(np.uint64)) & (known_keys[n] == k[asked].view(np.uint64))
                at[asked] += 1
                asked = asked[at[asked] < len(known)]
        return out


def rows_by_key(docs: DataFrame, keys: KeySet, key_of, member: bool) -> DataFrame:
    """The rows of docs, all columns, whose (doc_id, key_of(text)) is in keys, or is not. Rows stay where they are: no
    text is shuffled. Rows without doc_id are no members."""
    import pyarrow as pa

    def run(batches):
        for b in slices(batches):
            ids = b.column(b.schema.get_field_index("doc_id"))
            known = np.asarray(ids.is_valid())
            numbers = np.asarray(ids.cast(pa.int64()).fill_null(0)).astype(np.int64)
            text = b.column(b.schema.get_field_index("text")).cast(pa.large_string())
            found = np.array([key_of((t or "").encode("utf-8", "surrogatepass")) for t in text.to_pylist()], np.uint64).view(np.int64)
            yield b.filter(pa.array((known & keys.find(numbers, found)) == member))

    return docs.mapInArrow(tidy(run), docs.schema)


def without(docs: DataFrame, drop: DataFrame, tag: str = "drop") -> DataFrame:
    """docs without the rows in drop(doc_id, text_key), all columns. Rows without doc_id stay."""
    return rows_by_key(docs, KeySet(drop.select("doc_id", F.col("text_key").alias("key")), tag), text_key_of, False)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_fs(uri: str):
    """(pyarrow file system, path) of a folder or file of the shared store; usable on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri)


def write_shared(uri: str, data) -> None:
    """Writes a file under a name of its own attempt and renames it, so that a retried task never leaves half a file."""
    store, path = shared_fs(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        for chunk in data if isinstance(data, (list, tuple)) else [data]:
            out.write(chunk)
    store.move(part, path)


def map_shared(uri: str):
    """A file's bytes as a numpy array: memory-mapped where the store is a file system, else read whole."""
    store, path = shared_fs(uri)
    if store.type_name == "local":
        return np.memmap(path, np.uint8, "r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, np.uint8)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


class SharedFile:
    """Ranges of a file of the shared store: of a memory map where it is a file system, else read one by one."""

    def __init__(self, uri: str):
        store, path = shared_fs(uri)
        self.raw = map_shared(uri) if store.type_name == "local" else None
        self.file = None if store.type_name == "local" else store.open_input_file(path)

    def read(self, at: int, n: int) -> np.ndarray:
        return self.raw[at : at + n] if self.file is None else np.frombuffer(self.file.read_at(n, at), np.uint8)


def words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8: bytes.split() parts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split()


def chunks(batches, chars: int = 4 << 20, column: str = "text"):
    """Batches cut so that each holds about chars characters, or one longer text."""
    for b in batches:
        if len(b):
            total = np.cumsum(b[column].str.len().to_numpy(np.int64))
            cuts = np.flatnonzero(np.diff(total // chars)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(b)]):
                yield b.iloc[a:z]


def slices(batches, rows: int = 1000):
    """Arrow batches in slices of so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def tidy(run):
    """run, a function over a task's batches, that gives freed memory back to the system at its end: workers live on and are shared by all
    stages of a session."""

    @wraps(run)
    def tidied(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
