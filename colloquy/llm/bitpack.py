"""Token ids as fixed-width bit-packed files, and reading them back.

File: 8 bytes of magic, a little-endian header of eight unsigned 64-bit numbers (version, bits, ids, documents, ids per
block, blocks, offset of the index, 0), the blocks, then the index: byte offset of each block (and of the end), doc_id
of each document, first id of each document (and the end). A block holds BLOCK ids of the minimum number of bits for
the vocabulary, lowest bit first, and starts at a byte; eight ids fill exactly `bits` bytes, so packing and unpacking
are a few numpy operations on whole columns and any id is found from its number alone.

Documents are dealt to files by ascending doc_id; a task streams its rows through one block at a time. The file's name
is the attempt's own, and only names that a finished task reported are read.

Defined results: null and empty texts hold the end id alone; rows that repeat a doc_id follow each other in the order of their texts' hashes; rows without
doc_id come first; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_shared, saved, shared_fs, texts, tidy, work_dir
from .tokens import Encoder, default_path

MAGIC = b"FWBITS01"
BLOCK = 1 << 16
END = 2


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    n = len(ids)
    lanes = np.zeros((-(-n // 8), 8), np.uint64)
    lanes.reshape(-1)[:n] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for j in range(8):
        for byte in range(j * bits // 8, (j * bits + bits - 1) // 8 + 1):
            shift = byte * 8 - j * bits
            out[:, byte] |= ((lanes[:, j] >> np.uint64(shift)) if shift >= 0 else (lanes[:, j] << np.uint64(-shift))).astype(np.uint8)
    return out.tobytes()


def unpack_ids(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    rows = np.asarray(data).reshape(-1, bits)
    out = np.zeros((len(rows), 8), np.uint64)
    for j in range(8):
        for byte in range(j * bits // 8, (j * bits + bits - 1) // 8 + 1):
            shift = byte * 8 - j * bits
            x = rows[:, byte].astype(np.uint64)
            out[:, j] |= (x << np.uint64(shift)) if shift >= 0 else (x >> np.uint64(-shift))
    return (out & np.uint64((1 << bits) - 1)).astype("<u4").reshape(-1)[:n]


class Writer:
    """Streams documents into one file."""

    def __init__(self, uri: str, bits: int):
        self.uri, self.bits, self.n = uri, bits, 0
        self.store, self.path = shared_fs(uri)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.store.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.held, self.held_n, self.at = [], 0, 8
        self.blocks, self.doc_ids, self.starts = [], [], []

    def add(self, doc_id: int, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.n)
        self.held.append(ids)
        self.held_n += len(ids) // 4
        self.n += len(ids) // 4
        if self.held_n >= BLOCK:
            flat = np.frombuffer(b"".join(self.held), "<u4")
            whole = len(flat) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(flat[k : k + BLOCK])
            self.held, self.held_n = [flat[whole:].tobytes()], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        data = pack_ids(ids, self.bits)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held_n:
            self._block(np.frombuffer(b"".join(self.held), "<u4"))
        index = self.at
        head = np.array([1, self.bits, self.n, len(self.doc_ids), BLOCK, len(self.blocks), index, 0], "<u8")
        for numbers in ([*self.blocks, index], self.doc_ids, [*self.starts, self.n]):
            self.out.write(np.array(numbers, "<i8").tobytes())
        self.out.write(head.tobytes())
        self.out.close()


class Reader:
    def __init__(self, uri: str):
        self.data = map_shared(uri)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError(f"{uri} isn't a bit-packed file")
        _, self.bits, self.n, docs, self.block, blocks, index, _ = (int(x) for x in self.data[-64:].copy().view("<u8"))
        numbers = self.data[index:-64].copy().view("<i8")
        self.offsets, self.doc_ids, self.starts = np.split(numbers, [blocks + 1, blocks + 1 + docs])

    def ids(self, start: int, n: int) -> np.ndarray:
        """Random access: ids start .. start+n-1, from the blocks that hold them."""
        first, last = start // self.block, max(start, start + n - 1) // self.block
        parts = []
        for k in range(first, last + 1):
            if k * self.block < self.n:
                size = min(self.block, self.n - k * self.block)
                parts.append(unpack_ids(self.data[self.offsets[k] : self.offsets[k + 1]], self.bits, size))
        flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        return flat[start - first * self.block : start - first * self.block + n]

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(len(self.offsets) - 1):
            yield k * self.block, self.ids(k * self.block, min(self.block, self.n - k * self.block))


def _writer_of(folder: str, path: str, end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, tail, out, first = Encoder.of(path), np.array([end], "<u4").tobytes(), None, None
        bits = bits_for(max(encoder.vocabulary, end + 1))
        for b in batches:
            for doc_id, text, h in zip(b.doc_id, b.text, b.h):
                out = out or Writer(f"{folder}/{uuid.uuid4().hex}.ids", bits)
                first = (0 if pd.isna(doc_id) else 1, 0 if pd.isna(doc_id) else int(doc_id), int(h)) if first is None else first
                out.add(-(2**63) if pd.isna(doc_id) else int(doc_id), encoder.ids(text) + tail)
        encoder.forget()
        if out:
            out.close()
            yield pd.DataFrame({"file": [out.uri], "null_last": [first[0]], "first_id": [first[1]], "first_h": [first[2]], "ids": [out.n], "docs": [len(out.doc_ids)]})

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Writes the files; returns file, start (ids of all files before it), ids and docs, one row per file."""
    ordered = texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    files = saved(ordered.mapInPandas(tidy(_writer_of(folder, tokenizer or default_path(), end)), "file string, null_last int, first_id long, first_h long, ids long, docs long"), "bitpack")
    rows = files.orderBy("null_last", "first_id", "first_h").toPandas()  # one row per file
    rows["start"] = rows.ids.cumsum() - rows.ids
    schema = "file string, start long, ids long, docs long"
    return docs.sparkSession.createDataFrame(rows[["file", "start", "ids", "docs"]], schema)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for uri, base in zip(b.file, b.start):
            f = Reader(uri)
            crc, k, ends = np.zeros(len(f.doc_ids), np.int64), 0, f.starts[1:]
            for at, ids in f.blocks():
                raw = ids.tobytes()
                while k < len(ends) and f.starts[k] < at + len(ids):
                    part = raw[4 * max(0, int(f.starts[k]) - at) : 4 * (min(int(ends[k]), at + len(ids)) - at)]
                    crc[k] = zlib.crc32(part, int(crc[k]))
                    if ends[k] > at + len(ids):
                        break
                    k += 1
            ids = pd.Series(f.doc_ids).astype("Int64")
            yield pd.DataFrame({"doc_id": ids.mask(ids == -(2**63)), "start": base + f.starts[:-1], "n_tokens": np.diff(f.starts), "ids_crc32": crc})


def read(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, files.count())
    return files.repartition(min(n, 100_000), "file").mapInPandas(tidy(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to the shared folder in the file format and reads them back."""
    return read(write(docs, work_dir(docs.sparkSession, "bitpack"), tokenizer))
