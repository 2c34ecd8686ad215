"""Packing along a space-filling curve.

Each document's token ids are hashed into a vector, projected to few dimensions and given a Hilbert key;
documents are range-sorted by key (then id, so that equal keys split), and each partition lays them end
to end into sequences. A sequence has `length` tokens; what a partition has left is cut into powers of
two, which need no padding. So there is no padding at all.

Documents travel in pieces of PIECE tokens at most, so ranges that hold equally many rows hold about equally
many tokens, however long a document is; the number of ranges follows the volume of tokens.

Defined results. Null or empty text: the end id alone. Null doc_id: sorts first among equal keys.
Repeated rows: each is packed. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._shared import give_back, lean, small_batches, stored_bytes, workspace, written
from .tokens import library_cache, library_encoder, tokenizer_path

DIMS, ORDER, FEATURES, SEED = 4, 10, 256, 20
#: Tokens of a piece of a document on its way to its range; bytes of stored tokens that a range should hold.
PIECE, RANGE_BYTES = 1 << 14, 32 << 20
#: Texts that a worker gets at once: fewer take less memory, but equal chunks are looked up more often.
BATCH = 2000

OUT = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def projection(vocabulary: int) -> np.ndarray:
    """For each id the projected vector of its hashed feature: hashing, then a random projection."""
    hashed = (np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    return np.random.default_rng(SEED).standard_normal((FEATURES, DIMS))[hashed.astype(np.int64) % FEATURES].astype(np.float32)


def hilbert_key(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Index along the Hilbert curve of points with integer coordinates below 2**order; cells is (points, dimensions)."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    q = 1 << (order - 1)
    while q > 1:  # undo the excess work of the inverse transform, from the top bit down
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (order - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(order - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


class Features:
    """The projection of ids, as far as a vocabulary has been seen."""

    def __init__(self):
        self._table = projection(1 << 16)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        top = int(ids.max(initial=0))
        if top >= len(self._table):
            self._table = projection(1 << top.bit_length())
        return self._table


def keys_of(ids: np.ndarray, o: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids lie between consecutive offsets o; an empty one has the middle cell."""
    n = np.diff(o)
    doc = np.repeat(np.arange(len(n)), n)
    mean = np.stack([np.bincount(doc, weights=table[ids, d], minlength=len(n)) for d in range(DIMS)], 1) / np.maximum(n, 1)[:, None]
    cells = np.clip((np.tanh(mean * 2) + 1) * (1 << (ORDER - 1)), 0, (1 << ORDER) - 1).astype(np.int64)
    return hilbert_key(cells)


def _coder(path: str, end_id: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        features = Features()
        for batch in batches:
            own = batch.column(0)
            for lo, hi, flat, o in encoder(batch.column(1)):
                keys = keys_of(flat, o, features(flat))
                small = flat.astype("<u2") if not len(flat) or flat.max() < 1 << 16 and end_id < 1 << 16 else None
                wide = small is None
                data = flat.astype("<u4") if wide else small
                end = np.array([end_id], data.dtype).tobytes()
                rows, doc, start = [], [], []
                for i, (s, e) in enumerate(zip(o[:-1].tolist(), o[1:].tolist(), strict=True)):
                    for at in range(s, max(e, s + 1), PIECE):
                        rows.append(data[at : min(at + PIECE, e)].tobytes() + (end if at + PIECE >= e else b""))
                        doc.append(i)
                        start.append(at - s)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": own.slice(lo, hi - lo).take(pa.array(doc)),
                    "key": pa.array(keys[doc], pa.int64()),
                    "start": pa.array(start, pa.int64()),
                    "n": pa.array((np.diff(o) + 1)[doc], pa.int64()),
                    "wide": pa.array([wide] * len(doc), pa.bool_()),
                    "ids": pa.array(rows, pa.binary()),
                })
            give_back()

    return code


class _Packer:
    """Lays documents end to end; holds what belongs to the open sequence."""

    def __init__(self, length: int, first: int):
        self.length, self.next = length, first
        self.open: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.used = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, start: int, n: int, ids: np.ndarray) -> None:
        """The ids from start on of a document of n."""
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.length - self.used)
            self.open.append((doc_id, start + at, ids[at : at + take], n))
            self.used += take
            at += take
            if self.used == self.length:
                self._close(self.length)

    def _close(self, size: int) -> None:
        """The first `size` open tokens become a sequence."""
        offset, rest = 0, []
        for doc_id, start, ids, n in self.open:
            take = min(len(ids), size - offset)
            if take:
                self.rows.append((doc_id, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), n, self.next, offset))
                offset += take
            if take < len(ids):
                rest.append((doc_id, start + take, ids[take:], n))
        self.open, self.used, self.next = rest, self.used - size, self.next + 1

    def finish(self) -> None:
        while self.used:
            self._close(1 << (self.used.bit_length() - 1))

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)


def _packing(length: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, start, n, wide, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                packer.add(doc_id, start, n, np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2"))
            yield packer.take()
        packer.finish()
        yield packer.take()

    return pack


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 2, length: int = 4096) -> DataFrame:
    """A row for each piece of a document in a sequence (OUT)."""
    at = workspace(docs.sparkSession, "packing")
    schema = "doc_id bigint, key bigint, start bigint, n bigint, wide boolean, ids binary"
    with small_batches(docs.sparkSession, BATCH):
        coded = written(docs.select("doc_id", "text").mapInArrow(lean(_coder(tokenizer, end_id), library_cache), schema), at)
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored_bytes(docs.sparkSession, at) // RANGE_BYTES + 1)
    placed = coded.repartitionByRange(ranges, "key", "doc_id", "start").sortWithinPartitions("key", "doc_id", "start")
    return placed.select("doc_id", "start", "n", "wide", "ids").mapInArrow(lean(_packing(length)), OUT)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=2)
