"""Token-id files: documents' ids in Simple-8b words, in ascending document order.

File format: a folder of Parquet files whose rows are runs of whole documents, about RUN ids each:
  shard, first (ids before the run in its shard), doc_ids, sizes (ids of each document), n_ids,
  words (little-endian unsigned 64-bit), offsets (first word of each block of 1024 ids),
  escape_at, escape_values (see simple8b).
Shards follow each other in document order; there is one for each range partition, and `shard_starts`
has a row for each.

Defined results. Null or empty text: the end id alone. Null doc_id: before all others. The same doc_id
again: ordered by text, each row is a document. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from ._shared import workspace
from .tokens import library_encoder, tokenizer_path

RUN = 1 << 16
SCHEMA = (
    "shard int, first bigint, doc_ids array<bigint>, sizes array<int>, n_ids int, words binary, offsets array<int>, "
    "escape_at array<int>, escape_values binary"
)


def _run(shard: int, first: int, doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    words, offsets, at, escaped = simple8b.encode(flat)
    cols = {
        "shard": pa.array([shard], pa.int32()),
        "first": pa.array([first], pa.int64()),
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
        "sizes": pa.array([[len(x) for x in ids]], pa.list_(pa.int32())),
        "n_ids": pa.array([len(flat)], pa.int32()),
        "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
        "offsets": pa.array([offsets.astype(np.int32)], pa.list_(pa.int32())),
        "escape_at": pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
        "escape_values": pa.array([escaped.astype("<u8").tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(cols)


def _writer(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_encoder(path), TaskContext.get().partitionId()
        first = held = 0
        doc_ids: list = []
        ids: list[np.ndarray] = []
        for batch in batches:
            own = batch.column(0).to_pylist()
            for lo, hi, flat, o in encoder(batch.column(1)):
                for i in range(lo, hi):
                    doc_ids.append(own[i])
                    ids.append(np.append(flat[o[i - lo] : o[i - lo + 1]], np.uint32(end_id)))
                    held += len(ids[-1])
                    if held >= RUN:
                        yield _run(shard, first, doc_ids, ids)
                        first, held, doc_ids, ids = first + held, 0, [], []
        if ids:
            yield _run(shard, first, doc_ids, ids)

    return write


def write_ids(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 1) -> None:
    """Encodes every text and writes the files."""
    # rows of one id, or without, are dealt by their texts' beginnings, as the keys sampled for the ranges come to the driver
    dealt = docs.select("doc_id", "text", F.substring("text", 1, 32).alias("begin")).repartitionByRange("doc_id", "begin")
    placed = dealt.sortWithinPartitions("doc_id", "text")
    placed.select("doc_id", "text").mapInArrow(_writer(tokenizer, end_id), SCHEMA).write.mode("overwrite").parquet(path)


def run_ids(row: dict) -> np.ndarray:
    """The ids of one row of the files."""
    return simple8b.decode(
        np.frombuffer(row["words"], "<u8"), np.array(row["offsets"], np.int64), row["n_ids"],
        np.array(row["escape_at"], np.int64), np.frombuffer(row["escape_values"], "<u8"),
    )


def shard_starts(files: DataFrame) -> DataFrame:
    """shard, shard_start: ids in the shards before; a row for each shard."""
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = run_ids(row).astype("<u4")
            sizes = np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            crcs = [zlib.crc32(ids[e - n : e].data) for n, e in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array(row["shard_start"] + row["first"] + ends - sizes, pa.int64()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "ids_crc32": pa.array(crcs, pa.int64()),
            })


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    files = spark.read.parquet(path)
    placed = files.join(F.broadcast(shard_starts(files)), "shard")
    return placed.mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "token_ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_digests(spark, path)
