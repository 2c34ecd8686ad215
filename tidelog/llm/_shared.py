"""What the operators of this subpackage share: the shared folder, row keys, hot keys."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is hot when it holds more than this share of the rows, or more than HOT_ROWS of them.
HOT_SHARE, HOT_ROWS = 1 / 1000, 1 << 20
#: Tables of keys are broadcast up to so many rows; beyond, they meet in a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes that a task of a small intermediate table should have at least.
PART_BYTES = 16 << 20

_MADE: list[str] = []
_CACHES: list[dict] = []


def worker_cache() -> dict:
    """A dictionary in which an operator keeps what it remembers between the tasks of a Python worker."""
    _CACHES.append({})
    return _CACHES[-1]


def forget_others(mine: dict | None = None) -> None:
    """A worker that turns to another operator drops what the last one remembered."""
    for cache in _CACHES:
        if cache is not mine:
            cache.clear()


def give_back() -> None:
    """Hands memory that a worker has freed back to the system; the C library and Arrow keep it otherwise while the worker lives."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], mine: Callable[[], dict] | None = None):
    """work on batches (for mapInArrow) in a worker that first drops what other operators remembered and gives memory back at both ends.

    mine() is the worker's own cache, which stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(mine and mine())
        give_back()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new path for one run of an operator; release() deletes it."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> int:
    """A mark for release()."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the intermediate tables that operators have written since the mark.

    Results of operators are lazy and read these tables, so this is for when results have been consumed."""
    while len(_MADE) > since:
        remove(spark, _MADE.pop())


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table which nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a written table, as stored."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def planned_bytes(df: DataFrame) -> int:
    """Spark's estimate of what df reads and makes; very large where it has none."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(spark: SparkSession, size: int) -> int:
    """How many partitions so many bytes are worth, for coalesce(): one for each core, or more with the bytes.

    Tables much smaller than the shuffle partitions would allow otherwise become as many tiny files, and a local file
    costs the JVM a child process or two (chmod, where Hadoop has no native library)."""
    return min(max(spark.sparkContext.defaultParallelism, size // PART_BYTES + 1), (1 << 31) - 1)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of so many rows for what is written inside, since rows hold whole texts or sets; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


@contextmanager
def spent_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run inside go when it ends, not when the driver happens to collect its garbage; the setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def row_key(*cols) -> list:
    """128 bits that name a row by its contents, never null; equal rows have equal keys."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(7), *reversed(cols)).alias("k2")]


def hash128(col) -> list:
    return [F.xxhash64(col).alias("h1"), F.xxhash64(F.lit(7), col).alias("h2")]


def ascii_lower(col):
    return F.translate(col, UPPER, UPPER.lower())


def hot_rows(total: int, least: int = 64) -> int:
    """A key with more rows than this is hot: a share of all rows, but never more than HOT_ROWS."""
    return min(max(least, int(total * HOT_SHARE)), HOT_ROWS)


def few(keys: DataFrame, n: int | None = None) -> DataFrame:
    """keys (a table), to be broadcast where their counted rows are few enough; else Spark chooses the join."""
    return F.broadcast(keys) if (keys.count() if n is None else n) <= BROADCAST_ROWS else keys


def hot_keys(rows: DataFrame, at: str, *, buckets: int = 1 << 16, least: int = 64) -> DataFrame:
    """The keys (h1, h2) with more than hot_rows() of the rows.

    Two counts with map-side combination: of hash buckets (so many at most, which may be broadcast), then of the
    keys inside the buckets that are large enough to hold a hot key. rows must be cheap to read (a table)."""
    most = hot_rows(rows.count(), least)
    b = F.pmod("h1", F.lit(buckets)).alias("b")
    large = rows.groupBy(b).agg(F.count("*").alias("n")).filter(F.col("n") > most).select("b")
    inside = rows.select(b, "h1", "h2").join(F.broadcast(large), "b")
    return written(inside.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("h1", "h2"), at)
