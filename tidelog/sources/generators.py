"""Synthetic events and records, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import draw


def _letters(length: Column, seed: int) -> Column:
    hex_ = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))), 256)
    return F.substring(F.repeat(hex_, F.ceil(length / 64).cast("int")), F.lit(1), length)


def random_events(spark: SparkSession, n: int, *, keys: tuple[int, int] = (0, 1 << 31), lengths: tuple[int, int] = (10, 100), per_window: int = 10, sources: tuple[int, ...] = (1,), trace_percent: float = 1.0, seed: int = 0) -> DataFrame:
    """n events with random keys and payload lengths, per_window of them in each window. Draws are hashes of id and seed."""
    span = lambda lo, hi, s: F.lit(lo).cast("bigint") + draw(F.col("id"), F.lit(seed + s)) % (hi - lo)
    rows = spark.range(n)
    return rows.select(
        (F.col("id") + 1).alias("id"), (F.floor(F.col("id") / per_window) + 1).alias("scn"), (F.col("id") % per_window + 1).alias("seq"),
        F.element_at(F.array(*map(F.lit, sources)), (F.col("id") % len(sources) + 1).cast("int")).alias("src_id"), span(*keys, 1).alias("key_long"),
        F.lit("UPSERT").alias("opcode"), _letters(span(*lengths, 2).cast("int"), seed).alias("payload"), (draw(F.col("id"), F.lit(seed + 3)) % 10_000 < int(trace_percent * 100)).alias("is_trace"),
    ).withColumn("size_bytes", F.length("payload") + 61)


def random_column(kind: T.DataType, seed: int) -> Column:
    """A random value of a type, nested ones included."""
    r = F.rand(seed)
    if isinstance(kind, T.BooleanType):
        return r < 0.5
    if isinstance(kind, T.NumericType):
        return (r * 1000).cast(kind)
    if isinstance(kind, T.StringType):
        return F.sha2(r.cast("string"), 256)
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.sha2(r.cast("string"), 256))
    if isinstance(kind, T.ArrayType):
        return F.array(*[random_column(kind.elementType, seed * 31 + i) for i in range(2)])
    if isinstance(kind, T.MapType):
        return F.create_map(random_column(kind.keyType, seed * 31), random_column(kind.valueType, seed * 31 + 1))
    if isinstance(kind, T.StructType):
        return F.struct(*[random_column(f.dataType, seed * 31 + i).alias(f.name) for i, f in enumerate(kind.fields)])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.timestamp_seconds((r * 1_700_000_000).cast("bigint")).cast(kind)
    return F.lit(None).cast(kind)


def random_records(spark: SparkSession, schema: T.StructType, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(*[random_column(f.dataType, seed + 7 * i + 1).alias(f.name) for i, f in enumerate(schema.fields)])


def rate_stream(spark: SparkSession, per_second: int, per_window: int = 10) -> DataFrame:
    """A stream of generated events at a fixed rate."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select(
        (F.col("value") + 1).alias("id"), (F.floor(F.col("value") / per_window) + 1).alias("scn"), (F.col("value") % per_window + 1).alias("seq"),
        F.xxhash64("value").alias("key_long"), F.lit(1).alias("src_id"), F.lit("UPSERT").alias("opcode"), (F.unix_micros("timestamp") * 1000).alias("ts_ns"),
    )
