"""Mergeable statistics of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw

RESERVOIR, ALPHA = 1028, 0.015


def totals(now_ns: int, predicate: Column | None = None) -> list[Column]:
    """Aggregates of data events; with a predicate also those it filters out."""
    lag = F.greatest(F.lit(now_ns) - F.col("ts_ns"), F.lit(0))
    out = [
        F.count("*").alias("n_events"), F.sum("size_bytes").alias("bytes"), F.sum("payload_bytes").alias("payload_bytes"),
        F.min("scn").alias("min_scn"), F.max("scn").alias("max_scn"), F.max("ts_ns").alias("max_ts"), F.min("ts_ns").alias("min_ts"),
        F.sum((lag / 1_000_000).cast("bigint")).alias("sum_latency_ms"),
    ]
    if predicate is not None:
        no = ~predicate
        out += [
            F.count_if(no).alias("n_filtered"), F.coalesce(F.sum(F.when(no, F.col("size_bytes"))), F.lit(0)).alias("bytes_filtered"),
            F.max(F.when(no, F.col("scn"))).alias("max_filtered_scn"),
        ]
    return out


def by_groups(log: DataFrame, now_ns: int) -> DataFrame:
    """Totals by source, by partition and of all, in one pass."""
    return log.groupingSets([["src_id"], ["pp_id"], []], "src_id", "pp_id").agg(F.grouping_id().alias("level"), *totals(now_ns))


def merge(*parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of parts as of the whole: sums add, bounds widen, a bound that is not positive does not count."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    positive = F.when(F.col("min_scn") > 0, F.col("min_scn"))
    merged = rows.groupBy(*keys).agg(
        F.sum("n_events").alias("n_events"), F.sum("bytes").alias("bytes"), F.sum("payload_bytes").alias("payload_bytes"),
        F.min(positive).alias("min_scn"), F.max("max_scn").alias("max_scn"), F.max("max_ts").alias("max_ts"), F.min("min_ts").alias("min_ts"),
        F.sum("sum_latency_ms").alias("sum_latency_ms"),
    )
    return merged.withColumn("time_span", F.when((F.col("max_ts") > 0) & (F.col("min_ts") > 0), F.col("max_ts") - F.col("min_ts")))


def system_counts(log: DataFrame) -> DataFrame:
    """Control rows and events by validity (column validity: OK, PARTIAL, ERR)."""
    return log.agg(
        F.count_if(F.col("src_id") < 0).alias("n_system"), F.count_if(F.col("validity") == "PARTIAL").alias("n_partial"), F.count_if(F.col("validity") == "ERR").alias("n_invalid")
    )


def bucket_of(v: Column, low: int, high: int, buckets: int) -> Column:
    """0 below, 1..buckets inside, buckets + 1 from the end on."""
    width = max((high - low) // buckets, 1)
    end = low + buckets * width
    return F.when(v < low, 0).when(v >= end, buckets + 1).otherwise(F.floor((v - low) / width).cast("int") + 1)


def histogram(values: DataFrame, column: str, *, low: int, high: int, buckets: int) -> DataFrame:
    """num, min, max, sum, mean and percentiles from a histogram of fixed buckets, whose values are their middles.
    The table between has buckets + 2 rows."""
    width = max((high - low) // buckets, 1)
    counts = values.select(bucket_of(F.col(column), low, high, buckets).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    value = (F.lit(low) + F.lit(width) * (F.col("b") - 1) + F.lit(width // 2)).cast("bigint")
    at = lambda q, name: F.min(F.when(F.col("upto") >= q, value)).alias(name)
    return running.agg(
        F.sum("n").alias("num"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value * F.col("n")).alias("sum"),
        (F.sum(value * F.col("n")) / F.sum("n")).alias("mean"), at(F.floor(F.col("all") / 2), "median"),
        at(F.col("all") * 0.75, "p75"), at(F.col("all") * 0.9, "p90"), at(F.col("all") * 0.95, "p95"), at(F.col("all") * 0.99, "p99"),
    )


def newest(values: DataFrame, order: str, capacity: int) -> DataFrame:
    """What a sliding histogram of that capacity still holds: the newest values."""
    return values.orderBy(F.desc(order)).limit(capacity)


def reservoir(values: DataFrame, time: Column, key: Column, *, size: int = RESERVOIR, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """A forward-decaying sample: the size greatest priorities exp(alpha * t) / u. In logarithms, so that it does
    not overflow; samples merge by taking the greatest of both. u is drawn by the hash of a key of the row."""
    u = (draw(key, F.lit(seed)) + 1) / F.lit(float(1 << 32))
    return values.withColumn("priority", time * alpha - F.log(u)).orderBy(F.desc("priority")).limit(size)


def merge_reservoirs(*parts: DataFrame, size: int = RESERVOIR) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.orderBy(F.desc("priority")).limit(size)


def percentiles(values: DataFrame, column: str, *, exact: bool = True) -> DataFrame:
    """50th, 90th, 95th, 99th and the greatest. exact holds the distinct values of a column; else a sketch."""
    f = F.percentile if exact else F.percentile_approx
    return values.agg(*[f(column, q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)], F.max(column).alias("max"))


def rate(log: DataFrame) -> DataFrame:
    """Events per second of the time they span."""
    return log.agg((F.count("*") / ((F.max("ts_ns") - F.min("ts_ns")) / 1_000_000_000)).alias("per_s"))


def rows_between(log: DataFrame, since: int, start: int) -> DataFrame:
    return log.filter((F.col("scn") >= since) & (F.col("scn") < start)).agg(F.count("*").alias("n"))


def row_id_before(log: DataFrame, scn: int) -> DataFrame:
    return log.filter(F.col("scn") < scn).agg((F.max("id") + 1).alias("row_id"))


def state_bounds(applier: DataFrame, producer: DataFrame) -> DataFrame:
    """Least applied and greatest produced window."""
    return applier.agg(F.min("scn").alias("start_scn")).crossJoin(producer.agg(F.max("scn").alias("producer_scn")))


def callback_counts(callbacks: DataFrame) -> DataFrame:
    """callbacks (type, result, latency_ms) by type."""
    return callbacks.groupBy("type").agg(
        F.count("*").alias("received"), F.count_if(F.col("result") < 200).alias("processed"), F.count_if(F.col("result") >= 200).alias("errors"), F.sum("latency_ms").alias("latency_ms")
    )
