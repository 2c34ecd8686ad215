"""Reads of the log from a checkpoint, order over partitions, late data, framing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .snapshot import byte_page


def windowed(log: DataFrame) -> DataFrame:
    """Position of each event in its window: column pos, from 1."""
    return log.withColumn("pos", F.row_number().over(Window.partitionBy("pp_id", "scn").orderBy("seq")))


def end_of_windows(log: DataFrame) -> DataFrame:
    """A control row for each window, of one more than its last position."""
    return log.groupBy("pp_id", "scn").agg((F.count("*") + 1).alias("pos"), F.count("*").alias("n_events"), F.max("ts_ns").alias("ts_ns")).withColumn("src_id", F.lit(-2))


def since(log: DataFrame, scn: int, offset: int = -1) -> DataFrame:
    """Events after a checkpoint: windows beyond scn, and in that window the events after the first `offset`."""
    rows = windowed(log.filter(F.col("scn") >= scn))
    return rows.filter((F.col("scn") > scn) | ((F.col("scn") == scn) & F.lit(offset >= 0) & (F.col("pos") > offset)))


def read_changes(log: DataFrame, scn: int, offset: int = -1, *, predicate: Column | None = None, budget: int | None = None) -> DataFrame:
    """What a `stream` request returns: events after the checkpoint that pass, while they fit the bytes."""
    rows = since(log, scn, offset)
    rows = rows if predicate is None else rows.filter((F.col("src_id") < 0) | predicate)
    return rows if budget is None else byte_page(rows, budget, order=("scn", "pp_id", "pos"))


def interleaved(log: DataFrame, *, after: dict[int, int] | None = None) -> DataFrame:
    """Order of a read over several partitions: one window of each partition in turn. Columns turn, pos.

    The rank is over windows (a row each), joined back to the events."""
    rows = log
    for pp, scn in (after or {}).items():
        rows = rows.filter((F.col("pp_id") != pp) | (F.col("scn") > scn))
    windows = rows.select("pp_id", "scn").distinct()
    ranked = windows.withColumn("turn", F.row_number().over(Window.partitionBy("pp_id").orderBy("scn")))
    return windowed(rows).join(ranked, ["pp_id", "scn"])


def late(log: DataFrame, *, order: str = "id") -> DataFrame:
    """Marks events whose window is below one already seen in their partition: column is_late."""
    before = Window.partitionBy("pp_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("is_late", F.coalesce(F.col("scn") < F.max("scn").over(before), F.lit(False)))


def floor_scn(log: DataFrame, scn: int) -> DataFrame:
    """The last window at or before scn, per partition."""
    return log.filter(F.col("scn") <= scn).groupBy("pp_id").agg(F.max("scn").alias("floor_scn"))


def head(log: DataFrame) -> DataFrame:
    """Per partition: first retained window, the boundary before it, and the last one."""
    return log.groupBy("pp_id").agg(F.min("scn").alias("min_scn"), (F.min("scn") - 1).alias("prev_scn"), F.max("scn").alias("max_scn"))


def advance(log: DataFrame) -> DataFrame:
    """Checkpoint of each partition after its events: the last window, with the number of its events as offset."""
    last = log.groupBy("pp_id", "scn").agg(F.count("*").alias("n"))
    return last.groupBy("pp_id").agg(F.max("scn").alias("window_scn"), F.max_by("n", "scn").alias("window_offset"))


def framed(log: DataFrame) -> DataFrame:
    """Boundaries a consumer is called at: starts_window, starts_source, ends_source, ends_window."""
    w = Window.partitionBy("pp_id", "scn").orderBy("src_id", "seq")
    prev, nxt = F.lag("src_id").over(w), F.lead("src_id").over(w)
    return log.select(
        "*", prev.isNull().alias("starts_window"), (~prev.eqNullSafe(F.col("src_id"))).alias("starts_source"),
        (~nxt.eqNullSafe(F.col("src_id"))).alias("ends_source"), nxt.isNull().alias("ends_window"),
    )


def batched(log: DataFrame, size: int, *, by: tuple[str, ...] = ("pp_id", "scn")) -> DataFrame:
    """Batches of up to size events inside each window (or source of a window): column batch."""
    w = Window.partitionBy(*by).orderBy("seq")
    return log.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def trimmed(log: DataFrame, head_scn: int) -> DataFrame:
    """Log after its consumer has moved the head."""
    return log.filter(F.col("scn") >= head_scn)


def with_control(log: DataFrame, kind: int, scn: int) -> DataFrame:
    """The log and one control row (checkpoint, end of period, ...)."""
    spark = log.sparkSession
    row = spark.range(1).select(*[
        F.lit({"src_id": int(kind), "scn": scn}.get(f.name)).cast(f.dataType).alias(f.name) for f in log.schema.fields
    ])
    return log.unionByName(row)


def tail_summary(log: DataFrame) -> DataFrame:
    """What the tail tool prints: events, windows, bytes, seconds, rates."""
    total = log.agg(
        F.count("*").alias("events"), F.countDistinct("scn").alias("windows"), F.sum("size_bytes").alias("bytes"),
        ((F.max("ts_ns") - F.min("ts_ns")) / 1_000_000_000).alias("seconds"),
    )
    return total.select("*", (F.col("bytes") / F.col("events")).alias("mean_bytes"), (F.col("events") / F.col("seconds")).alias("events_per_s"))
