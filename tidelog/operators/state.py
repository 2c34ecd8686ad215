"""Positions kept beside the log: log tables, sources, appliers and producers, and what is read first or last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_tables(log: DataFrame, rows_per_log: int) -> DataFrame:
    """srcid, logid, minwindowscn, maxwindowscn, maxrid, n: what the log's tables of so many rows hold of each source."""
    rows = log.withColumn("logid", F.floor((F.col("id") - 1) / rows_per_log))
    return rows.groupBy(F.col("pp_id").alias("srcid"), "logid").agg(
        F.min("scn").alias("minwindowscn"), F.max("scn").alias("maxwindowscn"), F.max("id").alias("maxrid"), F.count("*").alias("n")
    )


def applier_position(producer: DataFrame, applier: DataFrame, logs: DataFrame) -> DataFrame:
    """srcid, producer_scn, applier_scn, logid, maxrid: how far both are, and the last row of the table that the applier reads.

    producer: srcid, windowscn. applier: srcid, windowscn, logid. Sources that one of them lacks are left out."""
    p = producer.select("srcid", F.col("windowscn").alias("producer_scn"))
    a = applier.select("srcid", F.col("windowscn").alias("applier_scn"), "logid")
    return p.join(a, "srcid").join(logs.select("srcid", "logid", "maxrid"), ["srcid", "logid"]).select("srcid", "producer_scn", "applier_scn", "logid", "maxrid")


def producer_start(producer: DataFrame, seeder: DataFrame) -> DataFrame:
    """srcid, windowscn, endscn: the producer's last window beside the end of its seeding (null if it was not seeded)."""
    last = producer.groupBy("srcid").agg(F.max("windowscn").alias("windowscn"))
    return last.join(seeder.select("srcid", "endscn"), "srcid", "left")


def tracked_sources(sources: DataFrame, logs: DataFrame, active: tuple[str, ...]) -> DataFrame:
    """srcid, src, n_logs: the sources (srcid, src, status) of an active status, with the number of their log tables (0 without)."""
    counts = logs.groupBy("srcid").agg(F.countDistinct("logid").alias("n_logs"))
    kept = sources.filter(F.col("status").isin(*active)).join(counts, "srcid", "left")
    return kept.select("srcid", "src", F.coalesce("n_logs", F.lit(0)).alias("n_logs"))


def of_last_transaction(table: DataFrame, column: str = "txn") -> DataFrame:
    """The rows of the greatest transaction."""
    last = table.agg(F.max(column).alias(column))  # one row
    return table.join(F.broadcast(last), column, "left_semi")


def first_windows(logs: DataFrame, since: int, n: int = 1) -> DataFrame:
    """The n log tables with the least last windows that reach beyond since: where a catch-up begins."""
    return logs.filter(F.col("maxwindowscn") > since).orderBy("maxwindowscn", "srcid", "logid").limit(n)


def logs_in_order(logs: DataFrame, n: int | None = None, *, newest_first: bool = False) -> DataFrame:
    """Log tables by logid, then srcid; n: only so many."""
    rows = logs.orderBy(F.desc("logid") if newest_first else F.asc("logid"), "srcid")
    return rows if n is None else rows.limit(n)


def latest_rows(log: DataFrame, key: str = "srckey", time: str = "ts_ns") -> DataFrame:
    """The last row of each key by time, then id: key, time, id, scn."""
    last = F.max(F.struct(time, "id", "scn")).alias("last")
    return log.groupBy(key).agg(last).select(key, f"last.{time}", "last.id", "last.scn")


def reset(log: DataFrame, pp_id: int, prev_scn: int) -> DataFrame:
    """The log after one partition has been cleared and begins anew behind prev_scn: its windows up to there are gone."""
    return log.filter((F.col("pp_id") != pp_id) | (F.col("scn") > prev_scn))
