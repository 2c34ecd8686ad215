"""Polling a source table with its transaction log (txn -> scn): full, chunked by transactions or by sequence numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import INFINITY_SCN

CHUNK = 20_000


def changed_since(rows: DataFrame, txlog: DataFrame, since: int, *, infinity: int = INFINITY_SCN) -> DataFrame:
    """Rows of transactions with a known sequence number beyond since. The log is filtered before the join."""
    return rows.join(txlog.filter((F.col("scn") > since) & (F.col("scn") < infinity)), "txn")


def changed_since_row_scn(rows: DataFrame, txlog: DataFrame, since: int, *, infinity: int = INFINITY_SCN) -> DataFrame:
    """As changed_since, but a transaction without number yet takes the row's own (column row_scn)."""
    known = F.when(F.col("scn") == infinity, F.col("row_scn")).otherwise(F.col("scn"))
    return rows.filter(F.col("row_scn") > since).join(txlog, "txn").withColumn("scn", known).filter(F.col("scn") > since)


def next_transactions(txlog: DataFrame, since: int, n: int = CHUNK, *, infinity: int = INFINITY_SCN) -> DataFrame:
    """The next n transactions by sequence number: a top-n, numbered from 1 (column r)."""
    from pyspark.sql import Window

    top = txlog.filter((F.col("scn") > since) & (F.col("scn") < infinity)).orderBy("scn", "txn").limit(n)
    return top.withColumn("r", F.row_number().over(Window.orderBy("scn", "txn")))


def chunk_by_transactions(rows: DataFrame, txlog: DataFrame, since: int, n: int = CHUNK) -> DataFrame:
    """Rows of the next n transactions; the chunk has n rows at most and is broadcast for n up to CHUNK."""
    chunk = next_transactions(txlog, since, n)
    return rows.join(F.broadcast(chunk) if n <= CHUNK else chunk, "txn")


def chunk_by_scn(rows: DataFrame, txlog: DataFrame, since: int, width: int = CHUNK) -> DataFrame:
    return rows.join(txlog.filter((F.col("scn") > since) & (F.col("scn") <= since + width)), "txn")


def skip_ahead(txlog: DataFrame, since: int, n: int = CHUNK) -> DataFrame:
    """Where an empty chunk ends: the greatest number of the next n transactions, since if there are none."""
    return next_transactions(txlog, since, n).agg(F.coalesce(F.max("scn"), F.lit(since)).alias("scn"))


def max_scn(txlog: DataFrame, *, infinity: int = INFINITY_SCN) -> DataFrame:
    return txlog.filter(F.col("scn") < infinity).agg(F.max("scn").alias("max_scn"))


def heartbeat(txlog: DataFrame, since: int) -> DataFrame:
    """The empty window of a slow source: at the greatest known number, not below since."""
    return max_scn(txlog).select(F.greatest(F.coalesce("max_scn", F.lit(since)), F.lit(since)).alias("scn"), F.lit(-2).alias("src_id"))


def cycle(rows: DataFrame) -> DataFrame:
    """Summary of a poll per source: rows, bytes, time span; its window ends at the greatest number."""
    return rows.groupBy("src_id").agg(
        F.count("*").alias("n_rows"), F.sum("size_bytes").alias("bytes"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"), F.max("scn").alias("eop_scn")
    )


def keyset_page(rows: DataFrame, key: str, after, n: int, *, inclusive: bool = False) -> DataFrame:
    """The next n rows by key."""
    return rows.filter(F.col(key) >= after if inclusive else F.col(key) > after).orderBy(key).limit(n)


def txn_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.filter((F.col("txn") > low) & (F.col("txn") <= high))


def last_transaction(rows: DataFrame, txlog: DataFrame) -> DataFrame:
    """Sequence number of the last transaction that touched a table."""
    return txlog.join(F.broadcast(rows.agg(F.max("txn").alias("txn"))), "txn").select("txn", "scn")


def resume_scn(saved: int, overlap: int, default: int) -> int:
    """Where a restart reads on: behind the saved number by the overlap, if that is positive."""
    return saved - overlap if saved - overlap > 0 else default


def keyset_rest(table: DataFrame, key: str, start) -> DataFrame:
    """All rows from a key on (that key included), ordered: what is left of a seeding that resumes there."""
    return table.filter(F.col(key) >= start).orderBy(key)
