"""From captured row events to the change log: opcodes, sources, transactions, merges, end-of-window rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .snapshot import last_image


def to_changes(rows: DataFrame, source_map: DataFrame) -> DataFrame:
    """Row events (table_name, kind insert | update | delete, ...) with src_id and opcode; unknown tables go.
    source_map (table_name, src_id) is configuration; Spark broadcasts it where its size allows."""
    known = rows.withColumn("table_name", F.lower("table_name")).join(source_map, "table_name")
    return known.withColumn("opcode", F.when(F.col("kind") == "delete", "DELETE").otherwise("UPSERT"))


def unknown_sources(rows: DataFrame, source_map: DataFrame) -> DataFrame:
    return rows.withColumn("table_name", F.lower("table_name")).join(source_map, "table_name", "left_anti")


#: Positions of a stream are looked at in blocks of this width, so that a stream is not one task's work.
BLOCK_BITS = 16


def committed(events: DataFrame) -> DataFrame:
    """Row events of a binlog stream (pos, kind begin | commit | rollback | row, ...) that belong to a committed
    transaction: column txn. Rows before the first begin and rolled-back ones go.

    Each block of positions is looked at alone; a table of one row per block carries the begins before it and the first
    mark behind it. Positions that are no integers make one block of a stream."""
    whole = dict(events.dtypes)["pos"] in ("tinyint", "smallint", "int", "bigint")
    marked = events.withColumn("__block", F.shiftright(F.col("pos").cast("bigint"), BLOCK_BITS) if whole else F.lit(0).cast("bigint"))
    begins, mark = F.when(F.col("kind") == "begin", 1).otherwise(0), F.when(F.col("kind").isin("commit", "rollback", "begin"), F.col("kind"))

    # behind: what comes later is the past of the descending order, where frames grow instead of being summed anew for each row
    per = marked.groupBy("stream", "__block").agg(F.sum(begins).alias("n"), F.min_by("kind", F.when(mark.isNotNull(), F.col("pos"))).alias("first"))
    before = Window.partitionBy("stream").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("stream").orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(
        F.col("stream").alias("__stream"), F.col("__block").alias("__at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__begun"), F.last("first", True).over(behind).alias("__next"),
    )

    inside = Window.partitionBy("stream", "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("stream", "__block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = marked.withColumn("txn", F.sum(begins).over(inside)).withColumn("__mark", F.last(mark, True).over(ahead)).filter(F.col("kind") == "row")
    rows = rows.join(carried, F.col("stream").eqNullSafe(F.col("__stream")) & F.col("__block").eqNullSafe(F.col("__at")))
    txn = (F.col("txn") + F.col("__begun")).alias("txn")
    kept = rows.filter(F.coalesce("__mark", "__next") == "commit").filter(F.col("txn") + F.col("__begun") > 0)
    return kept.select(*[F.col(c) for c in events.columns if c != "txn"], txn)


def dedupe_transaction(entries: DataFrame) -> DataFrame:
    """Last image of each key of a source in a transaction."""
    return last_image(entries, ["txn", "src_id", "srckey"], "pos")


def merge_same_scn(entries: DataFrame) -> DataFrame:
    """Transactions with one sequence number become one: the newest image of a key stays. Entries below a number already seen are dropped."""
    seen = Window.partitionBy("pp_id").orderBy("txn_pos").rangeBetween(Window.unboundedPreceding, -1)
    fresh = entries.withColumn("__top", F.max("scn").over(seen)).filter(F.col("__top").isNull() | (F.col("scn") >= F.col("__top"))).drop("__top")
    return last_image(fresh, ["pp_id", "scn", "src_id", "srckey"], "txn_pos")


def regressions(transactions: DataFrame) -> DataFrame:
    """Transactions (pp_id, txn_pos, scn) below a number already seen."""
    seen = Window.partitionBy("pp_id").orderBy("txn_pos").rowsBetween(Window.unboundedPreceding, -1)
    return transactions.withColumn("seen_scn", F.max("scn").over(seen)).filter(F.col("scn") < F.col("seen_scn"))


def null_transaction_marks(transactions: DataFrame, every: int = 100) -> DataFrame:
    """Of transactions without rows (n = 0) in a run, each every-th becomes an end-of-window row."""
    w = Window.partitionBy("pp_id").orderBy("txn_pos")
    run = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).over(Window.partitionBy("pp_id", "run").orderBy("txn_pos").rowsBetween(Window.unboundedPreceding, 0))
    return transactions.withColumn("run", run).withColumn("nth", nth).filter((F.col("n") == 0) & (F.col("nth") % every == 0)).select("pp_id", "txn_pos", "scn")


def skip_start(entries: DataFrame, start_prev: int) -> DataFrame:
    return entries.filter(F.col("scn") != start_prev)


def stamp_window(rows: DataFrame, scn: int, last_written: int) -> DataFrame:
    """The rows of an open window with its number, which must not be below the last one."""
    if scn < last_written:
        raise ValueError(f"window {scn} ends below {last_written}")
    return rows.withColumn("scn", F.lit(scn).cast("bigint")).withColumn("window_scn", F.lit(scn).cast("bigint"))


def guarded(rows: DataFrame, current_scn: int) -> DataFrame:
    """Rows that a log still takes: not below its current window."""
    return rows.filter(F.col("scn") >= current_scn)
