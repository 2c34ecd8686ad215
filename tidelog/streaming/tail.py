"""The log as a stream: tailing, late windows, the snapshot kept up to date, consumers, bootstrap then stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import snapshot as S
from ..schema import ConsumerResult


def tail(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 100, latest_first: bool = False) -> DataFrame:
    """Log files as they are added to a folder, oldest first."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", str(latest_first).lower()).parquet(folder)
    )


def mark_late(stream: DataFrame) -> DataFrame:
    """pp_id, scn, id, is_late: whether a window is below one already seen in its partition, over all batches.
    The state of a partition is one number."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else -1
        for frame in pd.concat(list(frames)).sort_values("id"), :
            top = frame["scn"].cummax().shift(1).fillna(-1).clip(lower=seen).astype("int64")
            seen = max(seen, int(frame["scn"].max()))
            yield pd.DataFrame({"pp_id": frame["pp_id"], "scn": frame["scn"], "id": frame["id"], "is_late": frame["scn"] < top})
        state.update((seen,))

    rows = stream.select("pp_id", "scn", "id")
    return rows.groupBy("pp_id").applyInPandasWithState(
        judge, "pp_id int, scn bigint, id bigint, is_late boolean", "scn bigint", "append", GroupStateTimeout.NoTimeout
    )


class SnapshotTable:
    """A snapshot as versions in a folder: each micro-batch merges into a new one, so a failed batch leaves the last as it was.

    Versions have a counter of their own; beside it their names hold the query and the batch that made them, so a batch
    that is run again does nothing, and one of a query with a fresh checkpoint is merged whatever its number."""

    def __init__(self, spark: SparkSession, folder: str, schema):
        self._spark, self._folder, self._schema = spark, folder.rstrip("/"), schema

    def _fs(self, path: str):
        p = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._spark._jsc.hadoopConfiguration()), p

    def _held(self) -> list[tuple[int, str, str]]:
        """(version, maker, folder name) of the finished ones, in order."""
        fs, p = self._fs(self._folder)
        if not fs.exists(p):
            return []
        names = [f.getPath() for f in fs.listStatus(p)]
        done = lambda q: fs.exists(self._spark._jvm.org.apache.hadoop.fs.Path(q, "_SUCCESS"))
        parts = [(*q.getName().partition("."), q) for q in names]
        return sorted((int(n), maker, q.getName()) for n, _, maker, q in parts if n.isdigit() and done(q))

    def versions(self) -> list[int]:
        return [n for n, _, _ in self._held()]

    def read(self) -> DataFrame:
        held = self._held()
        return self._spark.read.schema(self._schema).parquet(f"{self._folder}/{held[-1][2]}") if held else self._spark.createDataFrame([], self._schema)

    def merge(self, batch: DataFrame, batch_id: int, keep: int = 2) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        held, maker = self._held(), f"{query}.{batch_id}"
        if any(m == maker for _, m, _ in held):
            return
        number = held[-1][0] + 1 if held else 0
        S.merge_snapshot(self.read(), batch).write.mode("overwrite").parquet(f"{self._folder}/{number:010d}.{maker}")
        for _, _, old in held[: -keep + 1 or None]:
            fs, p = self._fs(f"{self._folder}/{old}")
            fs.delete(p, True)


def keep_snapshot(stream: DataFrame, table: SnapshotTable, checkpoint: str) -> StreamingQuery:
    """Folds the stream into a snapshot table."""
    return stream.writeStream.foreachBatch(lambda df, i: table.merge(df, i)).option("checkpointLocation", checkpoint).start()


class Consumer:
    """What a client of the log may override; the results decide whether a batch is kept (ConsumerResult)."""

    def on_start_window(self, scn: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_end_window(self, scn: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_start_source(self, scn: int, src_id: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_end_source(self, scn: int, src_id: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_data(self, events: DataFrame, scn: int, src_id: int) -> ConsumerResult:
        """The events of a source in a window, as a DataFrame."""
        return ConsumerResult.SUCCESS

    def on_checkpoint(self, scn: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_rollback(self, scn: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_error(self, error: Exception) -> ConsumerResult:
        return ConsumerResult.ERROR


class LoggingConsumer(Consumer):
    """Appends the events it gets to a folder as JSON."""

    def __init__(self, folder: str):
        self._folder = folder

    def on_data(self, events: DataFrame, scn: int, src_id: int) -> ConsumerResult:
        events.write.mode("append").json(self._folder)
        return ConsumerResult.SUCCESS


class DelegatingConsumer(Consumer):
    """Passes calls on to another consumer, for those sources (all if none are named)."""

    def __init__(self, other: Consumer, sources: tuple[int, ...] = ()):
        self._other, self._sources = other, sources

    def on_data(self, events: DataFrame, scn: int, src_id: int) -> ConsumerResult:
        wanted = not self._sources or src_id in self._sources
        return self._other.on_data(events, scn, src_id) if wanted else ConsumerResult.SUCCESS


def deliver(batch: DataFrame, consumer: Consumer) -> ConsumerResult:
    """A micro-batch's windows and sources in order. Only their (scn, src_id) pairs come to the driver; events stay in
    DataFrames. A failed window rolls the batch back by raising, and it is run again from its checkpoint."""
    worst, last = ConsumerResult.SUCCESS, None
    call = lambda r: max(worst, r)
    pairs = batch.filter("src_id >= 0").select("scn", "src_id").distinct().orderBy("scn", "src_id")
    for row in pairs.toLocalIterator():
        if last != row.scn:
            if last is not None:
                worst = call(consumer.on_end_window(last))
                worst = call(consumer.on_checkpoint(last))
            worst, last = call(consumer.on_start_window(row.scn)), row.scn
        worst = call(consumer.on_start_source(row.scn, row.src_id))
        worst = call(consumer.on_data(batch.filter((F.col("scn") == row.scn) & (F.col("src_id") == row.src_id)), row.scn, row.src_id))
        worst = call(consumer.on_end_source(row.scn, row.src_id))
        if not worst.ok:
            consumer.on_rollback(row.scn)
            raise RuntimeError(f"window {row.scn} failed with {worst.name}")
    if last is not None:
        worst = call(consumer.on_end_window(last))
        worst = call(consumer.on_checkpoint(last))
    return worst


def run(stream: DataFrame, consumer: Consumer, checkpoint: str) -> StreamingQuery:
    """A registration: one query for each consumer."""
    return stream.writeStream.foreachBatch(lambda df, i: deliver(df, consumer) and None).option("checkpointLocation", checkpoint).start()


def bootstrap_then_stream(spark: SparkSession, log: DataFrame, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, *, start_scn: int, target_scn: int, since_scn: int = 0) -> StreamingQuery:
    """Snapshot and catch-up as batch -1, then the stream of what lies beyond the target."""
    handle(S.snapshot_then_catchup(log, start_scn=start_scn, target_scn=target_scn, since_scn=since_scn), -1)
    rest = tail(spark, folder, log.schema).filter(F.col("scn") > target_scn)
    return rest.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
