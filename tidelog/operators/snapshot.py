"""The keyed table: last image per key, snapshot and catch-up reads, log rotation, retention, seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_ROWS, LOG_ROWS = 1000, 10_000


def last_image(entries: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row for each of keys: the one with the greatest position. max_by combines before the shuffle."""
    rest = [c for c in entries.columns if c not in keys]
    picked = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*entries.columns)


def source_order(entries: DataFrame, *, scn: str = "scn", src: str = "src_id", position: str = "pos") -> DataFrame:
    """Position of each entry in its transaction when sources go by id: column out_pos."""
    w = Window.partitionBy(scn).orderBy(src, position)
    return entries.withColumn("out_pos", F.row_number().over(w))


def apply_log(log: DataFrame, *, before_scn: int | None = None) -> DataFrame:
    """The snapshot that a log makes: id is that of a key's first entry, everything else its last image.
    Deletes stay as last images. before_scn: only entries of earlier windows."""
    if before_scn is not None:
        log = log.filter(F.col("scn") < before_scn)
    image = [c for c in log.columns if c not in ("src_id", "srckey", "id")]
    folded = log.groupBy("src_id", "srckey").agg(F.min("id").alias("id"), F.max_by(F.struct(*image), "id").alias("r"))
    return folded.select("src_id", "srckey", "id", "r.*").select(*log.columns)


def live(snapshot: DataFrame) -> DataFrame:
    """Without the keys whose last image is a delete (an extension: a snapshot keeps them)."""
    return snapshot.filter(F.col("opcode") != "DELETE")


def merge_snapshot(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """A snapshot after more log entries (same columns): ids of known keys stay."""
    image = [c for c in log.columns if c not in ("src_id", "srckey", "id")]
    both = snapshot.withColumn("__new", F.lit(0)).unionByName(log.withColumn("__new", F.lit(1)))
    folded = both.groupBy("src_id", "srckey").agg(F.min("id").alias("id"), F.max_by(F.struct(*image), F.struct("__new", "id")).alias("r"))
    return folded.select("src_id", "srckey", "id", "r.*").select(*log.columns)


def page(rows: DataFrame, *, after: int = 0, n: int = PAGE_ROWS, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """A keyset page: the next n rows by order with order[-1] beyond `after`."""
    return rows.filter(F.col(order[-1]) > after).orderBy(*order).limit(n)


def snapshot_rows(snapshot: DataFrame, *, start_scn: int, since_scn: int = 0, predicate: Column | None = None) -> DataFrame:
    """Snapshot rows in [since, start); none if start <= since."""
    rows = snapshot.filter((F.col("scn") < start_scn) & (F.col("scn") >= since_scn))
    return rows if predicate is None else rows.filter(predicate)


def catchup_rows(log: DataFrame, *, start_scn: int, target_scn: int, since_scn: int = 0, predicate: Column | None = None) -> DataFrame:
    """Log rows in [max(start, since), target]."""
    rows = log.filter((F.col("scn") >= start_scn) & (F.col("scn") <= target_scn) & (F.col("scn") >= since_scn))
    return rows if predicate is None else rows.filter(predicate)


def snapshot_then_catchup(log: DataFrame, *, start_scn: int, target_scn: int, since_scn: int = 0, predicate: Column | None = None) -> DataFrame:
    """Last image per key at the target for keys changed since `since`: the snapshot at start, folded with the catch-up."""
    snapshot = snapshot_rows(apply_log(log, before_scn=start_scn), start_scn=start_scn, since_scn=since_scn, predicate=predicate)
    tail = catchup_rows(log, start_scn=start_scn, target_scn=target_scn, since_scn=since_scn, predicate=predicate)
    return apply_log(snapshot.unionByName(tail))


def phases(sources: list[int]) -> list[tuple[str, int, list[int]]]:
    """Order of a bootstrap of several sources: each source's snapshot, then a catch-up of all so far."""
    out: list[tuple[str, int, list[int]]] = []
    for i, s in enumerate(sources):
        out += [("SNAPSHOT", s, [s]), ("CATCHUP", s, sources[: i + 1])]
    return out


def rotate(windows: DataFrame, most: int = LOG_ROWS) -> DataFrame:
    """log_id of each window of a source (src_id, scn, n): a log closes at the end of the window in which it
    reaches `most` rows. The state is one counter, so the fold runs per source over window counts, in
    Arrow batches of sorted groups."""
    import pandas as pd

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("scn")
        log_id, held, ids = 0, 0, []
        for n in frame["n"]:
            ids.append(log_id)
            held += n
            if held >= most:
                log_id, held = log_id + 1, 0
        return frame.assign(log_id=ids)[["src_id", "scn", "n", "log_id"]]

    return windows.select("src_id", "scn", "n").groupBy("src_id").applyInPandas(fold, "src_id int, scn bigint, n bigint, log_id int")


def log_info(log: DataFrame) -> DataFrame:
    """Per log table: first and last window and the greatest row id."""
    return log.groupBy("src_id", "log_id").agg(F.min("scn").alias("min_scn"), F.max("scn").alias("max_scn"), F.max("id").alias("max_rid"))


def log_for_scn(info: DataFrame, scn: int) -> DataFrame:
    """The first live log that holds scn; for scn <= 0 the first live one."""
    held = info.filter(~F.col("deleted")) if "deleted" in info.columns else info
    if scn > 0:
        held = held.filter((F.col("min_scn") <= scn) & (F.col("max_scn") >= scn))
    return held.groupBy("src_id").agg(F.min("log_id").alias("log_id"))


def min_scn(snapshot: DataFrame, *, seeded: Column | None = None, up_to_id: int | None = None) -> DataFrame:
    """Per source the sequence number from which a snapshot is complete: 0 if seeded, else its least one less 1, not below 0."""
    rows = snapshot if up_to_id is None else snapshot.filter(F.col("id") <= up_to_id)
    least = rows.groupBy("src_id").agg(F.greatest(F.min("scn") - 1, F.lit(0)).alias("min_scn"))
    return least if seeded is None else least.withColumn("min_scn", F.when(seeded, F.lit(0)).otherwise(F.col("min_scn")))


def byte_page(rows: DataFrame, budget: int, *, size: str = "size_bytes", order: tuple[str, ...] = ("id",), by: tuple[str, ...] = (), strict: bool = False, least: int = 61) -> DataFrame:
    """Rows while they fit a byte budget, in order. strict: an exact fit is refused (bootstrap pages); else it is sent (online reads).

    Without `by` the running sum would need all rows in one task. No event is smaller than its header of `least`
    bytes, so budget / least rows hold the answer; a top-n takes them before the sum. A size that is null or below it is
    an error there."""
    if not by:
        small = F.raise_error(F.lit(f"a size is null or below {least}"))
        rows = rows.orderBy(*order).limit(budget // least + 1).withColumn(size, F.when(F.col(size) >= least, F.col(size)).otherwise(small.cast("bigint")))
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("running_bytes", F.sum(size).over(w))
    return rows.filter(F.col("running_bytes") < budget if strict else F.col("running_bytes") <= budget)


def retained_logs(info: DataFrame, *, threshold_scn: int, keep: int) -> DataFrame:
    """Logs that cleaning may drop: below the threshold, live, not the newest, and beyond the newest `keep` of these."""
    newest = info.groupBy("src_id").agg(F.max("log_id").alias("newest"))
    old = info.join(newest, "src_id").filter((F.col("max_scn") < threshold_scn) & (F.col("log_id") < F.col("newest")))
    nth = F.row_number().over(Window.partitionBy("src_id").orderBy(F.desc("log_id")))
    return old.withColumn("nth", nth).filter(F.col("nth") > keep).select("src_id", "log_id", "min_scn", "max_scn")


def expired_logs(info: DataFrame, last_event: DataFrame, *, threshold_scn: int, older_than_ns: int) -> DataFrame:
    """Logs that cleaning may drop by age: last event at or before a time."""
    newest = info.groupBy("src_id").agg(F.max("log_id").alias("newest"))
    old = info.join(newest, "src_id").filter((F.col("max_scn") < threshold_scn) & (F.col("log_id") < F.col("newest")))
    return old.join(last_event, ["src_id", "log_id"]).filter(F.col("last_ts_ns") <= older_than_ns).select("src_id", "log_id", "min_scn", "max_scn")


def purge(snapshot: DataFrame, log: DataFrame, dropped: DataFrame, *, through_scn: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshot and log without the dropped log tables; with through_scn the snapshot loses its older rows too."""
    log = log.join(dropped.select("src_id", "log_id"), ["src_id", "log_id"], "left_anti")
    return (snapshot if through_scn is None else snapshot.filter(F.col("scn") > through_scn)), log


def log_start(info: DataFrame, through_scn: int) -> DataFrame:
    """First log that begins after a sequence number, per source."""
    return info.filter(F.col("min_scn") > through_scn).groupBy("src_id").agg(F.min("log_id").alias("log_id"), F.min_by("min_scn", "log_id").alias("logstartscn"))


def status(state: DataFrame) -> DataFrame:
    """state (src_id, status, applier_scn, seed_end_scn): catch-up of a seeded source ends, and it is active, once the applier has passed the seed."""
    done = (F.col("status") == "SEEDING_CATCHUP") & (F.col("applier_scn") >= F.col("seed_end_scn"))
    return state.withColumn("status", F.when(done, "ACTIVE").otherwise(F.col("status")))


def seeded(state: DataFrame) -> DataFrame:
    """seeder state (src_id, start_scn, end_scn) -> producer and applier start at the least start; log 0 is created."""
    least = state.agg(F.min("start_scn").alias("scn"))
    return state.join(F.broadcast(least)).select("src_id", F.col("scn").alias("producer_scn"), F.col("scn").alias("applier_scn"), F.lit(0).alias("log_id"), F.lit("SEEDING_CATCHUP").alias("status"))


def retained_bytes(log: DataFrame, budget: int, *, size: str = "size_bytes") -> DataFrame:
    """What a ring of `budget` bytes holds of each partition: the newest whole windows that fit.
    Bytes are summed per window first, so the running sum is over windows, not rows."""
    windows = log.groupBy("pp_id", "scn").agg(F.sum(size).alias("bytes"))
    newest = Window.partitionBy("pp_id").orderBy(F.desc("scn")).rowsBetween(Window.unboundedPreceding, 0)
    kept = windows.withColumn("running", F.sum("bytes").over(newest)).filter(F.col("running") <= budget).select("pp_id", "scn")
    return log.join(kept, ["pp_id", "scn"], "left_semi")
