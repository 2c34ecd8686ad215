"""Checkpoints: positions of a consumer in the log, their rules and their stores."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ClientMode, ControlType, ScnNotFound

FULL_WINDOW = -1


@dataclass(frozen=True)
class Checkpoint:
    """window_offset -1: the window is consumed; k >= 0: its first k events are. flexible: any start will do."""

    mode: str = ClientMode.ONLINE_CONSUMPTION.value
    window_scn: int = -1
    window_offset: int = FULL_WINDOW
    prev_scn: int = -1
    ts_ns: int = -1
    since_scn: int = -1
    start_scn: int = -1
    target_scn: int = -1
    snapshot_offset: int = -1
    snapshot_src_idx: int = 0
    catchup_src_idx: int = 0
    flexible: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Checkpoint:
        return Checkpoint(**json.loads(text))


def online(scn: int) -> Checkpoint:
    return Checkpoint(window_scn=scn, prev_scn=scn)


def flexible() -> Checkpoint:
    return Checkpoint(flexible=True)


def at_time(ts_ns: int) -> Checkpoint:
    return Checkpoint(flexible=True, ts_ns=ts_ns)


def advance(c: Checkpoint, events: Iterable[tuple[int, int]]) -> Checkpoint:
    """After events (scn, src_id): an end-of-period row closes its window, data moves the offset or opens a window."""
    for scn, src in events:
        if src == ControlType.END_OF_PERIOD:
            c = replace(c, window_scn=scn, prev_scn=scn, window_offset=FULL_WINDOW, flexible=False)
        elif src >= 0:
            same = c.window_scn == scn and c.window_offset >= 0
            c = replace(c, window_scn=scn, window_offset=c.window_offset + 1 if same else 1, flexible=False)
    return c


def problems(c: Checkpoint) -> list[str]:
    """What breaks the rules of the checkpoint's mode."""
    out = []
    mode = ClientMode(c.mode)
    if mode is ClientMode.ONLINE_CONSUMPTION:
        if not c.flexible and c.window_scn < 0:
            out.append("online without a window")
        if c.window_offset < FULL_WINDOW:
            out.append("offset below -1")
        if c.window_offset == FULL_WINDOW and not c.flexible and c.prev_scn != c.window_scn:
            out.append("a full window whose predecessor is another")
    if mode in (ClientMode.BOOTSTRAP_SNAPSHOT, ClientMode.BOOTSTRAP_CATCHUP):
        if c.since_scn < 0:
            out.append("bootstrap without since")
        if c.start_scn < 0:
            out.append("bootstrap without start")
    if mode is ClientMode.BOOTSTRAP_SNAPSHOT and c.snapshot_offset < -1:
        out.append("snapshot offset below -1")
    if mode is ClientMode.BOOTSTRAP_CATCHUP:
        if c.target_scn < c.start_scn:
            out.append("target below start")
        if c.catchup_src_idx > c.snapshot_src_idx:
            out.append("catch-up ahead of the snapshots")
    return out


def position(c: Checkpoint, *, min_scn: int | None, prev_scn: int, last_scn: int, latest: bool = False) -> tuple[int, int]:
    """(scn, offset) at which a read starts, given the log's bounds (min_scn None: empty). Raises ScnNotFound if it fell off."""
    if min_scn is None:
        if c.flexible or c.window_scn >= prev_scn:
            return max(c.window_scn, prev_scn), FULL_WINDOW
        raise ScnNotFound(f"{c.window_scn} is below the empty log's {prev_scn}")
    if latest:
        return last_scn, 0
    if c.flexible:
        return min_scn, 0
    if c.window_scn < min_scn:
        if c.window_scn > prev_scn or (c.window_scn == prev_scn and c.window_offset == FULL_WINDOW):
            return min_scn, 0
        raise ScnNotFound(f"{c.window_scn} is below {prev_scn}")
    return c.window_scn, c.window_offset


def restart(c: Checkpoint) -> Checkpoint:
    """A partial window is read again from the end of the one before; without that, any start will do."""
    if c.window_offset <= 0:
        return c
    return online(c.prev_scn) if c.prev_scn > 0 else flexible()


def replace_file(spark: SparkSession, path, text: str) -> None:
    """Writes aside and renames, so that a reader finds the old text or the new one, whole."""
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(aside, path):  # some file systems do not rename onto a file
        fs.delete(path, False)
        fs.rename(aside, path)


class MaxScnStore:
    """The greatest sequence number of each server (or partition), as a file each. Smaller ones are not taken unless forced."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def _path(self, server: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{server}.maxscn")

    def load(self, server: str, default: int = -1) -> int:
        p = self._path(server)
        if not p.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(p):
            return default
        return int(self._spark.read.text(p.toString(), wholetext=True).first()[0].split(":")[0])

    def save(self, server: str, scn: int, *, force: bool = False) -> int:
        """What is kept then."""
        held = self.load(server)
        if scn > held or force:
            replace_file(self._spark, self._path(server), f"{scn}:{time.time_ns() // 1_000_000}")
            return scn
        return held

    def all(self) -> DataFrame:
        """server, scn."""
        rows = self._spark.read.text(f"{self._folder}/*.maxscn", wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
        return rows.select(F.regexp_extract("file", r"^(.*)\.maxscn$", 1).alias("server"), F.substring_index("value", ":", 1).cast("bigint").alias("scn"))


class CheckpointStore:
    """Checkpoints by name as one JSON file each, in a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self._fs = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
        self._spark = spark

    def save(self, name: str, c: Checkpoint) -> None:
        replace_file(self._spark, self._path(name), c.to_json())

    def load(self, name: str) -> Checkpoint | None:
        p = self._path(name)
        if not self._fs(p).exists(p):
            return None
        return Checkpoint.from_json(self._spark.read.text(p.toString(), wholetext=True).first()[0])

    def delete(self, name: str) -> None:
        p = self._path(name)
        self._fs(p).delete(p, False)
