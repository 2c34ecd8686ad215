"""Comparing a snapshot with its source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(source: DataFrame, snapshot: DataFrame, key: str, fields: list[str], *, txn: str = "txn") -> DataFrame:
    """Full outer join on the key and the class of each key:
    DATA_EQUAL, KEY_EQUAL (data differs, same transaction), SOURCE_OLDER, SNAPSHOT_OLDER, ABSENT_IN_SOURCE, ABSENT_IN_SNAPSHOT."""
    a = source.select(F.col(key).alias("__a"), *[F.col(f).alias(f"a_{f}") for f in (*fields, txn)])
    b = snapshot.select(F.col(key).alias("__b"), *[F.col(f).alias(f"b_{f}") for f in (*fields, txn)])
    same = reduce(lambda x, y: x & y, [F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")) for f in fields], F.lit(True))
    kind = (
        F.when(F.col("__a").isNull(), "ABSENT_IN_SOURCE").when(F.col("__b").isNull(), "ABSENT_IN_SNAPSHOT").when(same, "DATA_EQUAL")
        .when(F.col(f"a_{txn}") < F.col(f"b_{txn}"), "SOURCE_OLDER").when(F.col(f"a_{txn}") > F.col(f"b_{txn}"), "SNAPSHOT_OLDER").otherwise("KEY_EQUAL")
    )
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), kind.alias("class"))


def verdict(compared: DataFrame) -> DataFrame:
    """Counts by class, and whether all is equal."""
    counts = [F.count_if(F.col("class") == c).alias(c.lower()) for c in ("DATA_EQUAL", "KEY_EQUAL", "SOURCE_OLDER", "SNAPSHOT_OLDER", "ABSENT_IN_SOURCE", "ABSENT_IN_SNAPSHOT")]
    return compared.agg(F.count("*").alias("processed"), *counts).withColumn("passed", F.col("processed") == F.col("data_equal"))


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each left key with whether right has it."""
    return left.select(key).join(right.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left").select(key, F.col("__k").isNotNull().alias("found"))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")
