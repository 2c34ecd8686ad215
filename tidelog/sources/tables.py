"""Sources by name, and the registry that finds one for a URI scheme."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: scheme -> reader(spark, uri, options)
_READERS: dict[str, Callable[[SparkSession, str, dict], DataFrame]] = {}


def register(scheme: str, reader: Callable[[SparkSession, str, dict], DataFrame]) -> None:
    _READERS[scheme] = reader


def open_source(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    """The DataFrame behind a source URI: jdbc:, mock:, gg: (XML trails), mysql: (decoded row events as JSON lines); anything else is another log's table."""
    scheme = uri.split(":", 1)[0] if ":" in uri else ""
    return _READERS.get(scheme, _log_table)(spark, uri, options)


def _log_table(spark: SparkSession, uri: str, options: dict) -> DataFrame:
    return spark.read.options(**options).parquet(uri)


def _jdbc(spark: SparkSession, uri: str, options: dict) -> DataFrame:
    """Needs the database's driver on the class path; split by partitionColumn, lowerBound, upperBound, numPartitions."""
    return spark.read.format("jdbc").options(**{"url": uri, "fetchsize": "10000", **options}).load()


def _trails(spark: SparkSession, uri: str, options: dict) -> DataFrame:
    from .trails import read_trails

    return read_trails(spark, uri.split(":", 1)[1])


def _row_events(spark: SparkSession, uri: str, options: dict) -> DataFrame:
    from .jsonlines import read_row_events

    return read_row_events(spark, uri.split(":", 1)[1])


def _mock(spark: SparkSession, uri: str, options: dict) -> DataFrame:
    from .generators import random_events

    return random_events(spark, int(options.get("n", "1000")), seed=int(options.get("seed", "0")))


for _scheme, _reader in (("jdbc", _jdbc), ("gg", _trails), ("mysql", _row_events), ("mock", _mock)):
    register(_scheme, _reader)
