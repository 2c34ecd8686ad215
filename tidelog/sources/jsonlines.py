"""Events and row events as JSON lines, event logs, and the writers of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = (
    "timestampInNanos BIGINT, sequence BIGINT, key BIGINT, logicalPartitionId INT, physicalPartitionId INT, srcId INT, "
    "schemaId STRING, valueEnc STRING, value STRING, endOfPeriod BOOLEAN, traceEnabled BOOLEAN"
)
REQUIRED = ("timestampInNanos", "sequence", "key", "logicalPartitionId", "physicalPartitionId", "srcId", "schemaId", "valueEnc", "value")
ROW_EVENT = "stream STRING, pos BIGINT, kind STRING, file_no INT, offset BIGINT, table_name STRING, srckey STRING, payload STRING"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """One event a line; a data line that lacks a required field raises."""
    rows = spark.read.schema(EVENT).json(path)
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]
    lacks = F.array_compact(F.array(*missing))
    checked = F.when(~F.coalesce("endOfPeriod", F.lit(False)) & (F.size(lacks) > 0), F.raise_error(F.concat(F.lit("missing "), F.array_join(lacks, ", "))).cast("bigint")).otherwise(F.col("sequence"))
    return rows.select(
        checked.alias("scn"), F.col("key").alias("key_long"), F.col("physicalPartitionId").alias("pp_id"), F.col("logicalPartitionId").alias("lp_id"),
        F.when(F.coalesce("endOfPeriod", F.lit(False)), F.lit(-2)).otherwise(F.col("srcId")).alias("src_id"), F.col("timestampInNanos").alias("ts_ns"),
        F.unbase64("schemaId").alias("schema_id"), F.when(F.col("valueEnc") == "JSON", F.decode(F.unbase64("value"), "UTF-8")).otherwise(F.col("value")).alias("payload"),
        F.coalesce("traceEnabled", F.lit(False)).alias("is_trace"),
    )


def to_event_json(log: DataFrame, encoding: str = "JSON") -> DataFrame:
    """Column line: an event as JSON, its payload in base64 (JSON) or as text (JSON_PLAIN_VALUE)."""
    value = F.base64(F.encode("payload", "UTF-8")) if encoding == "JSON" else F.col("payload")
    fields = [
        F.col("ts_ns").alias("timestampInNanos"), F.col("scn").alias("sequence"), F.col("key_long").alias("key"), F.col("lp_id").alias("logicalPartitionId"),
        F.col("pp_id").alias("physicalPartitionId"), F.col("src_id").alias("srcId"), F.base64(F.encode(F.col("schema_id"), "UTF-8")).alias("schemaId"), F.lit(encoding).alias("valueEnc"), value.alias("value"),
    ]
    return log.select("*", F.to_json(F.struct(*fields)).alias("line"))


def write_events(log: DataFrame, path: str, *, encoding: str = "JSON", rows_per_file: int = 1_000_000) -> None:
    to_event_json(log, encoding).select("line").write.mode("append").option("maxRecordsPerFile", rows_per_file).text(path)


def read_row_events(spark: SparkSession, path: str) -> DataFrame:
    """Decoded binlog row events."""
    return spark.read.schema(ROW_EVENT).json(path)


def complete_windows(log: DataFrame) -> DataFrame:
    """An event log up to its last end-of-period row, per partition."""
    last = log.filter(F.col("src_id") == -2).groupBy("pp_id").agg(F.max("scn").alias("last"))
    return log.join(last, "pp_id").filter(F.col("scn") <= F.col("last")).drop("last")


def convert(spark: SparkSession, source: str, kind: str, target: str, to: str) -> None:
    """Records of one file format in another (json, parquet, orc, csv; avro where its package is on the class path)."""
    spark.read.format(kind).load(source).write.mode("overwrite").format(to).save(target)
