"""The test tables as change-data-capture inputs, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_NS = 1_735_689_600_000_000_000  # 2025-01-01, so that latencies do not depend on the clock


def events_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as the change log of source 101: ten events a window, users as keys, errors as deletes."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.lit(101).alias("src_id"), (F.col("event_id") + 1).alias("id"), F.expr("event_id div 10 + 1").alias("scn"), (F.col("event_id") % 10 + 1).alias("seq"),
        F.col("user_id").alias("key_long"), F.col("user_id").cast("string").alias("srckey"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT").alias("opcode"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), (F.col("user_id") % 3).cast("int").alias("pp_id"), (F.col("user_id") % 8).cast("int").alias("lp_id"),
        (F.length("props") + 61).alias("size_bytes"), F.length("props").alias("payload_bytes"), (F.get_json_object("props", "$.k").cast("bigint") < 10).alias("is_replicated"),
        "event_type", "value", "props",
    )


LOG = """log AS (SELECT 101 AS src_id, event_id + 1 AS id, event_id // 10 + 1 AS scn, event_id % 10 + 1 AS seq, user_id AS key_long,
  user_id::VARCHAR AS srckey, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPSERT' END AS opcode, epoch_us(ts) * 1000 AS ts_ns,
  (user_id % 3)::INT AS pp_id, (user_id % 8)::INT AS lp_id, (length(props) + 61)::INT AS size_bytes, length(props)::INT AS payload_bytes,
  (json_extract(props, '$.k'))::BIGINT < 10 AS is_replicated, event_type, value, props FROM events)"""


def lines_log(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as the change log of source 102: composite keys that repeat, 20 orders a window. Ties are broken by all columns."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select(
        F.lit(102).alias("src_id"), F.concat_ws("\t", "l_orderkey", "l_linenumber").alias("srckey"), F.expr("l_orderkey div 20 + 1").alias("scn"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )


def orders_table(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("*", F.expr("o_orderkey div 20").alias("txn"), F.lit(103).alias("src_id"), (F.col("o_orderkey") + 7).alias("row_scn"))


def txlog(spark: SparkSession, sf: str, infinity_from: int | None = None) -> DataFrame:
    """txn, scn of orders; transactions from infinity_from on have no number yet."""
    from .schema import INFINITY_SCN

    t = orders_table(spark, sf).select("txn").distinct()
    scn = F.col("txn") + 1
    return t.withColumn("scn", scn if infinity_from is None else F.when(F.col("txn") >= infinity_from, F.lit(INFINITY_SCN)).otherwise(scn))


ORDERS = "o AS (SELECT *, o_orderkey // 20 AS txn, o_orderkey + 7 AS row_scn FROM orders), tx AS (SELECT DISTINCT txn, txn + 1 AS scn FROM o)"
ORDERS_INF = "o AS (SELECT *, o_orderkey // 20 AS txn, o_orderkey + 7 AS row_scn FROM orders), tx AS (SELECT DISTINCT txn, CASE WHEN txn >= 400 THEN 9999999999999999 ELSE txn + 1 END AS scn FROM o)"


def perturbed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """orders with keys % 97 = 0 dropped, % 89 = 0 of an older transaction, % 83 = 0 edited."""
    o = orders_table(spark, sf).filter(F.col("o_orderkey") % 97 != 0)
    old, edit = F.col("o_orderkey") % 89 == 0, F.col("o_orderkey") % 83 == 0
    return o.withColumn("txn", F.when(old, F.col("txn") - 1).otherwise(F.col("txn"))).withColumn(
        "o_totalprice", F.when(old | edit, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
