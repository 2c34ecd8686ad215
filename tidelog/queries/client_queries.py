"""Clients of the log: callbacks, retries, several consumers at once; event files written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import convert as V
from ..schema import ConsumerResult
from ..sources import jsonlines as J
from ..streaming import consumers as C
from .registry import query

W = f"WITH {X.LOG}"
COUNTS = """pp_id, 0::INT AS result, max(scn) AS scn, -1::BIGINT AS "offset", count(DISTINCT scn) AS windows, count(DISTINCT (scn, src_id)) AS sources, count(*) AS events,
  count(DISTINCT scn) AS checkpoints, 0::BIGINT AS rollbacks"""
COLUMNS = ("pp_id", "result", "scn", "offset", "windows", "sources", "events", "checkpoints", "rollbacks")


def _log(spark, sf):
    return X.events_log(spark, sf).select("pp_id", "scn", "src_id", "seq", "id", "size_bytes", "event_type")


class FailsOnce(C.StreamConsumer):
    """Fails at the first sight of each event whose id is divisible by 97."""

    def __init__(self):
        self._seen: set[int] = set()

    def on_event(self, event: C.Event) -> ConsumerResult:
        if event["id"] % 97 or event["id"] in self._seen:
            return ConsumerResult.SUCCESS
        self._seen.add(event["id"])
        return ConsumerResult.ERROR

    def on_checkpoint(self, scn: int, offset: int) -> ConsumerResult:
        self._seen.clear()  # what is behind the checkpoint does not come again
        return ConsumerResult.SUCCESS


@query("u01_stream_consumer", f"{W} SELECT {COUNTS} FROM log GROUP BY pp_id")
def _stream(spark, sf):
    return C.deliver_partitions(_log(spark, sf), C.StreamConsumer).select(*COLUMNS)


@query("u04_multi_consumer", f"{W} SELECT {COUNTS} FROM log GROUP BY pp_id")
def _multi(spark, sf):
    make = lambda: C.MultiConsumer([C.StreamConsumer(), C.SelectingConsumer({101: lambda e: ConsumerResult.SUCCESS})], timeout=60)
    return C.deliver_partitions(_log(spark, sf), make).select(*COLUMNS)


@query("w12_rollback_and_retry", f"{W} SELECT pp_id, max(scn) AS scn, count(*) FILTER (WHERE id % 97 = 0) AS rollbacks, count(DISTINCT scn) AS checkpoints FROM log GROUP BY pp_id")
def _retry(spark, sf):
    return C.deliver_partitions(_log(spark, sf), FailsOnce, retries=10).select("pp_id", "scn", "rollbacks", "checkpoints")


@query("w14_checkpoint_in_window", f"{W}, s AS (SELECT pp_id, scn, count(*) FILTER (WHERE size_bytes >= 68) AS k FROM log GROUP BY 1, 2) SELECT pp_id, sum(k + 1)::BIGINT AS checkpoints FROM s GROUP BY 1")
def _inside(spark, sf):
    # sizes are 0 or beyond the budget, so that each large event has a checkpoint behind it
    log = _log(spark, sf).withColumn("size_bytes", F.when(F.col("size_bytes") >= 68, F.col("size_bytes")).otherwise(0))
    return C.deliver_partitions(log, C.StreamConsumer, checkpoint_bytes=68).select("pp_id", "checkpoints")


@query("s25_json_lines", f"{W} SELECT id AS scn, key_long, pp_id, lp_id, src_id, ts_ns, props AS payload FROM log")
def _lines(spark, sf):
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp()
    path = f"{at.rstrip('/')}/events-{uuid.uuid4().hex}"
    log = X.events_log(spark, sf).select("ts_ns", F.col("id").alias("scn"), "key_long", "lp_id", "pp_id", "src_id", F.lit("abcdefghijklmnop").alias("schema_id"), F.col("props").alias("payload"))
    J.write_events(log, path)
    return J.read_events(spark, path).select("scn", "key_long", "pp_id", "lp_id", "src_id", "ts_ns", "payload")


@query("p21_camel_case", """SELECT p_partkey, w[1] || array_to_string(list_transform(w[2:], lambda x: upper(x[1:1]) || x[2:]), '') AS name
  FROM (SELECT p_partkey, string_split(lower(replace(p_type, ' ', '_') || '_' || replace(p_brand, '#', '_')), '_') AS w FROM part)""")
def _camel(spark, sf):
    under = lambda c, x: F.replace(c, F.lit(x), F.lit("_"))
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", V.camel_case(F.concat(under("p_type", " "), F.lit("_"), under("p_brand", "#"))).alias("name"))
