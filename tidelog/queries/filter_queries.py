"""F01..F26."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import filters as L
from .registry import query

W = f"WITH {X.LOG} "


def _ids(name: str, predicate, sql: str) -> None:
    """A query that returns id and key of the events that a predicate keeps."""
    query(name, f"{W} SELECT id, key_long FROM log WHERE {sql}")(lambda spark, sf: X.events_log(spark, sf).filter(predicate()).select("id", "key_long"))


_ids("f01_allow_all", L.allow_all, "true")
_ids("f02_source_set", lambda: L.sources([101, 7]), "src_id IN (101, 7)")
_ids("f03_key_mod_filter", lambda: L.key_mod(F.col("key_long") - 60, 10, 2, 5), "abs(key_long - 60) % 10 BETWEEN 2 AND 4")
_ids("f04_key_range_filter", lambda: L.key_range(F.col("srckey"), 20, 90), "key_long >= 20 AND key_long < 90")
_ids("f05_ring_range", lambda: L.in_range(F.col("key_long") - 10, 120, 30), "key_long - 10 >= 0 AND (key_long - 10 >= 120 OR key_long - 10 < 30)")
_ids("f06_key_filter_any", lambda: L.KeyFilter("RANGE", ((0, 10), (140, 150))).column(F.col("key_long")), "(key_long >= 0 AND key_long < 10) OR (key_long >= 140 AND key_long < 150)")
_ids("f07_range_ids", lambda: L.range_filter(25, "[1,3-4]").column(F.col("key_long")), "key_long // 25 IN (1, 3, 4)")
_ids("f08_filter_grammar", lambda: L.mod_filter(8, "[0,2,4-5]").column(F.col("key_long")), "key_long % 8 IN (0, 2, 4, 5)")
_ids(
    "f09_json_config",
    lambda: L.by_source(L.parse_source_filters('{"101": {"partitionType": "MOD", "filters": [{"numBuckets": 7, "bktRange": {"start": 1, "end": 3}}]}}'), F.col("src_id"), F.col("key_long")),
    "key_long % 7 IN (1, 2)",
)
_ids("f10_by_source", lambda: L.by_source({101: L.KeyFilter("RANGE", ((0, 50),)), 5: L.KeyFilter("MOD")}, F.col("src_id"), F.col("key_long")), "key_long < 50")
_ids("f11_merge_filters", lambda: L.mod_filter(5, "[1]").merge(L.mod_filter(7, "[1]")).merge(L.mod_filter(5, "[1]")).column(F.col("key_long")), "key_long % 5 = 1 OR key_long % 7 = 1")
_ids("f13_logical_partitions", lambda: L.logical([(101, 3), (101, 5), (None, 1)], F.col("src_id"), F.col("lp_id")), "lp_id IN (3, 5)")
_ids("f14_physical_partition", lambda: L.physical(1, L.logical([(101, None)], F.col("src_id"), F.col("lp_id")), F.col("pp_id")), "pp_id = 1")
_ids("f15_conjunction", lambda: L.conjunction([F.col("pp_id") == 2, L.key_range(F.col("key_long"), 0, 80)]), "pp_id = 2 AND key_long < 80")
_ids("f16_subscriptions", lambda: L.subscriptions([(0, 101, 3), (2, 101, None)], F.col("pp_id"), F.col("src_id"), F.col("lp_id")), "(pp_id = 0 AND lp_id = 3) OR pp_id = 2")
_ids("f17_min_max_key", lambda: L.min_max_key(F.col("key_long"), 30, 60), "key_long >= 30 AND key_long < 60")
_ids("f18_filter_to_sql", lambda: F.expr(L.KeyFilter("MOD", ((9, 2, 4), (11, 0, 1))).sql("key_long")), "(key_long % 9 >= 2 AND key_long % 9 < 4) OR (key_long % 11 >= 0 AND key_long % 11 < 1)")
_ids("f19_scn_predicates", lambda: (F.col("scn") < 700) & (F.col("scn") >= 300), "scn < 700 AND scn >= 300")
_ids("f20_payload_greater", lambda: L.payload_field(F.col("value"), ">", "50.5", "double"), "value > 50.5")
_ids("f20_payload_integral", lambda: L.payload_field(F.get_json_object("props", "$.k"), "==", "7.9", "bigint"), "(json_extract(props, '$.k'))::BIGINT = 7")
_ids("f20_payload_text", lambda: L.payload_field(F.col("event_type"), "<", "error", "string"), "event_type < 'error'")
_ids("f21_metadata_range", lambda: L.metadata_range(F.col("srckey"), F.col("scn"), "12", "30", 100, 600), "srckey >= '12' AND srckey <= '30' AND scn >= 100 AND scn <= 600")
_ids("f22_replication_bit", lambda: L.replicated(F.when(F.col("is_replicated"), F.col("event_type")), "click|view", "LOCAL"), "is_replicated AND event_type IN ('click', 'view')")
_ids("f23_partitioned_client", lambda: L.partition_filter("MOD", 4, 2).column(F.col("key_long")), "key_long % 4 = 2")


@query("f03_string_key_mod", """WITH RECURSIVE c AS (SELECT c_custkey, c_name, 1 AS i, 0::BIGINT AS h FROM customer UNION ALL
  SELECT c_custkey, c_name, i + 1, (h * 31 + unicode(substr(c_name, i, 1))) % 4294967296 FROM c WHERE i <= length(c_name)),
  k AS (SELECT c_custkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM c WHERE i = length(c_name) + 1)
  SELECT c_custkey, hash FROM k WHERE abs(hash) % 10 BETWEEN 3 AND 6""")
def _string_mod(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    kept = c.filter(L.key_mod(F.col("c_name"), 10, 3, 7, "string"))  # a filter on the column hash would compute it for each place where it is named
    return kept.select("c_custkey", L.numeric_key(F.col("c_name"), "string").alias("hash"))


@query("f12_control_bypass", f"""{W} SELECT id, src_id FROM (SELECT id, src_id, key_long FROM log UNION ALL SELECT max(id), -2, NULL FROM log GROUP BY scn) WHERE src_id < 0 OR key_long < 20""")
def _bypass(spark, sf):
    log = X.events_log(spark, sf)
    eop = log.groupBy("scn").agg(F.max("id").alias("id")).select("id", F.lit(-2).alias("src_id"), F.lit(None).cast("bigint").alias("key_long"))
    return log.select("id", "src_id", "key_long").unionByName(eop).filter(L.or_control(L.key_range(F.col("key_long"), 0, 20), F.col("src_id"))).select("id", "src_id")


@query("f24_dispatch", f"{W} SELECT r.name AS registration, count(*) AS n FROM log, (VALUES ('all'), ('one')) r(name) GROUP BY r.name")
def _dispatch(spark, sf):
    return L.dispatch(X.events_log(spark, sf), {"all": [101, 102], "one": [101], "none": [7]}).groupBy("registration").agg(F.count("*").alias("n"))


@query("f25_sampling", f"{W} SELECT id FROM log WHERE ('0x' || substr(md5(id || ':3'), 1, 8))::BIGINT < 1073741824")
def _sample(spark, sf):
    return X.events_log(spark, sf).filter(L.sampled(25, F.col("id"), seed=3)).select("id")


@query("f26_validity", f"""{W} SELECT CASE WHEN size_bytes < 68 THEN 'PARTIAL' WHEN id % 50 = 0 THEN 'ERR' ELSE 'OK' END AS validity, count(*) AS n FROM log GROUP BY 1""")
def _validity(spark, sf):
    log = X.events_log(spark, sf)
    crc = L.checksum(F.encode("props", "UTF-8"))
    stored = F.when(F.col("id") % 50 == 0, crc + 1).otherwise(crc)
    return log.select(L.valid_event(F.encode("props", "UTF-8"), stored, F.col("size_bytes"), least=68).alias("validity")).groupBy("validity").agg(F.count("*").alias("n"))
