"""Snapshot, catch-up, rotation, retention, audit: B, J, K."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import audit as U
from ..operators import filters as L
from ..operators import snapshot as S
from .registry import query

W = f"WITH {X.LOG}"
#: The snapshot before window {0}: id of the first entry, last image otherwise.
SNAP = f"{W}, snap AS (SELECT srckey, min(id) AS id, arg_max(scn, log.id) AS scn, arg_max(opcode, log.id) AS opcode, arg_max(value, log.id) AS value FROM log WHERE scn < {{0}} GROUP BY 1)"
COLS = ("srckey", "id", "scn", "opcode", "value")


@query("b05_apply_log", SNAP.format(10**9) + " SELECT * FROM snap")
def _apply(spark, sf):
    return S.apply_log(X.events_log(spark, sf)).select(*COLS)


@query("b05_merge_snapshot", SNAP.format(10**9) + " SELECT * FROM snap")
def _merge(spark, sf):
    log = X.events_log(spark, sf)
    return S.merge_snapshot(S.apply_log(log, before_scn=400), log.filter("scn >= 400")).select(*COLS)


@query("b06_producer_guard", f"{W} SELECT id FROM log WHERE scn >= 640")
def _guard(spark, sf):
    from ..operators.capture import guarded

    return guarded(X.events_log(spark, sf), 640).select("id")


@query("b07_snapshot_read", SNAP.format(600) + " SELECT * FROM snap WHERE scn < 600 AND scn >= 200 AND id > 5 AND srckey::BIGINT % 4 IN (1, 2) ORDER BY id LIMIT 1000")
def _snapshot(spark, sf):
    snap = S.apply_log(X.events_log(spark, sf), before_scn=600)
    rows = S.snapshot_rows(snap, start_scn=600, since_scn=200, predicate=L.key_mod(F.col("srckey"), 4, 1, 3))
    return S.page(rows, after=5).select(*COLS)


@query("b08_catchup_read", f"{W} SELECT id, scn, srckey FROM log WHERE scn BETWEEN 600 AND 800 AND scn >= 650 AND id > 6600 ORDER BY id LIMIT 1000")
def _catchup(spark, sf):
    rows = S.catchup_rows(X.events_log(spark, sf), start_scn=600, target_scn=800, since_scn=650)
    return S.page(rows, after=6600).select("id", "scn", "srckey")


@query("b09_snapshot_then_catchup", f"""{W}, s AS (SELECT srckey, arg_max(scn, id) AS scn, arg_max(opcode, id) AS opcode, arg_max(value, id) AS value FROM log WHERE scn <= 800 AND key_long % 3 IN (0, 1) GROUP BY 1)
  SELECT srckey, scn, opcode, value FROM s WHERE scn >= 100""")
def _both(spark, sf):
    rows = S.snapshot_then_catchup(X.events_log(spark, sf), start_scn=500, target_scn=800, since_scn=100, predicate=L.key_mod(F.col("key_long"), 3, 0, 2))
    return rows.select("srckey", "scn", "opcode", "value")


@query("b09_live_keys", f"{W} SELECT srckey FROM log GROUP BY 1 HAVING arg_max(opcode, id) <> 'DELETE'")
def _live(spark, sf):
    return S.live(S.apply_log(X.events_log(spark, sf))).select("srckey")


@query("b01_last_image_in_transaction", f"{W} SELECT scn AS txn, srckey, max(seq) AS pos, arg_max(event_type, seq) AS event_type FROM log GROUP BY 1, 2")
def _last(spark, sf):
    from ..operators.capture import dedupe_transaction

    log = X.events_log(spark, sf).select(F.col("scn").alias("txn"), "src_id", "srckey", F.col("seq").alias("pos"), "event_type")
    return dedupe_transaction(log).select("txn", "srckey", "pos", "event_type")


@query("b02_last_image_by_scn", """SELECT srckey, scn, l_quantity, l_extendedprice FROM (SELECT l_orderkey::VARCHAR || chr(9) || l_linenumber::VARCHAR AS srckey, l_orderkey // 20 + 1 AS scn, *,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1""")
def _by_scn(spark, sf):
    log = X.lines_log(spark, sf)
    order = F.struct("l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey")
    return S.last_image(log.withColumn("pos", order), ["srckey", "scn"], "pos").select("srckey", "scn", "l_quantity", "l_extendedprice")


@query("b03_source_order", f"{W} SELECT id, row_number() OVER (PARTITION BY scn ORDER BY lp_id, seq)::INT AS out_pos FROM log")
def _order(spark, sf):
    return S.source_order(X.events_log(spark, sf), src="lp_id", position="seq").select("id", "out_pos")


@query("b04_log_rotation", """WITH RECURSIVE w AS (SELECT l_orderkey // 20 + 1 AS scn, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY scn) AS i FROM w),
  f AS (SELECT scn, n, i, 0 AS log_id, n AS held FROM o WHERE i = 1 UNION ALL
    SELECT o.scn, o.n, o.i, CASE WHEN f.held >= 10000 THEN f.log_id + 1 ELSE f.log_id END, CASE WHEN f.held >= 10000 THEN o.n ELSE f.held + o.n END FROM f JOIN o ON o.i = f.i + 1)
  SELECT scn, n, log_id FROM f""")
def _rotate(spark, sf):
    windows = X.lines_log(spark, sf).groupBy("src_id", "scn").agg(F.count("*").alias("n"))
    return S.rotate(windows).select("scn", "n", "log_id")


def _with_logs(spark, sf):
    return X.events_log(spark, sf).withColumn("log_id", F.expr("int((id - 1) div 1000)"))


LOGS = f"{W}, info AS (SELECT src_id, ((id - 1) // 1000)::INT AS log_id, min(scn) AS min_scn, max(scn) AS max_scn, max(id) AS max_rid FROM log GROUP BY 1, 2)"


@query("a14_log_info", LOGS + " SELECT * FROM info")
def _info(spark, sf):
    return S.log_info(_with_logs(spark, sf))


@query("b14_log_for_scn", LOGS + " SELECT src_id, min(log_id) AS log_id FROM info WHERE min_scn <= 450 AND max_scn >= 450 GROUP BY 1")
def _find(spark, sf):
    return S.log_for_scn(S.log_info(_with_logs(spark, sf)), 450)


@query("b10_start_scn", f"{W} SELECT min(m) AS start_scn FROM (SELECT max(scn) AS m FROM log WHERE id % 5 <> 0 GROUP BY pp_id)")
def _start(spark, sf):
    from ..plans.bootstrap import SourceState, start_scn

    log = X.events_log(spark, sf)
    rows = log.groupBy("pp_id").agg(F.max(F.when(F.col("id") % 5 != 0, F.col("scn"))).alias("a"), F.max("scn").alias("p")).collect()  # a row per source
    return spark.range(1).select(F.lit(start_scn([SourceState(r.a, r.p) for r in rows], 10)).cast("bigint").alias("start_scn"))


@query("b11_bypass_snapshot", f"{W} SELECT coalesce(bool_and(n <= 4000), true) AS bypass FROM (SELECT count(*) AS n FROM log WHERE scn >= 700 AND scn < 900 GROUP BY pp_id)")
def _bypass(spark, sf):
    from ..plans.bootstrap import bypass_snapshot

    log = X.events_log(spark, sf).filter("scn >= 700 AND scn < 900")
    counts = {str(r.pp_id): r.n for r in log.groupBy("pp_id").agg(F.count("*").alias("n")).collect()}  # a row per source
    return spark.range(1).select(F.lit(bypass_snapshot(700, counts, 4000)).alias("bypass"))


@query("b13_min_scn", SNAP.format(10**9) + " SELECT 101 AS src_id, greatest(min(scn) - 1, 0) AS min_scn FROM snap WHERE id <= 200")
def _min_scn(spark, sf):
    return S.min_scn(S.apply_log(X.events_log(spark, sf)), up_to_id=200)


@query("b17_target_scn", f"{W} SELECT src_id, max(scn) AS target_scn FROM log GROUP BY 1")
def _target(spark, sf):
    return X.events_log(spark, sf).groupBy("src_id").agg(F.max("scn").alias("target_scn"))


@query("b18_seeding", "SELECT n_nationkey AS src_id, 100::BIGINT AS producer_scn, 100::BIGINT AS applier_scn, 0 AS log_id, 'SEEDING_CATCHUP' AS status FROM nation")
def _seeding(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return S.seeded(n.select(F.col("n_nationkey").alias("src_id"), (F.col("n_nationkey") + 100).cast("bigint").alias("start_scn"), F.lit(500).alias("end_scn")))


@query("b19_status", "SELECT n_nationkey AS src_id, CASE WHEN n_nationkey * 10 >= 120 THEN 'ACTIVE' ELSE 'SEEDING_CATCHUP' END AS status FROM nation")
def _status(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    state = n.select(F.col("n_nationkey").alias("src_id"), F.lit("SEEDING_CATCHUP").alias("status"), (F.col("n_nationkey") * 10).alias("applier_scn"), F.lit(120).alias("seed_end_scn"))
    return S.status(state).select("src_id", "status")


@query("b20_retention", LOGS + """ SELECT src_id, log_id, min_scn, max_scn FROM (SELECT *, row_number() OVER (ORDER BY log_id DESC) AS nth FROM info WHERE max_scn < 800 AND log_id < (SELECT max(log_id) FROM info)) WHERE nth > 2""")
def _retention(spark, sf):
    return S.retained_logs(S.log_info(_with_logs(spark, sf)), threshold_scn=800, keep=2)


@query("b20_retention_seconds", LOGS + f""", t AS (SELECT ((id - 1) // 1000)::INT AS log_id, max(ts_ns) AS last_ts FROM log GROUP BY 1), c AS (SELECT median(ts_ns)::BIGINT AS m FROM log WHERE id IN (5000))
  SELECT src_id, log_id, min_scn, max_scn FROM info JOIN t USING (log_id), c WHERE max_scn < 900 AND log_id < (SELECT max(log_id) FROM info) AND last_ts <= 1709251200000000000""")
def _retention_s(spark, sf):
    log = _with_logs(spark, sf)
    last = log.groupBy("src_id", "log_id").agg(F.max("ts_ns").alias("last_ts_ns"))
    return S.expired_logs(S.log_info(log), last, threshold_scn=900, older_than_ns=1_709_251_200_000_000_000)


@query("b21_threshold", f"{W} SELECT min(m) AS scn FROM (SELECT max(scn) AS m FROM log GROUP BY pp_id)")
def _threshold(spark, sf):
    return X.events_log(spark, sf).groupBy("pp_id").agg(F.max("scn").alias("m")).agg(F.min("m").alias("scn"))


@query("b22_purge", SNAP.format(10**9) + " SELECT 'snapshot' AS part, count(*) AS n FROM snap WHERE scn > 300 UNION ALL SELECT 'log', count(*) FROM log WHERE (id - 1) // 1000 >= 3")
def _purge(spark, sf):
    log = _with_logs(spark, sf)
    dropped = S.log_info(log).filter("max_scn <= 300")
    snap, rest = S.purge(S.apply_log(X.events_log(spark, sf)), log, dropped, through_scn=300)
    n = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return n(snap, "snapshot").unionByName(n(rest, "log"))


@query("b22_log_start", LOGS + " SELECT src_id, min(log_id) AS log_id, min(min_scn) AS logstartscn FROM info WHERE min_scn > 300 GROUP BY 1")
def _log_start(spark, sf):
    return S.log_start(S.log_info(_with_logs(spark, sf)), 300)


AUDIT = """WITH a AS (SELECT *, o_orderkey // 20 AS txn FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN o_orderkey // 20 - 1 ELSE o_orderkey // 20 END AS txn,
  CASE WHEN o_orderkey % 89 = 0 OR o_orderkey % 83 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 97 <> 0),
  c AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'ABSENT_IN_SOURCE' WHEN b.o_orderkey IS NULL THEN 'ABSENT_IN_SNAPSHOT'
  WHEN a.o_totalprice = b.o_totalprice AND a.o_orderstatus = b.o_orderstatus THEN 'DATA_EQUAL' WHEN a.txn < b.txn THEN 'SOURCE_OLDER' WHEN a.txn > b.txn THEN 'SNAPSHOT_OLDER' ELSE 'KEY_EQUAL' END AS class
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) """


def _compared(spark, sf):
    return U.compare(X.orders_table(spark, sf), X.perturbed_orders(spark, sf), "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("j06_audit_join", AUDIT + "SELECT o_orderkey, class FROM c")
def _audit(spark, sf):
    return _compared(spark, sf)


@query("j07_audit_lookup", "SELECT o_orderkey, o_orderkey % 97 <> 0 AS found FROM orders")
def _lookup(spark, sf):
    return U.lookup(X.orders_table(spark, sf), X.perturbed_orders(spark, sf), "o_orderkey")


@query("j08_audit_verdict", AUDIT + """SELECT count(*) AS processed, count(*) FILTER (WHERE class = 'DATA_EQUAL') AS data_equal, count(*) FILTER (WHERE class = 'KEY_EQUAL') AS key_equal,
  count(*) FILTER (WHERE class = 'SOURCE_OLDER') AS source_older, count(*) FILTER (WHERE class = 'SNAPSHOT_OLDER') AS snapshot_older, count(*) FILTER (WHERE class = 'ABSENT_IN_SOURCE') AS absent_in_source,
  count(*) FILTER (WHERE class = 'ABSENT_IN_SNAPSHOT') AS absent_in_snapshot, false AS passed FROM c""")
def _verdict(spark, sf):
    return U.verdict(_compared(spark, sf))


@query("b25_audit_absent", "SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0")
def _absent(spark, sf):
    return U.missing(X.orders_table(spark, sf), X.perturbed_orders(spark, sf), "o_orderkey").select("o_orderkey")


@query("k09_log_append", f"{W} SELECT scn, scn AS window_scn, srckey, event_type FROM log WHERE scn >= 300")
def _append(spark, sf):
    from ..operators.capture import guarded

    return guarded(X.events_log(spark, sf), 300).select("scn", F.col("scn").alias("window_scn"), "srckey", "event_type")


@query("k10_seed_upsert", SNAP.format(500) + " SELECT srckey, scn, value FROM snap")
def _seed(spark, sf):
    return S.apply_log(X.events_log(spark, sf), before_scn=500).select("srckey", "scn", "value")


@query("x08_metadata_report", LOGS + " SELECT src_id, min(min_scn) AS log_min_scn, max(max_scn) AS log_max_scn, count(*) AS n_logs FROM info GROUP BY 1")
def _report(spark, sf):
    return S.log_info(_with_logs(spark, sf)).groupBy("src_id").agg(F.min("min_scn").alias("log_min_scn"), F.max("max_scn").alias("log_max_scn"), F.count("*").alias("n_logs"))
