"""Sources and capture: S, J, N, K."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import capture as C
from ..operators import polling as P
from ..operators import state as D
from .registry import query

W = f"WITH {X.LOG}"
O = f"WITH {X.ORDERS} "
OI = f"WITH {X.ORDERS_INF} "
KEEP = ("o_orderkey", "txn", "scn")


@query("s01_changed_since", OI + "SELECT o_orderkey, txn, scn FROM o JOIN tx USING (txn) WHERE scn > 50 AND scn < 9999999999999999")
def _changed(spark, sf):
    return P.changed_since(X.orders_table(spark, sf), X.txlog(spark, sf, 400), 50).select(*KEEP)


@query("s02_no_skip_infinity", OI + "SELECT o_orderkey, txn, CASE WHEN scn = 9999999999999999 THEN row_scn ELSE scn END AS scn FROM o JOIN tx USING (txn) WHERE row_scn > 50 AND CASE WHEN scn = 9999999999999999 THEN row_scn ELSE scn END > 50")
def _row_scn(spark, sf):
    return P.changed_since_row_scn(X.orders_table(spark, sf), X.txlog(spark, sf, 400), 50).select(*KEEP)


@query("s03_chunk_by_transactions", O + "SELECT o_orderkey, txn, scn FROM o JOIN (SELECT * FROM tx WHERE scn > 20 ORDER BY scn LIMIT 100) USING (txn)")
def _chunk(spark, sf):
    return P.chunk_by_transactions(X.orders_table(spark, sf), X.txlog(spark, sf), 20, 100).select(*KEEP)


@query("s04_chunk_by_scn", O + "SELECT o_orderkey, txn, scn FROM o JOIN tx USING (txn) WHERE scn > 20 AND scn <= 220")
def _scn_chunk(spark, sf):
    return P.chunk_by_scn(X.orders_table(spark, sf), X.txlog(spark, sf), 20, 200).select(*KEEP)


@query("s05_skip_ahead", O + "SELECT max(scn) AS scn FROM (SELECT scn FROM tx WHERE scn > 30 ORDER BY scn LIMIT 64)")
def _skip(spark, sf):
    return P.skip_ahead(X.txlog(spark, sf), 30, 64)


@query("s06_max_scn", OI + "SELECT max(scn) AS max_scn FROM tx WHERE scn < 9999999999999999")
def _max(spark, sf):
    return P.max_scn(X.txlog(spark, sf, 400))


@query("s07_heartbeat", O + "SELECT greatest(max(scn), 5) AS scn, -2 AS src_id FROM tx")
def _beat(spark, sf):
    return P.heartbeat(X.txlog(spark, sf), 5)


@query("s08_poll_window", f"{W} SELECT src_id, id, 1234::BIGINT AS scn FROM log WHERE scn = 7 UNION ALL SELECT -2, NULL, 1234")
def _window(spark, sf):
    from ..operators.relay import with_control

    rows = C.stamp_window(X.events_log(spark, sf).filter("scn = 7"), 1234, 1000)
    return with_control(rows.drop("window_scn"), -2, 1234).select("src_id", "id", "scn")


@query("s09_committed_rows", f"{W} SELECT id FROM log WHERE scn > 2 AND scn % 7 <> 0 AND seq BETWEEN 2 AND 9")
def _committed(spark, sf):
    log = X.events_log(spark, sf)
    end = F.when(F.col("scn") % 7 == 0, "rollback").otherwise("commit")
    kind = F.when((F.col("seq") == 1) & (F.col("scn") > 2), "begin").when((F.col("seq") == 10) & (F.col("scn") > 2), end).otherwise("row")
    events = log.select("id", F.col("id").alias("pos"), kind.alias("kind"), F.lit("binlog").alias("stream"))
    return C.committed(events).select("id")


def _source_map(spark):
    return spark.range(1).select(F.explode(F.array(F.struct(F.lit("db.click").alias("table_name"), F.lit(7).alias("src_id")), F.struct(F.lit("db.view").alias("table_name"), F.lit(8).alias("src_id")))).alias("m")).select("m.*")


def _rows(spark, sf):
    log = X.events_log(spark, sf)
    kind = F.element_at(F.array(F.lit("insert"), F.lit("update"), F.lit("delete")), (F.col("id") % 3 + 1).cast("int"))
    return log.select("id", F.concat(F.lit("DB."), F.upper("event_type")).alias("table_name"), kind.alias("kind"))


@query("s11_row_mapping", f"{W} SELECT id, CASE event_type WHEN 'click' THEN 7 ELSE 8 END AS src_id, CASE WHEN id % 3 = 2 THEN 'DELETE' ELSE 'UPSERT' END AS opcode FROM log WHERE event_type IN ('click', 'view')")
def _mapping(spark, sf):
    return C.to_changes(_rows(spark, sf), _source_map(spark)).select("id", "src_id", "opcode")


@query("j09_unknown_sources", f"{W} SELECT event_type, count(*) AS n FROM log WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def _unknown(spark, sf):
    gone = C.unknown_sources(_rows(spark, sf), _source_map(spark))
    return gone.groupBy(F.substring("table_name", 4, 100).alias("event_type")).agg(F.count("*").alias("n"))


@query("s18_merge_same_scn", f"""{W}, t AS (SELECT pp_id, CASE WHEN scn % 50 = 0 THEN scn - 30 ELSE scn - scn % 2 END AS scn, src_id, srckey, id AS txn_pos, event_type FROM log),
  m AS (SELECT *, max(scn) OVER (PARTITION BY pp_id ORDER BY txn_pos RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t)
  SELECT pp_id, scn, srckey, max(txn_pos) AS txn_pos, arg_max(event_type, txn_pos) AS event_type FROM m WHERE seen IS NULL OR scn >= seen GROUP BY 1, 2, 3""")
def _merged(spark, sf):
    log = X.events_log(spark, sf)
    scn = F.when(F.col("scn") % 50 == 0, F.col("scn") - 30).otherwise(F.col("scn") - F.col("scn") % 2)
    return C.merge_same_scn(log.select("pp_id", scn.alias("scn"), "src_id", "srckey", F.col("id").alias("txn_pos"), "event_type")).select("pp_id", "scn", "srckey", "txn_pos", "event_type")


@query("s18_regressions", f"""{W}, t AS (SELECT 0 AS pp_id, scn AS txn_pos, CASE WHEN scn % 40 = 0 THEN scn - 5 ELSE scn END AS scn FROM (SELECT DISTINCT scn FROM log)),
  m AS (SELECT *, max(scn) OVER (ORDER BY txn_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_scn FROM t) SELECT txn_pos, scn, seen_scn FROM m WHERE scn < seen_scn""")
def _regressed(spark, sf):
    t = X.events_log(spark, sf).select("scn").distinct()
    t = t.select(F.lit(0).alias("pp_id"), F.col("scn").alias("txn_pos"), F.when(F.col("scn") % 40 == 0, F.col("scn") - 5).otherwise(F.col("scn")).alias("scn"))
    return C.regressions(t).select("txn_pos", "scn", "seen_scn")


@query("s19_null_transactions", f"""{W}, t AS (SELECT id AS txn_pos, pp_id, scn, CASE WHEN key_long = 5 THEN 1 ELSE 0 END AS n FROM log),
  r AS (SELECT *, sum(n) OVER (PARTITION BY pp_id ORDER BY txn_pos) AS run FROM t),
  k AS (SELECT *, sum(1 - n) OVER (PARTITION BY pp_id, run ORDER BY txn_pos) AS nth FROM r) SELECT pp_id, txn_pos, scn FROM k WHERE n = 0 AND nth % 20 = 0""")
def _nulls(spark, sf):
    t = X.events_log(spark, sf).select("pp_id", F.col("id").alias("txn_pos"), "scn", F.when(F.col("key_long") == 5, 1).otherwise(0).alias("n"))
    return C.null_transaction_marks(t, 20)


@query("s20_skip_start", f"{W} SELECT id FROM log WHERE scn <> 1")
def _skip_start(spark, sf):
    return C.skip_start(X.events_log(spark, sf), 1).select("id")


@query("s22_generator", "SELECT id // 10 + 1 AS scn, count(*) AS n, max(id + 1) AS max_id, sum(1 + ('0x' || substr(md5(id || ':2'), 1, 8))::BIGINT % 99)::BIGINT AS key_sum FROM (SELECT event_id AS id FROM events) GROUP BY 1")
def _generator(spark, sf):
    from ..sources.generators import random_events

    n = spark.read.parquet(f"{sf}/events.parquet").count()
    rows = random_events(spark, n, keys=(1, 100), seed=1)
    return rows.groupBy("scn").agg(F.count("*").alias("n"), F.max("id").alias("max_id"), F.sum("key_long").alias("key_sum"))


@query("s28_keyset_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 500")
def _keyset(spark, sf):
    return P.keyset_page(X.orders_table(spark, sf), "o_orderkey", 700, 500).select("o_orderkey", "o_custkey")


@query("s29_txn_range", O + "SELECT o_orderkey, txn FROM o WHERE txn > 10 AND txn <= 60")
def _txn_range(spark, sf):
    return P.txn_range(X.orders_table(spark, sf), 10, 60).select("o_orderkey", "txn")


@query("s32_column_reader", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100 AND 2000")
def _column(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").filter(F.col("c_acctbal").between(100, 2000)).select("c_custkey", "c_acctbal")


@query("s33_payload_reader", f"{W} SELECT id, srckey FROM log WHERE srckey >= '10' AND srckey <= '40' AND scn >= 200 AND value > 40 AND id > 2500 ORDER BY id LIMIT 200")
def _payload(spark, sf):
    from ..operators import filters as L
    from ..operators import snapshot as S

    log = X.events_log(spark, sf).filter(L.metadata_range(F.col("srckey"), F.col("scn"), "10", "40", 200))
    return S.page(log.filter(L.payload_field(F.col("value"), ">", "40", "double")), after=2500, n=200).select("id", "srckey")


@query("s34_last_transaction", O + "SELECT txn, scn FROM tx WHERE txn = (SELECT max(txn) FROM o)")
def _last(spark, sf):
    return P.last_transaction(X.orders_table(spark, sf), X.txlog(spark, sf))


@query("j01_changes_with_scn", O + "SELECT o_orderkey, scn FROM o JOIN tx USING (txn)")
def _join(spark, sf):
    return X.orders_table(spark, sf).join(X.txlog(spark, sf), "txn").select("o_orderkey", "scn")


@query("j03_applier_position", f"""{W}, s AS (SELECT pp_id AS srcid, max(scn) AS p FROM log GROUP BY 1), a AS (SELECT pp_id AS srcid, max(scn) AS a, max((id - 1) // 1000) AS logid FROM log WHERE id % 3 = 0 GROUP BY 1),
  l AS (SELECT pp_id AS srcid, (id - 1) // 1000 AS logid, max(id) AS maxrid FROM log GROUP BY 1, 2) SELECT s.srcid, p AS producer_scn, a AS applier_scn, a.logid, maxrid FROM s JOIN a USING (srcid) JOIN l ON l.srcid = a.srcid AND l.logid = a.logid""")
def _position(spark, sf):
    log = X.events_log(spark, sf)
    done = lambda rows: D.log_tables(rows, 1000).groupBy("srcid").agg(F.max("maxwindowscn").alias("windowscn"), F.max("logid").alias("logid"))
    return D.applier_position(done(log), done(log.filter("id % 3 = 0")), D.log_tables(log, 1000))


@query("j04_producer_start", f"{W} SELECT pp_id AS srcid, max(scn) AS windowscn, CASE WHEN pp_id <> 1 THEN max(scn) - 10 END AS endscn FROM log GROUP BY 1, pp_id")
def _producer(spark, sf):
    p = X.events_log(spark, sf).select(F.col("pp_id").alias("srcid"), F.col("scn").alias("windowscn"))
    seeded = p.filter("srcid <> 1").groupBy("srcid").agg((F.max("windowscn") - 10).alias("endscn"))
    return D.producer_start(p, seeded)


@query("j05_tracked_sources", f"""{W}, src AS (SELECT n_nationkey AS srcid, n_name AS src, CASE n_regionkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'NEW' ELSE 'SEEDING' END AS status FROM nation)
  SELECT src.srcid, src.src, count(DISTINCT (id - 1) // 1000) AS n_logs FROM src LEFT JOIN log ON log.pp_id = src.srcid WHERE status IN ('ACTIVE', 'SEEDING') GROUP BY 1, 2""")
def _tracked(spark, sf):
    status = F.element_at(F.array(F.lit("ACTIVE"), F.lit("NEW"), F.lit("SEEDING")), F.col("n_regionkey") % 3 + 1)
    sources = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("srcid"), F.col("n_name").alias("src"), status.alias("status"))
    return D.tracked_sources(sources, D.log_tables(X.events_log(spark, sf), 1000), ("ACTIVE", "SEEDING"))


@query("j11_update_target", f"{W} SELECT id FROM log WHERE pp_id IN (SELECT pp_id FROM log WHERE event_type = 'purchase' AND id < 20)")
def _semi(spark, sf):
    log = X.events_log(spark, sf)
    return log.join(log.filter("event_type = 'purchase' AND id < 20").select("pp_id").distinct(), "pp_id", "left_semi").select("id")


@query("n01_numbered_transactions", O + "SELECT txn, scn, row_number() OVER (ORDER BY scn)::INT AS r FROM (SELECT * FROM tx WHERE scn > 20 ORDER BY scn LIMIT 100)")
def _numbered(spark, sf):
    return P.next_transactions(X.txlog(spark, sf), 20, 100).select("txn", "scn", "r")


@query("a15_cycle_summary", f"{W} SELECT src_id, count(*) AS n_rows, sum(size_bytes)::BIGINT AS bytes, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts, max(scn) AS eop_scn FROM log WHERE scn > 990 GROUP BY 1")
def _cycle(spark, sf):
    return P.cycle(X.events_log(spark, sf).filter("scn > 990"))


@query("k02_end_window", f"{W} SELECT id, 77::BIGINT AS scn, 77::BIGINT AS window_scn FROM log WHERE scn = 3")
def _stamp(spark, sf):
    return C.stamp_window(X.events_log(spark, sf).filter("scn = 3"), 77, 76).select("id", "scn", "window_scn")


@query("k08_event_json", f"{W} SELECT id, length(props) AS n FROM log")
def _encoded(spark, sf):
    from ..sources.jsonlines import to_event_json

    log = X.events_log(spark, sf).withColumn("payload", F.col("props")).withColumn("schema_id", F.lit("abcdefghijklmnop"))
    back = F.decode(F.unbase64(F.get_json_object("line", "$.value")), "UTF-8")
    return to_event_json(log).select("id", F.length(back).cast("bigint").alias("n"))


@query("k14_restart_overlap", f"{W} SELECT id FROM log WHERE scn > 980 - 30")
def _resume(spark, sf):
    return X.events_log(spark, sf).filter(F.col("scn") > P.resume_scn(980, 30, 0)).select("id")
