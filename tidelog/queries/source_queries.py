"""Sources that are text (trails, JSON lines) and the remaining scans and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import polling as P
from ..operators import relay as R
from ..operators import snapshot as S
from ..operators import state as D
from ..sources import jsonlines as J
from ..sources import trails as T
from .registry import query

W = f"WITH {X.LOG}"


def _trail(spark, sf):
    """orders as a trail: a transaction for each, with a before-image first; every tenth lacks its status, table X is unknown."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    col = lambda name, value, key="": F.concat(F.lit(f'<column name="{name}"{key}>'), value.cast("string"), F.lit("</column>"))
    key = col("ID", F.col("o_orderkey"), ' key="true"')
    status = F.when(F.col("o_orderkey") % 10 == 0, F.lit("")).otherwise(col("STATUS", F.col("o_orderstatus")))
    tokens = F.concat(F.lit('<tokens><token name="TK-XID">x</token><token name="TK-CSN">'), (F.col("o_orderkey") + 5).cast("string"), F.lit("</token></tokens>"))
    update = lambda attrs, cols: F.concat(F.lit(f"<dbupdate {attrs}><columns>"), cols, F.lit("</columns>"), tokens, F.lit("</dbupdate>"))
    table = F.when(F.col("o_orderkey") % 7 == 0, update('table="X" type="insert"', key)).otherwise(update('table="O" type="update"', F.concat(key, status)))
    raw = F.concat(F.lit('<transaction timestamp="2013-07-04:02:27:51.5">'), update('table="O" type="update" image="before"', key), table, F.lit("</transaction>"))
    return o.select(F.lit("trail").alias("file"), F.col("o_orderkey").alias("pos"), raw.alias("raw"))


@query("s12_xml_trail", "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'insert' ELSE 'update' END AS kind FROM orders")
def _xml(spark, sf):
    return T.updates(_trail(spark, sf)).select(T.column("ID", key=True).alias("id"), T.column("STATUS", required=False).alias("status"), "kind")


@query("s13_known_tables", "SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 7 <> 0")
def _known(spark, sf):
    return T.updates(_trail(spark, sf), ["O"]).select(T.column("ID", key=True).alias("id"))


@query("s14_trail_scn", "SELECT o_orderkey AS pos, o_orderkey + 5 AS scn FROM orders")
def _scn(spark, sf):
    return T.updates(_trail(spark, sf)).groupBy("pos").agg(F.max("scn").alias("scn"))


@query("s15_missing_fields", "SELECT o_orderkey AS pos, o_orderkey % 10 = 0 AS seen_missing FROM orders WHERE o_orderkey % 7 <> 0")
def _missing(spark, sf):
    return T.updates(_trail(spark, sf), ["O"]).select("pos", T.missing_fields(["ID", "STATUS"]).alias("seen_missing"))


@query("s35_trail_validation", "SELECT o_orderkey AS pos, false AS malformed, false AS no_xid, o_orderkey % 5 = 0 AS no_csn, o_orderkey % 9 = 0 AS bad_chars FROM orders")
def _validate(spark, sf):
    rows = _trail(spark, sf)
    raw = F.when(F.col("pos") % 5 == 0, F.regexp_replace("raw", '<token name="TK-CSN">[0-9]+</token>', "")).otherwise(F.col("raw"))
    checked = T.validate(rows.withColumn("raw", raw)).select("pos", "malformed", "no_xid", "no_csn")
    chars = T.validate(rows.withColumn("raw", F.when(F.col("pos") % 9 == 0, F.concat("raw", F.lit("\x01"))).otherwise(F.col("raw")))).select("pos", "bad_chars")
    return checked.join(chars, "pos")


#: SQL of the draws that generated events are made of.
DRAW = "('0x' || substr(md5(id || ':{}'), 1, 8))::BIGINT"


@query("s23_random_events", f"""WITH g AS (SELECT event_id + 1 AS n, event_id AS id FROM events)
  SELECT n AS id, id // 10 + 1 AS scn, id % 10 + 1 AS seq, (id % 2 + 7)::INT AS src_id, 1000 + {DRAW.format(6)} % 9000 AS key_long, {DRAW.format(8)} % 10000 < 100 AS is_trace,
  10 + {DRAW.format(7)} % 90 + 61 AS size_bytes, substr(repeat(sha256(id || ':5'), 2), 1, (10 + {DRAW.format(7)} % 90)::INT) AS payload FROM g""")
def _random(spark, sf):
    from ..sources.generators import random_events

    n = spark.read.parquet(f"{sf}/events.parquet").count()
    rows = random_events(spark, n, keys=(1000, 10_000), lengths=(10, 100), per_window=10, sources=(7, 8), seed=5)
    return rows.select("id", "scn", "seq", "src_id", "key_long", "is_trace", F.col("size_bytes").cast("bigint").alias("size_bytes"), "payload")


@query("s26_complete_windows", f"{W}, e AS (SELECT pp_id, max(scn) - 5 AS last FROM log GROUP BY 1) SELECT id FROM log JOIN e USING (pp_id) WHERE scn <= last")
def _complete(spark, sf):
    log = X.events_log(spark, sf).select("pp_id", "scn", "id", "src_id")
    eop = log.groupBy("pp_id").agg((F.max("scn") - 5).alias("scn")).select("pp_id", "scn", F.lit(None).cast("bigint").alias("id"), F.lit(-2).alias("src_id"))
    return J.complete_windows(log.unionByName(eop)).filter("src_id >= 0").select("id")


@query("s27_seed_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 4000")
def _resume(spark, sf):
    return P.keyset_rest(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", 4000).select("o_orderkey")


@query("s30_snapshot_scan", f"{W}, s AS (SELECT srckey, min(id) AS id, arg_max(scn, log.id) AS scn FROM log WHERE scn < 900 GROUP BY 1) SELECT * FROM s WHERE scn >= 10")
def _snapshot(spark, sf):
    return S.snapshot_rows(S.apply_log(X.events_log(spark, sf), before_scn=900), start_scn=900, since_scn=10).select("srckey", "id", "scn")


@query("s31_log_scan", f"{W} SELECT (id - 1) // 1000 AS log_id, id FROM log WHERE scn BETWEEN 150 AND 450")
def _log(spark, sf):
    return S.catchup_rows(X.events_log(spark, sf), start_scn=150, target_scn=450).select(F.expr("(id - 1) div 1000").alias("log_id"), "id")


@query("j02_chunk_join_order", f"WITH {X.ORDERS} SELECT o_orderkey, r FROM o JOIN (SELECT txn, row_number() OVER (ORDER BY scn)::INT AS r FROM tx WHERE scn > 100 ORDER BY scn LIMIT 50) USING (txn) WHERE r <= 50")
def _chunk(spark, sf):
    return P.chunk_by_transactions(X.orders_table(spark, sf), X.txlog(spark, sf), 100, 50).filter("r <= 50").select("o_orderkey", "r")


@query("j10_max_subquery", f"WITH {X.ORDERS} SELECT o_orderkey FROM o WHERE txn = (SELECT max(txn) FROM o)")
def _subquery(spark, sf):
    return D.of_last_transaction(X.orders_table(spark, sf)).select("o_orderkey")


@query("n02_row_number_pages", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey))::INT AS r FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 300")
def _pages(spark, sf):
    from pyspark.sql import Window

    page = P.keyset_page(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", 100, 300, inclusive=True)
    return page.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderkey")).alias("r"))


#: SQL of the log tables.
LOGS = "(SELECT pp_id AS srcid, (id - 1) // 1000 AS logid, min(scn) AS minwindowscn, max(scn) AS maxwindowscn, max(id) AS maxrid, count(*) AS n FROM log GROUP BY 1, 2)"


@query("t03_log_order", f"{W} SELECT * FROM {LOGS} ORDER BY logid DESC, srcid LIMIT 4")
def _logs(spark, sf):
    return D.logs_in_order(D.log_tables(X.events_log(spark, sf), 1000), 4, newest_first=True)


@query("t07_file_order", """SELECT row_number() OVER (ORDER BY number NULLS FIRST, file)::INT AS nth, number, file FROM (SELECT DISTINCT 'x' || (user_id // 3) AS file, (user_id // 3)::BIGINT AS number FROM events)""")
def _files(spark, sf):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf}/events.parquet")
    files = T.in_order(e.select(F.concat(F.lit("x"), F.expr("user_id div 3").cast("string")).alias("file")).distinct())
    return files.select("*", F.row_number().over(Window.orderBy(F.asc_nulls_first("number"), "file")).alias("nth"))


@query("a19_entry_sets", f"{W} SELECT scn, count(DISTINCT srckey) AS n_keys FROM log GROUP BY 1")
def _sets(spark, sf):
    from ..operators.capture import dedupe_transaction

    entries = X.events_log(spark, sf).select(F.col("scn").alias("txn"), "src_id", "srckey", F.col("seq").alias("pos"))
    return dedupe_transaction(entries).groupBy(F.col("txn").alias("scn")).agg(F.count("*").alias("n_keys"))


@query("k05_validated_ingest", f"{W} SELECT id FROM log WHERE id % 50 <> 0 AND size_bytes >= 61")
def _ingest(spark, sf):
    from ..operators import filters as L

    log = X.events_log(spark, sf)
    crc = L.checksum(F.encode("props", "UTF-8"))
    stored = F.when(F.col("id") % 50 == 0, crc + 1).otherwise(crc)
    return log.filter(L.valid_event(F.encode("props", "UTF-8"), stored, F.col("size_bytes")) == "OK").select("id")


def _stored(spark, heads, name: str, scn: str):
    """A store of this run in the shared folder, told of every row of heads (a row for each server) and of a smaller number."""
    import tempfile
    import uuid

    from ..plans.checkpoint import MaxScnStore

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp()
    store = MaxScnStore(spark, f"{at.rstrip('/')}/maxscn-{uuid.uuid4().hex}")
    for r in heads.collect():
        store.save(str(r[name]), r[scn])
        store.save(str(r[name]), r[scn] - 1)  # kept as it was
    return store


@query("k13_max_scn_store", f"{W} SELECT pp_id, max(scn) AS max_scn FROM log GROUP BY 1")
def _max(spark, sf):
    kept = _stored(spark, R.head(X.events_log(spark, sf)), "pp_id", "max_scn").all()
    return kept.select(F.col("server").cast("int").alias("pp_id"), F.col("scn").alias("max_scn"))


@query("x09_scn_by_server", f"{W} SELECT lp_id AS server, max(scn) AS scn FROM log GROUP BY 1")
def _servers(spark, sf):
    heads = X.events_log(spark, sf).groupBy(F.col("lp_id").alias("server")).agg(F.max("scn").alias("scn"))
    return _stored(spark, heads, "server", "scn").all().select(F.col("server").cast("int").alias("server"), "scn")


@query("b12_completeness", f"{W} SELECT pp_id, NOT (300 <= min(scn) - 1 AND NOT (300 = 0 AND min(scn) - 1 = 0)) AS complete FROM log GROUP BY 1")
def _complete_check(spark, sf):
    from ..plans.bootstrap import BootstrapTooYoung, check_complete

    out = None
    for r in R.head(X.events_log(spark, sf)).collect():  # a row per partition
        try:
            check_complete(300, r.prev_scn)
            ok = True
        except BootstrapTooYoung:
            ok = False
        row = spark.range(1).select(F.lit(r.pp_id).alias("pp_id"), F.lit(ok).alias("complete"))
        out = row if out is None else out.unionByName(row)
    return out


@query("x03_reset", f"{W} SELECT pp_id, min(scn) AS min_scn, min(scn) - 1 AS prev_scn, max(scn) AS max_scn FROM log WHERE pp_id <> 1 OR scn > 60 GROUP BY 1")
def _reset(spark, sf):
    return R.head(D.reset(X.events_log(spark, sf), 1, 60))
