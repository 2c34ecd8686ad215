"""Reads of the log and its statistics: W, T, A, N, X."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import relay as R
from ..operators import snapshot as S
from ..operators import stats as A
from ..operators import state as D
from .registry import query

W = f"WITH {X.LOG}"
POS = f"{W}, p AS (SELECT *, row_number() OVER (PARTITION BY pp_id, scn ORDER BY seq) AS pos FROM log)"
NOW = X.NOW_NS
TOTALS = f"""count(*) AS n_events, sum(size_bytes)::BIGINT AS bytes, sum(payload_bytes)::BIGINT AS payload_bytes, min(scn) AS min_scn, max(scn) AS max_scn,
  max(ts_ns) AS max_ts, min(ts_ns) AS min_ts, sum(greatest({NOW} - ts_ns, 0) // 1000000)::BIGINT AS sum_latency_ms"""


@query("w01_end_of_windows", f"{W} SELECT pp_id, scn, count(*) + 1 AS pos, count(*) AS n_events, max(ts_ns) AS ts_ns, -2 AS src_id FROM log GROUP BY 1, 2")
def _eop(spark, sf):
    return R.end_of_windows(X.events_log(spark, sf))


@query("w02_read_since", f"{POS} SELECT id, scn, pos::INT AS pos FROM p WHERE scn > 500 OR (scn = 500 AND pos > 2)")
def _since(spark, sf):
    return R.read_changes(X.events_log(spark, sf), 500, 2).select("id", "scn", "pos")


@query("w02_read_since_window", f"{W} SELECT id, scn FROM log WHERE scn > 500")
def _since_window(spark, sf):
    return R.read_changes(X.events_log(spark, sf), 500).select("id", "scn")


@query("w03_log_bounds", f"{W} SELECT pp_id, min(scn) AS min_scn, min(scn) - 1 AS prev_scn, max(scn) AS max_scn FROM log GROUP BY 1")
def _head(spark, sf):
    return R.head(X.events_log(spark, sf))


@query("w04_late_windows", f"""{W}, s AS (SELECT id, pp_id, CASE WHEN id % 37 = 0 THEN scn - 20 ELSE scn END AS scn FROM log)
  SELECT id, coalesce(scn < max(scn) OVER (PARTITION BY pp_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_late FROM s""")
def _late(spark, sf):
    log = X.events_log(spark, sf).withColumn("scn", F.when(F.col("id") % 37 == 0, F.col("scn") - 20).otherwise(F.col("scn")))
    return R.late(log).select("id", "is_late")


@query("w05_from_latest", f"{W} SELECT id FROM log WHERE scn = (SELECT max(scn) FROM log)")
def _latest(spark, sf):
    log = X.events_log(spark, sf)
    return log.join(F.broadcast(log.agg(F.max("scn").alias("scn"))), "scn", "left_semi").select("id")


@query("w06_interleaved", f"""{W}, w AS (SELECT pp_id, scn, row_number() OVER (PARTITION BY pp_id ORDER BY scn) AS turn FROM (SELECT DISTINCT pp_id, scn FROM log WHERE pp_id <> 1 OR scn > 10))
  SELECT id, pp_id, turn::INT AS turn FROM log JOIN w USING (pp_id, scn)""")
def _interleaved(spark, sf):
    return R.interleaved(X.events_log(spark, sf), after={1: 10}).select("id", "pp_id", "turn")


@query("w07_advance", f"""{W}, c AS (SELECT pp_id, scn, count(*) AS n FROM log GROUP BY 1, 2)
  SELECT pp_id, max(scn) AS window_scn, arg_max(n, scn) AS window_offset FROM c GROUP BY 1""")
def _advance(spark, sf):
    return R.advance(X.events_log(spark, sf))


@query("w10_floor_scn", f"{W} SELECT pp_id, max(scn) AS floor_scn FROM log WHERE scn <= 333 GROUP BY 1")
def _floor(spark, sf):
    return R.floor_scn(X.events_log(spark, sf), 333)


@query("w11_partial_window", f"{W} SELECT id FROM log WHERE scn > 499")
def _partial(spark, sf):
    from ..plans.checkpoint import Checkpoint, restart

    c = restart(Checkpoint(window_scn=500, window_offset=3, prev_scn=499))
    return R.read_changes(X.events_log(spark, sf), c.window_scn, c.window_offset).select("id")


@query("w13_framing", f"""{W}, f AS (SELECT id, lag(lp_id) OVER w AS p, lead(lp_id) OVER w AS n, lp_id FROM log WINDOW w AS (PARTITION BY pp_id, scn ORDER BY lp_id, seq))
  SELECT id, p IS NULL AS starts_window, p IS DISTINCT FROM lp_id AS starts_source, n IS DISTINCT FROM lp_id AS ends_source, n IS NULL AS ends_window FROM f""")
def _framing(spark, sf):
    log = X.events_log(spark, sf).withColumn("src_id", F.col("lp_id"))
    return R.framed(log).select("id", "starts_window", "starts_source", "ends_source", "ends_window")


@query("w15_bootstrap_switch", f"""{W} SELECT 'SNAPSHOT' AS phase, count(*) AS n FROM (SELECT srckey, max(scn) AS scn FROM log WHERE scn < 600 GROUP BY 1) WHERE scn >= 100
  UNION ALL SELECT 'CATCHUP', count(*) FROM log WHERE scn BETWEEN 600 AND 900""")
def _switch(spark, sf):
    from ..plans import bootstrap as P
    from ..plans.checkpoint import online

    seen = []
    P.consume(X.events_log(spark, sf), online(100), min_scn=700, target_scn=900, start=600, handle=lambda df, phase: seen.append(df.agg(F.lit(phase).alias("phase"), F.count("*").alias("n"))))
    return seen[0].unionByName(seen[1])


@query("t01_keyset_page", f"{W} SELECT id, srckey FROM log WHERE id > 4321 ORDER BY id LIMIT 1000")
def _page(spark, sf):
    return S.page(X.events_log(spark, sf), after=4321).select("id", "srckey")


@query("t02_first_window", f"""{W} SELECT srcid, logid, maxwindowscn FROM (SELECT pp_id AS srcid, (id - 1) // 1000 AS logid, max(scn) AS maxwindowscn FROM log GROUP BY 1, 2)
  WHERE maxwindowscn > 40 ORDER BY maxwindowscn, srcid, logid LIMIT 1""")
def _first(spark, sf):
    return D.first_windows(D.log_tables(X.events_log(spark, sf), 1000), 40).select("srcid", "logid", "maxwindowscn")


@query("t04_byte_budget", f"{W} SELECT id, running_bytes FROM (SELECT id, sum(size_bytes) OVER (ORDER BY scn, seq)::BIGINT AS running_bytes FROM log WHERE scn > 200) WHERE running_bytes <= 50000")
def _budget(spark, sf):
    log = X.events_log(spark, sf).filter("scn > 200")
    return S.byte_page(log, 50_000, order=("scn", "seq")).select("id", "running_bytes")


@query("b16_bootstrap_page", f"{W} SELECT id, running_bytes FROM (SELECT id, sum(size_bytes) OVER (ORDER BY id)::BIGINT AS running_bytes FROM log) WHERE running_bytes < 70000")
def _bpage(spark, sf):
    return S.byte_page(X.events_log(spark, sf), 70_000, strict=True).select("id", "running_bytes")


@query("t05_tail_limit", f"{W} SELECT id, event_type FROM log ORDER BY id LIMIT 25")
def _tail(spark, sf):
    return X.events_log(spark, sf).orderBy("id").limit(25).select("id", "event_type")


@query("t06_latest_row", f"{W} SELECT srckey, ts_ns, id, scn FROM (SELECT *, row_number() OVER (PARTITION BY srckey ORDER BY ts_ns DESC, id DESC) AS r FROM log) WHERE r = 1")
def _latest_row(spark, sf):
    return D.latest_rows(X.events_log(spark, sf))


@query("a01_totals", f"{W} SELECT {TOTALS} FROM log")
def _totals(spark, sf):
    return X.events_log(spark, sf).agg(*A.totals(NOW))


@query("a02_filtered_totals", f"""{W} SELECT n_filtered, bytes_filtered, max_filtered_scn FROM (SELECT count(*) FILTER (WHERE key_long >= 100) AS n_filtered,
  coalesce(sum(size_bytes) FILTER (WHERE key_long >= 100), 0)::BIGINT AS bytes_filtered, max(scn) FILTER (WHERE key_long >= 100) AS max_filtered_scn FROM log)""")
def _filtered(spark, sf):
    return X.events_log(spark, sf).agg(*A.totals(NOW, F.col("key_long") < 100)).select("n_filtered", "bytes_filtered", "max_filtered_scn")


@query("a03_system_counts", f"{W} SELECT 0::BIGINT AS n_system, count(*) FILTER (WHERE id % 10 = 1) AS n_partial, count(*) FILTER (WHERE id % 10 = 2) AS n_invalid FROM log")
def _system(spark, sf):
    log = X.events_log(spark, sf).withColumn("validity", F.when(F.col("id") % 10 == 1, "PARTIAL").when(F.col("id") % 10 == 2, "ERR").otherwise("OK"))
    return A.system_counts(log)


@query("a04_grouped_totals", f"{W} SELECT src_id, pp_id, grouping_id(src_id, pp_id)::BIGINT AS level, {TOTALS} FROM log GROUP BY GROUPING SETS ((src_id), (pp_id), ())")
def _grouped(spark, sf):
    return A.by_groups(X.events_log(spark, sf), NOW)


@query("a05_merge_stats", f"{W} SELECT {TOTALS}, max(ts_ns) - min(ts_ns) AS time_span FROM log")
def _merge(spark, sf):
    log = X.events_log(spark, sf)
    parts = [log.filter(F.col("pp_id") == i).agg(*A.totals(NOW)) for i in range(3)]
    return A.merge(*parts)


@query("a06_merge_by_source", f"{W} SELECT pp_id, count(*) AS n_events, sum(size_bytes)::BIGINT AS bytes FROM log GROUP BY 1")
def _merge_by(spark, sf):
    log = X.events_log(spark, sf)
    halves = [log.filter(F.col("id") % 2 == i).groupBy("pp_id").agg(*A.totals(NOW)) for i in range(2)]
    return A.merge(*halves, keys=("pp_id",)).select("pp_id", "n_events", "bytes")


@query("a07_histogram", f"""{W}, c AS (SELECT CASE WHEN v < 10 THEN 0 WHEN v >= 90 THEN 9 ELSE 1 + (v - 10) // 10 END AS b, count(*) AS n FROM (SELECT trunc(value)::BIGINT AS v FROM log) GROUP BY 1),
  r AS (SELECT b, n, 10 + 10 * (b - 1) + 5 AS x, sum(n) OVER (ORDER BY b) AS upto, sum(n) OVER () AS a FROM c)
  SELECT sum(n)::BIGINT AS num, min(x)::BIGINT AS min, max(x)::BIGINT AS max, sum(x * n)::BIGINT AS sum, sum(x * n) / sum(n) AS mean, min(x) FILTER (WHERE upto >= a // 2)::BIGINT AS median,
  min(x) FILTER (WHERE upto >= a * 0.75)::BIGINT AS p75, min(x) FILTER (WHERE upto >= a * 0.9)::BIGINT AS p90, min(x) FILTER (WHERE upto >= a * 0.95)::BIGINT AS p95, min(x) FILTER (WHERE upto >= a * 0.99)::BIGINT AS p99 FROM r""")
def _histogram(spark, sf):
    log = X.events_log(spark, sf).select(F.col("value").cast("bigint").alias("v"))
    return A.histogram(log, "v", low=10, high=90, buckets=8)


@query("a08_reservoir", f"""{W} SELECT id FROM log ORDER BY ((ts_ns - 1704067200000000000) / 1000000000) * 0.015
  - ln((('0x' || substr(md5(id || ':' || id % 2), 1, 8))::BIGINT + 1) / 4294967296) DESC LIMIT 1028""")
def _reservoir(spark, sf):
    log = X.events_log(spark, sf)
    t = (F.col("ts_ns") - F.lit(1_704_067_200_000_000_000)) / 1_000_000_000
    parts = [A.reservoir(log.filter(F.col("id") % 2 == i).select("id", "ts_ns"), t, F.col("id"), seed=i) for i in range(2)]
    return A.merge_reservoirs(*parts).select("id")


@query("a09_percentiles", f"""{W} SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max FROM log""")
def _percentiles(spark, sf):
    return A.percentiles(X.events_log(spark, sf), "value")


@query("a10_rate", f"{W} SELECT count(*) / ((max(ts_ns) - min(ts_ns)) / 1000000000) AS per_s FROM log")
def _rate(spark, sf):
    return A.rate(X.events_log(spark, sf))


@query("a11_state_bounds", f"{W} SELECT min(a) AS start_scn, max(b) AS producer_scn FROM (SELECT pp_id, max(scn) FILTER (WHERE id % 2 = 0) AS a, max(scn) AS b FROM log GROUP BY 1)")
def _bounds(spark, sf):
    log = X.events_log(spark, sf)
    state = lambda df: df.groupBy("pp_id").agg(F.max("scn").alias("scn"))
    return A.state_bounds(state(log.filter("id % 2 = 0")), state(log))


@query("a12_rows_between", f"{W} SELECT count(*) AS n FROM log WHERE scn >= 250 AND scn < 750")
def _between(spark, sf):
    return A.rows_between(X.events_log(spark, sf), 250, 750)


@query("a13_row_id_for_scn", f"{W} SELECT max(id) + 1 AS row_id FROM log WHERE scn < 444")
def _row_id(spark, sf):
    return A.row_id_before(X.events_log(spark, sf), 444)


@query("a16_callbacks", f"{W} SELECT event_type AS type, count(*) AS received, count(*) FILTER (WHERE id % 7 <> 0) AS processed, count(*) FILTER (WHERE id % 7 = 0) AS errors, sum(payload_bytes)::BIGINT AS latency_ms FROM log GROUP BY 1")
def _callbacks(spark, sf):
    log = X.events_log(spark, sf)
    return A.callback_counts(log.select(F.col("event_type").alias("type"), F.when(F.col("id") % 7 == 0, 200).otherwise(0).alias("result"), F.col("payload_bytes").alias("latency_ms")))


@query("a18_tail_summary", f"""{W} SELECT count(*) AS events, count(DISTINCT scn) AS windows, sum(size_bytes)::BIGINT AS bytes, (max(ts_ns) - min(ts_ns)) / 1000000000 AS seconds,
  sum(size_bytes) / count(*) AS mean_bytes, count(*) / ((max(ts_ns) - min(ts_ns)) / 1000000000) AS events_per_s FROM log""")
def _summary(spark, sf):
    return R.tail_summary(X.events_log(spark, sf))


@query("n03_window_offset", f"{POS} SELECT id, pos FROM p")
def _offset(spark, sf):
    return R.windowed(X.events_log(spark, sf)).select("id", F.col("pos").cast("bigint").alias("pos"))


@query("u05_batches", f"{W} SELECT pp_id, scn, (row_number() OVER (PARTITION BY pp_id, scn ORDER BY seq) - 1) // 3 AS batch, id FROM log")
def _batches(spark, sf):
    return R.batched(X.events_log(spark, sf), 3).select("pp_id", "scn", "batch", "id")


@query("k04_ring_retention", f"""{W}, w AS (SELECT pp_id, scn, sum(sum(size_bytes)) OVER (PARTITION BY pp_id ORDER BY scn DESC) AS running FROM log GROUP BY 1, 2)
  SELECT id FROM log JOIN w USING (pp_id, scn) WHERE running <= 100000""")
def _ring(spark, sf):
    return S.retained_bytes(X.events_log(spark, sf), 100_000).select("id")


@query("x02_trim", f"{W} SELECT id FROM log WHERE scn >= 900")
def _trim(spark, sf):
    return R.trimmed(X.events_log(spark, sf), 900).select("id")


@query("x04_inject_control", f"{W} SELECT id, src_id, scn FROM log UNION ALL SELECT NULL, -3, 77")
def _inject(spark, sf):
    from ..schema import ControlType

    return R.with_control(X.events_log(spark, sf), ControlType.CHECKPOINT, 77).select("id", "src_id", "scn")


@query("x06_stats_by_database", f"{W} SELECT CASE WHEN pp_id < 2 THEN 'a' ELSE 'b' END AS db, count(*) AS n_events FROM log GROUP BY 1")
def _by_db(spark, sf):
    log = X.events_log(spark, sf).withColumn("db", F.when(F.col("pp_id") < 2, "a").otherwise("b"))
    return A.merge(log.groupBy("db", "pp_id").agg(*A.totals(NOW)).drop("pp_id"), keys=("db",)).select("db", "n_events")
