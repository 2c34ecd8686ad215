"""P01..P23 and the hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import convert as C
from ..functions import hashing as H
from .registry import query

W = f"WITH {X.LOG} "


@query("p01_record", "SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders")
def _record(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    r = F.struct(C.scalar(F.col("o_orderkey"), "long").alias("id"), C.scalar(F.col("o_custkey"), "long").alias("cust"), F.col("o_orderstatus").alias("status"), C.scalar(F.col("o_totalprice"), "double").alias("price"))
    return o.select(r.alias("r")).select("r.*")


@query("p02_coercions", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS price_long, epoch_ms(o_orderdate) AS date_ms, o_orderkey::VARCHAR AS text FROM orders")
def _coerce(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", C.scalar(F.col("o_totalprice"), "long").alias("price_long"), C.scalar(F.col("o_orderdate"), "timestamp").alias("date_ms"), C.scalar(F.col("o_orderkey"), "string").alias("text"))


@query("p03_nested_record", "SELECT c_custkey, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def _nested(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_mktsegment").alias("segment")).alias("more")).alias("r")).select("c_custkey", "r.nation", "r.more.segment")


@query("p04_record_arrays", "SELECT l_orderkey, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1")
def _arrays(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    grouped = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    tagged = grouped.select("l_orderkey", F.transform("lines", lambda x: F.struct(x["l_linenumber"].cast("bigint").alias("no"))).alias("lines"))
    return tagged.select("l_orderkey", F.size("lines").cast("bigint").alias("n"), F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["no"]).alias("total"))


@query("p05_composite_key", "SELECT l_orderkey::VARCHAR || chr(9) || l_linenumber::VARCHAR AS srckey, count(*) AS n FROM lineitem GROUP BY 1")
def _key(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy(C.composite_key(F.col("l_orderkey"), F.col("l_linenumber")).alias("srckey")).agg(F.count("*").alias("n"))


@query("p06_unsigned", f"""{W} SELECT id, CASE WHEN v < 0 THEN v + 256 ELSE v END AS tiny, CASE WHEN v < 0 THEN v + 4294967296 ELSE v END AS full_int, v AS big FROM (SELECT id, key_long - 75 AS v FROM log)""")
def _unsigned(spark, sf):
    v = F.col("key_long") - 75
    return X.events_log(spark, sf).select("id", C.unsigned(v, "TINYINT UNSIGNED").alias("tiny"), C.unsigned(v, "INT UNSIGNED").alias("full_int"), C.unsigned(v, "BIGINT UNSIGNED").alias("big"))


@query("p07_binlog_values", f"{W} SELECT id, value::FLOAT::DOUBLE AS as_float, trunc(value)::BIGINT AS as_long, props AS as_text FROM log")
def _binlog(spark, sf):
    log = X.events_log(spark, sf)
    return log.select("id", F.col("value").cast("float").cast("double").alias("as_float"), C.scalar(F.col("value"), "long").alias("as_long"), F.decode(F.encode("props", "UTF-8"), "UTF-8").alias("as_text"))


@query("p08_trail_timestamp", f"""{W} SELECT id, epoch_ms(date_trunc('second', make_timestamp(ts_ns // 1000))) + (id % 1000) AS ms FROM log""")
def _stamp(spark, sf):
    log = X.events_log(spark, sf)
    text = F.concat(F.date_format(F.timestamp_micros(F.expr("ts_ns div 1000")), "yyyy-MM-dd:HH:mm:ss"), F.lit("."), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit("789"))
    return log.select("id", C.trail_timestamp_ms(text).alias("ms"))


@query("p09_trail_date", "SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)) AS ms FROM orders")
def _date(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", C.trail_date_ms(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("ms"))


@query("p10_hex", "SELECT c_custkey, c_name AS back FROM customer")
def _hex(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", F.decode(C.trail_hex(F.concat(F.lit("0x"), F.hex(F.encode("c_name", "UTF-8")))), "UTF-8").alias("back"))


@query("p11_trail_casts", f"{W} SELECT id, (json_extract(props, '$.k'))::INT AS k, value AS d FROM log")
def _casts(spark, sf):
    return X.events_log(spark, sf).select("id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value").cast("string").cast("double").alias("d"))


@query("p12_decode_payload", f"{W} SELECT event_type, sum((json_extract(props, '$.k'))::BIGINT)::BIGINT AS k FROM log GROUP BY 1")
def _decode(spark, sf):
    r = F.from_json("props", "k BIGINT")
    return X.events_log(spark, sf).select("event_type", r.alias("r")).groupBy("event_type").agg(F.sum("r.k").alias("k"))


@query("p13_event_json", f"""{W} SELECT id, '{{"srcId":101,"opCode":"' || opcode || '","partId":' || pp_id || ',"value":"' || event_type || '"}}' AS line FROM log""")
def _json(spark, sf):
    return X.events_log(spark, sf).select("id", C.event_json(F.col("src_id"), F.col("opcode"), F.col("pp_id"), F.col("event_type")).alias("line"))


@query("p14_metadata", f"{W} SELECT id, lp_id AS part, is_replicated AS rep FROM log")
def _meta(spark, sf):
    return X.events_log(spark, sf).select("id", F.struct(F.col("lp_id").alias("part"), F.col("is_replicated").alias("rep")).alias("m")).select("id", "m.*")


@query("p15_logical_partition", f"{W} SELECT id, 4 AS part FROM log")
def _part(spark, sf):
    return X.events_log(spark, sf).select("id", C.logical_partition("constant:4").cast("int").alias("part"))


@query("p16_fnv1a_bucket", """WITH RECURSIVE h AS (SELECT c_custkey, c_name, 1 AS i, 2166136261::UHUGEINT AS h FROM customer UNION ALL
  SELECT c_custkey, c_name, i + 1, (xor(h, unicode(substr(c_name, i, 1))::UHUGEINT) * 16777619::UHUGEINT) % 18446744073709551616::UHUGEINT FROM h WHERE i <= length(c_name))
  SELECT c_custkey, ((h % 9223372036854775808::UHUGEINT) % 97)::BIGINT AS bucket FROM h WHERE i = length(c_name) + 1""")
def _fnv(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", H.fnv1a_bucket(F.encode("c_name", "UTF-8"), 97).alias("bucket"))


#: SQL of Jenkins' hash: rounds over units of 12 bytes, the last one with the length beside its third word.
_UNIT = "unicode(substr(c_name || repeat(chr(0), 12), (12 * i + 4 * {w} + {k} + 1)::INT, 1))::BIGINT"
_WORDS = ", ".join(
    "(" + " + ".join(f"CASE WHEN 12 * i + {4 * w + k} < length(c_name) THEN {_UNIT.format(w=w, k=k)} << {8 * k} ELSE 0 END" for k in range(4)) + f") AS w{w}" for w in range(3)
)


def _mix_sql() -> str:
    """The steps as nested selects, each with one of a, b, c renewed."""
    sql = "SELECT c_custkey, c_name, i, (a + w0) & 4294967295 AS a, (b + w1) & 4294967295 AS b, (c + CASE WHEN 12 * (i + 1) > length(c_name) THEN (w2 << 8) + length(c_name) ELSE w2 END) & 4294967295 AS c FROM w"
    for x, by in H.JENKINS_STEPS:
        n, other = "abc"[x], "abc"[(x + 2) % 3]
        shifted = f"(({other} << {by}) & 4294967295)" if by > 0 else f"({other} >> {-by})"
        new = f"xor(({n} - {'abc'[(x + 1) % 3]} - {other}) & 4294967295, {shifted})"
        sql = f"SELECT c_custkey, c_name, i, {', '.join(f'{new} AS {m}' if m == n else m for m in 'abc')} FROM ({sql})"
    return sql


@query("p17_jenkins", f"""WITH RECURSIVE h AS (SELECT c_custkey, c_name, 0::BIGINT AS i, {H.JENKINS_START}::BIGINT AS a, {H.JENKINS_START}::BIGINT AS b, 0::BIGINT AS c FROM customer
  UNION ALL (WITH w AS (SELECT *, {_WORDS} FROM h WHERE 12 * i <= length(c_name)) SELECT c_custkey, c_name, i + 1, a, b, c FROM ({_mix_sql()})))
  SELECT c_custkey, c AS hash FROM h WHERE 12 * i > length(c_name)""")
def _jenkins(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", H.jenkins(F.encode("c_name", "UTF-8")).alias("hash"))


@query("p18_digests", "SELECT c_custkey, md5(c_name) AS digest, length(md5(c_name)) AS n FROM customer")
def _digest(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    digest = F.lower(F.hex(F.unbase64(H.schema_digest(F.col("c_name")))))
    return c.select("c_custkey", digest.alias("digest"), F.length(digest).cast("bigint").alias("n"))


@query("p19_base64", "SELECT c_custkey, base64(encode(c_name)) AS coded, c_name AS back FROM customer")
def _b64(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("coded", F.base64(F.encode("c_name", "UTF-8")))
    return c.select("c_custkey", "coded", F.decode(F.unbase64("coded"), "UTF-8").alias("back"))


@query("p20_time_units", f"{W} SELECT id, ts_ns // 1000000 AS ms, ts_ns // 1000 AS us FROM log")
def _units(spark, sf):
    return X.events_log(spark, sf).select("id", F.expr(f"ts_ns div {C.NANOS_PER_MILLI}").alias("ms"), F.expr(f"ts_ns div {C.NANOS_PER_MICRO}").alias("us"))


@query("p23_same_field", "SELECT o_orderkey FROM orders WHERE o_orderkey % 83 = 0 OR o_orderkey % 97 = 0")
def _same(spark, sf):
    o = X.orders_table(spark, sf)
    edited = F.when(F.col("o_orderkey") % 97 == 0, F.lit(None)).when(F.col("o_orderkey") % 83 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return o.filter(~C.same_field(F.col("o_totalprice"), edited)).select("o_orderkey")


@query("s10_binlog_scn", "SELECT o_orderkey, (o_custkey::BIGINT << 32) + 4294960000 - o_orderkey AS scn FROM orders")
def _binscn(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", C.binlog_scn(F.col("o_custkey"), F.lit(4294960000) - F.col("o_orderkey")).alias("scn"))
