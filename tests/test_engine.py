"""What the queries' SQL does not cover: parsers, plans, checkpoints, sources, streaming."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import convert as C
from tidelog.functions import hashing as H
from tidelog.operators import filters as L
from tidelog.operators import snapshot as S
from tidelog.plans import bootstrap as B
from tidelog.plans import checkpoint as K
from tidelog.schema import ConsumerResult, ScnNotFound, camel_case, column_type, row_schema


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_ring_ranges(spark):
    keys = [(-5,), (0,), (5,), (9,), (10,), (None,), (-(1 << 63),)]
    got = lambda a, b: values(spark, keys, "k bigint", L.in_range(F.col("k"), a, b))
    assert got(5, 10) == [False, False, True, True, False, False, False]
    assert got(9, 5) == [False, True, False, True, True, False, False]
    assert got(5, 5) == [False] * 7


def test_mod_of_extremes_and_text(spark):
    assert values(spark, [(-(1 << 63),), (-7,), (7,)], "k bigint", L.key_mod(F.col("k"), 5, 2, 3)) == [False, True, True]
    java = lambda s: (lambda h: h - (1 << 32) if h >= 1 << 31 else h)(__import__("functools").reduce(lambda h, c: (h * 31 + c) & 0xFFFFFFFF, [int.from_bytes(s.encode("utf-16-be")[i : i + 2], "big") for i in range(0, 2 * len(s.encode("utf-16-be")) // 2, 2)], 0))
    words = ["abc", "", "Customer#000000001", "é中😀", "x" * 50]
    assert values(spark, [(w,) for w in words] + [(None,)], "s string", H.string_hash(F.col("s"))) == [java(w) for w in words] + [None]
    assert H.string_hash is not None and java("abc") == 96354


def test_fnv_and_jenkins(spark):
    def fnv(data):
        h = 2166136261
        for b in data:
            h = (h ^ b) * 16777619 % (1 << 64)
        return h - (1 << 64) if h >= 1 << 63 else h

    data = [b"", b"a", bytes(range(256)), b"hello world, twelve"]
    assert values(spark, [(bytearray(d),) for d in data], "b binary", H.fnv1a(F.col("b"))) == [fnv(d) for d in data]
    assert values(spark, [(bytearray(d),) for d in data], "b binary", H.jenkins(F.col("b"))) == [H.jenkins_of(d) for d in data]
    assert len({H.jenkins_of(bytes([i]) * n) for i in range(50) for n in range(1, 30)}) == 50 * 29


def test_filter_grammar_and_configs():
    assert L.parse_ids("[1,2,4-7]") == [(1, 1), (2, 2), (4, 7)]
    for bad in ("1,2", "[5-3]", "[a]"):
        with pytest.raises(ValueError):
            L.parse_ids(bad)
    assert L.range_filter(10, "[3,5-6]").entries == ((30, 40), (50, 70))
    config = {"partitionType": "RANGE", "filters": [{"keyRange": {"start": 3, "end": -1}}]}
    assert L.parse_filter(json.dumps(config)).entries == ((3, L.LONG_MAX),)
    with pytest.raises(ValueError):
        L.mod_filter(0, "[1]")
    with pytest.raises(ValueError):
        L.mod_filter(4, "[1]").merge(L.range_filter(4, "[1]"))
    assert L.KeyFilter("MOD", ((10, 1, 3),)).merge(L.KeyFilter("MOD", ((20, 1, 3),))).entries == ((10, 1, 3), (20, 1, 3))
    assert L.KeyFilter("RANGE", ((1, 5), (7, 9))).sql("k") == "(k >= 1 AND k < 5) OR (k >= 7 AND k < 9)"
    assert L.KeyFilter().sql() == ""


def test_empty_filters_deny_and_pushdown_differs_on_negatives(spark):
    k = F.col("k")
    assert values(spark, [(3,)], "k bigint", L.KeyFilter("MOD").column(k)) == [False]
    f = L.KeyFilter("RANGE", ((-10, 10),))
    assert values(spark, [(-3,), (3,)], "k bigint", f.column(k)) == [False, True]
    assert values(spark, [(-3,), (3,)], "k bigint", F.expr(f.sql("k"))) == [True, True]


def test_partition_filters_cover_everything(spark):
    rows = spark.range(100).select(F.col("id").alias("k"))
    assert sum(rows.filter(L.partition_filter("MOD", 4, i).column(F.col("k"))).count() for i in range(4)) == 100


def test_bad_input_raises(spark):
    one = spark.createDataFrame([("x",)], "s string")
    for column in (C.trail_timestamp_ms(F.col("s")), C.trail_hex(F.col("s")), C.composite_key(F.lit(None), F.col("s")), L.key_range(F.col("s"), 0, 5), L.replicated(F.lit(None).cast("string"), "a")):
        with pytest.raises(Exception):
            one.select(column).collect()
    with pytest.raises(ValueError):
        C.logical_partition("hash:3")
    with pytest.raises(ValueError):
        L.payload_field(F.col("s"), "<=", "1", "string")


def test_trail_timestamps(spark):
    text = ["2013-07-04:02:27:51.000000", "1970-01-01:00:00:01.5", "1970-01-01:00:00:01", "1970-01-01:00:00:00.123456789", "1970-01-01:00:00:01."]
    assert values(spark, [(t,) for t in text] + [(None,)], "s string", C.trail_timestamp_ms(F.col("s"))) == [1372904871000, 1005, 1000, 123, 1000, None]
    assert values(spark, [("0xCAfe",), ("0x",)], "s string", C.trail_hex(F.col("s"))) == [bytearray(b"\xca\xfe"), bytearray()]


def test_types():
    assert column_type("NUMBER", 0, 3) == T.FloatType() and column_type("NUMBER", 0, 9) == T.DoubleType()
    assert column_type("NUMBER", 12, 0) == T.LongType() and column_type("NUMBER", 5, 0) == T.IntegerType()
    with pytest.raises(ValueError):
        column_type("NUMBER", 0, 18)
    assert camel_case("FIRST_NAME") == "firstName"
    assert row_schema([("ID", "NUMBER", 12, 0), ("FIRST_NAME", "VARCHAR2")]).names == ["id", "firstName"]


def test_checkpoints():
    c = K.advance(K.online(10), [(11, 5), (11, 5), (12, 5)])
    assert (c.window_scn, c.window_offset) == (12, 1)
    c = K.advance(c, [(12, -2)])
    assert (c.window_scn, c.window_offset, c.prev_scn) == (12, -1, 12)
    assert K.Checkpoint.from_json(c.to_json()) == c and not K.problems(c)
    assert K.problems(K.Checkpoint(mode="BOOTSTRAP_CATCHUP", since_scn=1, start_scn=5, target_scn=3))
    assert K.position(K.flexible(), min_scn=7, prev_scn=6, last_scn=9) == (7, 0)
    assert K.position(K.online(6), min_scn=7, prev_scn=6, last_scn=9) == (7, 0)
    assert K.position(K.online(8), min_scn=7, prev_scn=6, last_scn=9) == (8, -1)
    assert K.position(K.online(8), min_scn=7, prev_scn=6, last_scn=9, latest=True) == (9, 0)
    with pytest.raises(ScnNotFound):
        K.position(K.online(5), min_scn=7, prev_scn=6, last_scn=9)
    assert K.restart(K.Checkpoint(window_scn=9, window_offset=2, prev_scn=8)).window_scn == 8
    assert K.restart(K.Checkpoint(window_scn=9, window_offset=2)).flexible


def test_checkpoint_store(spark, tmp_path):
    store = K.CheckpointStore(spark, f"file://{tmp_path}")
    assert store.load("a") is None
    store.save("a", K.online(4))
    assert store.load("a") == K.online(4)
    store.delete("a")
    assert store.load("a") is None


def test_bootstrap_rules():
    table = [
        (("SNAPSHOT", 0, 10), {}, True), (("SNAPSHOT", 10, 10), {}, False), (("SNAPSHOT", 3, 10), {}, True), (("SNAPSHOT", 3, 10), {"full": True}, False),
        (("CATCHUP", 3, 10), {"last_scn": 5, "target_scn": 5}, True), (("CATCHUP", 3, 10), {"last_scn": 4, "target_scn": 5}, False), (("CATCHUP", 0, 10), {}, True), (("CATCHUP", 0, 10), {"error": True}, False),
    ]
    for args, more, want in table:
        assert B.phase_done(*args, **more) is want
    assert B.start_scn([B.SourceState(5, 9), B.SourceState(7, 8)], 6) == 5
    with pytest.raises(B.BootstrapTooOld):
        B.start_scn([B.SourceState(5, 5)], 6)
    with pytest.raises(ValueError):
        B.start_scn([B.SourceState(5, 4)], 0)
    B.check_complete(0, 0)
    with pytest.raises(B.BootstrapTooYoung):
        B.check_complete(3, 3)
    assert B.bypass_snapshot(5, {"a": 3}, 3) and not B.bypass_snapshot(5, {"a": 4}, 3) and B.bypass_snapshot(5, {"a": 9}, B.ALWAYS) and not B.bypass_snapshot(0, {}, 3)
    assert B.batch_result([0, 200, 100]) == ConsumerResult.ERROR and not ConsumerResult(B.batch_result([200])).ok
    assert S.phases([1, 2]) == [("SNAPSHOT", 1, [1]), ("CATCHUP", 1, [1]), ("SNAPSHOT", 2, [2]), ("CATCHUP", 2, [1, 2])]


def test_snapshot_plus_catchup_is_the_fold(spark):
    r = random.Random(5)
    log = [(1, str(r.randint(0, 20)), i + 1, i // 3 + 1, r.choice(["UPSERT", "DELETE"])) for i in range(200)]
    df = spark.createDataFrame(log, "src_id int, srckey string, id bigint, scn bigint, opcode string")
    for start, target, since in ((20, 50, 0), (30, 30, 10), (1, 66, 40)):
        want = {k: (scn, op) for _, k, _, scn, op in log if scn <= target}
        got = {x.srckey: (x.scn, x.opcode) for x in S.snapshot_then_catchup(df, start_scn=start, target_scn=target, since_scn=since).collect()}
        assert got == {k: v for k, v in want.items() if v[0] >= since}


TRAIL = """<transaction timestamp="2013-07-04:02:27:51.0"><dbupdate table="P" type="update" image="before"><columns><column name="ID" key="true">1</column></columns><tokens><token name="TK-CSN">5</token></tokens></dbupdate>
<dbupdate table="P" type="update"><columns><column name="ID" key="true">1</column><column name="NAME">last &amp; first</column></columns><tokens><token name="TK-XID">x1</token><token name="TK-CSN">5</token></tokens></dbupdate>
<dbupdate table="Q" type="delete"><columns><column name="ID" key="true">2</column></columns><tokens><token name="TK-XID">x1</token><token name="TK-CSN">6</token></tokens></dbupdate></transaction>
<transaction timestamp="2013-07-04:02:27:52.0"><dbupdate table="P" type="insert"><columns><column name="ID" key="true">3</column></columns><tokens><token name="TK-XID">x2</token></tokens></dbupdate></transaction>
"""


def test_xml_trails(spark, tmp_path):
    from tidelog.sources import tables, trails

    (tmp_path / "a.xml").write_text(TRAIL)
    raw = trails.transactions(spark, f"file://{tmp_path}/a.xml")
    assert raw.count() == 2
    checks = trails.validate(raw).orderBy("pos").collect()
    assert [(c.malformed, c.no_csn, c.bad_chars) for c in checks] == [(False, False, False), (False, True, False)]
    with pytest.raises(Exception):
        trails.updates(raw).collect()
    good = TRAIL.replace('<token name="TK-XID">x2</token>', '<token name="TK-XID">x2</token><token name="TK-CSN">7</token>')
    (tmp_path / "a.xml").write_text(good)
    got = tables.open_source(spark, f"gg:file://{tmp_path}/a.xml").orderBy("pos", "nth").collect()
    assert [(g.table_name, g.kind, g.scn) for g in got] == [("P", "update", 5), ("Q", "delete", 6), ("P", "insert", 7)]
    assert got[0]["columns"]["NAME"] == "last & first" and got[0]["keys"] == ["ID"]
    df = tables.open_source(spark, f"gg:file://{tmp_path}/a.xml")
    assert df.filter(trails.missing_fields(["ID", "NAME"])).count() == 2
    with pytest.raises(Exception):
        df.select(trails.column("NAME")).collect()
    assert [r[0] for r in df.select(trails.column("NAME", required=False)).collect()].count(None) == 2
    files = trails.positions(spark, f"file://{tmp_path}/a.xml")
    assert trails.find_position(files, 6)[0] == "FOUND" and trails.find_position(files, 99)[0] == "EXACT_SCN_NOT_FOUND"
    assert trails.find_position(files.filter("false"), 6) == ("NO_TXNS_FOUND", None)


def test_json_events_round_trip(spark, tmp_path):
    from tidelog.sources import jsonlines as J

    log = spark.createDataFrame([(1, 7, 0, 3, 9, 100, "abcdefghijklmnop", '{"a": 1}'), (1, 8, 0, 3, 9, 101, "abcdefghijklmnop", "é")], "scn bigint, key_long bigint, pp_id int, lp_id int, src_id int, ts_ns bigint, schema_id string, payload string")
    for encoding in ("JSON", "JSON_PLAIN_VALUE"):
        J.write_events(log, f"file://{tmp_path}/{encoding}", encoding=encoding)
        back = J.read_events(spark, f"file://{tmp_path}/{encoding}").orderBy("key_long").collect()
        assert [(b.scn, b.key_long, b.payload) for b in back] == [(1, 7, '{"a": 1}'), (1, 8, "é")]
    (tmp_path / "bad.json").write_text('{"sequence": 4}\n')
    with pytest.raises(Exception):
        J.read_events(spark, f"file://{tmp_path}/bad.json").collect()
    (tmp_path / "eop.json").write_text('{"sequence": 4, "endOfPeriod": true}\n')
    assert J.read_events(spark, f"file://{tmp_path}/eop.json").first().src_id == -2
    ends = spark.createDataFrame([(0, 1, 5), (0, 1, -2), (0, 2, 5)], "pp_id int, scn bigint, src_id int")
    assert J.complete_windows(ends).count() == 2


def test_generators(spark):
    from tidelog.sources import generators as G

    a, b = (G.random_events(spark, 50, seed=4).collect() for _ in range(2))
    assert a == b and {x.scn for x in a} == set(range(1, 6))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("m", T.MapType(T.StringType(), T.DoubleType())), T.StructField("r", T.ArrayType(T.StructType([T.StructField("x", T.BooleanType())])))])
    assert G.random_records(spark, schema, 3).dropna().count() == 3
    assert G.rate_stream(spark, 5).isStreaming


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_streaming(spark, tmp_path):
    from tidelog.streaming import tail as W

    ddl = "src_id int, srckey string, id bigint, scn bigint, pp_id int, opcode string"
    log = [(1 + i % 2, str(i % 7), i + 1, i // 5 + 1 - (3 if i == 17 else 0), 0, "UPSERT") for i in range(40)]
    folder = f"{tmp_path}/log"
    df = spark.createDataFrame(log, ddl)
    for lo in (0, 20):
        df.filter(f"id > {lo} AND id <= {lo + 20}").coalesce(1).write.mode("append").parquet(folder)
    table = W.SnapshotTable(spark, f"{tmp_path}/snap", df.schema)
    stream = lambda: W.tail(spark, folder, df.schema, files_per_trigger=1)
    _drain(W.keep_snapshot(stream(), table, f"{tmp_path}/c1"))
    got = {(r.src_id, r.srckey, r.id, r.scn) for r in table.read().collect()}
    want = {(r.src_id, r.srckey, r.id, r.scn) for r in S.apply_log(df).collect()}
    assert got == want and len(table.versions()) == 2
    table.merge(df, table.versions()[-1])  # a batch that runs again changes nothing
    assert {(r.src_id, r.srckey, r.id, r.scn) for r in table.read().collect()} == want

    calls = []

    class Seen(W.Consumer):
        def on_start_window(self, scn):
            calls.append(("start", scn))
            return ConsumerResult.SUCCESS

        def on_data(self, events, scn, src_id):
            calls.append((scn, src_id, events.count()))
            return ConsumerResult.SUCCESS

    one = df.filter("id <= 10")
    assert W.deliver(one, Seen()) == ConsumerResult.SUCCESS
    assert calls == [("start", 1), (1, 1, 3), (1, 2, 2), ("start", 2), (2, 1, 2), (2, 2, 3)]

    class Bad(W.Consumer):
        def on_data(self, events, scn, src_id):
            return ConsumerResult.ERROR

    with pytest.raises(RuntimeError):
        W.deliver(one, Bad())
    assert W.deliver(one, W.DelegatingConsumer(Bad(), (9,))) == ConsumerResult.SUCCESS

    out = []
    _drain(W.bootstrap_then_stream(spark, df, folder, lambda d, i: out.append((i, d.count())), f"{tmp_path}/c2", start_scn=3, target_scn=4))
    assert out[0][0] == -1 and sum(n for i, n in out if i >= 0) == df.filter("scn > 4").count()

    q = W.mark_late(stream()).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/c3").start()
    _drain(q)
    assert [r.id for r in spark.sql("SELECT id FROM late WHERE is_late").collect()] == [18]


def test_empty_log(spark):
    empty = spark.createDataFrame([], "src_id int, srckey string, id bigint, scn bigint, opcode string")
    assert S.apply_log(empty).count() == 0 and S.snapshot_then_catchup(empty, start_scn=1, target_scn=2).count() == 0


def test_committed_rows_over_blocks(spark):
    """Transactions and gaps that reach over several blocks of positions, in two streams and a nameless one."""
    from tidelog.operators import capture

    r, rows, want = random.Random(3), [], set()
    for stream in ("a", "b", None):
        pos, txn, open_ = -5, 0, []
        for _ in range(600):
            pos += r.choice((1, 7, 40_000, 300_000))
            kind = r.choice(("begin", "commit", "rollback") + ("row",) * 6)
            rows.append((stream, pos, kind))
            if kind == "row":
                open_.append((stream, pos, txn))
                continue
            if kind == "commit":
                want |= {x for x in open_ if x[2] > 0}
            open_, txn = [], txn + (kind == "begin")
    events = spark.createDataFrame(rows, "stream string, pos bigint, kind string")
    got = capture.committed(events)
    assert got.columns == ["stream", "pos", "kind", "txn"] and {(x.stream, x.pos, x.txn) for x in got.collect()} == want
    as_text = capture.committed(events.withColumn("pos", F.lpad((F.col("pos") + 5).cast("string"), 12, "0")))
    assert {(x.stream, int(x.pos) - 5, x.txn) for x in as_text.collect()} == want
    # frames that end with the partition are summed anew for each row
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_hash_of_a_text_key_is_computed_once(spark, sf):
    """A filter and a column of it: two computations, without number conversions for each character."""
    from tidelog.queries import QUERIES

    plan = QUERIES["f03_string_key_mod"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2 and "conv(" not in plan
    texts = [("abc",), ("",), ("7",), ("-9223372036854775808",), ("\0é中😀",), (None,)]
    df = spark.createDataFrame(texts, "s string").select("s", L.numeric_key(F.col("s"), "string").alias("k"))
    rows = df.select("k", L.key_mod(F.col("k"), 5, 1, 4), L.key_mod(F.col("s"), 5, 1, 4, "string")).collect()
    assert all(r[1] == r[2] for r in rows) and rows[3][2] is False and rows[5][2] is False
    units = "\0é中😀".encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) % (1 << 32)
    assert rows[4].k == h - (h >> 31 << 32)
