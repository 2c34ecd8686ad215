"""Callback order, retries, checkpoints inside windows, several consumers."""

import time

import pytest

from tidelog.schema import ConsumerResult as R
from tidelog.streaming import consumers as C


def log(*rows):
    return [{"scn": scn, "src_id": src, "seq": i, "size_bytes": 50, "id": i} for i, (scn, src) in enumerate(rows)]


EVENTS = log((1, 7), (1, 7), (1, 8), (1, -2), (2, 7), (3, 8), (3, -3), (3, -2))


class Tells(C.StreamConsumer):
    def __init__(self, **results):
        self.calls, self.results = [], {k: list(v) for k, v in results.items()}

    def __getattribute__(self, name):
        if not name.startswith("on_"):
            return super().__getattribute__(name)

        def call(*args):
            self.calls.append((name, *(a["id"] if isinstance(a, dict) else a for a in args)))
            left = self.results.get(name)
            return left.pop(0) if left else None

        return call


def names(c):
    return [x[0].removeprefix("on_") for x in c.calls]


def test_callback_order():
    c = Tells()
    d = C.Dispatcher(c)
    assert d.run(EVENTS) == R.SUCCESS and d.checkpoint == (3, -1)
    assert names(c) == (
        ["start_consumption", "start_window", "start_source", "event", "event", "end_source", "start_source", "event", "end_source", "end_window", "checkpoint"]
        + ["start_window", "start_source", "event", "end_source", "end_window", "checkpoint"] * 2 + ["stop_consumption"]
    )
    assert [x[1:] for x in c.calls if x[0] == "on_checkpoint"] == [(1, -1), (2, -1), (3, -1)]


def test_no_events():
    c = Tells()
    assert C.Dispatcher(c).run([]) == R.SUCCESS and names(c) == ["start_consumption", "stop_consumption"]


def test_retries_from_the_last_checkpoint():
    c = Tells(on_event=[R.SUCCESS, R.SUCCESS, R.SUCCESS, R.ERROR, R.SUCCESS])
    assert C.Dispatcher(c).run(EVENTS) == R.SUCCESS
    assert [x[1] for x in c.calls if x[0] == "on_event"] == [0, 1, 2, 4, 4, 5] and ("on_rollback", 1) in c.calls
    c = Tells(on_event=[R.ERROR] * 9)
    with pytest.raises(C.Failed):
        C.Dispatcher(c, retries=3).run(EVENTS)
    assert names(c).count("event") == 4 and names(c)[-1] == "stop_consumption"
    c = Tells(on_event=[R.ERROR_FATAL])
    with pytest.raises(C.Failed):
        C.Dispatcher(c).run(EVENTS)
    assert names(c).count("event") == 1


def test_checkpoints_inside_a_window():
    c = Tells(on_event=[R.SUCCESS] * 3 + [R.ERROR])
    d = C.Dispatcher(c, checkpoint_bytes=100)
    d.run(log(*[(5, 7)] * 5))
    assert [x[1:] for x in c.calls if x[0] == "on_checkpoint"] == [(5, 2), (5, 4), (5, -1)]
    # rolled back to behind the second event
    assert [x[1] for x in c.calls if x[0] == "on_event"] == [0, 1, 2, 3, 2, 3, 4]


def test_skipped_checkpoints_are_not_taken():
    d = C.Dispatcher(Tells(on_checkpoint=[R.SKIP_CHECKPOINT, R.SUCCESS, R.SKIP_CHECKPOINT]))
    assert d.run(EVENTS) == R.SKIP_CHECKPOINT and d.checkpoint == (2, -1)


def test_several_consumers():
    a, b = Tells(), Tells(on_end_window=[R.CHECKPOINT])
    m = C.MultiConsumer([a, b])
    assert C.Dispatcher(m).run(EVENTS) == R.CHECKPOINT
    assert a.calls == b.calls and len(a.calls) > 10
    m.close()

    class Slow(C.StreamConsumer):
        def on_event(self, event):
            time.sleep(0.5)

    m = C.MultiConsumer([C.StreamConsumer(), Slow()], timeout=0.05)
    with pytest.raises(C.Failed):
        C.Dispatcher(m, retries=0).run(EVENTS)
    m.close()


def test_raising_callbacks_ask_on_error():
    class Bad(C.StreamConsumer):
        def on_event(self, event):
            raise ValueError("no")

        def on_error(self, error):
            return R.SUCCESS if isinstance(error, ValueError) else R.ERROR

    assert C.Dispatcher(Bad()).run(EVENTS) == R.SUCCESS


def test_bootstrap_callbacks():
    calls = []

    class Seen(C.BootstrapConsumer):
        def __getattribute__(self, name):
            if name.startswith("on_"):
                return lambda *a: calls.append((name, *(x["id"] if isinstance(x, dict) else x for x in a)))
            return super().__getattribute__(name)

    rows = [{"src_id": s, "id": i} for s, i in ((7, 1), (7, 2), (7, 3), (8, 9))]
    assert C.bootstrap(Seen(), 40, rows, every=2) == R.SUCCESS
    assert [c[0].removeprefix("on_") for c in calls] == [
        "start_bootstrap", "start_sequence", "start_source", "event", "event", "checkpoint", "event", "end_source", "checkpoint", "start_source", "event", "checkpoint",
        "end_source", "checkpoint", "end_sequence", "stop_bootstrap",
    ]
    assert [c[1] for c in calls if c[0] == "on_checkpoint"] == [2, 3, 9, 9]


def test_snapshot_of_a_fresh_checkpoint(spark, tmp_path):
    """Batch numbers begin anew with a fresh stream checkpoint; no batch is lost and the newest version is read."""
    from tidelog.streaming import tail as W

    one = lambda key: spark.createDataFrame([(1, key, 5, 5, 0, "UPSERT")], "src_id int, srckey string, id bigint, scn bigint, pp_id int, opcode string")
    table = W.SnapshotTable(spark, f"{tmp_path}/snap", one("a").schema)
    set_ = spark.sparkContext.setLocalProperty
    try:
        for query, batch, key in (("q1", 7, "a"), ("q1", 8, "b"), ("q1", 8, "again"), ("q2", 0, "c")):
            set_("sql.streaming.queryId", query)
            table.merge(one(key), batch)
    finally:
        set_("sql.streaming.queryId", None)
    assert {r.srckey for r in table.read().collect()} == {"a", "b", "c"} and table.versions() == [1, 2]


def test_max_scn_store(spark, tmp_path):
    from tidelog.plans.checkpoint import MaxScnStore

    s = MaxScnStore(spark, f"file://{tmp_path}")
    assert s.load("a", 3) == 3 and s.save("a", 10) == 10 and s.save("a", 7) == 10 and s.save("a", 7, force=True) == 7 and s.load("a") == 7


def test_jenkins_rows_equal_one_by_one():
    import random

    from tidelog.functions.hashing import jenkins_of, jenkins_rows

    r = random.Random(1)
    rows = [r.randbytes(n) for n in [*range(40), 12, 24, 5, 5]]
    assert jenkins_rows(rows).tolist() == [jenkins_of(x) for x in rows]


def test_a_long_log_leaves_no_trace_of_each_call():
    """What a dispatcher and the consumer that fails hold does not grow with the events."""
    import tracemalloc

    from tidelog.queries.client_queries import FailsOnce

    def held(windows, make, **how):
        events = ({"scn": i // 5 + 1, "src_id": 7, "id": i, "size_bytes": 50} for i in range(5 * windows))
        tracemalloc.start()
        consumer = make()
        d = C.Dispatcher(consumer, **how)
        d.run(events)
        size = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        assert d.checkpoint == (windows, -1)
        return size, d.calls

    for make, how in ((C.StreamConsumer, {"checkpoint_bytes": 100}), (FailsOnce, {"retries": 10})):
        held(10, make, **how)
        (small, _), (large, calls) = held(200, make, **how), held(8000, make, **how)
        assert large < small + 10_000
        assert calls["on_end_window"] == 8000 and calls["on_rollback"] == (0 if make is C.StreamConsumer else len(range(0, 40_000, 97)))


class Stumbles(Tells):
    """Fails once at each event whose id % every == 3, and at some other callbacks."""

    def __init__(self, every, also=()):
        super().__init__()
        self.every, self.also, self.seen = every, also, set()

    def __getattribute__(self, name):
        call = super().__getattribute__(name)
        if not name.startswith("on_") or name in ("on_stop_consumption", "on_rollback", "on_error"):
            return call

        def failing(*args):
            call(*args)
            what = (name, args[0]["id"] if isinstance(args[0], dict) else args) if args else None
            bad = what and what not in self.seen and (args[0]["id"] % self.every == 3 if name == "on_event" else name in self.also and args[0] % 5 == 2)
            self.seen.add(what)
            return R.ERROR if bad else R.CHECKPOINT if name == "on_end_source" else R.SUCCESS

        return failing


@pytest.mark.parametrize("every, also, most", [(10**9, (), None), (10, (), None), (10, (), 120), (7, ("on_end_window", "on_start_source", "on_checkpoint"), 120)])
def test_calls_made_ahead_are_those_of_one_consumer(every, also, most):
    import random

    r, events, scn = random.Random(5), [], 1
    for i in range(3000):
        events.append({"scn": scn, "src_id": r.choice((7, 7, 8, 9, -3)), "seq": i, "size_bytes": 50, "id": i})
        if r.random() < 0.3:
            if r.random() < 0.5:
                events.append({"scn": scn, "src_id": -2, "seq": i, "size_bytes": 0, "id": -1})
            scn += 1
    alone, both = Stumbles(every, also), [Stumbles(every, also), Stumbles(every, also)]
    a, m = C.Dispatcher(alone, retries=20, checkpoint_bytes=most), C.MultiConsumer(both)
    b = C.Dispatcher(m, retries=20, checkpoint_bytes=most, ahead=100)
    assert a.run(events) == b.run(iter(events)) and a.checkpoint == b.checkpoint and a.calls == b.calls
    m.close()
    assert both[0].calls == both[1].calls == alone.calls


def test_short_callbacks_need_no_thread_each(monkeypatch):
    submit, n = C.ThreadPoolExecutor.submit, [0]

    def counted(*args, **more):
        n[0] += 1
        return submit(*args, **more)

    monkeypatch.setattr(C.ThreadPoolExecutor, "submit", counted)
    m = C.MultiConsumer([C.StreamConsumer(), C.SelectingConsumer({7: lambda e: R.SUCCESS})], timeout=60)
    d = C.Dispatcher(m, ahead=1000)
    assert d.run(log(*[(i // 3, 7) for i in range(30_000)])) == R.SUCCESS and d.calls["on_event"] == 30_000
    m.close()
    assert n[0] < 15_000  # one for 1000 events; far more only if something else holds the machine up


def test_slow_callbacks_made_ahead_run_at_once_and_in_order():
    class Slow(Tells):
        def __getattribute__(self, name):
            call = super().__getattribute__(name)
            if name == "on_event":
                return lambda e: (time.sleep(0.05), call(e))[1]
            return call

    consumers = [Slow() for _ in range(5)]
    m = C.MultiConsumer(consumers, timeout=30)
    began = time.monotonic()
    assert C.Dispatcher(m, ahead=1000).run(log(*[(i // 4, 7) for i in range(20)])) == R.SUCCESS
    assert time.monotonic() - began < 20 * 5 * 0.05 * 0.7  # one after another they need 5 s
    m.close()
    alone = Tells()
    C.Dispatcher(alone).run(log(*[(i // 4, 7) for i in range(20)]))
    assert all(c.calls == alone.calls for c in consumers)


def test_a_callback_that_hangs_is_an_error_ahead_too():
    import threading

    free = threading.Event()

    class Hangs(C.StreamConsumer):
        def on_event(self, event):
            if event["id"] == 4:
                free.wait(30)

    for order in (1, -1):
        m = C.MultiConsumer([Hangs(), C.StreamConsumer()][::order], timeout=0.1)
        began = time.monotonic()
        with pytest.raises(C.Failed):
            C.Dispatcher(m, retries=1, ahead=1000).run(EVENTS + log((9, 7)))
        assert time.monotonic() - began < 10
        m.close()
    free.set()

    def torn():
        yield from EVENTS[:5]
        raise OSError("torn")

    t = Tells()
    with pytest.raises(OSError):
        C.Dispatcher(C.MultiConsumer([t]), ahead=1000).run(torn())
    assert names(t).count("event") == 4 and names(t)[-1] == "stop_consumption"
