"""Clients of the log inside tasks: framing of events into callbacks, several consumers at once, retries from the
last good checkpoint, checkpoints inside large windows, and delivery of a batch partition by partition.

A physical partition's events are delivered in order by one task, to a consumer that is made there; the events
never come to the driver. Results are the greatest of the callbacks' results (ConsumerResult).

Defined results. No events: consumption starts and stops. A null result of a callback: SUCCESS. A callback that
raises: on_error decides. Control rows (negative source ids) close windows or are passed over, they are no data.
"""

from __future__ import annotations

import threading
import time
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..schema import ConsumerResult, ControlType

Event = dict[str, Any]


class StreamConsumer:
    """Callbacks of a consumer of the online stream; events come one by one, as dictionaries."""

    def on_start_consumption(self) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_stop_consumption(self) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_start_window(self, scn: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_end_window(self, scn: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_start_source(self, scn: int, src_id: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_end_source(self, scn: int, src_id: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_event(self, event: Event) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_checkpoint(self, scn: int, offset: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_rollback(self, scn: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_error(self, error: Exception) -> ConsumerResult:
        return ConsumerResult.ERROR


class BootstrapConsumer:
    """Callbacks of a consumer of a snapshot or catch-up; positions are row ids."""

    def on_start_bootstrap(self) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_stop_bootstrap(self) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_start_sequence(self, scn: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_end_sequence(self, scn: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_start_source(self, src_id: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_end_source(self, src_id: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_event(self, event: Event) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_checkpoint(self, row_id: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_rollback(self, row_id: int) -> ConsumerResult:
        return ConsumerResult.SUCCESS

    def on_error(self, error: Exception) -> ConsumerResult:
        return ConsumerResult.ERROR


class SelectingConsumer(StreamConsumer):
    """Passes each event on to the handler of its source; events of other sources are passed over."""

    def __init__(self, handlers: dict[int, Callable[[Event], ConsumerResult]]):
        self._handlers = handlers

    def on_event(self, event: Event) -> ConsumerResult:
        handle = self._handlers.get(event["src_id"])
        return ConsumerResult.SUCCESS if handle is None else handle(event)


class MultiConsumer:
    """Several consumers as one. Events of a source go to all of them at once; every other callback is a barrier:
    it waits until all have returned from what came before. A callback that takes longer than timeout seconds is an error.

    A switch of threads takes longer than a short callback, so calls that are known ahead (run_ahead) are made by one
    thread, consumer after consumer, for as long as they are quick. When they are not, the consumers get threads of their own
    again. A consumer's calls come in order and never two at once, but not all from one thread."""

    #: How often (seconds) run_ahead looks at its calls, how long one may take on average, and how many go to threads before it tries again.
    LOOK, QUICK, THREADED = 0.005, 0.0005, 64

    def __init__(self, consumers: list, *, timeout: float | None = None):
        self._consumers, self._timeout = consumers, timeout
        self._pools = [ThreadPoolExecutor(1) for _ in consumers]  # one thread each keeps a consumer's calls in order
        self._together = ThreadPoolExecutor(1)
        self._waiting: list = []
        self._late: list = []  # what had not returned when its time was over

    def _barrier(self) -> ConsumerResult:
        done, late = wait(self._waiting, timeout=self._timeout)
        self._waiting = []
        if late:
            self._late = [f for f in (*self._late, *late) if not f.cancel() and not f.done()]
            return ConsumerResult.ERROR
        return max((f.result() or ConsumerResult.SUCCESS for f in done), default=ConsumerResult.SUCCESS)

    def __getattr__(self, name: str):
        if not name.startswith("on_"):
            raise AttributeError(name)

        def call(*args) -> ConsumerResult:
            before = ConsumerResult.SUCCESS if name == "on_event" else self._barrier()

            self._waiting += [pool.submit(_called, c, name, *args) for pool, c in zip(self._pools, self._consumers, strict=True)]
            return before if name == "on_event" else max(before, self._barrier())

        return call

    def run_ahead(self, calls: list[tuple]) -> list[ConsumerResult]:
        """Makes calls (name, arguments) in order up to the first failure, and gives their results, at least one."""
        results: list[ConsumerResult] = []
        while len(results) < len(calls) and (not results or results[-1].ok):
            self._late = [f for f in self._late if not f.done()]
            if self._late or self._waiting or self._one_thread(calls, results):
                self._own_threads(calls, results)
        return results

    def _one_thread(self, calls: list[tuple], results: list[ConsumerResult]) -> bool:
        """Makes calls in one thread until one fails; whether they were too slow, then the next one is under way."""
        batch = _Batch(self._consumers, calls, results)
        running = self._together.submit(batch.run)
        look = self.LOOK if self._timeout is None else min(self.LOOK, self._timeout)
        seen, since = 0, time.monotonic()
        while wait([running], timeout=look).not_done:
            now, made = time.monotonic(), batch.made
            if now - since <= (made - seen) * self.QUICK:
                seen, since = made, now
                continue
            with batch.lock:
                if batch.over:
                    continue
                batch.over, at = True, batch.at
            if at < 0:  # between two calls
                running.result()
                return not results or results[-1].ok
            # the consumer whose callback is under way waits for it in its own thread, those behind it start now
            name, *args = calls[len(results)]
            self._waiting = [running, self._pools[at].submit(running.result)]
            for pool, c in list(zip(self._pools, self._consumers, strict=True))[at + 1 :]:
                self._waiting.append(pool.submit(_called, c, name, *args))
            results.append(ConsumerResult.SUCCESS if name == "on_event" else self._barrier())
            return results[-1].ok
        running.result()
        return False

    def _own_threads(self, calls: list[tuple], results: list[ConsumerResult]) -> None:
        """Makes some calls in a thread for each consumer; the last one's result has what is still out."""
        for name, *args in calls[len(results) : len(results) + self.THREADED]:
            results.append(getattr(self, name)(*args))
            if not results[-1].ok:
                return
        if results:
            results[-1] = max(results[-1], self._barrier())

    def close(self) -> None:
        self._together.shutdown(wait=False, cancel_futures=True)
        for pool in self._pools:
            pool.shutdown(wait=False, cancel_futures=True)


def _called(consumer, name: str, *args) -> ConsumerResult:
    try:
        return getattr(consumer, name)(*args) or ConsumerResult.SUCCESS
    except Exception as e:  # as above
        return consumer.on_error(e)


class _Batch:
    """Calls of several consumers in one thread, of which another thread may take over what has not begun."""

    def __init__(self, consumers: list, calls: list[tuple], results: list[ConsumerResult]):
        self._consumers, self._calls, self._results = consumers, calls, results
        self.lock, self.over = threading.Lock(), False
        self.made, self.at = 0, -1  # callbacks made; the consumer under way, -1 between two calls

    def run(self) -> ConsumerResult:
        for name, *args in self._calls[len(self._results) :]:
            worst = ConsumerResult.SUCCESS
            for i, c in enumerate(self._consumers):
                with self.lock:
                    if self.over:
                        return worst
                    self.at = i
                worst = max(worst, _called(c, name, *args))
                self.made += 1
            with self.lock:
                if self.over:
                    return worst
                self._results.append(worst)
                self.at = -1
            if not worst.ok:
                break
        with self.lock:
            self.over = True
        return ConsumerResult.SUCCESS


class _Told:
    """Writes down what it is called with."""

    def __init__(self):
        self.calls: list[tuple] = []

    def __getattr__(self, name: str):
        if not name.startswith("on_"):
            raise AttributeError(name)

        def call(*args) -> ConsumerResult:
            self.calls.append((name, *args))
            return ConsumerResult.SUCCESS

        return call


class Failed(RuntimeError):
    """A callback has failed more often than it may."""


class Dispatcher:
    """Delivers events in order (scn, src_id, ...) with checkpoints at window ends, and inside a window whenever
    checkpoint_bytes have been delivered since the last one.

    After a failed callback the consumer is rolled back and gets everything since its last good checkpoint again, at
    most `retries` times for the same checkpoint; ERROR_FATAL is not tried again. What is held for that is what came
    since the checkpoint. SKIP_CHECKPOINT as the result of on_checkpoint keeps the older one.

    ahead: so many events are read before the first of them is delivered, and a MultiConsumer is told at once which
    callbacks they make as long as none fails. After a failure that is worked out anew."""

    def __init__(self, consumer, *, retries: int = 3, checkpoint_bytes: int | None = None, size: str = "size_bytes", ahead: int = 1):
        self._consumer, self._retries, self._most, self._size, self._tries = consumer, retries, checkpoint_bytes, size, 0
        self._ended_before = False
        self._ahead = ahead if isinstance(consumer, MultiConsumer) else 1
        self._coming: deque[Event] = deque()  # read, not delivered
        self._planned: deque[tuple[str, ConsumerResult]] = deque()  # callbacks that were made ahead
        self._covered = 0  # events whose callbacks are among these
        self.checkpoint: tuple[int, int] = (-1, -1)  # scn, events of it that are done (-1: all)
        self.calls: Counter[str] = Counter()  # how often each callback was called: a number each, however long the log

    def _call(self, name: str, *args) -> ConsumerResult:
        if self._planned:
            made, result = self._planned.popleft()
            if made != name:
                raise RuntimeError(f"{made} was called ahead, {name} is due")
        else:
            result = _called(self._consumer, name, *args)
        self.calls[name] += 1
        return result

    def run(self, events: Iterable[Event]) -> ConsumerResult:
        worst = self._call("on_start_consumption")
        held: list[Event] = []  # since the checkpoint
        state = self._fresh()
        try:
            for event in self._read(events):
                held.append(event)
                state, worst = self._deliver(held, len(held) - 1, state, worst)
            state, worst = self._ended(held, state, worst)
        finally:
            self._call("on_stop_consumption")
        return worst

    def _read(self, events: Iterable[Event]) -> Iterator[Event]:
        if self._ahead == 1:
            yield from events
            return
        source, failure = iter(events), None
        while failure is None:
            try:
                for event in islice(source, self._ahead):
                    self._coming.append(event)
            except Exception as e:  # what came before it is delivered first
                failure = e
            if not self._coming:
                break
            while self._coming:
                yield self._coming.popleft()
        if failure is not None:
            raise failure

    def _plan(self, events: list[Event], state: dict) -> None:
        """Has the callbacks of these events made up to the first failure; _call finds their results."""
        told = _Told()
        trial = Dispatcher(told, checkpoint_bytes=self._most, size=self._size)
        state = dict(state)
        for event in events:
            trial._step(event, state)
        if told.calls:
            results = self._consumer.run_ahead(told.calls)
            self._planned.extend(zip((c[0] for c in told.calls), results, strict=False))
        self._covered = len(events)

    @staticmethod
    def _fresh() -> dict:
        return {"scn": None, "src": None, "n": 0, "bytes": 0}

    def _deliver(self, held: list[Event], at: int, state: dict, worst: ConsumerResult) -> tuple[dict, ConsumerResult]:
        while at < len(held):
            if self._ahead > 1 and not self._covered:
                soon = held[at : at + self._ahead]
                self._plan([*soon, *islice(self._coming, self._ahead - len(soon))], state)
            result, done = self._step(held[at], state)
            self._covered = self._covered - 1 if result.ok else 0
            if self._ended_before:  # the window before this event is done, whatever has become of the event
                del held[:at]
                at, self._tries, self._ended_before = 0, 0, False
            if result.ok:
                worst = max(worst, result)
                at += 1
                if done:
                    del held[:at]
                    at, self._tries = 0, 0
                continue
            self._tries += 1
            if result == ConsumerResult.ERROR_FATAL or self._tries > self._retries:
                raise Failed(f"{result.name} after checkpoint {self.checkpoint}")
            self._call("on_rollback", self.checkpoint[0])
            # inside a window the window is opened again, behind the events that are done
            state.update(self._fresh())
            if self.checkpoint[1] >= 0:
                state["n"] = self.checkpoint[1]
            at = 0
        return state, worst

    def _close(self, state: dict) -> ConsumerResult:
        """Ends the open source and window; takes the checkpoint."""
        result = ConsumerResult.SUCCESS
        if state["src"] is not None:
            result = max(result, self._call("on_end_source", state["scn"], state["src"]))
        result = max(result, self._call("on_end_window", state["scn"]))
        return result

    def _checkpointed(self, scn: int, offset: int) -> tuple[ConsumerResult, bool]:
        result = self._call("on_checkpoint", scn, offset)
        taken = result.ok and result != ConsumerResult.SKIP_CHECKPOINT
        if taken:
            self.checkpoint = (scn, offset)
        return result, taken

    def _step(self, event: Event, state: dict) -> tuple[ConsumerResult, bool]:
        """(result, whether a checkpoint behind this event was taken)."""
        scn, src = event["scn"], event["src_id"]
        if src < 0 and src != ControlType.END_OF_PERIOD:
            return ConsumerResult.SUCCESS, False
        result = ConsumerResult.SUCCESS
        if state["scn"] is not None and state["scn"] != scn:  # without an end-of-period row
            result = self._close(state)
            if not result.ok:
                return result, False
            last, self._ended_before = self._checkpointed(state["scn"], -1)
            state.update(self._fresh())
            result = max(result, last)
            if not result.ok:
                return result, False
        if src == ControlType.END_OF_PERIOD:
            if state["scn"] is None:
                return ConsumerResult.SUCCESS, False
            result = self._close(state)
            if not result.ok:
                return result, False
            state.update(self._fresh())
            last, taken = self._checkpointed(scn, -1)
            return max(result, last), taken
        if state["scn"] is None:
            done = state["n"]
            state.update(scn=scn, n=done)
            result = max(result, self._call("on_start_window", scn))
        if result.ok and state["src"] != src:
            if state["src"] is not None:
                result = max(result, self._call("on_end_source", scn, state["src"]))
            state["src"] = src
            result = max(result, self._call("on_start_source", scn, src))
        if result.ok:
            result = max(result, self._call("on_event", event))
        if not result.ok:
            return result, False
        state["n"] += 1
        state["bytes"] += event.get(self._size) or 0
        if self._most and state["bytes"] >= self._most:
            state["bytes"] = 0
            last, taken = self._checkpointed(scn, state["n"])
            return max(result, last), taken
        return result, False

    def _ended(self, held: list[Event], state: dict, worst: ConsumerResult) -> tuple[dict, ConsumerResult]:
        if state["scn"] is None:
            return state, worst
        return self._deliver([*held, {"scn": state["scn"], "src_id": int(ControlType.END_OF_PERIOD)}], len(held), state, worst)


def bootstrap(consumer: BootstrapConsumer, scn: int, events: Iterable[Event], *, every: int = 1000) -> ConsumerResult:
    """Delivers a snapshot's or catch-up's events (in order of source, then row id) to a bootstrap consumer, with a
    checkpoint after each `every` events and at the end of each source. A failure rolls back and raises Failed."""
    worst, src, n, last, kept = _called(consumer, "on_start_bootstrap"), None, 0, -1, -1
    worst = max(worst, _called(consumer, "on_start_sequence", scn))

    def told(name: str, *args) -> None:
        nonlocal worst
        result = _called(consumer, name, *args)
        worst = max(worst, result)
        if not result.ok:
            _called(consumer, "on_rollback", kept)
            raise Failed(f"{name} gave {result.name}")

    for event in events:
        if event["src_id"] != src:
            if src is not None:
                told("on_end_source", src)
                told("on_checkpoint", last)
                kept = last
            src = event["src_id"]
            told("on_start_source", src)
        told("on_event", event)
        last, n = event["id"], n + 1
        if n % every == 0:
            told("on_checkpoint", last)
            kept = last
    if src is not None:
        told("on_end_source", src)
        told("on_checkpoint", last)
    told("on_end_sequence", scn)
    told("on_stop_bootstrap")
    return worst


def deliver_partitions(
    log: DataFrame, make: Callable[[], StreamConsumer], *, retries: int = 3, checkpoint_bytes: int | None = None, order: tuple[str, ...] = ("scn", "src_id", "seq")
) -> DataFrame:
    """Delivers each physical partition's events in a task of their own kind: pp_id, result, scn, offset (the last
    checkpoint), calls, rollbacks. A consumer that keeps failing fails the task, and so the batch."""
    names = log.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (dict(zip(names, r, strict=True)) for f in frames for r in f.itertuples(index=False, name=None))
        ahead = next(rows, None)
        while ahead is not None:
            pp, first = ahead["pp_id"], ahead
            rest: list[Event | None] = [None]

            def part(pp=pp, first=first, rest=rest) -> Iterator[Event]:
                yield first
                for row in rows:
                    if row["pp_id"] != pp:
                        rest[0] = row
                        return
                    yield row

            dispatcher = Dispatcher(make(), retries=retries, checkpoint_bytes=checkpoint_bytes, ahead=1000)
            result = dispatcher.run(part())
            calls = dispatcher.calls
            yield pd.DataFrame({
                "pp_id": [pp], "result": [int(result)], "scn": [dispatcher.checkpoint[0]], "offset": [dispatcher.checkpoint[1]], "calls": [calls.total()],
                "windows": [calls["on_end_window"]], "sources": [calls["on_end_source"]], "events": [calls["on_event"]],
                "checkpoints": [calls["on_checkpoint"]], "rollbacks": [calls["on_rollback"]],
            })
            ahead = rest[0]

    dealt = log.repartition("pp_id").sortWithinPartitions("pp_id", *order)
    return dealt.mapInPandas(
        run, "pp_id int, result int, scn bigint, offset bigint, calls bigint, windows bigint, sources bigint, events bigint, checkpoints bigint, rollbacks bigint"
    )
