"""When to take a snapshot, where to start, and when a phase ends."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..operators import snapshot as S
from ..operators.relay import read_changes
from ..schema import ClientMode, ScnNotFound
from .checkpoint import Checkpoint

ALWAYS = (1 << 63) - 1


class BootstrapTooOld(Exception):
    """The producer has not come as far as the client."""


class BootstrapTooYoung(Exception):
    """The snapshot does not reach back to where the client is."""


@dataclass(frozen=True)
class SourceState:
    applier_scn: int
    producer_scn: int
    min_scn: int = 0


def start_scn(states: list[SourceState], since: int) -> int:
    """The least applied window, once every producer is at least at since and not behind its applier."""
    start = min(s.applier_scn for s in states)
    producer = min(s.producer_scn for s in states)
    if any(s.producer_scn < s.applier_scn for s in states):
        raise ValueError("a producer is behind its applier")
    if producer < since:
        raise BootstrapTooOld(f"producer at {producer}, client at {since}")
    return start


def check_complete(since: int, least: int) -> None:
    """since must be above the snapshot's least complete number, unless both are 0."""
    if since <= least and not since == least == 0:
        raise BootstrapTooYoung(f"client at {since}, snapshot from {least}")


def bypass_snapshot(since: int, row_counts: dict[str, int], threshold: int, *, enabled: bool = True, in_logs: bool = True) -> bool:
    """Whether the logs alone will do: few enough rows since then, for every source."""
    if not enabled or since <= 0 or not in_logs:
        return False
    return threshold == ALWAYS or all(n <= threshold for n in row_counts.values())


def phase_done(phase: str, n_rows: int, page: int, *, last_scn: int = -1, target_scn: int = -1, full: bool = False, error: bool = False) -> bool:
    """No rows: done. Snapshot: a short page. Catch-up: a short page that ends at the target. A full client buffer or an error: not done."""
    if error or full:
        return False
    if n_rows == 0:
        return True
    if n_rows >= page:
        return False
    return phase == "SNAPSHOT" or last_scn == target_scn


def finished(c: Checkpoint) -> Checkpoint:
    """The online checkpoint after a bootstrap."""
    return Checkpoint(mode=ClientMode.ONLINE_CONSUMPTION.value, window_scn=c.target_scn, prev_scn=c.target_scn)


def consume(log: DataFrame, c: Checkpoint, *, min_scn: int, target_scn: int, start: int, bootstrap: bool = True, latest: bool = False,
            handle: Callable[[DataFrame, str], None] = lambda df, phase: None) -> Checkpoint:
    """A client's pass: online if the log still holds its place, else snapshot and catch-up, then online from the target."""
    try:
        if not c.flexible and c.window_scn < min_scn - 1:
            raise ScnNotFound(str(c.window_scn))
        handle(read_changes(log.filter(f"scn >= {min_scn}"), max(c.window_scn, min_scn - 1), c.window_offset), "ONLINE")
        return replace(c, window_scn=target_scn, prev_scn=target_scn, window_offset=-1, flexible=False)
    except ScnNotFound:
        if not bootstrap:
            if latest:
                return Checkpoint(window_scn=target_scn, prev_scn=target_scn)
            raise
    since = max(c.window_scn, 0)
    handle(S.snapshot_rows(S.apply_log(log, before_scn=start), start_scn=start, since_scn=since), "SNAPSHOT")
    handle(S.catchup_rows(log, start_scn=start, target_scn=target_scn, since_scn=since), "CATCHUP")
    return finished(Checkpoint(target_scn=target_scn))


def batch_result(codes: list[int]) -> int:
    """A batch's result is the worst of its callbacks'."""
    return max(codes, default=0)
