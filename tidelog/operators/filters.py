"""Filters of change events, all as native columns so that they reach the scan."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import checksum, draw, string_hash

LONG_MAX = (1 << 63) - 1
WILDCARD = None


def in_range(x: Column, start: int, end: int) -> Column:
    """[start, end) of non-negative values; start > end wraps around, start = end is empty. Null is out."""
    if start < end:
        inside = (x >= start) & (x < end)
    elif start > end:
        inside = (x >= start) | (x < end)
    else:
        return F.lit(False)
    return x.isNotNull() & (x >= 0) & inside  # false for null without a wrapper, so that the scan gets the parts


def allow_all() -> Column:
    return F.lit(True)


def sources(ids: Iterable[int], src: str = "src_id") -> Column:
    return F.col(src).isin(*ids)


def numeric_key(key: Column, kind: str = "long") -> Column:
    """A key as a number: text that is no number goes by its hash code."""
    if kind == "long":
        return key.cast("long")
    return F.coalesce(key.try_cast("long"), string_hash(key))


def key_mod(key: Column, buckets: int, start: int, end: int, kind: str = "long") -> Column:
    """abs(key) % buckets in [start, end). The least bigint has no absolute value and is never in."""
    if buckets <= 0:
        raise ValueError("buckets must be positive")
    k = numeric_key(key, kind)
    if kind != "long":  # as an element, so that the hash of a text is computed once
        return F.transform(F.array(k), lambda x: key_mod(x, buckets, start, end))[0]
    return F.when(k == -(1 << 63), F.lit(False)).otherwise(in_range(F.abs(k) % buckets, start, end))


def key_range(key: Column, start: int, end: int) -> Column:
    """Key in [start, end); text that is no number raises."""
    return in_range(key.cast("long"), start, end)


@dataclass(frozen=True)
class KeyFilter:
    """A source's key filter: NONE lets all pass, RANGE and MOD are true where any of their entries is
    (so without entries nothing passes). Entries are (start, end) or (buckets, start, end)."""

    kind: str = "NONE"
    entries: tuple = field(default=())

    def column(self, key: Column, key_kind: str = "long") -> Column:
        if self.kind == "NONE":
            return F.lit(True)
        if self.kind == "RANGE":
            parts = [key_range(key, a, b) for a, b in self.entries]
        else:
            parts = [key_mod(key, n, a, b, key_kind) for n, a, b in self.entries]
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    def merge(self, other: KeyFilter) -> KeyFilter:
        """Either filter; entries that are equal in every part count once. Kinds do not mix."""
        if "NONE" in (self.kind, other.kind):
            return KeyFilter()
        if self.kind != other.kind:
            raise ValueError("RANGE and MOD filters cannot be merged")
        return KeyFilter(self.kind, tuple(dict.fromkeys((*self.entries, *other.entries))))

    def sql(self, key: str = "srckey") -> str:
        """As text for a database: no absolute value and no exclusion of negative keys there."""
        if self.kind == "RANGE":
            return " OR ".join(f"({key} >= {a} AND {key} < {b})" for a, b in self.entries)
        if self.kind == "MOD":
            return " OR ".join(f"({key}%{n} >= {a} AND {key}%{n} < {b})" for n, a, b in self.entries)
        return ""


def parse_ids(text: str) -> list[tuple[int, int]]:
    """`[1,2,4-7]` to inclusive pairs."""
    text = text.strip()
    if not (text.startswith("[") and text.endswith("]")):
        raise ValueError(f"brackets are missing: {text}")
    out = []
    for part in filter(None, (p.strip() for p in text[1:-1].split(","))):
        lo, dash, hi = part.partition("-")
        pair = (int(lo), int(hi) if dash else int(lo))
        if pair[0] > pair[1]:
            raise ValueError(f"not a range: {part}")
        out.append(pair)
    return out


def range_filter(size: int, ids: str) -> KeyFilter:
    """Id i stands for [i * size, (i + 1) * size)."""
    if size <= 0:
        raise ValueError("size must be positive")
    return KeyFilter("RANGE", tuple((a * size, (b + 1) * size) for a, b in parse_ids(ids)))


def mod_filter(buckets: int, ids: str) -> KeyFilter:
    if buckets <= 0:
        raise ValueError("buckets must be positive")
    return KeyFilter("MOD", tuple((buckets, a, b + 1) for a, b in parse_ids(ids)))


def parse_filter(config: dict | str) -> KeyFilter:
    """{"partitionType": NONE | RANGE | MOD, "filters": [{"keyRange" | "bktRange": {"start", "end"}, "numBuckets"}]}; end -1 is without limit."""
    spec = json.loads(config) if isinstance(config, str) else config
    kind = spec.get("partitionType", "NONE").upper()
    entries = []
    for f in spec.get("filters", []):
        r = f["keyRange"] if kind == "RANGE" else f["bktRange"]
        end = LONG_MAX if r["end"] in (-1, LONG_MAX) else r["end"]
        if kind == "MOD" and f["numBuckets"] <= 0:
            raise ValueError("numBuckets must be positive")
        entries.append((r["start"], end) if kind == "RANGE" else (f["numBuckets"], r["start"], end))
    return KeyFilter(kind, tuple(entries))


def parse_source_filters(config: dict | str) -> dict[int, KeyFilter]:
    spec = json.loads(config) if isinstance(config, str) else config
    return {int(k): parse_filter(v) for k, v in spec.items()}


def by_source(filters: dict[int, KeyFilter], src: Column, key: Column, key_kind: str = "long") -> Column:
    """Each source's filter; sources without one pass."""
    out = F.lit(True)
    for src_id, f in filters.items():
        out = F.when(src == src_id, f.column(key, key_kind)).otherwise(out)
    return out


def or_control(predicate: Column, src: Column) -> Column:
    """Control rows pass every filter."""
    return (src < 0) | predicate


def logical(conditions: Iterable[tuple[int | None, int | None]], src: Column, lp: Column) -> Column:
    """Any of (source, partition); a wildcard partition is any. A wildcard source is ignored, so alone it denies all data. Control rows pass."""
    parts = [(src == s) & (F.lit(True) if p is WILDCARD else lp == p) for s, p in conditions if s is not WILDCARD]
    return or_control(reduce(lambda a, b: a | b, parts, F.lit(False)), src)


def physical(partition: int | None, nested: Column, pp: Column) -> Column:
    return nested if partition is WILDCARD else (pp == partition) & nested


def conjunction(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def subscriptions(subs: Iterable[tuple[int | None, int | None, int | None]], pp: Column, src: Column, lp: Column) -> Column:
    """Any of (physical partition, source, logical partition), wildcards as None; a subscription of wildcards only is everything."""
    out = F.lit(False)
    for p, s, q in subs:
        own = conjunction([pp == p] * (p is not None) + [src == s] * (s is not None) + [lp == q] * (q is not None))
        out = out | own
    return or_control(out, src)


def min_max_key(key: Column, low: int, high: int) -> Column:
    """Older requests' bounds: they apply only if both are positive."""
    return key_range(key, low, high) if low > 0 and high > 0 else F.lit(True)


def payload_field(column: Column, op: str, value: str, kind: str) -> Column:
    """==, < and > of a payload field in its type: integral fields compare as bigint (1.9 is 1), the others as they are; null never matches."""
    if op not in ("==", "<", ">"):
        raise ValueError(f"unsupported comparison: {op}")
    if kind in ("float", "double"):
        a, b = column.cast("double"), F.lit(float(value))
    elif kind in ("int", "bigint", "smallint", "tinyint"):
        a, b = column.cast("bigint"), F.lit(int(float(value)))
    else:
        a, b = column.cast("string"), F.lit(value)
    return a.isNotNull() & {"==": a == b, "<": a < b, ">": a > b}[op]


def metadata_range(key: Column, scn: Column, key_low: str | None = None, key_high: str | None = None, scn_low: int = 0, scn_high: int = 0) -> Column:
    """Bounds are inclusive; keys compare as text, sequence numbers count when positive."""
    parts = [key >= key_low] * (key_low is not None) + [key <= key_high] * (key_high is not None)
    return conjunction(parts + [scn >= scn_low] * (scn_low > 0) + [scn <= scn_high] * (scn_high > 0))


def replicated(value: Column, pattern: str, missing: str = "STOP") -> Column:
    """Whether the whole value matches; a missing value raises (STOP), is local (LOCAL) or replicated (REPLICATED)."""
    absent = {"LOCAL": F.lit(False), "REPLICATED": F.lit(True)}.get(missing, F.raise_error(F.lit("no replication value")).cast("boolean"))
    return F.when(value.isNull(), absent).otherwise(value.rlike(f"^(?:{pattern})$"))


def partition_filter(kind: str, size: int, partition: int) -> KeyFilter:
    """The filter of one client of a partitioned group: bucket `partition` of size buckets, or that range of width size."""
    return mod_filter(size, f"[{partition}]") if kind == "MOD" else range_filter(size, f"[{partition}]")


#: A factory of a client's filter: (group, partition) -> column.
FilterFactory = Callable[[str, int], Column]


def dispatch(events: DataFrame, registrations: dict[str, Iterable[int]]) -> DataFrame:
    """A copy of each event for each registration (name -> source ids) that wants it; control rows for all."""
    names = [F.when(or_control(sources(ids), F.col("src_id")), F.lit(name)) for name, ids in registrations.items()]
    return events.withColumn("registration", F.explode(F.array_compact(F.array(*names))))


def sampled(percent: float, key: Column, seed: int = 0) -> Column:
    """Whether an event is in the sample, by a hash of its key, so that it is in every read or in none."""
    return F.lit(False) if percent <= 0 else F.lit(True) if percent >= 100 else draw(key, F.lit(seed)) < int(percent / 100 * (1 << 32))


def valid_event(payload: Column, stored_crc: Column, size: Column, least: int = 61) -> Column:
    """OK, PARTIAL (shorter than a header) or ERR (checksum differs)."""
    return F.when(size < least, "PARTIAL").when(checksum(payload).eqNullSafe(stored_crc), "OK").otherwise("ERR")
