"""Conversions from database and trail values to the change log's types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a negative value of an unsigned column lacks. 64 bits do not fit a bigint and stay as they are.
UNSIGNED = {"TINYINT": 1 << 8, "SMALLINT": 1 << 16, "MEDIUMINT": 1 << 24, "INT": 1 << 32, "INTEGER": 1 << 32}
NANOS_PER_MILLI, NANOS_PER_MICRO = 1_000_000, 1_000


def binlog_scn(file_no: Column, offset: Column) -> Column:
    """(file << 32) | offset with an unsigned 32-bit offset."""
    return F.shiftleft(file_no.cast("long"), 32).bitwiseOR(offset.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unsigned(value: Column, db_type: str) -> Column:
    words = db_type.upper().split()
    add = next((UNSIGNED[k] for k in words if k in UNSIGNED), 0) if "UNSIGNED" in words else 0
    v = value.cast("long")
    return F.when(v < 0, v + F.lit(add).cast("long")).otherwise(v)


def _or_raise(text: Column, good: Column, value: Column, kind: str, what: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"not {what}: "), text)).cast(kind)
    return F.when(text.isNull(), F.lit(None).cast(kind)).when(good, value).otherwise(bad)


def trail_timestamp_ms(text: Column) -> Column:
    """yyyy-MM-dd:HH:mm:ss[.f{0,9}] in UTC to milliseconds. The fraction's first three digits count as they
    stand, so ".5" is 5 ms; other text raises."""
    pattern = r"^(\d{4}-\d{2}-\d{2}):(\d{2}:\d{2}:\d{2})(?:\.(\d{0,9}))?$"
    stamp = F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    frac = F.substring(F.regexp_extract(text, pattern, 3), 1, 3)
    ms = F.unix_seconds(F.to_timestamp(stamp, "yyyy-MM-dd HH:mm:ss")) * 1000 + F.when(frac == "", 0).otherwise(frac.cast("int"))
    return _or_raise(text, text.rlike(pattern), ms, "long", "a trail timestamp")


def trail_timestamp_ns(text: Column) -> Column:
    return trail_timestamp_ms(text) * NANOS_PER_MILLI


def trail_date_ms(text: Column) -> Column:
    """yyyy-MM-dd[...] to milliseconds at midnight UTC."""
    return F.unix_millis(F.to_timestamp(F.substring(text, 1, 10), "yyyy-MM-dd"))


def trail_hex(text: Column) -> Column:
    """0x.. to bytes; all digits count (see README, divergences)."""
    return _or_raise(text, text.rlike("^0[xX]([0-9A-Fa-f]{2})*$"), F.unhex(F.substring(text, 3, 1 << 30)), "binary", "a hex literal")


def scalar(value: Column, kind: str) -> Column:
    """Numbers truncate, timestamps become epoch milliseconds, everything else text; null stays null."""
    if kind in ("int", "long", "bigint"):
        return value.cast("double").cast("int" if kind == "int" else "bigint")
    if kind in ("float", "double"):
        return value.cast(kind)
    if kind in ("date", "timestamp"):
        return F.unix_millis(value.cast("timestamp"))
    return value.cast("binary") if kind == "bytes" else value.cast("string")


def composite_key(*columns: Column) -> Column:
    """Key of several columns: joined by a tab; a null column raises, as a key must be whole."""
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in columns])
    whole = F.concat_ws("\t", *[c.cast("string") for c in columns])
    return F.when(missing, F.raise_error(F.lit("null in a key")).cast("string")).otherwise(whole)


def event_json(src_id: Column, opcode: Column, partition: Column, value: Column) -> Column:
    return F.to_json(F.struct(src_id.alias("srcId"), opcode.alias("opCode"), partition.alias("partId"), value.alias("value")))


def json_record(text: Column, path: str, kind: str) -> Column:
    """A field of a JSON payload in its type; absent: null."""
    return F.get_json_object(text, path).cast(kind)


def logical_partition(spec: str) -> Column:
    """`constant:<n>`; nothing else is a partition function."""
    name, _, n = spec.partition(":")
    if name != "constant":
        raise ValueError(f"not a partition function: {spec}")
    return F.lit(int(n)).cast("smallint")


def same_field(a: Column, b: Column) -> Column:
    """Typed equality of the audit: nulls are equal to each other."""
    return a.eqNullSafe(b)


def camel_case(name: Column) -> Column:
    """FIRST_NAME -> firstName, for a column of names; null stays null, doubled underscores count once."""
    words = F.filter(F.split(F.lower(name), "_"), lambda w: w != "")
    said = F.array_join(F.transform(words, lambda w, i: F.when(i > 0, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)), "")
    return F.when(name.isNotNull(), said)
