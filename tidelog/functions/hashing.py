"""Hashes as columns: string hash codes, 64-bit FNV-1a, Jenkins, checksums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a (32-bit constants, kept in a 64-bit accumulator) and of Jenkins' hash.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
JENKINS_START = 0x9E3779B9
M32, M63 = 0xFFFFFFFF, 0x7FFFFFFFFFFFFFFF


def _codes(text: Column) -> Column:
    """Code points of a string, as an array of bigints; empty for an empty string."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def string_hash(text: Column) -> Column:
    """h * 31 + c over UTF-16 units, wrapping at 32 bits, as a signed int in a bigint."""

    def step(h: Column, c: Column) -> Column:
        high, low = F.shiftright(c, 10) + (0xD800 - (0x10000 >> 10)), c.bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return F.when(c < 0x10000, h * 31 + c).otherwise((h * 31 + high) * 31 + low).bitwiseAND(F.lit(M32))

    h = F.aggregate(_codes(text), F.lit(0).cast("long"), step)
    return F.shiftright(F.shiftleft(h, 32), 32)  # the sign without naming h twice, as each name is a computation


def _times_wrapping(h: Column, prime: int) -> Column:
    """h * prime modulo 2^64 on signed longs without overflow: the halves are multiplied apart."""
    low = h.bitwiseAND(F.lit(M32)) * prime  # below 2^57
    high = F.shiftrightunsigned(h, 32) * prime
    return F.shiftleft((high + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(M32)), 32).bitwiseOR(low.bitwiseAND(F.lit(M32)))


def fnv1a(binary: Column) -> Column:
    """FNV-1a of a binary column with a 64-bit accumulator, signed."""
    return F.aggregate(_codes(F.decode(binary, "ISO-8859-1")), F.lit(FNV_BASIS).cast("long"), lambda a, b: _times_wrapping(a.bitwiseXOR(b), FNV_PRIME))


def fnv1a_bucket(binary: Column, buckets: int) -> Column:
    return fnv1a(binary).bitwiseAND(F.lit(M63)) % buckets


#: Place changed and shift (left positive) of the value before it, in each step of Jenkins' mix.
JENKINS_STEPS = ((0, -13), (1, 8), (2, -13), (0, -12), (1, 16), (2, -5), (0, -3), (1, 10), (2, -15))


def jenkins_of(data: bytes) -> int:
    """Jenkins' hash of bytes, 32 bits: three words at a time, then what is left with the length beside it."""

    def mix(v: list[int]) -> list[int]:
        for x, by in JENKINS_STEPS:
            other = v[(x + 2) % 3]
            v[x] = ((v[x] - v[(x + 1) % 3] - other) ^ (other << by if by > 0 else other >> -by)) & M32
        return v

    v = [JENKINS_START, JENKINS_START, 0]
    full = len(data) // 12 * 12
    for at in range(0, full, 12):
        v = mix([(s + int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little")) & M32 for i, s in enumerate(v)])
    tail = data[full:]
    last = (int.from_bytes(tail[8:], "little") << 8) + len(data)
    v = [v[0] + int.from_bytes(tail[:4], "little"), v[1] + int.from_bytes(tail[4:8], "little"), v[2] + last]
    return mix([x & M32 for x in v])[2]


def _mixed(v: list[np.ndarray]) -> list[np.ndarray]:
    """A round of the hash on three columns of unsigned 32-bit values, held in 64 bits."""
    for x, by in JENKINS_STEPS:
        other = v[(x + 2) % 3]
        v[x] = ((v[x] - v[(x + 1) % 3] - other) & M32) ^ ((other << by) & M32 if by > 0 else other >> -by)
    return v


def jenkins_rows(rows: list[bytes]) -> np.ndarray:
    """jenkins_of of each row; rows of equal length are hashed together."""
    out = np.zeros(len(rows), np.int64)
    lengths = np.array([len(r) for r in rows], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        units = int(n) // 12 + 1  # the last unit holds what is left, perhaps nothing
        data = np.zeros((len(at), 12 * units), np.uint8)
        data[:, :n] = np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), n)
        words = data.view("<u4").astype(np.int64)
        v = [np.full(len(at), s, np.int64) for s in (JENKINS_START, JENKINS_START, 0)]
        for u in range(units - 1):
            v = _mixed([(s + words[:, 3 * u + i]) & M32 for i, s in enumerate(v)])
        last = [words[:, 3 * (units - 1) + i] for i in range(3)]
        last[2] = (last[2] << 8) + n
        out[at] = _mixed([(s + w) & M32 for s, w in zip(v, last, strict=True)])[2]
    return out


def jenkins(binary: Column) -> Column:
    """Jenkins' hash of a binary column, in Arrow batches, by array operations over rows of equal length."""

    @F.pandas_udf("bigint")
    def hashed(data: pd.Series) -> pd.Series:
        given = data.notna()
        out = pd.Series(pd.NA, index=data.index, dtype="Int64")
        out[given] = jenkins_rows([bytes(x) for x in data[given]])
        return out

    return hashed(binary)


def draw(*parts: Column) -> Column:
    """An even 32-bit number that depends on the parts alone, so that other engines and later runs draw the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def checksum(binary: Column) -> Column:
    """CRC-32, unsigned."""
    return F.crc32(binary)


def schema_digest(canonical: Column) -> Column:
    """Id of a schema: MD5 of its canonical text, as base64 of the 16 bytes."""
    return F.base64(F.unhex(F.md5(canonical)))
