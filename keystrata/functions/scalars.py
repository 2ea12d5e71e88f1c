"""Scalar expressions and small parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import StoreError


def log2_bucket(x: Column) -> Column:
    """The smallest b with 2^b >= x; 0 for x of 0 or 1. Exact, as it counts binary digits."""
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1)))


def key_prefix(key: Column, delimiter: str) -> Column:
    """The part before the first delimiter; null without one."""
    return F.when(F.instr(key, delimiter) > 0, F.substring_index(key, delimiter, 1))


def blocks_512(size: Column) -> Column:
    """Storage blocks of an object: a ladder up to 8 KiB, then whole blocks of 512 bytes."""
    return F.when(size <= 512, 1).when(size <= 1024, 2).when(size <= 2048, 3).when(size <= 4096, 4).when(size <= 8192, 5).otherwise(F.ceil(size / 512)).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """Hash placement of a key."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def epoch_seconds(ts: str) -> Column:
    """Whole seconds of a timestamp without zone since 1970."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def format_count(x: Column) -> Column:
    """Two decimals with ki, mi or bi from above 1e3, 1e6, 1e9."""
    return _scaled(x, ((1e9, "bi"), (1e6, "mi"), (1e3, "ki")))


def format_bytes(x: Column) -> Column:
    """Two decimals with k, m or b from above 2^10, 2^20, 2^30."""
    return _scaled(x, ((2.0**30, "b"), (2.0**20, "m"), (2.0**10, "k")))


def _scaled(x: Column, steps: tuple[tuple[float, str], ...]) -> Column:
    # format_number rounds halves to even, as printf does, but groups thousands
    two = lambda v: F.replace(F.format_number(v, 2), F.lit(","), F.lit(""))
    out = two(x.cast("double"))
    for unit, suffix in reversed(steps):
        out = F.when(x > unit, F.concat(two(x.cast("double") / unit), F.lit(suffix))).otherwise(out)
    return out


def parse_size(text: str) -> int:
    """A decimal, 0x or leading-0 octal number with an optional suffix k, m, g, t or p."""
    m = re.fullmatch(r"\s*([+-]?)(0[xX][0-9a-fA-F]+|[0-9]+)([kKmMgGtTpP]?)", text)
    if not m:
        raise StoreError("INVALID_PARAMETER", f"not a size: {text!r}")
    digits = m[2]
    value = int(digits, 16) if digits[:2].lower() == "0x" else int(digits, 8) if digits.startswith("0") and len(digits) > 1 else int(digits)
    value = (-value if m[1] == "-" else value) << 10 * " kmgtp".index(m[3].lower() or " ")
    if abs(value) >= 1 << 63:
        raise StoreError("INVALID_PARAMETER", f"size out of range: {text!r}")
    return value


# Nanoseconds of a unit.
_UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}


def parse_time(text: str) -> int:
    """Nanoseconds of a number with a unit, seconds without one; -1 for `end`."""
    if text == "end":
        return -1
    m = re.fullmatch(r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(ns|us|ms|s|m|h|d)?", text)
    if not m:
        raise StoreError("INVALID_PARAMETER", f"not a time: {text!r}")
    return int(float(m[1]) * _UNITS[m[2] or "s"])
