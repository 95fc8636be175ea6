"""Stable hash buckets, identical in Spark SQL and DuckDB.

A bucket is the first 32 bits of ``md5(key)`` read as an unsigned integer. It is
a pure per-row expression: no shuffle, no driver state, same value on every run
and every partitioning, which is what makes splits and samples reproducible.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def md5_u32(key: Column) -> Column:
    """First 8 hex digits of md5(key) as a bigint in [0, 2^32)."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def plain_md5_u32(key: str) -> int:
    """``md5_u32`` of one string."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


def md5_unit(key: Column) -> Column:
    """md5 bucket scaled to [0, 1)."""
    return md5_u32(key) / F.lit(TWO_POW_32)


def seeded_bucket(id_col: Column, seed: int = 42, buckets: int = 100) -> Column:
    """``conv(substr(md5(id || ':' || seed), 1, 8), 16, 10) % buckets``."""
    return md5_u32(F.concat(id_col.cast("string"), F.lit(f":{seed}"))) % F.lit(buckets)


# DuckDB spellings of the same expressions (used by the oracle SQL).
def duck_md5_u32(expr: str) -> str:
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def duck_md5_unit(expr: str) -> str:
    return f"({duck_md5_u32(expr)} / {TWO_POW_32})"


def duck_seeded_bucket(expr: str, seed: int = 42, buckets: int = 100) -> str:
    return f"({duck_md5_u32(f'CAST({expr} AS VARCHAR) || {chr(39)}:{seed}{chr(39)}')} % {buckets})"
