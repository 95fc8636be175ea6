"""Small helpers shared by the query plans and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(expr: str) -> str:
    """DuckDB: round a numeric expression to 6 places as DOUBLE."""
    return f"round(CAST({expr} AS DOUBLE), 6)"


def i64(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def arr_str(c: Column | str, sep: str = ",") -> Column:
    """Spark: array<string> -> delimited string (null stays null)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(col, sep)


def duck_arr_str(expr: str, sep: str = ",") -> str:
    return f"array_to_string({expr}, '{sep}')"
