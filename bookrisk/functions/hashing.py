"""Deterministic uniform draws from md5, identical in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def uniform(x: Column | str, salt: str) -> Column:
    """First 8 hex digits of md5('<salt>:<x>') as an integer, divided by 2**32."""
    x = F.col(x) if isinstance(x, str) else x
    hexed = F.substring(F.md5(F.concat(F.lit(salt + ":"), x.cast("string"))), 1, 8)
    return F.conv(hexed, 16, 10).cast("bigint") / F.lit(TWO_32)


def uniform_sql(x: str, salt: str) -> str:
    """DuckDB twin of :func:`uniform` (used by the oracle SQL)."""
    return (f"(CAST(('0x' || substr(md5('{salt}:' || CAST({x} AS VARCHAR)), 1, 8)) AS BIGINT)"
            f" / CAST({TWO_32} AS DOUBLE))")
