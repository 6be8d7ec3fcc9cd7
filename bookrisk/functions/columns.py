"""Column expressions shared by the batch and streaming operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookrisk.sources import schema as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: Column | str, den: Column | str, places: int = 4) -> Column:
    """num/den rounded half-even, 0.0 when den == 0 (guarded before dividing: ANSI)."""
    num, den = col(num), col(den)
    return F.when(den == 0, F.lit(0.0)).otherwise(F.bround(num / den, places))


def raw_ratio(num: Column | str, den: Column | str) -> Column:
    """Unrounded num/den, 0.0 when den == 0."""
    num, den = col(num), col(den)
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def elapsed_days_floor(start: Column | str, end: Column | str) -> Column:
    """Whole days elapsed, floored (negative goes down), like a timedelta's days."""
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return F.floor(micros / F.lit(86400000000)).cast("int")


def edge_hour(hour: Column, early: int = S.EDGE_EARLY_HOUR, late: int = S.EDGE_LATE_HOUR) -> Column:
    return F.coalesce((hour <= early) | (hour >= late), F.lit(False)).cast("int")


def risk_level(p: Column | str) -> Column:
    p = col(p)
    return (F.when(p >= S.RISK_HIGH, "High").when(p >= S.RISK_MEDIUM, "Medium").otherwise("Low"))


def pct0(x: Column) -> Column:
    """Python's '{:.0%}' (half-even on the scaled value)."""
    return F.concat(F.bround(x * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def pct2(x: Column) -> Column:
    """Python's '{:.2%}' for values already rounded to 4 places."""
    return F.concat(F.format_string("%.2f", x * 100), F.lit("%"))


def lookup(mapping: dict, key: Column | str, default=None) -> Column:
    """Literal map lookup (fixed-size lookup table, no join, stays in codegen)."""
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    out = F.element_at(m, col(key)) if default is None else F.coalesce(F.try_element_at(m, col(key)), F.lit(default))
    return out


def ts_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")
