"""Distinct counts from mergeable sketches (HyperLogLog, Spark's own functions).

A sketch of 2^``LG`` registers per month and column is stored; months merge
into any period by union, without a second look at the rows. The relative
standard error is ``ERROR``; small counts are exact or nearly so. Null values
are not counted. The exact counts beside it are ``count(DISTINCT)`` aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 14
ERROR = 0.65 / 2 ** (LG / 2)


def monthly(df: DataFrame, cols: list[str], ts: str) -> DataFrame:
    """(month, column, sketch): one pass over the rows, partial sketches before
    the shuffle. Rows without a time have the month null."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]))
    long = df.select(F.date_format(ts, "yyyy-MM").alias("month"), each.alias("x")).select("month", "x.*")
    return long.groupBy("month", "column").agg(F.hll_sketch_agg("value", F.lit(LG)).alias("sketch"))


def merged(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Sketches united over the months of each group of ``by`` and column."""
    return sketches.groupBy(*by, "column").agg(F.hll_union_agg("sketch").alias("sketch"))


def counts(sketches: DataFrame) -> DataFrame:
    """The estimate in place of each sketch."""
    return sketches.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")
