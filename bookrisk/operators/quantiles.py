"""Exact quantiles of any column, without a buffer or a sort per group.

The distinct values of all groups are counted, cut into ranges of (group,
value) and ranked on two levels: inside a range, and over the totals of the
ranges. A task holds one range of distinct values; a group with most of the
rows, or with a value per row, spreads over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookrisk.session import ensure_checkpoint_dir


def in_ranges(counts: DataFrame, *by: str | Column, ranges: int | None = None) -> DataFrame:
    """``counts`` dealt out by ranges of ``by``, their number in ``_r``.
    ``ranges`` (by default the session's shuffle partitions) sets the size of
    a task, not the result. The ranges come from a sample, so they are fixed
    by a reliable checkpoint before both levels read them."""
    spark = counts.sparkSession
    ensure_checkpoint_dir(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return counts.repartitionByRange(ranges, *by).withColumn("_r", F.spark_partition_id()).checkpoint()


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], ranges: int | None = None) -> DataFrame:
    """One row per group of ``by`` (null groups included) with a double column
    per entry of ``probs``: the quantile of the non-null values, linear between
    the two neighbouring ranks. Groups without a value give no row."""
    counts = (df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
              .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))
    counts = in_ranges(counts, *by, "_v", ranges=ranges)
    totals = counts.groupBy(*by, "_r").agg(F.sum("_n").alias("_rn"))
    group = Window.partitionBy(*by)
    offsets = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_r").alias("_gr"),
                            (F.sum("_rn").over(group.orderBy("_r")) - F.col("_rn")).alias("_before"),
                            F.sum("_rn").over(group).alias("_total"))
    inside = Window.partitionBy(*by, "_r").orderBy("_v")
    same = F.col("_r") == F.col("_gr")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    ranked = counts.withColumn("_upto", F.sum("_n").over(inside)).join(offsets, same)
    last = F.col("_before") + F.col("_upto")  # ranks [last - _n, last) hold this value

    def at(rank):
        return F.max(F.when((rank >= last - F.col("_n")) & (rank < last), F.col("_v")))
    aggs = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        aggs += [at(F.floor(place)).alias(f"_a_{name}"), at(F.ceil(place)).alias(f"_b_{name}"),
                 F.max(place - F.floor(place)).alias(f"_w_{name}")]
    out = ranked.groupBy(*by).agg(*aggs)
    return out.select(*by, *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_w_{n}")).alias(n) for n in probs])


def with_quantiles(groups: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """``groups`` (one row per group) with the quantile columns; null groups match."""
    named = q.select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(by)], *[c for c in q.columns if c not in by])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_q{i}"))
    return groups.join(named, same, "left").drop(*[f"_q{i}" for i in range(len(by))])
