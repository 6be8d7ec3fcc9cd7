"""Skew-safe prefix operators (running sums and lags per key, global fill).

A plain ``Window.partitionBy(key)`` puts every row of a key into one task.
Here a key is cut into buckets of a fixed time grain: rows are dealt out by
(key, bucket), windowed inside their bucket, and what the earlier buckets of
the key hold comes back by a join with one row per (key, bucket). There is
one plan for every size and no job runs while the plan is built. Running sums
cut only keys of more than ``WHOLE_ROWS`` rows, found by one grouped count
and sent to the tasks (a row for every ``WHOLE_ROWS`` rows at most): with few
rows per key, buckets are as many as rows and cost a second shuffle of all.

What bounds a task is the rows of one key in one grain; choose a shorter
``grain_days`` where a key has more in 28 days than a task can sort. Rows of
one key at one instant stay together, since their order is the tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days in a bucket of a key.
GRAIN_DAYS = 28
#: Rows of a key up to which :func:`prior_sums` keeps it in one task.
WHOLE_ROWS = 200_000
#: Values of the order column in a range of ``forward_back_fill``.
RANGE_WIDTH = 1 << 20
_DAY_MICROS = 86_400_000_000
#: Bucket of the rows without a time, before all others.
_NO_TIME = -(1 << 62)
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ (zone independent)."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts)


def _in_buckets(df: DataFrame, key: str, order_ts: str, grain_days: int) -> DataFrame:
    """Add ``_t`` (microseconds) and ``_b`` (bucket); dealt out by (key, bucket)."""
    d = df.withColumn("_t", ntz_micros(F.col(order_ts)))
    return d.withColumn("_b", F.floor(F.col("_t") / F.lit(grain_days * _DAY_MICROS))).repartition(key, "_b")


def prior_sums(df: DataFrame, key: str, order_ts: str, tiebreak: str, values: dict[str, Column],
               grain_days: int = GRAIN_DAYS, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Add ``name = sum(expr)`` over the *earlier* rows of the same ``key``,
    ordered by (``order_ts``, ``tiebreak``); 0 for the first row of a key. Only
    keys of more than ``whole_rows`` rows are cut into buckets."""
    n = range(len(values))
    large = df.groupBy(F.col(key).alias("_k")).count().where(F.col("count") > whole_rows).select("_k", F.lit(True).alias("_large"))
    same = F.col(key).eqNullSafe(F.col("_k"))  # at most a row of ``large`` per whole_rows rows
    d = df.withColumns({"_t": ntz_micros(F.col(order_ts)), **{f"_v{i}": v for i, v in enumerate(values.values())}})
    bucket = F.coalesce(F.floor(F.col("_t") / F.lit(grain_days * _DAY_MICROS)), F.lit(_NO_TIME))
    at = ["key_", "_b"]  # a struct, whose nulls are equal: the join takes the rows as they were dealt out
    dealt = d.join(F.broadcast(large), same, "left").withColumns({
        "key_": F.struct(F.col(key).alias("k")), "_b": F.when(F.col("_large"), bucket).otherwise(F.lit(0))}).repartition(*at)
    w = Window.partitionBy(*at).orderBy("_t", tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_l{i}": F.coalesce(F.sum(f"_v{i}").over(w), F.lit(0)) for i in n})
    totals = d.join(F.broadcast(large), same, "left_semi").groupBy(F.col(key).alias("_k"), bucket.alias("_kb")).agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in n])
    wk = Window.partitionBy("_k").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.struct(F.col("_k").alias("k")).alias("_in"), "_kb",
                           *[F.coalesce(F.sum(f"_s{i}").over(wk), F.lit(0)).alias(f"_o{i}") for i in n])
    out = local.join(before, (F.col("key_") == F.col("_in")) & (F.col("_b") == F.col("_kb")), "left")
    out = out.withColumns({name: F.col(f"_l{i}") + F.coalesce(f"_o{i}", F.lit(0)) for i, name in enumerate(values)})
    return out.drop("_t", "_k", "_large", "key_", "_b", "_in", "_kb", *[f"_{p}{i}" for i in n for p in "vlo"])


def forward_back_fill(df: DataFrame, order_col: str, cols: list[str], width: int = RANGE_WIDTH) -> DataFrame:
    """pandas ``ffill().bfill()`` in ``order_col`` order (an integer column),
    without a global single-task window: rows are cut into ranges of ``width``
    values and filled inside; a range starts from the last value of the ranges
    before it. Rows before the first value of all take that one. The running
    values go over one row per range that is in use."""
    d = df.withColumn("_b", F.floor(F.col(order_col) / F.lit(width))).repartition("_b")
    inside = Window.partitionBy("_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    filled = d.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(inside) for c in cols})

    def at(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(order_col))
    per = d.groupBy("_b").agg(*[F.max_by(F.col(c), at(c)).alias(f"_z_{c}") for c in cols],
                              *[F.min_by(F.col(c), at(c)).alias(f"_a_{c}") for c in cols])
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seeds = per.select(F.col("_b").alias("_r"), *[F.last(f"_z_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in cols],
                       *[F.first(f"_a_{c}", ignorenulls=True).over(every).alias(f"_x_{c}") for c in cols])
    out = filled.join(seeds, F.col("_b").eqNullSafe(F.col("_r")), "left")
    out = out.withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.col(f"_c_{c}"), F.col(f"_x_{c}")) for c in cols})
    return out.drop("_b", "_r", *[f"_{p}_{c}" for c in cols for p in "fcx"])


def previous_values(df: DataFrame, key: str, order_ts: str, tiebreak: str, cols: list[str],
                    prefix: str = "prev_", grain_days: int = GRAIN_DAYS) -> DataFrame:
    """``lag(c, 1)`` per ``key`` in (``order_ts``, ``tiebreak``) order for each
    column: lagged inside each bucket; the first row of a bucket takes the
    last row of the key's previous bucket in use."""
    d = _in_buckets(df, key, order_ts, grain_days)
    w = Window.partitionBy(key, "_b").orderBy("_t", tiebreak)
    lagged = d.withColumns({"_first": F.row_number().over(w) == 1, **{f"_lag_{c}": F.lag(c, 1).over(w) for c in cols}})
    last = d.groupBy(key, "_b").agg(F.max_by(F.struct(*cols), F.struct("_t", tiebreak)).alias("_last"))
    carry = last.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"),
                        F.lag("_last", 1).over(Window.partitionBy(key).orderBy("_b")).alias("_carry"))
    out = lagged.join(carry, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb")), "left")
    out = out.withColumns({f"{prefix}{c}": F.when(F.col("_first"), F.col("_carry")[c]).otherwise(F.col(f"_lag_{c}")) for c in cols})
    return out.drop("_t", "_b", "_k", "_kb", "_first", "_carry", *[f"_lag_{c}" for c in cols])
