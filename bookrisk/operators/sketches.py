"""Quantiles from mergeable sketches (KLL, Spark's own functions).

A sketch holds at most a few times ``K`` values, whatever it has seen, so it
can be the state of a streaming window. Up to ``K`` values it is exact: the
quantile q of n values is the one of rank ceil(q n). Beyond, the rank is off
by at most ``RANK_ERROR`` of the values (with 99 % confidence). Sketches of
minutes merge into those of hours and days without a second look at the rows.
Null values are passed over; a window without values has null quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 2048
#: Bound of the normalised rank error of a KLL sketch of this K, at 99 % confidence.
RANK_ERROR = 2.296 / K ** 0.9021
POINTS = {"p50_latency_ms": 0.5, "p99_latency_ms": 0.99}


def latency_sketch(value: str) -> Column:
    return F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K))


def quantiles(sketch: str, points: dict[str, float] = POINTS) -> list[Column]:
    some = F.kll_sketch_get_n_double(sketch) > 0
    return [F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(sketch)), F.lit(q))).alias(name) for name, q in points.items()]


def rolled_up(windows: DataFrame, grain: str = "1 day", ts: str = "window_start", sketch: str = "latency") -> DataFrame:
    """(window_start, n, P50, P99, sketch) of longer windows from shorter ones."""
    g = windows.groupBy(F.window(F.col(ts).cast("timestamp"), grain).alias("w")).agg(
        F.sum("n").cast("bigint").alias("n"), F.kll_merge_agg_double(sketch, F.lit(K)).alias(sketch))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", *quantiles(sketch), sketch)
