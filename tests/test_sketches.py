"""P50 and P99 from sketches: exact when small, within the bound when merged."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from bookrisk.operators import sketches as SK
from bookrisk.streaming import stream as SS


def log(spark, values):
    start = dt.datetime(2024, 3, 1)
    rows = [(start + dt.timedelta(seconds=s), v, 0, 0) for s, v in values]
    return spark.createDataFrame(rows, "ts timestamp, latency_ms double, failed int, null_feature int")


def test_small_windows_are_exact(spark):
    r = random.Random(1)
    values = [(r.randrange(600), r.choice([r.expovariate(0.1), 5.0, None])) for _ in range(3000)] + [(700, None)]
    got = SS.tumbling_ops(log(spark, values), watermark=None).collect()
    by = {}
    for s, v in values:
        by.setdefault(s // 60, []).append(v)
    assert len(got) == len(by)
    for w in got:
        own = sorted(v for v in by[w["window_start"].minute] if v is not None)
        for name, q in SK.POINTS.items():
            assert w[name] == (own[max(1, math.ceil(q * len(own))) - 1] if own else None)


def test_days_merged_from_minutes_keep_the_bound(spark):
    n = 120_000
    rows = spark.range(n).select((F.timestamp_seconds(F.lit(1_709_251_200) + F.col("id") % 86_400)).alias("ts"),
                                 (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("latency_ms"), F.lit(0).alias("failed"), F.lit(0).alias("null_feature"))
    day = SK.rolled_up(SS.tumbling_ops(rows, watermark=None)).collect()
    assert sum(d["n"] for d in day) == n
    values = sorted(r[0] for r in rows.select("latency_ms").collect())
    (d,) = day
    for name, q in SK.POINTS.items():
        rank = sum(v <= d[name] for v in values) / n
        assert abs(rank - q) <= 2 * SK.RANK_ERROR
    assert SK.rolled_up(SS.tumbling_ops(rows.limit(0), watermark=None)).count() == 0
