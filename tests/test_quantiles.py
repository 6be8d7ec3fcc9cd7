"""Exact quantiles against numpy: ties, one value per row, null groups, few and many ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookrisk.operators.drift import ops_latency
from bookrisk.operators.quantiles import quantiles

PROBS = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "hi": 1.0}


@pytest.mark.parametrize("ranges", [1, 7])
def test_quantiles_match_numpy(spark, ranges):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.normal(size=900)] + [("ties", float(v)) for v in rng.integers(0, 3, 101)]
    rows += [(None, 4.0), (None, 9.0), ("one", -2.5), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", PROBS, ranges).collect()}
    assert set(got) == {"hot", "ties", None, "one"}
    for g, r in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quantiles_of_two_group_columns_and_of_nothing(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("a"), F.lit(None).cast("string").alias("b"), "id")
    got = {r["a"]: r["mid"] for r in quantiles(df, ["a", "b"], "id", {"mid": 0.5}).collect()}
    assert got == {0: 49.0, 1: 50.0}
    assert quantiles(df.limit(0), ["a"], "id", {"mid": 0.5}).count() == 0
    empty = ops_latency(spark.createDataFrame([], "latency_ms double")).first()
    assert (empty["n"], empty["p50_ms"]) == (0, None)
