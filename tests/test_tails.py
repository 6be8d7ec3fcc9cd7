"""Tail probabilities and empty sides against values stated by hand, and the
prefix operators on the shapes that are hard for them."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

# P(X > x) of a chi-square, from closed forms: dof 1 erfc(sqrt(x/2)), dof 2 exp(-x/2),
# dof 6 exp(-x/2) (1 + x/2 + (x/2)^2 / 2)
CHI2 = [(x, 1, math.erfc(math.sqrt(x / 2))) for x in (0.1, 5.0, 50.0, 700.0, 900.0, 5000.0)] + [
    (x, 6, math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2)) for x in (0.5, 5.0, 7.9, 8.1, 50.0, 900.0, 5000.0)] + [
    (x, 2, math.exp(-x / 2)) for x in (1.0, 3.9, 4.1, 200.0)]


def test_chi2_tail(spark):
    from bookrisk.functions.stats import chi2_sf
    df = spark.createDataFrame([(x, d) for x, d, _ in CHI2], "x double, dof int")
    got = {(r["x"], r["dof"]): r["p"] for r in df.select("x", "dof", chi2_sf(F.col("x"), F.col("dof")).alias("p")).collect()}
    for x, d, p in CHI2:
        assert got[(x, d)] == pytest.approx(p, rel=1e-9, abs=1e-14), (x, d)


def test_chi2_tail_falls_with_many_degrees(spark):
    from bookrisk.functions.stats import chi2_sf
    df = spark.range(1, 400).select((F.col("id") * 10.0).alias("x"), F.lit(1000).alias("dof"))
    p = [r["p"] for r in df.select("x", chi2_sf(F.col("x"), F.col("dof")).alias("p")).orderBy("x").collect()]
    assert all(a >= b - 1e-12 for a, b in zip(p[:-1], p[1:], strict=True)) and p[0] > 1 - 1e-9 and p[-1] < 1e-9


def test_kolmogorov_tail(spark):
    from bookrisk.functions.stats import kolmogorov_sf
    want = {0.0: 1.0, 0.0003: 1.0, 0.01: 1.0, 0.1: 1.0, 0.5: 0.9639452436, 0.999999: 0.2699997, 1.0: 0.2699996717, 1.36: 0.0494858, 3.0: 3.046e-8}
    df = spark.createDataFrame([(x,) for x in want], "x double")
    for r in df.select("x", kolmogorov_sf(F.col("x")).alias("p")).collect():
        assert r["p"] == pytest.approx(want[r["x"]], rel=1e-3, abs=2e-6), r


@pytest.mark.parametrize("width", [1, 2, 3, 1000])
@pytest.mark.parametrize("values, want", [
    ([None, 5, None, 7], [5, 5, 5, 7]), ([None, None, None, None], [None] * 4), ([1, None, None, None], [1, 1, 1, 1]),
    ([None, None, None, 4], [4, 4, 4, 4])])
def test_fill_does_not_depend_on_ranges(spark, width, values, want):
    from bookrisk.operators.prefix import forward_back_fill
    df = spark.createDataFrame(list(enumerate(values)), "id long, v int")
    assert [r["v"] for r in forward_back_fill(df, "id", ["v"], width).orderBy("id").collect()] == want


@pytest.mark.parametrize("step", ["0", "id", "id * 40"])
def test_prefix_sums_of_one_key(spark, step):
    """All rows of one key at one time, in few buckets, and each in its own."""
    from bookrisk.operators.prefix import previous_values, prior_sums
    df = spark.range(50).selectExpr("id", "CASE WHEN id % 10 = 3 THEN NULL ELSE 1 END AS k",
                                    f"timestampadd(DAY, int({step}), TIMESTAMP_NTZ'2020-01-01 00:00:00') AS t", "id % 7 AS v")
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = df.withColumns({"s": F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "p": F.lag("v").over(w)})
    got = prior_sums(df, "k", "t", "id", {"s": F.col("v")})
    assert sorted(got.select("id", "s").collect()) == sorted(ref.select("id", "s").collect())
    lag = previous_values(df, "k", "t", "id", ["v"])
    assert {r["id"]: r["prev_v"] for r in lag.collect()} == {r["id"]: r["p"] for r in ref.collect()}


def test_prefix_sums_deal_rows_out_by_bucket(spark):
    from bookrisk.operators.prefix import prior_sums
    df = spark.range(10).selectExpr("id", "id div 100 AS k", "timestampadd(DAY, int(id), TIMESTAMP_NTZ'2020-01-01 00:00:00') AS t")
    plan = prior_sums(df, "k", "t", "id", {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_b" in plan.split("hashpartitioning(k")[1].split(")")[0]


def test_psi_and_class_weights_of_an_empty_side(spark):
    from bookrisk.operators import drift, metrics
    df = spark.createDataFrame([("reference", 1.0), ("reference", 2.0)], "period string, x double")
    row = drift.psi(df, ["x"]).first()
    assert row["psi"] is None and row["status"] == "not enough data"
    one = metrics.class_weights(spark.createDataFrame([(0,), (0,)], "No_Show int")).first()
    assert (one["w0"], one["w1"], one["pos_weight"]) == (0.5, None, None)
