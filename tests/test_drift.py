"""Drift and metric operators on small hand-made tables against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from bookrisk.operators import drift as D
from bookrisk.operators import metrics as M
from bookrisk.sources import schema as S


def test_ks_equals_the_largest_gap_of_the_empirical_shares(spark):
    r = random.Random(4)
    a, b = [r.gauss(0, 1) for _ in range(300)], [round(r.gauss(0.4, 1), 1) for _ in range(200)]
    df = spark.createDataFrame([("reference", x) for x in a] + [("current", x) for x in b] + [("current", None)], "period string, x double")
    want = max(abs(sum(v <= t for v in a) / len(a) - sum(v <= t for v in b) / len(b)) for t in a + b)
    assert D.ks_two_sample(df, "x").first()["d"] == pytest.approx(want)
    assert D.ks_two_sample(df.where("period = 'reference'"), "x").first()["d"] is None


def test_deposit_churn_counts_requests_at_the_last_appointment(spark):
    deposit = S.DEPOSIT_ACTIONS[0]
    rows = [("a", 1, deposit), ("a", 2, "OTHER"), ("b", 1, deposit), ("b", 3, deposit), ("b", 3, deposit), ("c", 5, "OTHER"), (None, 9, deposit), ("d", None, deposit)]
    df = spark.createDataFrame(rows, "Customer_ID string, Appointment_Time int, action_type string")
    got = D.kpi_deposit_churn(df).first()
    assert (got["requested"], got["churned"], got["churn_rate"]) == (5, 2, 0.4)
    none = D.kpi_deposit_churn(df.limit(0)).first()
    assert (none["requested"], none["churned"], none["churn_rate"]) == (0, 0, None)


def test_psi_bins(spark):
    ref, cur = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10], [0, 0, 0, 10, 11, None]
    df = spark.createDataFrame([("reference", x, 1) for x in ref] + [("current", x, 1) for x in cur], "period string, x int, k int")
    import math
    share = lambda v: [max(1e-6, sum(min(9, x) == b for x in v) / len(v)) for b in range(10)]
    e, a = share(ref), share([0, 0, 0, 10])
    got = {x["feature"]: x["psi"] for x in D.psi(df, ["x", "k"]).collect()}
    assert got["x"] == pytest.approx(sum((q - p) * math.log(q / p) for p, q in zip(e, a)))
    assert got["k"] == pytest.approx(0)
    assert D.psi(df.where("period = 'reference'"), ["x"]).first()["status"] == "not enough data"


def test_one_pass_metrics_equal_the_two_operators(spark):
    r = random.Random(9)
    rows = [(m, r.choice([0.49996, 0.5, 0.50004, r.random()]), int(r.random() < 0.3)) for m in "ab" for _ in range(300)]
    df = spark.createDataFrame(rows + [("one class", 0.7, 1)], "model string, score double, label int")
    got = M.confusion_with_auc(df, 0.5).collect()
    want = {x["model"]: x.asDict() for x in M.confusion(df, 0.5).join(M.roc_auc(df), "model").collect()}
    assert {x["model"]: x.asDict() for x in got} == want and want["one class"]["auc"] is None
    assert M.confusion_with_auc(df.where(F.lit(False))).count() == 0
