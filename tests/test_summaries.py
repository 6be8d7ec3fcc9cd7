"""Stability from stored counts against the index of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bookrisk.operators import drift as D
from bookrisk.operators import summaries as SU

SCHEMA = "Appointment_Time timestamp_ntz, x double, `y z` double"
SPLIT = dt.date(2024, 1, 31)
REFERENCE = f"day < DATE '{SPLIT}'"
CURRENT = f"CASE WHEN day >= DATE '{SPLIT}' THEN 'current' END"


def rows(kind, n=3000):
    r = random.Random(kind)
    out = []
    for _ in range(n):
        day = r.randrange(60)
        x = {"steps": r.randrange(11) / 10, "normal": r.gauss(day / 60, 1), "skewed": r.paretovariate(1) * r.choice([1, 1, -1]),
             "constant": 3.0}[kind]
        out.append((dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=r.randrange(24)), x, r.choice([None, float(r.randrange(5))])))
    return out


@pytest.mark.parametrize("kind", ["steps", "normal", "skewed", "constant"])
def test_index_of_the_rows_lies_between_the_bounds(spark, kind):
    df = spark.createDataFrame(rows(kind), SCHEMA)
    direct = {r["feature"]: r["psi"] for r in D.psi(D.period(df, str(SPLIT)), ["x", "y z"]).collect()}
    for grid in (0.002, 0.2) if kind in ("normal", "skewed") else (0.002,):
        s = SU.summarise(df, ["x", "y z"], grid=grid)
        got = {r["feature"]: r for r in SU.psi_between(s, F.expr(REFERENCE), F.expr(CURRENT)).collect()}
        assert got.keys() == direct.keys()
        for f, want in direct.items():
            g = got[f]
            assert g["psi_low"] - 1e-9 <= want <= g["psi_high"] + 1e-9
            assert g["psi_low"] - 1e-9 <= g["psi"] <= g["psi_high"] + 1e-9
            if grid == 0.002 and (kind in ("steps", "constant") or f == "y z"):  # a value per cell
                assert g["psi"] == pytest.approx(want, abs=1e-12) and g["psi_low"] == pytest.approx(g["psi_high"], abs=1e-12)
            if grid == 0.002 and kind == "normal":
                assert g["psi"] == pytest.approx(want, abs=0.01)


def test_tables_of_parts_merge(spark):
    data = rows("normal")
    whole = SU.summarise(spark.createDataFrame(data, SCHEMA), ["x"])
    parts = SU.summarise(spark.createDataFrame(data[:1000], SCHEMA), ["x"]).unionByName(SU.summarise(spark.createDataFrame(data[1000:], SCHEMA), ["x"]))
    assert sorted(SU.merge(parts, "day").collect()) == sorted(whole.select("day", "feature", "cell", "n", "lo", "hi").collect())


def test_weeks_equal_a_summary_of_each_week_alone(spark):
    df = spark.createDataFrame(rows("steps"), SCHEMA)
    week = F.when(F.col("day") >= F.lit(SPLIT), F.date_trunc("week", "day").cast("date"))
    got = {r["week"]: r["psi"] for r in SU.psi_between(SU.summarise(df, ["x"]), F.expr(REFERENCE), week, "week").collect()}
    assert len(got) > 3
    for w, value in got.items():
        part = df.where(F.col("Appointment_Time").cast("date") < F.lit(SPLIT)).unionByName(
            df.where((F.date_trunc("week", "Appointment_Time").cast("date") == F.lit(w)) & (F.col("Appointment_Time").cast("date") >= F.lit(SPLIT))))
        assert value == pytest.approx(D.psi(D.period(part, str(SPLIT)), ["x"]).first()["psi"])


def test_odd_values_and_empty_tables(spark):
    t0, t1 = dt.datetime(2024, 1, 2), dt.datetime(2024, 3, 2)
    odd = [(t0, float("nan"), 0.0), (t0, float("inf"), -0.0), (t0, None, 5e-324), (None, 1.0, -1.0), (t1, 1.0, 1e308), (t1, None, -1e308)]
    s = SU.summarise(spark.createDataFrame(odd, SCHEMA), ["x", "y z"])
    assert s.where("feature = 'x'").agg(F.sum("n")).first()[0] == 2
    got = {r["feature"]: (r["psi"], r["status"]) for r in SU.psi_between(s, F.expr(REFERENCE), F.expr(CURRENT)).collect()}
    assert got == {"x": (None, "not enough data"), "y z": (None, "not enough data")}
    none = SU.summarise(spark.createDataFrame([], SCHEMA), ["x"])
    assert SU.psi_between(none, F.expr(REFERENCE), F.expr(CURRENT)).count() == 0
