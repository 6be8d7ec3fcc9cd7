"""Feature edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from bookrisk.functions.columns import pct0, safe_ratio
from bookrisk.operators import features as FE
from bookrisk.sources import schema as S


def _bk(spark, rows):
    return spark.createDataFrame(rows, S.BOOKING)


def _r(i, book, appt, visits=1, canc=0, ns=0):
    return (i, 1, "Facial", "Chennai", book, appt, None, visits, canc, ns, "Card", "Monday", 0.1, "Show")


def test_lead_floor_and_edge_hours(spark):
    d = dt.datetime
    rows = [_r(1, d(2024, 1, 2, 10), d(2024, 1, 1, 9)),       # appointment before booking: -25 h -> -2
            _r(2, d(2024, 1, 1, 10), d(2024, 1, 3, 9, 59)),   # 47h59m -> 1; 09:59 is edge
            _r(3, d(2024, 1, 1, 10), d(2024, 1, 1, 18)),      # 18:00 edge
            _r(4, d(2024, 1, 1, 10), d(2024, 1, 1, 17, 59)),  # 17:59 not edge
            _r(5, d(2024, 1, 1, 10), None)]                   # null time -> lead null, edge 0
    out = {r["Booking_ID"]: r for r in FE.build_base(_bk(spark, rows)).collect()}
    assert out[1]["Lead_Time_Days"] == -2
    assert out[2]["Lead_Time_Days"] == 1 and out[2]["Is_Edge_Hour"] == 1
    assert out[3]["Is_Edge_Hour"] == 1 and out[4]["Is_Edge_Hour"] == 0
    assert out[5]["Lead_Time_Days"] is None and out[5]["Is_Edge_Hour"] == 0


def test_rates_clip_and_half_even(spark):
    d = dt.datetime(2024, 1, 1, 12)
    rows = [_r(1, d, d, visits=0, ns=2),            # visits 0 with no-shows -> rates 0
            _r(2, d, d, visits=3, canc=2, ns=2),    # ns + canc > visits -> success clipped to 0
            _r(3, d, d, visits=32, ns=1),           # 1/32 -> 0.0312 (half-even)
            _r(4, d, d, visits=5, ns=2)]            # 2/5
    out = {r["Booking_ID"]: r for r in FE.build_base(_bk(spark, rows)).collect()}
    assert out[1]["Customer_No_Show_Rate"] == 0.0 and out[1]["Is_New_Customer"] == 1
    assert out[2]["Successful_Visit_Rate"] == 0.0
    assert out[3]["Customer_No_Show_Rate"] == 0.0312
    assert out[4]["Customer_No_Show_Rate"] == 0.4
    r = spark.range(1).select(pct0(F.lit(0.125)).alias("a"), pct0(F.lit(0.135)).alias("b")).first()
    assert r["a"] == "12%"


def test_unknown_levels_encode_to_zero(spark):
    levels = {"Branch": sorted(S.BRANCHES)}
    df = spark.createDataFrame([(1, "Bangalore_MG"), (2, "Chennai")], "Booking_ID long, Branch string")
    out = {r["Booking_ID"]: r for r in FE.one_hot(df, levels).collect()}
    assert all(out[1][f"Branch_{b}"] == 0 for b in sorted(S.BRANCHES)[1:])
    assert out[2]["Branch_Chennai"] == 1
