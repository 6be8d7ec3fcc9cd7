"""The action tree against an independent pure-Python statement of the table."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from pyspark.sql import types as T

from bookrisk.operators.rules import evaluate
from bookrisk.sources import schema as S

SCORED = T.StructType(S.BOOKING.fields + [T.StructField("no_show_probability", T.DoubleType()),
                                          T.StructField("risk_level", T.StringType())])


def expected_action(p, chronic, cash, weekend, new, premium, edge, long_):
    if p < 0.25:
        return "NO_ACTION"
    if p < 0.40:
        if cash:
            return "SOFT_DEPOSIT"
        if long_:
            return "SMS_REMINDER"
        if new and edge:
            return "MULTI_REMINDER"
        return "SMS_REMINDER"
    if p < 0.60:
        if chronic or (cash and weekend) or (cash and premium):
            return "HARD_DEPOSIT"
        if new and cash:
            return "SOFT_DEPOSIT"
        if premium and edge:
            return "CALL_REMINDER"
        return "MULTI_REMINDER"
    if p < 0.75:
        return "HARD_DEPOSIT"
    return "PREPAYMENT" if chronic or (cash and premium) else "HARD_DEPOSIT"


DEPOSIT = {"SOFT_DEPOSIT": 25, "HARD_DEPOSIT": 50, "PREPAYMENT": 100}
PRIORITY = {"NO_ACTION": 1, "SMS_REMINDER": 2, "MULTI_REMINDER": 3, "CALL_REMINDER": 3, "SOFT_DEPOSIT": 3,
            "HARD_DEPOSIT": 4, "PREPAYMENT": 5}


def _row(i, p, chronic, cash, weekend, new, premium, edge, long_):
    visits = 0 if new else 10
    ns = 0 if new else (5 if chronic else 1)
    appt = dt.datetime(2024, 6, 12, 19 if edge else 12, 0)
    lead = 8 if long_ else 2
    return (i, 1, "Hair Spa" if premium else "Haircut", "Chennai", appt - dt.timedelta(days=lead), appt, lead,
            visits, 0, ns, "Cash" if cash else "Card", "Saturday" if weekend else "Tuesday", 0.5, None, p)


def test_truth_table(spark):
    rows, exp = [], {}
    for i, (p, *facts) in enumerate(itertools.product([0.10, 0.30, 0.50, 0.65, 0.80], *[[False, True]] * 7)):
        chronic, cash, weekend, new, premium, edge, long_ = facts
        rows.append(_row(i, p, *facts))
        real_chronic = chronic and not new  # a new customer has no history
        exp[i] = expected_action(p, real_chronic, cash, weekend, new, premium, edge, long_)
    schema = SCORED
    df = spark.createDataFrame([r + ("Low",) for r in rows], schema)
    got = {r["Booking_ID"]: r for r in evaluate(df).collect()}
    assert len(got) == 640
    for i, a in exp.items():
        assert got[i]["action_type"] == a, (rows[i], a, got[i]["action_type"])
        assert got[i]["deposit_pct"] == DEPOSIT.get(a, 0)
        assert got[i]["priority"] == PRIORITY[a]
        assert (got[i]["risk_drivers"] == []) == (a == "NO_ACTION" or got[i]["risk_drivers"] == [])


def test_band_edges(spark):
    ps = [0.25, 0.2499, 0.40, 0.3999, 0.60, 0.5999, 0.75, 0.7499]
    rows = [_row(i, p, False, False, False, False, False, False, False) for i, p in enumerate(ps)]
    schema = SCORED
    df = spark.createDataFrame([r + ("Low",) for r in rows], schema)
    got = {r["Booking_ID"]: r["action_type"] for r in evaluate(df).collect()}
    for i, p in enumerate(ps):
        assert got[i] == expected_action(p, False, False, False, False, False, False, False), p


def test_texts_and_rounding(spark):
    # chronic rate 1/32 -> 3% (0.0312 after half-even rounding), lead 0 falls through
    row = list(_row(1, 0.80, False, True, True, False, True, True, False))
    row[7], row[9], row[6] = 32, 13, 0  # visits, no-shows (13/32 = 0.40625), supplied lead 0
    schema = SCORED
    df = spark.createDataFrame([tuple(row) + ("High",)], schema)
    r = evaluate(df).first()
    assert r["action_type"] == "PREPAYMENT"
    assert r["risk_drivers"][0] == "chronic no-show history (41% rate)"
    assert r["reason"].startswith("Full prepayment required. P=80.00%.")
    assert r["timing_days_before"] == [3, 1] and r["channels"] == ["Call", "SMS", "Email"]
