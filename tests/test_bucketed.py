"""Stores in buckets of the booking id: same results, no shuffle of a stored side."""

from conftest import SF
from pyspark.sql import functions as F

from bookrisk.operators import stores as ST
from bookrisk.plans import common as C
from bookrisk.plans import q_stores as Q


def test_joins_of_stored_sides_do_not_shuffle(spark):
    sides = [f(spark, SF) for f in (Q.bookings_by_booking, Q.scores_by_booking, Q.log_by_booking)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = ST.booking_score_log(*sides)
        latest = ST.latest_scores(sides[1])
        for df in (joined, latest):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
        history = ST.customer_score_history(sides[1], sides[0])._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(booking_id" not in history
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = ST.booking_score_log(C.bk(spark, SF), Q.risk_scores(spark, SF), Q.intervention_log(spark, SF))
    assert sorted(map(str, joined.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(str, latest.collect())) == sorted(map(str, ST.latest_scores(Q.risk_scores(spark, SF)).select(*latest.columns).collect()))


def test_the_queue_filter_is_not_inlined(spark):
    """The action is worked out once for a row, not again inside a predicate."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (None, "b")], "Booking_ID long, x string")
    actions = rows.withColumn("action_type", F.expr("CASE WHEN x = 'a' THEN 'NO_ACTION' WHEN x = 'b' THEN concat('DEPO', 'SIT_', x) END"))
    log = spark.createDataFrame([(2,), (2,), (None,)], "booking_id long")
    out = ST.anti_no_intervention(actions, log)
    assert sorted(map(str, (r.asDict() for r in out.collect()))) == sorted(map(str, (
        {"Booking_ID": i, "x": "b", "action_type": "DEPOSIT_b"} for i in (3, None))))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "DEPO" in line], plan
