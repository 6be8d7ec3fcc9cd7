"""Properties: PSI(x, x) = 0, AUC invariance and agreement with MLlib,
split disjoint and complete, single-record scores equal batch scores,
stream output equals the batch output, skew paths equal plain windows."""

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from conftest import SF


def test_psi_identity(spark):
    from bookrisk.operators import drift as D
    from bookrisk.plans import common as C
    b = C.bk(spark, SF)
    both = b.withColumn("period", F.lit("reference")).unionByName(b.withColumn("period", F.lit("current")))
    out = D.psi(both, ["Customer_Latent_Risk", "Past_Visit_Count"]).collect()
    assert all(abs(r["psi"]) < 1e-12 for r in out)


def test_auc_matches_mllib_and_is_rank_invariant(spark):
    from bookrisk.operators import metrics as M
    from bookrisk.plans.q_metrics import long
    t = long(spark, SF).where(F.col("model") == "lr")
    ours = M.roc_auc(t).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC")
    ref = ev.evaluate(t.select(F.col("score"), F.col("label").cast("double")))
    assert abs(ours - ref) < 1e-9
    sq = t.withColumn("score", F.bround(F.pow("score", 3), 4))
    # a monotone map that keeps distinct scores distinct keeps the AUC
    if sq.select("score").distinct().count() == t.select("score").distinct().count():
        assert abs(M.roc_auc(sq).first()["auc"] - ours) < 1e-12
    const = t.withColumn("score", F.lit(0.3))
    assert M.roc_auc(const).first()["auc"] == 0.5


def test_split_disjoint_and_complete(spark):
    from bookrisk.plans.q_metrics import wide
    w = wide(spark, SF)
    n = w.count()
    g = {r["split"]: r["count"] for r in w.groupBy("split").count().collect()}
    assert sum(g.values()) == n and set(g) == {"train", "val", "test"}
    assert w.select("Booking_ID").distinct().count() == n


def test_single_record_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    a = q["score_one"](spark, SF).select("Booking_ID", F.col("no_show_probability").alias("a"))
    b = q["score_batch"](spark, SF).select("Booking_ID", F.col("no_show_probability").alias("b"))
    j = a.join(b, "Booking_ID")
    assert j.count() == a.count() == b.count()
    assert j.where(F.col("a") != F.col("b")).count() == 0


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    from bookrisk.plans import common as C
    from bookrisk.plans.q_stores import risk_scores
    s = E.queries()["stream_score"](spark, SF)
    b = C.texts(risk_scores(spark, SF).where("model_version = 'v1'")).select(*s.columns)
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0


def test_streamed_windows_are_complete(spark):
    import __spark_entry__ as E
    q = E.queries()
    for key in ("stream_sliding_drift", "stream_tumbling_ops"):
        batch, streamed = q[key](spark, SF), q[key + "_stream"](spark, SF)
        assert streamed.count() == batch.count() > 0
        assert streamed.select(*batch.columns).exceptAll(batch).count() == 0


def test_skew_paths_equal_plain_windows(spark):
    from pyspark.sql import Window
    from bookrisk.operators.prefix import previous_values, prior_sums
    from bookrisk.plans import common as C
    b = C.bk(spark, SF).select("Booking_ID", "Customer_ID", "Appointment_Time", "Outcome")
    hot = b.withColumn("Customer_ID", F.lit(1))  # one key holds every row
    val = {"n": F.lit(1), "ns": (F.col("Outcome") == "No-Show").cast("int")}
    got = prior_sums(hot, "Customer_ID", "Appointment_Time", "Booking_ID", val, grain_days=7)
    w = Window.partitionBy("Customer_ID").orderBy("Appointment_Time", "Booking_ID").rowsBetween(
        Window.unboundedPreceding, -1)
    ref = hot.select("Booking_ID", F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0)).alias("n_ref"),
                     F.coalesce(F.sum((F.col("Outcome") == "No-Show").cast("int")).over(w), F.lit(0)).alias("ns_ref"))
    j = got.join(ref, "Booking_ID")
    assert j.where((F.col("n") != F.col("n_ref")) | (F.col("ns") != F.col("ns_ref"))).count() == 0
    lag = previous_values(hot, "Customer_ID", "Appointment_Time", "Booking_ID", ["Booking_ID"], grain_days=7)
    wl = Window.partitionBy("Customer_ID").orderBy("Appointment_Time", "Booking_ID")
    ref2 = hot.select("Booking_ID", F.lag("Booking_ID").over(wl).alias("prev_ref"))
    j2 = lag.join(ref2, "Booking_ID")
    assert j2.where(~F.col("prev_Booking_ID").eqNullSafe(F.col("prev_ref"))).count() == 0


def test_running_sums_move_few_rows_twice(spark):
    """Keys of few rows go through one shuffle with their rows; large and null keys give the same sums."""
    import random
    from bookrisk.operators import prefix as PX
    r = random.Random(5)
    data = [(k, None if r.random() < 0.1 else f"1998-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} 10:00:00", i, r.randint(0, 3))
            for i in range(600) for k in [r.choice([1, 1, 1, 2, 3, None, None, *range(10, 40)])]]
    df = spark.createDataFrame(data, "k int, t string, id int, v int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    want = {}
    for k in {x[0] for x in data}:
        total = 0
        for _, _, i, v in sorted((x for x in data if x[0] == k), key=lambda x: (x[1] is not None, x[1] or "", x[2])):
            want[i], total = total, total + v
    for most in (0, 30, 10_000):
        got = PX.prior_sums(df, "k", "t", "id", {"s": F.col("v")}, whole_rows=most)
        assert got.columns == ["k", "t", "id", "v", "s"] and {x["id"]: x["s"] for x in got.collect()} == want
    plan = PX.prior_sums(df, "k", "t", "id", {"s": F.col("v")}, whole_rows=30)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(key_" in line]
    assert len(wide) == 1, plan  # the join takes the rows as they were dealt out
