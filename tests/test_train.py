"""The groups of model settings reach the MLlib estimators."""

import pytest
from pyspark.sql import functions as F

from bookrisk.operators import train as TR


@pytest.mark.parametrize("settings", list(TR.SETTINGS))
def test_settings_reach_the_estimators(spark, settings):
    s = TR.SETTINGS[settings]
    lr, dt, rf, gbt = (TR.estimator(k, 1000.0, settings)[-1] for k in ("lr", "dt", "rf", "gbt"))
    assert lr.getRegParam() == pytest.approx(1 / (s["lr"]["C"] * 1000))
    assert (dt.getMaxDepth(), dt.getMinInstancesPerNode()) == (s["dt"]["depth"], s["dt"]["min_leaf"])
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getMinInstancesPerNode()) == (s["rf"]["trees"], s["rf"]["depth"], s["rf"]["min_leaf"])
    g = s["gbt"]
    assert (gbt.getMaxIter(), gbt.getStepSize(), gbt.getSubsamplingRate()) == (g["trees"], g["rate"], g["rows"])
    assert gbt.getMinInfoGain() == pytest.approx(g["gamma"] / 1000) and gbt.getMinInstancesPerNode() == g["min_child"]
    with pytest.raises(ValueError, match="unknown model kind"):
        TR.estimator("svm", 1.0, settings)


def test_rows_of_a_fit_are_spread_over_the_cores(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(cores * 1000, numPartitions=1)
    monkeypatch.setattr(TR, "LEAST_ROWS", 1000)
    assert TR.spread(df, cores * 1000).rdd.getNumPartitions() == cores
    monkeypatch.setattr(TR, "TASK_ROWS", 500)
    monkeypatch.setattr(TR, "LEAST_ROWS", 100)
    assert TR.spread(df, cores * 1000).rdd.getNumPartitions() == 2 * cores and TR.spread(df, 99).rdd.getNumPartitions() == 1


def test_a_forest_keeps_node_numbers_and_grows_the_same_trees(spark, monkeypatch):
    from bookrisk.operators import metrics as M
    from bookrisk.plans import common as C
    assert not TR.estimator("rf", rows=TR.NODE_IDS)[-1].getCacheNodeIds() and TR.estimator("rf", rows=900_000)[-1].getCacheNodeIds()
    train = M.split_two(TR.feature_table(C.bk(spark, "/root/testdata/sf0.001"))).where("split = 'train'").drop("split")
    kept = TR.fit(train, "rf", trees=3).stages[-1].trees
    monkeypatch.setattr(TR, "NODE_IDS", 0)
    again = TR.fit(train, "rf", trees=3).stages[-1].trees
    assert [t.toDebugString.partition("\n")[2] for t in kept] == [t.toDebugString.partition("\n")[2] for t in again]


@pytest.mark.parametrize("kind", ["lr", "gbt", "leaves"])
def test_a_fit_computes_its_rows_once(spark, kind):
    from bookrisk.operators import boost as B
    from bookrisk.operators import metrics as M
    from bookrisk.plans import common as C
    seen, others = spark.sparkContext.accumulator(0), set(spark.sparkContext._jsc.getPersistentRDDs())

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x
    train = M.split_two(TR.feature_table(C.bk(spark, "/root/testdata/sf0.001"))).where("split = 'train'").drop("split")
    rows = train.withColumn("Lead_Time_Days", counted("Lead_Time_Days"))
    if kind == "leaves":
        with TR.prepared(rows) as (kept, n):
            assert [len(B.refitted(kept, s, 2).values) for s in TR.SETTINGS] == [2, 2, 2]
    else:
        assert len(TR.fit(rows, kind, trees=2).stages) == (3 if kind == "lr" else 2)
        n = train.count()
    assert seen.value == n and set(spark.sparkContext._jsc.getPersistentRDDs()) <= others
