"""Exact stratified split and curves of unrounded scores."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from bookrisk.functions.hashing import uniform
from bookrisk.operators import metrics as M
from bookrisk.operators import split as SP


def rows_of(spark, n, classes=(0, 1, 2, None), seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(f"K{i}", r.choice(classes), i) for i in range(n)], "Booking_ID string, No_Show int, keep int")


def plain(df, parts):
    w = Window.partitionBy("No_Show")
    r = F.row_number().over(w.orderBy(uniform(F.col("Booking_ID"), "split"), "Booking_ID"))
    n, upto, case = F.count(F.lit(1)).over(w), 0.0, F
    for name, share in parts.items():
        upto += share
        case = case.when(r <= F.floor(n * F.lit(upto) + 0.5), name)
    return df.withColumn("split", case.otherwise("train"))


def test_equals_ranking_whole_classes(spark, monkeypatch):
    for cells, n in ((4096, 900), (4, 900), (1, 50), (4096, 3), (4096, 0)):
        monkeypatch.setattr(SP, "CELLS", cells)
        df = rows_of(spark, n)
        for parts in ({"test": 0.2}, {"test": 0.2, "val": 0.2}, {"a": 0.0, "b": 0.5, "c": 0.5}):
            got, want = SP.stratified(df, parts), plain(df, parts)
            assert got.columns == [*df.columns, "split"]
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_every_class_has_its_share(spark):
    got = SP.stratified(rows_of(spark, 1234), {"test": 0.2, "val": 0.2})
    for r in got.groupBy("No_Show").pivot("split", ["test", "val", "train"]).count().collect():
        n = r["test"] + r["val"] + r["train"]
        assert abs(r["test"] - 0.2 * n) <= 0.5 and abs(r["val"] - 0.2 * n) < 1 and abs(r["train"] - 0.6 * n) <= 0.5


def test_null_and_repeated_keys_stay_together(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 1), ("a", 1), ("b", 1)], "Booking_ID string, No_Show int")
    got = SP.stratified(df, {"test": 0.4}).collect()
    assert len(got) == 5 and all(len({r["split"] for r in got if r["Booking_ID"] == k}) == 1 for k in (None, "a", "b"))


def test_curves_of_scores_that_rounding_would_join(spark):
    r = random.Random(3)
    data = [(m, 0.5 + r.random() * 1e-6 if r.random() < 0.8 else r.choice([0.1, 0.5, 0.9]), int(r.random() < 0.3))
            for m in ("a", "a", "a", None) for _ in range(400)]
    df = spark.createDataFrame(data, "model string, score double, label int")
    for ranges in ("1", "3", "200"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        try:
            auc = {x["model"]: x["auc"] for x in M.roc_auc(df).collect()}
            curve = M.pr_curve(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        for m in ("a", None):
            own = [(s, y) for k, s, y in data if k == m]
            pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
            want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
            assert abs(auc[m] - want) < 1e-12
            points = {x["threshold"]: (x["tp"], x["fp"]) for x in curve if x["model"] == m}
            assert points == {t: (sum(s >= t for s in pos), sum(s >= t for s in neg)) for t in {s for s, _ in own}}


def test_a_class_is_not_one_task(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(8000, numPartitions=8).select(F.col("id").alias("Booking_ID"), (F.col("id") % 4 == 0).cast("int").alias("No_Show"))
        rows = SP.stratified(df, {"test": 0.2}).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert sum(r["count"] for r in rows) == 8000 and max(r["count"] for r in rows) <= 2000
