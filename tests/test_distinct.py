"""Distinct sketches, exact levels without a gathering task, level dictionary."""

import pytest
from pyspark.sql import functions as F

from bookrisk.operators import distinct as D
from bookrisk.operators import features as FE
from bookrisk.operators import report as RP


def wide(spark, n=60_000):
    return spark.range(n).select((F.col("id") % 37_000).cast("string").alias("many"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("L"), F.col("id") % 7)).alias("few"),
                                 F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 100).alias("ts"))


def test_sketches_merge_within_the_bound(spark):
    df = wide(spark)
    months = D.monthly(df, ["many", "few"], "ts").persist()
    assert months.select("month").distinct().count() > 1
    whole = {r["column"]: r["n_distinct"] for r in D.counts(D.merged(months)).collect()}
    assert whole["few"] == 7 and abs(whole["many"] - 37_000) <= 4 * D.ERROR * 37_000
    half = {r["column"]: r["n_distinct"] for r in D.counts(D.merged(months.where("month < '2023-12'"))).collect()}
    exact = df.where("date_format(ts, 'yyyy-MM') < '2023-12'").agg(F.count_distinct("many")).first()[0]
    assert abs(half["many"] - exact) <= 4 * D.ERROR * exact
    assert D.counts(D.merged(D.monthly(df.limit(0), ["few"], "ts"))).collect() == []


def test_levels_without_a_gathering_task(spark):
    df = wide(spark, 5000)
    got = {r["column_name"]: (r["n_levels"], r["levels"]) for r in RP.nunique_levels(df.withColumn("none", F.lit(None).cast("string")), ["few", "none"]).collect()}
    assert got == {"few": (7, "L0, L1, L2, L3, L4, L5, L6"), "none": (0, "")}
    assert FE.fit_levels(df, ["few", "absent"]) == {"few": [f"L{i}" for i in range(7)]}
    with pytest.raises(ValueError, match="level_table"):
        FE.fit_levels(df, ["few", "many"])


def test_level_dictionary_of_any_size(spark):
    df = wide(spark)
    table = FE.level_table(df, ["many", "few"]).persist()
    rows = [(r["column"], r["level"], r["position"]) for r in table.collect()]
    for c, n in (("many", 37_000), ("few", 7)):
        assert [p for _, _, p in sorted(x for x in rows if x[0] == c)] == list(range(n))
    place = {(c, v): p for c, v, p in rows}
    new = df.limit(300).unionByName(spark.createDataFrame([("unseen", None, None)], "many string, few string, ts timestamp")).withColumn("was", F.col("many")).withColumn("few_was", F.col("few"))
    got = FE.encode_levels(new, table, ["many", "few"]).collect()
    assert len(got) == 301
    for r in got:
        assert r["many"] == place.get(("many", r["was"])) and r["few"] == place.get(("few", r["few_was"]))
