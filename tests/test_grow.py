"""Forests and boosting grown in one stage, against MLlib's own."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import SF

from bookrisk.operators import grow as G
from bookrisk.operators import metrics as M
from bookrisk.operators import train as TR
from bookrisk.plans import common as C


@pytest.fixture
def grows(monkeypatch):
    """Few rows are grown here too, by several tasks."""
    monkeypatch.setattr(G, "LARGE", 0)
    monkeypatch.setattr(G, "LEAST", 200)


@pytest.fixture(scope="module")
def train(spark):
    return M.split_two(TR.feature_table(C.bk(spark, SF))).where("split = 'train'").drop("split")


def chances(model, t):
    rows = model.transform(t).select(vector_to_array("probability")[1].alias("p"), "No_Show").orderBy("features").collect()
    return np.array([r["p"] for r in rows])


def texts(model):
    return [x.toDebugString.partition("\n")[2] for x in model.trees]


def test_a_tree_without_draws_is_mllibs(spark, train, grows):
    with TR.prepared(train) as (kept, rows):
        t = kept.withColumn("weight", F.lit(1.0))
        est = TR.estimator("rf", trees=1)[-1].setBootstrap(False).setFeatureSubsetStrategy("all").setMinInstancesPerNode(3)
        ours, theirs = G.grown(t, est), est.fit(t)
        assert texts(ours) == texts(theirs) and list(chances(ours, t)) == list(chances(theirs, t))
        assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray())


@pytest.mark.parametrize("least,floor", [(1, 0.0), (20, 1e-3)])
def test_boosting_on_all_rows_is_mllibs(spark, train, grows, least, floor):
    with TR.prepared(train) as (kept, rows):
        t = kept.withColumn("weight", F.lit(1.0))
        est = TR.estimator("gbt", trees=3)[-1].setMinInstancesPerNode(least).setMinInfoGain(floor).setLeafCol("leaf")
        ours, theirs = G.grown(t, est), est.fit(t)
        assert list(ours.treeWeights) == list(theirs.treeWeights) and ours.numFeatures == len(TR.BASE_FEATURES)
        assert texts(ours)[0] == texts(theirs)[0]
        assert np.allclose(chances(ours, t), chances(theirs, t), atol=1e-6)
        assert {"leaf", "probability"} <= set(ours.transform(t).columns)


@pytest.mark.parametrize("kind,settings,trees", [("rf", "script", 10), ("gbt", "notebook", 5), ("gbt", "script", 5)])
def test_a_fit_grows_its_trees_in_one_stage(spark, train, grows, monkeypatch, tmp_path, kind, settings, trees):
    def no_fit(*_):
        raise AssertionError("MLlib fits")
    monkeypatch.setattr("pyspark.ml.classification.RandomForestClassifier._fit", no_fit)
    monkeypatch.setattr("pyspark.ml.classification.GBTClassifier._fit", no_fit)
    model, again = TR.fit(train, kind, settings, trees=trees), TR.fit(train, kind, settings, trees=trees)
    monkeypatch.undo()
    theirs = TR.fit(train, kind, settings, trees=trees)
    assert texts(model.stages[-1]) == texts(again.stages[-1]) and len(model.stages[-1].trees) == trees
    TR.save(model, str(tmp_path / "m"))
    auc = [M.roc_auc(TR.score(m, train, places=None).select(F.lit("m").alias("model"), F.col("no_show_probability").alias("score"), F.col("No_Show").alias("label"))).first()["auc"]
           for m in (model, TR.load(str(tmp_path / "m")), theirs)]
    assert auc[0] == auc[1] and abs(auc[0] - auc[2]) < 0.04
    folder = f"{spark.sparkContext.getCheckpointDir()}/tables".removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("grown-") and os.path.exists(f"{folder}/{x}/messages")]


def test_what_is_left_to_mllib(spark, grows, monkeypatch):
    def rows(labels, weights):
        return spark.createDataFrame([(Vectors.dense([float(i), 1.0]), y, w) for i, (y, w) in enumerate(zip(labels, weights, strict=True))], ["features", "No_Show", "weight"])
    est = TR.estimator("rf", trees=2)[-1]
    assert G.grown(rows([0, 0, 0], [1.0] * 3), est) is None  # one class
    assert G.grown(rows([0, 1, 2], [1.0] * 3), est) is None
    assert G.grown(rows([0, 1, 1], [1.0, 1.0, 2.0]), est) is None  # weights differ inside a class
    assert G.grown(rows([0, 1, 1], [1.0, 3.0, 3.0]), TR.estimator("lr")[-1]) is None
    assert len(G.grown(rows([0, 1, 1], [1.0, 3.0, 3.0]), est).trees) == 2
    monkeypatch.setattr(G, "LARGE", 4)
    assert G.grown(rows([0, 1, 1], [1.0, 3.0, 3.0]), est) is None


def test_cuts_and_codes():
    one = np.ones(6)
    assert G.cuts(np.array([0.0, 0.0, 1.0, 3.0, 3.0, 0.0]), one, 6.0, 32).tolist() == [0.5, 2.0]
    assert G.cuts(np.zeros(6), one, 6.0, 32).tolist() == [] and G.cuts(np.array([-1.0, 1.0]), np.ones(2), 5.0, 32).tolist() == [-0.5, 0.5]
    assert len(G.cuts(np.arange(1000.0), np.ones(1000), 1000.0, 32)) == 31
    lay = G.Layout([np.array([0.5]), np.array([1.5, 2.5]), np.array([]), np.arange(31.0), np.arange(200.0)])
    assert sorted(f for x in lay.packed for f in x) == [0, 1, 3, 4] and max(lay.cells) <= 256
    x = np.array([[0.0, 1.0, 9.0, 4.0, 77.5], [1.0, 2.5, 9.0, 99.0, -1.0], [0.5, 3.0, 9.0, -5.0, 1e9]])
    codes = lay.codes(x)
    got = [[int(lay.decoded[f][codes[lay.plane[f]][i]]) for f in (0, 1, 3, 4)] for i in range(3)]
    assert got == [[0, 0, 4, 78], [1, 1, 31, 0], [0, 2, 0, 200]]
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError, match="NaN or Infinity"):
            lay.codes(np.full((1, 5), bad))
    assert abs(np.mean(G.bag({"seed": 1, "bootstrap": True, "rate": 1.0}, 0, 0, 200_000)[1].sum() / 200_000) - 1) < 0.02
