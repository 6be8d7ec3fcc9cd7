"""Leaf values with penalties, against sums written out in numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from bookrisk.operators import boost as B
from bookrisk.operators import metrics as M
from bookrisk.operators import train as TR
from bookrisk.plans import common as C


def brute(leaf, y, w, forms, rate, l1, l2, gain, min_child):
    """Row by row, tree by tree, the splits undone by repeated passes."""
    margin, out = np.zeros(len(y)), []
    for t, form in enumerate(forms):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def total(nodes, leaf=leaf[:, t], g=g, h=h):
            rows = np.isin(leaf, nodes)
            return g[rows].sum(), h[rows].sum()

        def term(nodes, total=total):
            a, b = total(nodes)
            return np.sign(a) * max(abs(a) - l1, 0), b + l2

        def cut(x, term=term, total=total):
            if isinstance(x, int):
                return [[x]]
            parts = cut(x[0]) + cut(x[1])
            if len(parts) > 2:
                return parts
            (a, b), (c, d), (e, f) = term(parts[0]), term(parts[1]), term(parts[0] + parts[1])
            low = min(total(parts[0])[1], total(parts[1])[1])
            return [parts[0] + parts[1]] if a * a / b + c * c / d - e * e / f < gain or low < min_child else parts
        values = np.zeros(len(B.leaves(form)))
        for nodes in cut(form):
            a, b = term(nodes)
            values[nodes] = -rate * a / b
        margin = margin + values[leaf[:, t]]
        out.append(values)
    return out, margin


@pytest.fixture(scope="module")
def rows(spark):
    return M.split_two(TR.feature_table(C.bk(spark, "/root/testdata/sf0.001"))).where("split = 'train'").drop("split")


@pytest.mark.parametrize("settings", list(TR.SETTINGS))
def test_refit_equals_closed_form(spark, rows, settings, monkeypatch, tmp_path):
    monkeypatch.setattr(B, "BLOCK", 2)  # more than one block
    model, t = B.grow(rows, settings, trees=3)
    forms = [B.shape(x.toDebugString) for x in model.stages[-1].trees]
    assert [len(B.leaves(f)) for f in forms] == [(x.numNodes + 1) // 2 for x in model.stages[-1].trees]
    d = model.transform(t).select("No_Show", "weight", vector_to_array("leaf").alias("leaf")).toPandas()
    s = TR.SETTINGS[settings]["gbt"]
    one = spark.createDataFrame(d)
    args = {"rate": s["rate"], "gain": s["gamma"], "min_child": s["min_child"], **B.PENALTIES[settings]}
    want, margin = brute(np.array(d["leaf"].tolist()).astype(int), d["No_Show"].to_numpy(float), d["weight"].to_numpy(), forms, **args)
    got = B.refit(one, forms, **args)
    for a, b in zip(got, want, strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)
    if settings != "script":
        assert any(len(set(a)) < len(a) for a in got)  # some splits are undone
    boosted = B.Boosted(model, got)
    boosted.save(str(tmp_path / "m"))
    again = B.Boosted.load(spark, str(tmp_path / "m"))
    assert np.allclose(sorted(r["margin"] for r in again.margin(t).collect()), sorted(margin))


def test_penalties():
    sums = {0: (3.0, 2.0), 1: (-1.0, 1.0), 2: (0.05, 5.0)}
    tree = ((0, 1), 2)
    free = B.settle(tree, sums, 0.0, 1.0, 0.0, 0.0)
    assert np.allclose(free, [-1.0, 0.5, -0.05 / 6])
    assert np.allclose(B.settle(tree, sums, 0.1, 1.0, 0.0, 0.0), [-2.9 / 3, 0.45, 0.0])
    assert len(set(B.settle(tree, sums, 0.0, 1.0, 100.0, 0.0))) == 1  # no split is worth it
    assert B.settle(tree, sums, 0.0, 1.0, 0.0, 1.5)[:2] == [-0.5, -0.5]  # leaf 1 holds too little
    assert B.settle(0, {}, 0.0, 0.0, 0.0, 0.0) == [0.0]


def test_nulls_and_no_rows(spark):
    schema = "leaf array<int>, No_Show int, weight double"
    forms = [(0, 1)]
    some = spark.createDataFrame([([0], 1, 1.0), ([1], 0, 1.0), ([0], None, 1.0), ([0], 1, None)], schema)
    assert np.allclose(B.refit(some, forms, 1.0, min_child=0.0), [[0.4, -0.4]])
    assert B.refit(spark.createDataFrame([], schema), forms, 1.0, l2=0.0, min_child=0.0) == [[0.0, 0.0]]
