"""Whitening against a dense eigen decomposition and exact integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookrisk.llm import whitening as W

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>"


def matrices():
    r = np.random.default_rng(1)
    for d in (1, 2, 3, 10, 40):
        a = r.normal(size=(d * 3, d))
        yield a.T @ a / len(a)
        yield a[:max(1, d // 2)].T @ a[:max(1, d // 2)]  # fewer rows than dimensions
        yield np.eye(d) * 3.0
        q, _ = np.linalg.qr(r.normal(size=(d, d)))
        two = q @ np.diag([10.0] * (d // 2) + [5.0] * (d - d // 2)) @ q.T  # repeated eigenvalues
        yield (two + two.T) / 2
        near = q @ np.diag(1 + 1e-9 * np.arange(d)) @ q.T
        yield (near + near.T) / 2


def test_inertia_counts():
    r = np.random.default_rng(2)
    for v in matrices():
        e = np.linalg.eigvalsh(v)
        for s in [*r.uniform(-1, e[-1] * 1.2, 10), 0.3]:
            if np.abs(e - s).min() > 1e-9:
                assert W.above(v, s) == (e > s).sum()
    assert W.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_leading_pairs():
    for v in matrices():
        e = np.linalg.eigvalsh(v)[::-1]
        pairs = W.leading(v, 32)
        assert len(pairs) == min(32, int((e > 8 * len(v) * W.EPS * np.trace(v)).sum()))
        x = np.array([q for _, q in pairs])
        assert np.allclose([a for a, _ in pairs], e[:len(pairs)], rtol=0, atol=1e-13 * e[0])
        assert max(np.linalg.norm(v @ q - a * q) for a, q in pairs) < 1e-13 * e[0]
        assert np.abs(x @ x.T - np.eye(len(x))).max() < 1e-10
    assert W.leading(np.zeros((3, 3)), 3) == []


def test_products_are_exact():
    r = random.Random(3)
    for most in (5, 1 << 19, 1 << 21, 1 << 46):
        z = np.array([[r.randint(-most, most) for _ in range(4)] for _ in range(50)])
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j], strict=True)) for j in range(4)] for i in range(4)]
        assert W.products(z).tolist() == want


def expected(vectors, components=32):
    """By numpy's eigh, with exact sums."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 8 * d * W.EPS * e.sum()).sum()))
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    return n, deviation, y @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(rows, vectors, components=32, tolerance=1e-7):
    n, deviation, whitened, explained = expected(vectors, components)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    k = whitened.shape[1]
    assert len(rows) == len(vectors) * k and set(got) == {(i, c) for i, _ in vectors for c in range(1, k + 1)}
    w = np.array([[got[i, c]["whitened"] for c in range(1, k + 1)] for i, _ in vectors])
    sign = np.sign((w * whitened).sum(axis=0))
    assert np.abs(w * sign - whitened).max() < tolerance
    for a, (i, _) in enumerate(vectors):
        for c in range(1, k + 1):
            r = got[i, c]
            assert r["n"] == n and r["deviation"] == deviation[a] and abs(r["explained"] / explained[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_query_equals_a_dense_decomposition(spark):
    from bookrisk.llm.queries import QUERIES
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = QUERIES["op12_whitening"](spark, SF)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                               "explained": "double", "identity_error": "double"}
    compare(df.collect(), vectors)


def random_vectors(n, d, seed=1, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, (r.normal(size=d) * np.arange(1, d + 1) * scale).astype(np.float32).tolist()) for i in range(n)]


def test_left_out_rows_and_extra_columns(spark):
    good = random_vectors(60, 5)
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [math.nan] * 5), (103, [math.inf, 1.0, 1.0, 1.0, 1.0]), (104, []),
           (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad, ROWS).withColumns({c: F.lit("z") for c in ("id", "x", "component", "n", "whitened")})
    compare(W.whiten(df).collect(), good)
    compare(W.whiten(df, components=2).collect(), good, 2)


def test_repeats_null_ids_and_large_entries(spark):
    good = random_vectors(40, 3, scale=1e7)
    compare(W.whiten(spark.createDataFrame(good, ROWS)).collect(), good)
    twice = spark.createDataFrame([(None, v) for _, v in good] * 2, ROWS)
    rows = W.whiten(twice).collect()
    assert len(rows) == 240 and {r["n"] for r in rows} == {80} and rows[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("vectors", [[], [(1, [])], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])], [(1, None)]])
def test_nothing_to_whiten(spark, vectors):
    assert W.whiten(spark.createDataFrame(vectors, ROWS)).collect() == []


def test_fewer_rows_than_dimensions(spark):
    rows = W.whiten(spark.createDataFrame(random_vectors(4, 9), ROWS)).collect()
    assert {r["component"] for r in rows} == {1, 2, 3} and rows[0]["identity_error"] < 1e-9
