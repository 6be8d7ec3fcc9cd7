"""Whitening of embeddings by spectrum slicing.

An entry c becomes the integer floor(64 c) + 1000000. Counts, sums and the
products of the entries, taken around integers next to the means, are exact
integers: each task sums its rows, the sums of tasks are merged in two rounds
of tasks, and only one sum of dimension^2 numbers reaches the driver. So the
covariance is correctly rounded and does not depend on how rows are dealt.

The driver then works on one dimension x dimension matrix V. The inertia of
V - s I (signs of the pivots of its LDL^T factorisation with Bunch-Kaufman
pivoting) counts the eigenvalues above s. Counts at halved intervals isolate
the leading eigenvalues one by one; Rayleigh quotient iteration converges
cubically inside an interval; counts on both sides of what it found certify
the number of the component. Eigenvalues that no interval of working accuracy
parts (equal ones) take vectors orthogonal to each other, in any turn.

A last pass projects every row; the covariance of the projections is summed
in a pass of its own and its distance from the identity is part of the result.

Defined results: rows whose vector is null or holds a null, NaN or infinite
entry, or one of ``LARGEST`` or more in size, are left out; vectors of another
length than most rows have (ties: the longer) are left out too, as they have
no covariance with the others; components whose eigenvalue is not above the
rounding error of the trace do not exist (equal rows, one row: none; fewer
rows than dimensions: fewer); repeated rows and null ids are rows like others;
empty tables give empty results; other columns are ignored. A ``deviation``
of more than 38 digits is null.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.llm.common import durable

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 40)
#: Integers of this many bits can be multiplied and 2^13 products summed exactly in a double.
LIMB, ROWS = 20, 1 << 13
EPS = float(np.finfo(float).eps)


# ------------------------------------------------------------- eigenpairs
def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` lie above ``shift``: the positive part of
    the inertia of ``v - shift I``."""
    a = v - shift * np.eye(len(v))
    alpha, positive = (1 + 17 ** 0.5) / 8, 0
    while len(a):
        column = np.abs(a[:, 0])
        column[0] = 0
        r = int(column.argmax())
        most, two = column[r], False
        if most > 0 and abs(a[0, 0]) < alpha * most:
            other = np.abs(a[:, r])
            other[r] = 0
            if abs(a[0, 0]) * other.max() < alpha * most * most:
                two = abs(a[r, r]) < alpha * other.max()
                swap = 1 if two else 0
                a[[swap, r]] = a[[r, swap]]
                a[:, [swap, r]] = a[:, [r, swap]]
        if two:  # such a block has one eigenvalue of either sign
            positive += 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
        else:
            positive += bool(a[0, 0] > 0)
            a = a[1:, 1:] - np.outer(a[1:, 0] / a[0, 0], a[0, 1:]) if a[0, 0] else a[1:, 1:].copy()
    return positive


def _solve(v: np.ndarray, shift: float, x: np.ndarray, tiny: float) -> np.ndarray:
    for k in range(4):  # a shift that is an eigenvalue to the last bit is moved
        try:
            y = np.linalg.solve(v - (shift + k * tiny) * np.eye(len(v)), x)
            if np.isfinite(y).all():
                return y / np.linalg.norm(y)
        except np.linalg.LinAlgError:
            pass
    return x


def leading(v: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
    """Up to ``most`` eigenpairs of the positive semidefinite ``v``, largest
    first, each with its number certified by counts."""
    d = len(v)
    norm = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if norm == 0:
        return []
    tiny = EPS * norm
    counts = [(-norm * 0.5, d), (norm * 1.5, 0)]

    def count(s: float) -> int:
        c = above(v, s)
        insort(counts, (s, c))
        return c

    found: list[tuple[float, np.ndarray]] = []
    floor = max(8 * d * EPS * float(np.trace(v)), 0.0)
    fine = 64 * d ** 0.5 * tiny  # narrower intervals cannot be told apart
    for k in range(1, min(most, d) + 1):
        while True:
            lo = max(s for s, c in counts if c >= k)
            hi = min(s for s, c in counts if c < k and s > lo)
            mid, wide = (lo + hi) / 2, hi - lo > fine
            if wide and (dict(counts)[lo], dict(counts)[hi]) != (k, k - 1):
                count(mid)
                continue
            near = [x for e, x in found if e - hi < 1e-3 * norm]  # kept orthogonal where the gap is small
            pair = _iterate(v, mid, near, tiny, (lo, hi) if wide else (-np.inf, np.inf))
            if pair:
                break
            count(mid)  # the iteration left the interval: halve it
        e, x = pair
        if e <= floor:
            break
        if wide and (count(max(lo, e - fine)) < k or count(min(hi, e + fine)) >= k):
            raise ArithmeticError(f"component {k} is not certified")
        found.append((e, x))
    return found


def _iterate(v: np.ndarray, shift: float, near: list[np.ndarray], tiny: float,
             within: tuple[float, float]) -> tuple[float, np.ndarray] | None:
    """Inverse iteration at ``shift``, then Rayleigh quotient iteration, both
    orthogonal to ``near``; None if the quotient leaves ``within``."""
    def clean(x):
        for _ in range(2):
            for q in near:
                x = x - (q @ x) * q
        return x / max(np.linalg.norm(x), EPS)

    x = clean(np.cos(np.arange(1, len(v) + 1) ** 2.0))
    for _ in range(3):
        x = clean(_solve(v, shift, x, tiny))
    best = None
    for _ in range(12):
        e = float(x @ v @ x)
        miss = float(np.linalg.norm(v @ x - e * x))
        if best is not None and miss >= best[0] and best[0] <= 64 * tiny:
            break
        if not within[0] <= e <= within[1]:
            return None
        if best is None or miss < best[0]:
            best = (miss, e, x)
        x = clean(_solve(v, e, x, tiny))
    return best[1], best[2]


# ------------------------------------------------------------- exact sums
def products(z: np.ndarray) -> np.ndarray:
    """The exact z^T z of an integer matrix, as Python integers."""
    total = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    for at in range(0, len(z), ROWS):
        rest, limbs = z[at:at + ROWS].astype(np.int64), []
        while rest.any():
            if np.abs(rest).max() < 1 << LIMB:
                limbs.append(rest.astype(np.float64))
                break
            limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
            rest = rest >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def _matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def _summed(parts: DataFrame, kind: str, tasks: int) -> list:
    """Element-wise sum of the only column, an array of one length, in two
    rounds of tasks that each hold one sum."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in b.column(0):
                values = np.array(row.values.to_pylist(), dtype=object if kind != "double" else float)
                total = values if total is None else total + values
        if total is not None:
            yield pa.record_batch([pa.array([list(total)], ARROW[kind])], names=["total"])
    for width in (tasks, 1):
        parts = parts.repartition(width).mapInArrow(add, f"total array<{kind}>")
    rows = parts.collect()
    return [int(x) if kind != "double" else x for x in rows[0][0]] if rows else []


ARROW = {"double": pa.list_(pa.float64()), "decimal(38,0)": pa.list_(pa.decimal128(38, 0))}


def _partial(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Sum of ``of(matrix of rows)`` over all rows of column ``x``."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                values = of(_matrix(b.column(0).slice(at, ROWS)))
                total = values if total is None else total + values
        if total is not None:
            yield pa.record_batch([pa.array([list(total)], ARROW[kind])], names=["total"])
    parts = rows.select("x").mapInArrow(local, f"total array<{kind}>")
    return _summed(parts, kind, max(1, int(rows.sparkSession.sparkContext.defaultParallelism ** 0.5)))


# ------------------------------------------------------------- the operator
@dataclass(frozen=True)
class Model:
    n: int
    sums: list[int]
    #: dimension x components, divided by the square roots of the eigenvalues
    project: np.ndarray
    explained: list[float]


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows whose vector is whole and finite."""
    v = F.col(vec_col).cast("array<double>")
    whole = F.forall(v, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return vectors.where(v.isNotNull() & whole).select(F.col(id_col).alias("id"), x.alias("x"))


def fit(rows: DataFrame, components: int) -> Model | None:
    """Fit on all (id, x) rows of one length; None if there are none."""
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    if sizes is None or sizes["d"] == 0:
        return None
    n, d = sizes["count"], sizes["d"]
    rows = rows.where(F.size("x") == d)
    sums = _partial(rows, lambda x: x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) >= 1 << 48 else x.sum(axis=0).astype(object), "decimal(38,0)")
    middle = [round(s / n) for s in sums]
    away = [s - n * m for s, m in zip(sums, middle, strict=True)]
    centre = np.array(middle, dtype=np.int64)
    g = _partial(rows, lambda x: products(x - centre).ravel(), "decimal(38,0)")
    v = np.array([[(n * g[i * d + j] - away[i] * away[j]) / (n * n) for j in range(d)] for i in range(d)])
    pairs = leading(v, components)
    project = np.array([x / e ** 0.5 for e, x in pairs]).reshape(len(pairs), d).T
    trace = float(np.trace(v))
    return Model(n, sums, project, [e / trace for e, _ in pairs])


def centred(x: np.ndarray, m: Model) -> tuple[np.ndarray, list[int | None]]:
    """x minus its mean, and the sum of squares of n x - sums, exact."""
    safe = max(int(np.abs(x).max(initial=0)) * m.n, max(map(abs, m.sums))) < 1 << 62
    a = x * m.n - np.array(m.sums) if safe else x.astype(object) * m.n - np.array(m.sums, dtype=object)
    if safe and int(np.abs(a).max(initial=0)) ** 2 * a.shape[1] < 1 << 63:
        squares = (a * a).sum(axis=1).tolist()
    else:
        squares = [s if (s := sum(int(t) ** 2 for t in row)) < 10 ** 38 else None for row in a]
    return (a / m.n).astype(np.float64), squares


def identity_error(rows: DataFrame, m: Model) -> float:
    """Largest entry of the covariance of all projections minus the identity."""
    k = m.project.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x, m)[0] @ m.project
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
    total = np.array(_partial(rows, moments, "double"))
    mean, square = total[:k] / m.n, total[k:].reshape(k, k) / m.n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


COLUMNS = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per remaining vector and component: (id, component, n, deviation,
    whitened, explained, identity_error)."""
    rows = integers(vectors, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    model = fit(rows, components)
    if model is None or not model.explained:
        return rows.sparkSession.createDataFrame([], f"{id_col} {kind}, {COLUMNS}")
    rows = rows.where(F.size("x") == len(model.sums))
    error = identity_error(rows, model)
    k = len(model.explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                y, squares = centred(_matrix(part.column(1)), model)
                r = part.num_rows
                each = np.repeat(np.arange(r), k)
                yield pa.record_batch([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                    pa.array(np.full(r * k, model.n)), pa.array(squares, pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array((y @ model.project).ravel()), pa.array(np.tile(model.explained, r)), pa.array(np.full(r * k, error)),
                ], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(project, f"{id_col} {kind}, {COLUMNS}")
