"""Forests and boosted trees grown in one stage of tasks that add up their counts.

MLlib's forest and boosting pass over all rows for every level of every tree,
a job each. Here the rows are coded once (the bin of every feature, as MLlib
cuts them) and dealt out over one task per core; the tasks of the one barrier
stage keep their rows, count them by node and bin, and hand each other the
counts of a level through files in the checkpoint folder, from which the splits
follow. Nothing but the model passes the driver. The result is MLlib's own
model class, written in its file format and loaded.

What a tree is follows MLlib: bins between the values of a sample of the rows
(the same sample), gini or variance gains, the first of the best splits, nodes
of one class left whole, leaves of one prediction joined. With equal
weights and without draws the trees are MLlib's; with class weights sums are
rounded in another order, and of equally good splits another may be taken. Bags
of rows and subsets of features are drawn by another generator, seeded, as
there, by tree and task.

Bins of several features share a byte where the product of their numbers is at
most 256, so that one count serves all of them. A task holds about 30 bytes per
row and the bags of ``BAGS`` trees; a message has the counts of one level. The
tasks must all run at one time, and each reads the messages of all.

Defined results: a feature that is not finite raises, as in MLlib; what is left
to MLlib is named at :func:`grown`.
"""

from __future__ import annotations

import json
import math
import operator
import pickle
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import BarrierTaskContext
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.session import ensure_checkpoint_dir

#: Rows from which a fit is grown here; MLlib itself takes less time for fewer.
LARGE = 50_000
#: Fewest rows of a task; rows that are walked and counted at once.
LEAST, CHUNK = 10_000, 1 << 16
#: Trees of a forest that grow together, and the rows times trees they may have in a task.
BAGS, MOST = 16, 16_000_000
#: Bins that share a byte.
CELLS = 256


# ---------------------------------------------------------------- bins
def cuts(values: np.ndarray, weights: np.ndarray, total: float, bins: int) -> np.ndarray:
    """MLlib's thresholds of one feature: half way between neighbouring values,
    all of them where they fit, else at even steps of weight. ``total``: the
    weight of the sample, what is missing of it being zeros."""
    some = values != 0.0
    found, place = np.unique(values[some], return_inverse=True)
    counts = np.bincount(place, weights=weights[some], minlength=len(found))
    rest = total - weights[some].sum()
    if rest > np.finfo(float).eps * some.sum() ** 2:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, rest)
    between = (found[:-1] + found[1:]) / 2.0
    if len(between) <= bins - 1:
        return between
    step, out = total / bins, []
    target, current = step, counts[0]
    for i in range(1, len(found)):
        before, current = current, current + counts[i]
        if abs(before - target) < abs(current - target):
            out.append(between[i - 1])
            target += step
    return np.array(out)


def pack(bins: list[int]) -> list[list[int]]:
    """Features by the byte they share; a feature of one bin has none."""
    out: list[tuple[int, list[int]]] = []
    for f in sorted((f for f, b in enumerate(bins) if b > 1), key=lambda f: (-bins[f], f)):
        at = next((i for i, (n, _) in enumerate(out) if n * bins[f] <= CELLS), None)
        if at is None:
            out.append((bins[f], [f]))
        else:
            out[at] = (out[at][0] * bins[f], [*out[at][1], f])
    return [x for _, x in out]


class Layout:
    """Bins, bytes and the places of (feature, bin) in a row of counts."""

    def __init__(self, thresholds: list[np.ndarray]):
        self.thresholds = thresholds
        self.bins = np.array([len(t) + 1 for t in thresholds])
        self.used = np.flatnonzero(self.bins > 1)
        self.packed = pack(self.bins.tolist())
        self.start = np.concatenate([[0], np.cumsum(np.where(self.bins > 1, self.bins, 0))])
        self.plane, self.scale = np.zeros(len(self.bins), dtype=int), np.ones(len(self.bins), dtype=int)
        self.cells, self.sums, self.places = [], [], []
        for p, features in enumerate(self.packed):
            n = 1
            for f in features:
                self.plane[f], self.scale[f] = p, n
                n *= int(self.bins[f])
            cell, columns, places = np.arange(n), [], []
            for f in features:
                b = cell // self.scale[f] % self.bins[f]
                columns.append(b[:, None] == np.arange(self.bins[f]))
                places.append(self.start[f] + np.arange(self.bins[f]))
            self.cells.append(n)
            self.sums.append(np.concatenate(columns, axis=1).astype(float))
            self.places.append(np.concatenate(places))
        self.decoded = np.arange(CELLS) // self.scale[:, None] % self.bins[:, None]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bytes of rows of features, byte by byte."""
        if not np.isfinite(x).all():
            raise ValueError("Vector values MUST NOT be NaN or Infinity")  # nor does MLlib take them
        out = np.zeros((len(self.packed), len(x)), dtype=np.uint8)
        for f in self.used:
            out[self.plane[f]] += (np.searchsorted(self.thresholds[f], x[:, f]) * self.scale[f]).astype(np.uint8)
        return out


# ---------------------------------------------------------------- trees
class Tree:
    """Nodes in the order they were made: split (-1: none), children (a leaf:
    itself), rows of both classes and, in boosting, their sums of residuals."""

    def __init__(self, rows: list[float], sums: list[float] | None = None):
        self.feature, self.cut, self.gain, self.left, self.right = [-1], [-1], [-1.0], [0], [0]
        self.rows, self.sums = [rows], [sums]
        self.open = [0]  # nodes of the level that is to be split

    def add(self, rows: list[float], sums: list[float] | None) -> int:
        n = len(self.feature)
        for x, v in ((self.feature, -1), (self.cut, -1), (self.gain, -1.0), (self.left, n), (self.right, n), (self.rows, rows), (self.sums, sums)):
            x.append(v)
        return n

    def grow(self, best: list[tuple | None], last: bool) -> None:
        """The best split of every open node makes the next level."""
        fresh = []
        for node, found in zip(self.open, best, strict=True):
            if found is None:
                continue
            f, cut, gain, rows, sums = found
            self.feature[node], self.cut[node], self.gain[node] = f, cut, gain
            self.left[node] = self.add(rows, sums)
            self.right[node] = self.add([a - b for a, b in zip(self.rows[node], rows)], None if sums is None else [a - b for a, b in zip(self.sums[node], sums)])
            if not last:
                fresh += [x for x in (self.left[node], self.right[node]) if sums is not None or min(self.rows[x]) > 0]
        self.open = fresh

    def paths(self) -> Paths:
        return Paths(*(np.array(x, dtype=np.int32) for x in (self.feature, self.cut, self.left, self.right)))


class Paths:
    """What a row needs to find its node."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.feature, self.cut, self.left, self.right = feature, cut, left, right

    def step(self, layout: Layout, codes: np.ndarray, nodes: np.ndarray) -> None:
        """The rows go from their nodes to the next."""
        n = codes.shape[1]
        turn = (layout.decoded[self.feature] > self.cut[:, None]).astype(np.uint8).ravel()
        offset, to, flat = layout.plane[self.feature] * n, np.stack([self.left, self.right], axis=1).astype(np.int64).ravel(), codes.ravel()
        for start in range(0, len(nodes), CHUNK):
            at = nodes[start:start + CHUNK].astype(np.int64)
            place = offset[at]
            place += np.arange(start, start + len(at))
            code = flat[place]
            np.multiply(at, CELLS, out=place)
            place += code
            at *= 2
            at += turn[place]
            nodes[start:start + CHUNK] = to[at]


def counted(layout: Layout, codes: np.ndarray, label: np.ndarray, nodes: np.ndarray, asked: list[int],
            times: np.ndarray | None = None, residual: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows, and sums of their residuals, by node of ``asked``, class and bin of every feature."""
    m = len(asked)
    local = np.full(max(int(nodes.max(initial=0)), *asked) + 1, -1)
    local[asked] = np.arange(m)
    count, total = np.zeros((m, 2, layout.start[-1])), None if residual is None else np.zeros((m, 2, layout.start[-1]))
    step = max(CHUNK, 8 * m * 2 * CELLS)
    for start in range(0, len(nodes), step):
        part = slice(start, start + step)
        at = local[nodes[part]]
        kept = None if at.min(initial=0) >= 0 else np.flatnonzero(at >= 0)
        which = part
        if kept is not None:
            at, which = at[kept], kept + start
        group = at * 2
        group += label[which]
        weight, extra = (None if x is None else x[which] for x in (times, residual))
        key = np.empty_like(group)
        for p, n in enumerate(layout.cells):
            np.multiply(group, n, out=key)
            key += codes[p][which]
            for out, w in ((count, weight), (total, extra)):
                if out is not None:
                    found = np.bincount(key, weights=w, minlength=m * 2 * n).reshape(m * 2, n)
                    out[:, :, layout.places[p]] += (found @ layout.sums[p]).reshape(m, 2, -1)
    return count, total


def _bins(layout: Layout, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, number among its features, and bin; features of one bin have none."""
    width = np.where(layout.bins > 1, layout.bins, 0)[features]
    return np.nonzero(np.arange(int(layout.bins.max())) < width[:, :, None])


def _places(layout: Layout, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and place in its counts of every bin of its features."""
    node, f, b = _bins(layout, features)
    return node, layout.start[features[node, f]] + b


def best(layout: Layout, setting: dict, weights: np.ndarray, features: np.ndarray, rows: np.ndarray, sums: np.ndarray | None) -> list[tuple | None]:
    """The split of every node by one of its ``features``, the first of the best:
    feature, last bin on the left, gain, rows and sums of the left side; None
    where a node stays whole. Counts come by node, class and bin."""
    m, k = features.shape
    widest = int(layout.bins.max())
    node, f, b = _bins(layout, features)
    place = layout.start[features[node, f]] + b

    def left_of(x):
        out = np.zeros((m, k, widest, 2))
        out[node, f, b] = x[node, :, place]
        return out.cumsum(axis=2)
    left = left_of(rows)
    total = left[:, :, -1:, :]
    right = total - left
    wl, wr, wt = left @ weights, right @ weights, total @ weights
    a = None
    with np.errstate(divide="ignore", invalid="ignore"):
        if sums is None:
            def gini(x, s):
                few, many = x[..., 0] * weights[0] / s, x[..., 1] * weights[1] / s
                return 1.0 - few * few - many * many  # rounded as MLlib does
            gain = gini(total, wt) - wl / wt * gini(left, wl) - wr / wt * gini(right, wr)
        else:
            a = left_of(sums)
            s, t = a @ weights, a[:, :, -1:, :] @ weights
            mean = t * t / wt
            gain = (s * s / wl + (t - s) ** 2 / wr - mean) / wt
            gain[gain <= 1e-13 * (mean / wt)] = 0.0  # what rounding leaves
    least = setting["least"]
    bad = (left.sum(axis=-1) < least) | (right.sum(axis=-1) < least) | ~(gain >= setting["gain"])
    bad |= np.arange(widest) >= (layout.bins[features] - 1)[:, :, None]
    gain[bad] = -np.inf
    flat = gain.reshape(m, -1)
    top = flat.argmax(axis=1)
    out: list[tuple | None] = []
    for i, j in enumerate(top.tolist()):
        at = i, j // widest, j % widest
        out.append((int(features[at[:2]]), at[2], float(gain[at]), left[at].tolist(), None if a is None else a[at].tolist()) if gain[at] > 0 else None)
    return out


def subset(layout: Layout, setting: dict, number: int, level: int, m: int) -> np.ndarray:
    """The features a node may be split by, for ``m`` nodes, in order of their number."""
    k, n = setting["features"], len(layout.bins)
    if k >= n:
        return np.broadcast_to(layout.used, (m, len(layout.used)))
    drawn = np.random.default_rng([setting["seed"], number, level]).random((m, n))
    return np.sort(np.argpartition(drawn, k - 1, axis=1)[:, :k], axis=1)


#: Chances of at most so many of a Poisson number, by its mean.
def _poisson(rate: float) -> np.ndarray:
    term, total, out = math.exp(-rate), 0.0, []
    for i in range(1, 1000):
        total += term
        if total >= 1.0 - 2.0 ** -33:
            break
        out.append(round(total * 2 ** 32))
        term *= rate / i
    return np.array([x for x in out if x < 2 ** 32], dtype=np.uint32)


def bag(setting: dict, number: int, task: int, n: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The rows of a task that one tree is grown on (None: all), and how often each counts."""
    draw = np.random.default_rng([setting["seed"], number, 1 << 20, task])
    if setting["bootstrap"]:
        u, times = draw.integers(0, 1 << 32, n, dtype=np.uint32), np.zeros(n, dtype=np.uint8)
        for most in _poisson(setting["rate"]):
            times += u >= most
        rows = np.flatnonzero(times)
        return rows.astype(np.int32), times[rows]
    if setting["rate"] < 1.0:
        return np.flatnonzero(draw.random(n) < setting["rate"]).astype(np.int32), None
    return None, None


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    x = np.rint(x).astype(np.int64)
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


# ---------------------------------------------------------------- tasks
class Together:
    """Sums over the tasks of a stage, in the order of the tasks. The tasks agree
    on a folder by ``allGather`` (which waits a second each time) and then leave
    each other files in it; a file goes when all have read the one before the next."""

    def __init__(self, context: BarrierTaskContext, base: str):
        self.fs, path = FileSystem.from_uri(base)
        self.task, self.tasks, self.turn, self.old = context.partitionId(), len(context.getTaskInfos()), 0, []
        self.folder = f"{path}/{context.allGather(uuid.uuid4().hex)[0]}"  # another one if the stage is run again
        self.fs.create_dir(self.folder)

    def said(self, mine: bytes) -> Iterator[bytes]:
        """What every task says in this turn, in their order."""
        if self.tasks == 1:
            yield mine
            return
        name = f"{self.folder}/{self.turn}-"
        with self.fs.open_output_stream(f"{name}{self.task}.part") as f:
            f.write(mine)
        self.fs.move(f"{name}{self.task}.part", f"{name}{self.task}")
        for task in range(self.tasks):
            wait = 0.0005
            while self.fs.get_file_info(f"{name}{task}").type == FileType.NotFound:
                time.sleep(wait)
                wait = min(2 * wait, 0.02)
            with self.fs.open_input_stream(f"{name}{task}") as f:
                yield f.read()
        if len(self.old) > 1:  # all have written this turn, so they have read the one before
            self.fs.delete_file(self.old.pop(0))
        self.old.append(f"{name}{self.task}")
        self.turn += 1

    def total(self, arrays: list[np.ndarray]) -> list[np.ndarray]:
        return self.summed(map(pickle.loads, self.said(pickle.dumps(arrays, protocol=5))))

    @staticmethod
    def summed(parts: Iterator[list[np.ndarray]]) -> list[np.ndarray]:
        out = None
        for part in parts:
            out = part if out is None else [np.add(a, b, dtype=float if b.dtype.kind == "f" else np.int64) for a, b in zip(out, part, strict=True)]
        return out

    def worked(self, arrays: list[np.ndarray], work: Callable[[int, np.ndarray], object]) -> list:
        """``work`` on every sum, each done by one of the tasks."""
        mine = range(self.task, len(arrays), self.tasks)
        parts = [pickle.dumps(arrays[i::self.tasks], protocol=5) for i in range(self.tasks)]
        sums = self.summed(pickle.loads(pickle.loads(x)[self.task]) for x in self.said(pickle.dumps(parts, protocol=5)))
        done = {i: work(i, x) for i, x in zip(mine, sums, strict=True)}
        every = reduce(operator.or_, map(pickle.loads, self.said(pickle.dumps(done, protocol=5))))
        return [every[i] for i in range(len(arrays))]


class Rows:
    """The coded rows of a task."""

    def __init__(self, layout: Layout, setting: dict, weights: np.ndarray, codes: np.ndarray, label: np.ndarray, together: Together):
        self.layout, self.setting, self.weights, self.codes, self.label, self.together = layout, setting, weights, codes, label, together

    def forest(self) -> Iterator[Tree]:
        """Trees in groups; those of a group share the messages."""
        s = self.setting
        largest = int(self.together.total([np.bincount([self.together.task], weights=[len(self.label)], minlength=self.together.tasks)])[0].max())
        size = max(1, min(BAGS, MOST // max(1, largest)))
        for first in range(0, s["trees"], size):
            yield from self.group(range(first, min(first + size, s["trees"])))

    def taken(self, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes and labels of some rows."""
        return (self.codes, self.label) if rows is None else (np.stack([c[rows] for c in self.codes]), self.label[rows])

    def group(self, numbers: range) -> list[Tree]:
        s, lay, n = self.setting, self.layout, len(self.label)
        bags = [(*self.taken(rows), times) for rows, times in (bag(s, i, self.together.task, n) for i in numbers)]
        nodes = [np.zeros(len(label), dtype=np.int32) for _, label, _ in bags]
        root = self.together.total([small(np.bincount(label, weights=times, minlength=2)) for _, label, times in bags])
        trees = [Tree(x.astype(float).tolist()) for x in root]
        for level in range(s["depth"]):
            live = [i for i, t in enumerate(trees) if t.open]
            asked, sent = [], []
            for i in live:
                features = subset(lay, s, numbers[i], level, len(trees[i].open))
                codes, label, times = bags[i]
                found, _ = counted(lay, codes, label, nodes[i], trees[i].open, times)
                node, place = _places(lay, features)
                asked.append((features, node, place))
                sent.append(small(found[node, :, place]))

            def split(i: int, some: np.ndarray, asked=asked):
                features, node, place = asked[i]
                rows = np.zeros((len(features), 2, lay.start[-1]))
                rows[node, :, place] = some
                return best(lay, s, self.weights, features, rows, None)
            for i, found in zip(live, self.together.worked(sent, split) if live else [], strict=True):
                trees[i].grow(found, level == s["depth"] - 1)
                if trees[i].open:
                    trees[i].paths().step(lay, bags[i][0], nodes[i])
        return trees

    def boosted(self) -> tuple[list[Tree], list[np.ndarray]]:
        """Trees one after the other, each on what the margins of those before
        leave of the labels 1 and -1 (logistic loss; the first on the labels), and
        the sums of squares of the residuals by leaf and class. Of two siblings the
        smaller is counted; the other is what remains of their parent."""
        s, lay, n = self.setting, self.layout, len(self.label)
        y, margin, out, squares = self.label * 2.0 - 1.0, np.zeros(n), [], []
        for number in range(s["trees"]):
            residual = y if number == 0 else _residual(y, margin)
            sample, _ = bag(s, number, self.together.task, n)
            some = slice(None) if sample is None else sample
            codes, label = self.taken(sample)
            nodes, tree, held = np.zeros(n, dtype=np.int32), None, {}
            for level in range(s["depth"]):
                if tree is not None and not tree.open:
                    break
                pairs = [] if tree is None else [(p, *sorted((tree.left[p], tree.right[p]), key=lambda x: sum(tree.rows[x]))) for p in held if tree.feature[p] >= 0]
                asked = [x for _, x, _ in pairs] or [0]
                rows, sums = counted(lay, codes, label, nodes[some], asked, None, residual[some])
                rows, sums = self.together.total([small(rows), sums])
                few = dict(zip(asked, zip(rows.astype(float), sums, strict=True), strict=True))
                if tree is None:
                    tree = Tree(*(_whole(lay, x) for x in few[0]))
                held = few | {b: (held[p][0] - few[a][0], held[p][1] - few[a][1]) for p, a, b in pairs}
                features = subset(lay, s, number, level, len(tree.open))
                counts = (np.stack([held[x][i] for x in tree.open]) for i in (0, 1))
                tree.grow(best(lay, s, self.weights, features, *counts), level == s["depth"] - 1)
                tree.paths().step(lay, self.codes, nodes)
            with np.errstate(divide="ignore", invalid="ignore"):
                value = (np.array(tree.sums) @ self.weights) / (np.array(tree.rows) @ self.weights)
            squares.append(np.bincount(nodes[some] * 2 + label, weights=residual[some] ** 2, minlength=2 * len(value)).astype(float))  # a task without rows: whole numbers otherwise
            margin += (1.0 if number == 0 else s["step"]) * value[nodes]
            out.append(tree)
        return out, self.together.total(squares)


def _residual(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    out = 2.0 * y
    out *= margin
    with np.errstate(over="ignore"):
        np.exp(out, out=out)
    out += 1.0
    return np.divide(4.0 * y, out, out=out)


def _whole(layout: Layout, one: np.ndarray) -> list[float]:
    """Sums of a node by class, from the bins of any feature."""
    f = layout.used[0]
    return one[:, layout.start[f]:layout.start[f + 1]].sum(axis=1).tolist()


# ---------------------------------------------------------------- MLlib's file format
NODE = ("struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, "
        "rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


ARROW = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
    ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])


def nodes(tree: Tree, squares: np.ndarray | None, weights: np.ndarray, thresholds: list[np.ndarray]) -> list[dict]:
    """The nodes of one tree from the root, left before right; two leaves of one
    prediction become one."""
    n = len(tree.feature)
    rows = np.array(tree.rows)
    weight = rows * weights
    if squares is None:
        stats = weight
        prediction = stats.argmax(axis=1).astype(float)
        impurity = 1.0 - ((stats / stats.sum(axis=1, keepdims=True)) ** 2).sum(axis=1)
    else:
        square = squares.reshape(n, 2) @ weights
        for i in range(n - 1, -1, -1):  # children come after their parent
            if tree.feature[i] >= 0:
                square[i] = square[tree.left[i]] + square[tree.right[i]]
        stats = np.stack([weight.sum(axis=1), np.array(tree.sums) @ weights, square], axis=1)
        prediction = stats[:, 1] / stats[:, 0]
        impurity = np.maximum(stats[:, 2] - stats[:, 1] * prediction, 0.0) / stats[:, 0]
    whole = [f < 0 for f in tree.feature]
    for i in range(n - 1, -1, -1):
        left, right = tree.left[i], tree.right[i]
        whole[i] = whole[i] or (whole[left] and whole[right] and prediction[left] == prediction[right])
    out: list[dict] = []
    todo = [(0, None, "")]
    while todo:
        i, parent, side = todo.pop()
        if parent is not None:
            out[parent][side] = len(out)
        f, cut = (-1, []) if whole[i] else (tree.feature[i], [float(thresholds[tree.feature[i]][tree.cut[i]])])
        if not whole[i]:
            todo += [(tree.right[i], len(out), "rightChild"), (tree.left[i], len(out), "leftChild")]
        out.append({"id": len(out), "prediction": float(prediction[i]), "impurity": float(impurity[i]), "impurityStats": stats[i].tolist(),
                    "rawCount": round(rows[i].sum()), "gain": -1.0 if whole[i] else tree.gain[i], "leftChild": -1, "rightChild": -1,
                    "split": {"featureIndex": f, "leftCategoriesOrThreshold": cut, "numCategories": -1}})
    return out


def _setting(est, features: int) -> dict:
    boosts = isinstance(est, GBTClassifier)
    value = est.getOrDefault
    strategy, n = value("featureSubsetStrategy"), features
    if strategy == "auto":
        strategy = "all" if boosts or value("numTrees") == 1 else "sqrt"
    if strategy in ("all", "sqrt", "log2", "onethird"):
        k = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}[strategy]
    else:
        k = min(n, int(strategy)) if strategy.isdigit() and strategy != "1" else math.ceil(float(strategy) * n)
    return {"boosts": boosts, "trees": value("maxIter" if boosts else "numTrees"), "depth": value("maxDepth"), "least": value("minInstancesPerNode"),
            "gain": value("minInfoGain"), "features": k, "rate": value("subsamplingRate"), "seed": value("seed"), "bins": value("maxBins"),
            "bootstrap": not boosts and value("bootstrap"), "step": value("stepSize") if boosts else 1.0}


def _classes(t: DataFrame, est) -> dict[int, tuple[int, float]]:
    """Rows and weight of each class; none where a class has several weights."""
    label, weight = F.col(est.getLabelCol()).cast("double"), F.col(est.getWeightCol())
    found = t.groupBy(label.alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min(weight).alias("a"), F.max(weight).alias("b"),
                                            F.count_if(weight.isNull()).alias("missing")).limit(3).collect()
    good = {r["y"] for r in found} == {0.0, 1.0} and all(r["a"] == r["b"] and r["a"] > 0 and not r["missing"] for r in found)
    return {int(r["y"]): (r["n"], float(r["a"])) for r in found} if good else {}


def suits(est) -> bool:
    """Whether :func:`grown` knows this estimator and its parameters."""
    known = (isinstance(est, RandomForestClassifier) and est.getImpurity() == "gini") or (isinstance(est, GBTClassifier) and not est.isSet("validationIndicatorCol"))
    return known and est.isSet("weightCol") and est.getMaxBins() <= CELLS and est.getMinWeightFractionPerNode() == 0.0 and est.getMaxDepth() > 0


def _sample(t: DataFrame, est, rows: int, classes: dict[int, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray, float]:
    """The rows MLlib takes to find its cuts, their weights, and the weight they stand for."""
    spark = t.sparkSession
    part = t.select(vector_to_array(est.getFeaturesCol()).alias("x"), F.col(est.getLabelCol()).cast("int").alias("y"))
    most, share = max(est.getMaxBins() ** 2, 10_000), 1.0
    if most < rows:
        share = most / rows
        seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(est.getSeed()).nextInt()
        drawn_rows = part._jdf.toJavaRDD().sample(False, share, seed)
        part = DataFrame(spark._jsparkSession.createDataFrame(drawn_rows, part._jdf.schema()), spark)
    got = part.toArrow().combine_chunks()  # about ``most`` rows
    y = got.column("y").to_numpy()
    x = _matrix(got.column("x").combine_chunks()) if len(y) else np.zeros((0, 0))
    return x, np.where(y == 1, classes[1][1], classes[0][1]), share * sum(n * w for n, w in classes.values())


def _matrix(column) -> np.ndarray:
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of rows as one row each: the bytes of the codes and of the labels."""
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = layout.codes(_matrix(b.column(0)))
                yield pa.record_batch([pa.array([codes.tobytes()], pa.binary()), pa.array([b.column(1).to_numpy().astype(np.uint8).tobytes()], pa.binary())],
                                      names=["codes", "label"])
    return coded


def growing(layout: Layout, setting: dict, weights: np.ndarray, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task of the barrier stage; each gives out the nodes of some of the trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, label = [np.zeros((len(layout.packed), 0), dtype=np.uint8)], [np.zeros(0, dtype=np.uint8)]
        for b in batches:
            for c, y in zip(b.column(0), b.column(1), strict=True):
                label.append(np.frombuffer(y.as_py(), dtype=np.uint8))
                codes.append(np.frombuffer(c.as_py(), dtype=np.uint8).reshape(len(layout.packed), -1))
        codes, label = np.concatenate(codes, axis=1), np.concatenate(label)
        context = BarrierTaskContext.get()
        rows = Rows(layout, setting, weights, codes, label, Together(context, folder))
        trees, squares = rows.boosted() if setting["boosts"] else (rows.forest(), None)
        for i, tree in enumerate(trees):
            if i % rows.together.tasks == context.partitionId():
                found = nodes(tree, None if squares is None else squares[i], weights, layout.thresholds)
                yield pa.record_batch([pa.array([i] * len(found), pa.int32()), pa.array(found, ARROW)], names=["treeID", "nodeData"])
    return run


def _tasks(spark, rows: int) -> int:
    """Tasks of the stage, which must all run at one time."""
    context = spark.sparkContext._jsc.sc()
    return max(1, min(rows // LEAST, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())))


def _folder(spark) -> str | None:
    """A new folder that the tasks share, if they can open files there."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/grown-{uuid.uuid4().hex[:12]}"
    try:
        fs, path = FileSystem.from_uri(base)
        fs.create_dir(path)
    except (OSError, ValueError, pa.ArrowException):
        return None
    return base


def grown(t: DataFrame, est):
    """The fitted model of ``est`` on ``t``; None where it is MLlib's to fit: fewer
    than ``LARGE`` rows, odd labels or weights, other parameters, a checkpoint
    folder that only Spark can open, or executors that come and go."""
    spark = t.sparkSession
    if not suits(est) or spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true" or not (classes := _classes(t, est)):
        return None
    if (rows := sum(n for n, _ in classes.values())) < LARGE:
        return None
    x, weights, total = _sample(t, est, rows, classes)
    setting = _setting(est, x.shape[1])
    layout = Layout([cuts(x[:, f], weights, total, min(setting["bins"], rows)) for f in range(x.shape[1])])
    if not layout.packed or not (folder := _folder(spark)):
        return None
    coded = t.select(vector_to_array(est.getFeaturesCol()), F.col(est.getLabelCol()).cast("int")).mapInArrow(blocks(layout), "codes binary, label binary")
    grow = growing(layout, setting, np.array([classes[0][1], classes[1][1]]), f"{folder}/messages")
    coded.repartition(_tasks(spark, rows)).mapInArrow(grow, f"treeID int, nodeData {NODE}", barrier=True).write.parquet(f"{folder}/data")
    fs, path = FileSystem.from_uri(f"{folder}/messages")
    fs.delete_dir(path)
    return _loaded(spark, est, folder, setting, x.shape[1])


def _loaded(spark, est, path: str, setting: dict, features: int):
    boosts = setting["boosts"]
    model = GBTClassificationModel if boosts else RandomForestClassificationModel
    tree = "regression.DecisionTreeRegressionModel" if boosts else "classification.DecisionTreeClassificationModel"

    def metadata(kind: str, uid: str, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid, "paramMap": {}, "defaultParamMap": {}} | more)
    own, usual = ({p.name: v for p, v in x.items()} for x in (est._paramMap, est._defaultParamMap))
    of = metadata(f"classification.{model.__name__}", est.uid, paramMap=own, defaultParamMap=usual, numFeatures=features, numTrees=setting["trees"], **({} if boosts else {"numClasses": 2}))
    spark.createDataFrame([(of,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(i, metadata(tree, f"{est.uid}_{i}"), setting["step"] if boosts and i else 1.0) for i in range(setting["trees"])]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    return est._copyValues(model.load(path))
