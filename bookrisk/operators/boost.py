"""Boosted trees whose leaves carry L1, L2, a gain floor and a least Hessian sum.

MLlib grows the trees; it knows no penalty on leaf values. :func:`refit` goes
through the trees in their order: with p the probability of the trees before,
one grouped sum of gradients g = w (p - y) and Hessians h = w p (1 - p) per
leaf gives the value -soft(G, l1) / (H + l2), soft(G, l1) being G moved towards
0 by l1. A split whose gain soft(GL)^2 / (HL + l2) + soft(GR)^2 / (HR + l2) -
soft(G)^2 / (H + l2) is below the floor, or with a side of less than
``min_child`` Hessian sum, is undone from the leaves upwards: its leaves get
the value of their parent. Values are multiplied by the rate; the margin
starts at 0 (a probability of one half). All rows take part in every refit,
also where MLlib grew a tree on a part of them.

A tree costs one aggregation without a shuffle of rows (at most 2^depth sums
come back). Rows are stored with the leaf numbers of the next ``BLOCK`` trees
apart from those of the later ones, so that a pass reads one block's numbers
and the margin; the margin moves on when a block is done.

Null labels or weights leave a row out; a leaf without rows has the value 0;
without rows every value is 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookrisk.functions.columns import risk_level
from bookrisk.operators import train as TR
from bookrisk.session import ensure_checkpoint_dir

BLOCK = 25

# ---------------------------------------------------------------------------
# Fixed values (penalties of the three published groups of settings)
# ---------------------------------------------------------------------------
PENALTIES = {
    "script": {"l1": 0.0, "l2": 1.0},
    "pipeline": {"l1": 0.0, "l2": 1.0},
    "notebook": {"l1": 0.1, "l2": 2.0},
}

#: A tree: the number of its leaf, or its left and right part.
Shape = int | tuple


def shape(text: str) -> Shape:
    """The form of a tree from MLlib's description, leaves numbered from the left."""
    lines = iter([x.strip() for x in text.splitlines() if x.strip().startswith(("If", "Else", "Predict"))])
    number = iter(range(len(text)))

    def part(rows: Iterator[str]) -> Shape:
        if next(rows).startswith("Predict"):
            return next(number)
        left = part(rows)
        next(rows)  # the line of the other side
        return left, part(rows)
    return part(lines)


def leaves(tree: Shape) -> list[int]:
    return [tree] if isinstance(tree, int) else leaves(tree[0]) + leaves(tree[1])


def soft(g: float, l1: float) -> float:
    return max(0.0, abs(g) - l1) * (1 if g > 0 else -1)


def settle(tree: Shape, sums: dict[int, tuple[float, float]], l1: float, l2: float, gain: float, min_child: float) -> list[float]:
    """The value of every leaf of one tree from the sums (G, H) of its leaves."""
    value: dict[int, float] = {}

    def quality(g: float, h: float) -> float:
        return soft(g, l1) ** 2 / (h + l2) if h + l2 > 0 else 0.0

    def up(part: Shape) -> tuple[float, float, bool]:
        if isinstance(part, int):
            g, h = sums.get(part, (0.0, 0.0))
            whole = True
        else:
            (gl, hl, wl), (gr, hr, wr) = up(part[0]), up(part[1])
            g, h = gl + gr, hl + hr
            won = quality(gl, hl) + quality(gr, hr) - quality(g, h)
            whole = wl and wr and (won < gain or min(hl, hr) < min_child)
        if whole:  # nothing below is split: one value for all its leaves
            v = -soft(g, l1) / (h + l2) if h + l2 > 0 else 0.0
            value.update(dict.fromkeys(leaves(part), v))
        return g, h, whole
    up(tree)
    return [value[i] for i in range(len(value))]


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def _picked(values: list[list[float]], leaf: str) -> Column:
    """Sum of the leaf values of the trees whose numbers start ``leaf``."""
    one = [f"array({', '.join(f'{v!r}D' for v in tree)})[{leaf}[{i}]]" for i, tree in enumerate(values)]
    return F.expr(" + ".join(one)) if one else F.lit(0.0)


def refit(rows: DataFrame, trees: list[Shape], rate: float, l1: float = 0.0, l2: float = 1.0, gain: float = 0.0,
          min_child: float = 1.0) -> list[list[float]]:
    """Leaf values of every tree. ``rows``: leaf (array of leaf numbers, one
    for each tree), No_Show, weight."""
    spark = rows.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/boost-{uuid.uuid4().hex[:12]}"
    leaf = F.col("leaf").cast("array<smallint>")
    table = rows.where("No_Show is not null and weight is not null").select(
        F.col("No_Show").cast("double").alias("y"), F.col("weight").cast("double").alias("w"), F.lit(0.0).alias("margin"),
        F.slice(leaf, 1, BLOCK).alias("now"), F.slice(leaf, BLOCK + 1, len(trees)).alias("later"))
    out: list[list[float]] = []
    for start in range(0, len(trees), BLOCK):
        table.write.parquet(f"{base}-{start}")
        table = spark.read.parquet(f"{base}-{start}")
        block: list[list[float]] = []
        for i, tree in enumerate(trees[start:start + BLOCK]):
            p = probability(F.col("margin") + _picked(block, "now"))
            g = table.select(F.col("now")[i].alias("leaf"), "y", "w", p.alias("p")).groupBy("leaf").agg(
                F.sum(F.col("w") * (F.col("p") - F.col("y"))).alias("g"), F.sum(F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h"))
            sums = {r["leaf"]: (r["g"], r["h"]) for r in g.collect()}  # a row per leaf
            block.append([rate * v for v in settle(tree, sums, l1, l2, gain, min_child)])
        out += block
        table = table.select("y", "w", (F.col("margin") + _picked(block, "now")).alias("margin"),
                             F.slice("later", 1, BLOCK).alias("now"), F.slice("later", BLOCK + 1, len(trees)).alias("later"))
    return out


class Boosted:
    """Trees of a saved MLlib pipeline (``leaf`` column) and their leaf values."""

    def __init__(self, model: PipelineModel, values: list[list[float]]):
        self.model, self.values = model, values

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/trees")
        SparkSession.active().createDataFrame(list(enumerate(self.values)), "tree int, value array<double>").write.mode("overwrite").parquet(f"{path}/values")

    @classmethod
    def load(cls, spark, path: str) -> Boosted:
        rows = spark.read.parquet(f"{path}/values").orderBy("tree").collect()  # a row per tree
        return cls(PipelineModel.load(f"{path}/trees"), [list(r["value"]) for r in rows])

    def margin(self, feats: DataFrame) -> DataFrame:
        """``feats`` with the column ``margin``: a map over the rows, the leaf
        values being one row that is sent to every task (trees x 2^depth numbers)."""
        spark = feats.sparkSession
        one = spark.createDataFrame([(self.values,)], "_values array<array<double>>")
        d = self.model.transform(feats).withColumn("_leaf", vector_to_array("leaf").cast("array<int>")).crossJoin(F.broadcast(one))
        total = F.aggregate(F.zip_with("_leaf", "_values", lambda i, v: F.get(v, i)), F.lit(0.0), lambda a, x: a + x)
        return d.withColumn("margin", total).select(*feats.columns, "margin")

    def score(self, feats: DataFrame, keep: tuple[str, ...] = ("Booking_ID",)) -> DataFrame:
        extra = [c for c in ("No_Show",) if c in feats.columns]
        p = probability(F.col("margin"))
        return self.margin(feats).select(*keep, *extra, p.alias("no_show_probability"), risk_level(p).alias("risk_level"))


def grown(kept: DataFrame, settings: str = "script", trees: int | None = None) -> tuple[PipelineModel, DataFrame]:
    """MLlib's trees with the published depth, rate, parts of rows and columns
    (no gain floor: splits are undone by the refit), and the weighted rows.
    ``kept``: rows of :func:`train.prepared`."""
    t, weight_sum = TR.weighted(kept, "gbt", settings)
    stages = TR.estimator("gbt", weight_sum, settings, trees)
    stages[-1].setMinInfoGain(0.0).setParams(leafCol="leaf")
    return TR.fitted(t, stages), t


def grow(train: DataFrame, settings: str = "script", trees: int | None = None) -> tuple[PipelineModel, DataFrame]:
    """:func:`grown` on feature columns, which the weighted rows have too."""
    with TR.prepared(train) as (kept, _):
        return grown(kept, settings, trees)[0], TR.weighted(train, "gbt", settings)[0]


def refitted(kept: DataFrame, settings: str = "script", trees: int | None = None) -> Boosted:
    """:func:`fit` on rows of :func:`train.prepared`, which several groups may share."""
    model, t = grown(kept, settings, trees)
    s, penalties = TR.SETTINGS[settings]["gbt"], PENALTIES[settings]
    forms = [shape(x.toDebugString) for x in model.stages[-1].trees]
    rows = model.stages[-1].transform(t).select("No_Show", "weight", vector_to_array("leaf").alias("leaf"))
    return Boosted(model, refit(rows, forms, s["rate"], gain=s["gamma"], min_child=s["min_child"], **penalties))


def fit(train: DataFrame, settings: str = "script", trees: int | None = None) -> Boosted:
    """Grow and refit with the settings of one published group; ``trees``
    takes the place of the published number."""
    with TR.prepared(train) as (kept, _):
        return refitted(kept, settings, trees)
