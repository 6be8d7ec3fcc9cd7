"""Model training and serving with MLlib.

One feature function serves training and scoring (the frozen level list
fixes the one-hot layout, unseen levels encode as all zeros), and the
vector layout lives inside the saved ``PipelineModel``. Class balance is a
weight column; the sklearn ``C`` maps to ``regParam = 1 / (C * sum(w))``
because Spark minimises the weighted *mean* loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.functions.columns import risk_level
from bookrisk.operators import features as FE
from bookrisk.operators import metrics as M
from bookrisk.operators.grow import grown
from bookrisk.sources import schema as S

LEVELS = {"Service_Type": sorted(S.SERVICES), "Branch": sorted(S.BRANCHES), "Payment_Method": sorted(S.PAYMENTS),
          "Day_of_Week": sorted(S.DAYS)}
BASE_FEATURES = ["Customer_Latent_Risk"] + S.ENGINEERED + FE.one_hot_names(LEVELS)
SEED = 42


def feature_table(bookings: DataFrame, with_target: bool = True) -> DataFrame:
    """Booking_ID, the base feature columns and (optionally) No_Show."""
    f = FE.build_features(bookings, LEVELS, with_target=with_target)
    cols = ["Booking_ID", *BASE_FEATURES] + (["No_Show"] if with_target else [])
    return FE.align_columns(f, cols).withColumns({c: F.col(f"`{c}`").cast("double") for c in BASE_FEATURES})


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=BASE_FEATURES, outputCol="features", handleInvalid="keep")


# ---------------------------------------------------------------------------
# Fixed values (the three published groups of model settings)
# ---------------------------------------------------------------------------
SETTINGS = {
    "script": {
        "lr": {"C": 1.0},
        "dt": {"depth": 8, "min_leaf": 1},
        "rf": {"trees": 200, "depth": 10, "min_leaf": 1},
        "gbt": {"trees": 200, "depth": 6, "rate": 0.1, "rows": 1.0, "columns": 1.0, "min_child": 1, "gamma": 0.0, "weighted": True},
    },
    "pipeline": {
        "lr": {"C": 0.5},
        "dt": {"depth": 8, "min_leaf": 50},
        "rf": {"trees": 300, "depth": 12, "min_leaf": 20},
        "gbt": {"trees": 400, "depth": 6, "rate": 0.05, "rows": 0.8, "columns": 0.8, "min_child": 5, "gamma": 0.1, "weighted": False},
    },
    "notebook": {
        "lr": {"C": 1.0},
        "dt": {"depth": 8, "min_leaf": 50},
        "rf": {"trees": 500, "depth": 12, "min_leaf": 20},
        "gbt": {"trees": 500, "depth": 5, "rate": 0.03, "rows": 0.8, "columns": 0.7, "min_child": 10, "gamma": 0.2, "weighted": True},
    },
}


#: Rows times trees up to which a forest keeps the node of every row in every
#: tree (4 bytes each, two or three versions); beyond, rows go down the trees again at each level.
NODE_IDS = 500_000_000


def estimator(kind: str, weight_sum: float = 1.0, settings: str = "script", trees: int | None = None, rows: int | None = None):
    """The stages of one of the four classifiers in MLlib terms: ``C`` is
    ``regParam`` = 1 / (C * weight sum); the gain floor ``gamma``, a sum over
    the rows, is ``minInfoGain`` = gamma / weight sum; columns are drawn per
    node and ``min_child`` counts rows; ``trees`` takes the place of the published
    number. There is no L1 / L2 on leaf values. With the number of ``rows`` a
    forest keeps node numbers up to ``NODE_IDS``, which changes its time only."""
    if kind not in SETTINGS[settings]:
        raise ValueError(f"unknown model kind {kind!r}")
    s = SETTINGS[settings][kind] | ({"trees": trees} if trees else {})
    common = {"labelCol": "No_Show", "weightCol": "weight"}
    if kind == "lr":
        # scaling is a stage of the LR pipeline only
        return [StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                LogisticRegression(featuresCol="scaled", maxIter=1000, regParam=1.0 / (s["C"] * weight_sum),
                                   elasticNetParam=0.0, standardization=False, **common)]
    if kind == "dt":
        return [DecisionTreeClassifier(maxDepth=s["depth"], minInstancesPerNode=s["min_leaf"], seed=SEED, **common)]
    if kind == "rf":
        return [RandomForestClassifier(numTrees=s["trees"], maxDepth=s["depth"], minInstancesPerNode=s["min_leaf"],
                                       cacheNodeIds=rows is not None and rows * s["trees"] <= NODE_IDS, checkpointInterval=-1,
                                       featureSubsetStrategy="sqrt", seed=SEED, **common)]
    columns = "all" if s["columns"] == 1.0 else str(s["columns"])
    return [GBTClassifier(maxIter=s["trees"], maxDepth=s["depth"], stepSize=s["rate"], subsamplingRate=s["rows"],
                          featureSubsetStrategy=columns, minInstancesPerNode=s["min_child"],
                          minInfoGain=s["gamma"] / weight_sum, seed=SEED, **common)]


def weighted(train: DataFrame, kind: str, settings: str = "script") -> tuple[DataFrame, float]:
    """Training rows with the weight column, and the weight sum. LR, tree and
    forest use balanced weights; boosting weights positives by n0/n1 or not at all."""
    cw = M.class_weights(train).first()  # one aggregate row
    n0, n1 = int(cw["n0"]), int(cw["n1"])
    if kind == "gbt":
        pw = n0 / n1 if n1 and SETTINGS[settings]["gbt"]["weighted"] else 1.0
        t = train.withColumn("weight", F.when(F.col("No_Show") == 1, F.lit(pw)).otherwise(F.lit(1.0)))
        return t, n0 + pw * n1
    return M.with_class_weight(train, M.class_weights(train)), float(n0 + n1)


#: Rows of one task of a fit, and the fewest rows that are worth one.
TASK_ROWS, LEAST_ROWS = 250_000, 10_000


def spread(train: DataFrame, rows: int) -> DataFrame:
    """``train`` in tasks of at most about ``TASK_ROWS`` of its ``rows``, and on
    every core where there are ``LEAST_ROWS`` for each: the files of a table
    are fewer than the cores and grow with it."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    tasks = min(max(cores, -(-rows // TASK_ROWS)), rows // LEAST_ROWS)
    return train.repartition(tasks) if tasks > 1 else train


@contextmanager
def prepared(train: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """Vectors and labels of ``train``, dealt out by :func:`spread`, and their
    number. They stay on the executors' disks until the block ends: MLlib reads
    its rows four times or more, each a shuffle of every column otherwise."""
    rows = train.count()
    kept = _assembler().transform(spread(train, rows)).select("features", "No_Show").persist(StorageLevel.DISK_ONLY)
    try:
        yield kept, rows
    finally:
        kept.unpersist()


def fit(train: DataFrame, kind: str, settings: str = "script", weight: float | None = None,
        trees: int | None = None) -> PipelineModel:
    """Fit with the weights of :func:`weighted`, or with ``weight`` for every row."""
    with prepared(train) as (kept, rows):
        t, wsum = weighted(kept, kind, settings) if weight is None else (kept.withColumn("weight", F.lit(weight)), weight * rows)
        return fitted(t, estimator(kind, wsum, settings, trees, rows))


def fitted(t: DataFrame, stages: list) -> PipelineModel:
    """The fit of ``stages`` on prepared, weighted rows, to be applied to feature
    columns; a forest or boosting of many rows is grown by :func:`grow.grown`."""
    model = grown(t, stages[0])
    return PipelineModel([_assembler(), *([model] if model else Pipeline(stages=stages).fit(t).stages)])


def score(model: PipelineModel, feats: DataFrame, keep: list[str] = ("Booking_ID",), places: int | None = 4) -> DataFrame:
    """Probability rounded to ``places`` (None: as it is); level from the unrounded value."""
    out = model.transform(feats)
    p1 = vector_to_array(F.col("probability")).getItem(1)
    extra = [c for c in ("No_Show",) if c in feats.columns]
    return out.select(*keep, *extra, (p1 if places is None else F.bround(p1, places)).alias("no_show_probability"), risk_level(p1).alias("risk_level"))


def coefficients(spark, model: PipelineModel) -> DataFrame:
    """(feature, coefficient, abs) of the LR stage, in vector order (one
    row per feature: the model itself is small)."""
    lr = model.stages[-1]
    rows = [(f, float(c), abs(float(c))) for f, c in zip(BASE_FEATURES, lr.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, coefficient double, importance double")


def evaluate_model(name: str, scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of test metrics for a scored test set."""
    s = scored.select(F.lit(name).alias("model"), F.col("no_show_probability").alias("score"),
                      F.col("No_Show").alias("label"))
    return M.confusion_with_auc(s, threshold)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
