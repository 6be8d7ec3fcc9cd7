"""Model evaluation on a long score table ``(model, Booking_ID, score, label[, split])``.

Threshold metrics are one conditional aggregate per group. Curves and AUC
use the scores as they are: rows are counted by (model, score), the counts cut
into ranges of the score, and totals run on two levels, inside a range and
over the ranges. A task holds one range of distinct scores, also of a model
with a score per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookrisk.operators.quantiles import in_ranges
from bookrisk.operators.split import stratified

MODEL_ORDER = ["lr", "dt", "rf", "xgb", "gbt", "ensemble"]


def model_rank(model: Column) -> Column:
    """Position of a model in the fixed listing order (first wins ties)."""
    return F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), model), F.lit(999)).cast("int")


# ------------------------------------------------------------------ splits
def split_two(df: DataFrame, key: str = "Booking_ID", test: float = 0.20, salt: str = "split", label: str = "No_Show") -> DataFrame:
    """80/20 split, stratified to the row (:func:`stratified`)."""
    return stratified(df, {"test": test}, key=key, label=label, salt=salt)


def split_three(df: DataFrame, key: str = "Booking_ID", val: float = 0.20, test: float = 0.20,
                salt: str = "split", label: str = "No_Show") -> DataFrame:
    """60/20/20 train / val / test by the same order (test is the same rows
    as in :func:`split_two` when the test share is equal)."""
    return stratified(df, {"test": test, "val": val}, key=key, label=label, salt=salt)


def split_rates(df: DataFrame, label: str = "No_Show") -> DataFrame:
    """Rows and positive rate per split (the stratification check)."""
    return df.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                   F.avg(label).alias("target_rate"))


# ------------------------------------------------------------------ preprocessing
def fit_standard_scaler(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population std per column; a zero std becomes 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    one = train.agg(*aggs)
    return one.withColumns({f"{c}__std": F.when(F.col(f"{c}__std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__std"))
                            for c in cols})


def apply_standard_scaler(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / std with the one-row parameter table broadcast."""
    j = df.crossJoin(F.broadcast(params))
    j = j.withColumns({c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in cols})
    return j.drop(*[f"{c}__{s}" for c in cols for s in ("mean", "std")])


def class_weights(train: DataFrame, label: str = "No_Show") -> DataFrame:
    """Balanced weights n / (2 n_class) and the positive weight n0/n1 (round 2);
    the weight of a class without rows, and what divides by it, is null."""
    g = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("n0"),
                  F.count_if(F.col(label) == 1).alias("n1"))
    return g.select(F.col("n").cast("bigint"), F.col("n0").cast("bigint"), F.col("n1").cast("bigint"),
                    (F.col("n") / (2.0 * F.nullif("n0", F.lit(0)))).alias("w0"),
                    (F.col("n") / (2.0 * F.nullif("n1", F.lit(0)))).alias("w1"),
                    F.bround(F.col("n0") / F.nullif("n1", F.lit(0)), 2).alias("pos_weight"))


def with_class_weight(df: DataFrame, weights: DataFrame, label: str = "No_Show", out: str = "weight") -> DataFrame:
    w = weights.select("w0", "w1")
    return (df.crossJoin(F.broadcast(w))
            .withColumn(out, F.when(F.col(label) == 1, F.col("w1")).otherwise(F.col("w0"))).drop("w0", "w1"))


# ------------------------------------------------------------------ score tables
def long_scores(df: DataFrame, score_cols: dict[str, str], label: str = "No_Show",
                keep: list[str] = ("Booking_ID", "split")) -> DataFrame:
    """Wide ``score_<m>`` columns -> (model, keep..., score, label)."""
    keep = [k for k in keep if k in df.columns]
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score"))
                    for m, c in score_cols.items()])
    return df.select(*keep, F.col(label).cast("int").alias("label"), F.explode(arr).alias("_s")) \
        .select("_s.model", *keep, "_s.score", "label")


def ensemble_soft_vote(df: DataFrame, cols: list[str], out: str = "score_ensemble", places: int | None = 4) -> DataFrame:
    """Mean of the scores, rounded to ``places`` (None: as it is)."""
    mean = sum((F.col(c) for c in cols), F.lit(0.0)) / F.lit(float(len(cols)))
    return df.withColumn(out, mean if places is None else F.bround(mean, places))


# ------------------------------------------------------------------ threshold metrics
def confusion(df: DataFrame, threshold: Column | float = 0.5, by: list[str] = ("model",)) -> DataFrame:
    """tp/fp/tn/fn and accuracy, precision (0 when undefined), recall, F1 (round 4)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col("score") >= t
    pos = F.col("label") == 1
    g = df.groupBy(*by).agg(F.count_if(pred & pos).cast("bigint").alias("tp"),
                            F.count_if(pred & ~pos).cast("bigint").alias("fp"),
                            F.count_if(~pred & ~pos).cast("bigint").alias("tn"),
                            F.count_if(~pred & pos).cast("bigint").alias("fn"))
    return with_rates(g)


def with_rates(g: DataFrame, places: int = 4) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return g.withColumns({
        "accuracy": F.bround((tp + tn) / n, places),
        "precision": F.when(tp + fp == 0, F.lit(0.0)).otherwise(F.bround(tp / (tp + fp), places)),
        "recall": F.when(tp + fn == 0, F.lit(0.0)).otherwise(F.bround(tp / (tp + fn), places)),
        "f1": F.when(2 * tp + fp + fn == 0, F.lit(0.0)).otherwise(F.bround(2 * tp / (2 * tp + fp + fn), places)),
    })


def score_counts(df: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """(by..., score, pos, neg), one row per distinct score."""
    return df.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).cast("bigint").alias("pos"),
                                        F.count_if(F.col("label") != 1).cast("bigint").alias("neg"))


def cumulative(counts: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Per distinct score (descending): rows scored >= it, and class totals."""
    falling = F.col("score").desc_nulls_last()
    counts = in_ranges(counts, *by, falling)
    group = Window.partitionBy(*[f"_g{i}" for i in range(len(by))])
    sums = counts.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_r").alias("_gr")).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    ahead = group.orderBy("_gr")
    totals = sums.select(*[f"_g{i}" for i in range(len(by))], "_gr", (F.sum("_p").over(ahead) - F.col("_p")).alias("_tp"),
                         (F.sum("_n").over(ahead) - F.col("_n")).alias("_fp"), F.sum("_p").over(group).alias("P"), F.sum("_n").over(group).alias("N"))
    inside = Window.partitionBy(*by, "_r").orderBy(falling).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_r") == F.col("_gr")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    run = counts.withColumns({"_itp": F.sum("pos").over(inside), "_ifp": F.sum("neg").over(inside)}).join(totals, same)
    return run.withColumns({"tp": F.col("_itp") + F.col("_tp"), "fp": F.col("_ifp") + F.col("_fp")}).drop(
        "_r", "_gr", "_itp", "_ifp", "_tp", "_fp", *[f"_g{i}" for i in range(len(by))])


def roc_auc(df: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Area under ROC with ties counted half (Mann-Whitney); 0.5 when all
    scores are equal, null when a class is missing."""
    c = cumulative(score_counts(df, by), by)
    pair = F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0)
    return c.groupBy(*by).agg(
        F.when((F.first("P") > 0) & (F.first("N") > 0), F.sum(pair) / (F.first("P") * F.first("N"))).alias("auc"))


def confusion_with_auc(df: DataFrame, threshold: Column | float = 0.5, by: list[str] = ("model",)) -> DataFrame:
    """``confusion`` and ``roc_auc`` from one grouped table, so one pass over ``df``."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, pos = F.col("score") >= t, F.col("label") == 1
    counts = df.groupBy(*by, "score").agg(
        F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"),
        F.count_if(hit & pos).alias("hit_pos"), F.count_if(hit & ~pos).alias("hit_neg"),
        F.count_if(~hit & pos).alias("miss_pos"), F.count_if(~hit & ~pos).alias("miss_neg"))
    pair = F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0)
    g = cumulative(counts, by).groupBy(*by).agg(
        *[F.sum(c).cast("bigint").alias(k) for k, c in (("tp", "hit_pos"), ("fp", "hit_neg"), ("tn", "miss_neg"), ("fn", "miss_pos"))],
        F.when((F.first("P") > 0) & (F.first("N") > 0), F.sum(pair) / (F.first("P") * F.first("N"))).alias("auc"))
    return with_rates(g)


def roc_curve(df: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """(fpr, tpr) at every distinct score, plus the origin (threshold null)."""
    c = cumulative(score_counts(df, by), by)
    pts = c.select(*by, F.col("score").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"),
                   (F.col("tp") / F.col("P")).alias("tpr"))
    origin = df.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                              F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def pr_curve(df: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Precision and recall of ``score >= t`` for every distinct score t."""
    c = cumulative(score_counts(df, by), by)
    return c.select(*by, F.col("score").alias("threshold"), "tp", "fp", "P",
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0)).alias("recall"))


def threshold_max_recall(pr: DataFrame, min_precision: float = 0.40, fallback: float = 0.50,
                         by: list[str] = ("model",)) -> DataFrame:
    """Highest recall with precision >= floor, lowest threshold on ties;
    ``fallback`` when no threshold reaches the floor."""
    models = pr.select(*by).distinct()
    viable = pr.where(F.col("precision") >= min_precision)
    best = viable.groupBy(*by).agg(F.min_by("threshold", F.struct(-F.col("recall"), F.col("threshold"))).alias("t"))
    return models.join(best, list(by), "left").select(
        *by, F.coalesce(F.col("t"), F.lit(fallback)).alias("threshold"), F.col("t").isNotNull().alias("found"))


def threshold_max_f1(pr: DataFrame, by: list[str] = ("model",), eps: float = 1e-9) -> DataFrame:
    """argmax of 2pr/(p+r+eps), lowest threshold on ties."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps)
    return pr.withColumn("_f1", f1).groupBy(*by).agg(
        F.min_by(F.struct("threshold", "precision", "recall", "_f1"),
                 F.struct(-F.col("_f1"), F.col("threshold"))).alias("b")) \
        .select(*by, "b.threshold", "b.precision", "b.recall", F.col("b._f1").alias("f1"))


def brier(df: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))


def calibration_bins(df: DataFrame, bins: int = 10, by: list[str] = ("model",)) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                               F.avg("score").alias("mean_predicted"),
                                               F.avg("label").alias("observed_rate"))


# ------------------------------------------------------------------ comparison tables
def model_compare(test: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics per model at a fixed threshold plus AUC; ``is_best`` marks the
    highest AUC (the first model in listing order on ties)."""
    m = confusion_with_auc(test, threshold)
    w = Window.orderBy(F.col("auc").desc(), model_rank(F.col("model")))  # one row per model
    return m.withColumn("is_best", (F.row_number().over(w) == 1).cast("int")).withColumn("auc", F.bround("auc", 4))


def tuned_table(val: DataFrame, test: DataFrame) -> DataFrame:
    """Per model: the max-F1 threshold tuned on validation, then metrics on
    test at that threshold; ``is_best`` marks the highest test F1."""
    thr = threshold_max_f1(pr_curve(val)).select("model", F.col("threshold").alias("tuned_threshold"))
    j = test.join(F.broadcast(thr), "model")  # one row per model
    m = confusion_with_auc(j, F.col("tuned_threshold"), by=["model", "tuned_threshold"])
    w = Window.orderBy(F.col("f1").desc(), model_rank(F.col("model")))
    return m.withColumn("is_best", (F.row_number().over(w) == 1).cast("int")).withColumn("auc", F.bround("auc", 4))


def default_vs_tuned(val: DataFrame, test: DataFrame, min_precision: float = 0.40) -> DataFrame:
    """For the best model by test AUC: metrics at 0.50 and at the
    max-recall threshold (precision floor, tuned on validation), and deltas."""
    best = model_compare(test).where(F.col("is_best") == 1).select("model")
    v = val.join(F.broadcast(best), "model", "left_semi")
    t = test.join(F.broadcast(best), "model", "left_semi")
    thr = threshold_max_recall(pr_curve(v), min_precision).select("model", F.col("threshold").alias("thr"))
    tj = t.join(F.broadcast(thr), "model")
    base = confusion(t, 0.5).withColumn("setting", F.lit("default")).withColumn("threshold", F.lit(0.5))
    tuned = confusion(tj, F.col("thr"), by=["model", "thr"]).withColumn("setting", F.lit("tuned")) \
        .withColumnRenamed("thr", "threshold")
    cols = ["model", "setting", "threshold", "accuracy", "precision", "recall", "f1"]
    both = base.select(*cols).unionByName(tuned.select(*cols))
    d = both.groupBy("model").agg(*[(F.sum(F.when(F.col("setting") == "tuned", F.col(c)))
                                     - F.sum(F.when(F.col("setting") == "default", F.col(c)))).alias(c)
                                    for c in ("threshold", "accuracy", "precision", "recall", "f1")])
    delta = d.select("model", F.lit("delta").alias("setting"), *[F.bround(c, 4).alias(c)
                                                                 for c in ("threshold", "accuracy", "precision",
                                                                           "recall", "f1")])
    return both.unionByName(delta)


def overfit_gap(df: DataFrame) -> DataFrame:
    """train AUC - test AUC per model."""
    a = roc_auc(df.where(F.col("split").isin("train", "test")), by=["model", "split"])
    p = a.groupBy("model").agg(F.max(F.when(F.col("split") == "train", F.col("auc"))).alias("train_auc"),
                               F.max(F.when(F.col("split") == "test", F.col("auc"))).alias("test_auc"))
    return p.withColumn("gap", F.col("train_auc") - F.col("test_auc"))
