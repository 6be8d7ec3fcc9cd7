"""Queries: splits, scaling, weights and model evaluation (SURVEY §2.10, plus
Brier, calibration and the floor-constrained retune of §2.12).

Scores come from the frozen scorecards (``lr``, ``rf``, ``xgb``) and their
soft-vote ``ensemble``, so every number has an exact SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.functions.hashing import uniform
from bookrisk.functions.hashing import uniform_sql as h
from bookrisk.operators import features as FE
from bookrisk.operators import metrics as M
from bookrisk.operators.split import stratified_sql
from bookrisk.operators.score import CARDS, score_cards
from bookrisk.plans import common as C
from bookrisk.plans.catalog import query
from bookrisk.plans.q_reports import r6
from bookrisk.plans.sql import with_

SCORES = {**{m: f"score_{m}" for m in CARDS}, "ensemble": "score_ensemble"}
SCALED = ["Lead_Time_Days", "Appt_Hour", "Is_Edge_Hour", "Customer_No_Show_Rate", "Cancellation_Ratio",
          "Is_New_Customer", "Successful_Visit_Rate", "Customer_Latent_Risk"]


def wide(spark, sf) -> DataFrame:
    """Base features, the three card scores, the ensemble and the 3-way split."""
    s = score_cards(FE.build_base(C.bk(spark, sf)))
    s = M.ensemble_soft_vote(s, [f"score_{m}" for m in CARDS])
    return M.split_three(s)


def long(spark, sf) -> DataFrame:
    return M.long_scores(wide(spark, sf), SCORES)


def part(spark, sf, split) -> DataFrame:
    return long(spark, sf).where(F.col("split") == split)


# ---------------------------------------------------------------- SQL side
TWO, THREE = {"test": 0.2}, {"test": 0.2, "val": 0.2}
LG = f"""
sl AS (
  SELECT *, round_even((score_lr + score_rf + score_xgb) / 3.0, 4) AS score_ensemble
  FROM {stratified_sql('cards', 'No_Show', THREE, 'train', h('Booking_ID', 'split'))}
), lg AS (
  {' UNION ALL '.join(f"SELECT '{m}' AS model, Booking_ID, split, CAST({c} AS DOUBLE) AS score, No_Show AS label FROM sl"
                      for m, c in SCORES.items())}
), cnt AS (
  SELECT model, split, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
  FROM lg GROUP BY ALL
), cum AS (
  SELECT *, sum(pos) OVER (PARTITION BY model, split ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
    sum(neg) OVER (PARTITION BY model, split ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
    sum(pos) OVER (PARTITION BY model, split) AS P, sum(neg) OVER (PARTITION BY model, split) AS N
  FROM cnt
), auc AS (
  SELECT model, split, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(N)) END
    AS auc FROM cum GROUP BY ALL
), pr AS (
  SELECT model, split, score AS threshold, tp, fp, P, tp / (tp + fp) AS precision,
    CASE WHEN P > 0 THEN tp / P ELSE 1.0 END AS recall FROM cum
), f1best AS (
  SELECT model, split, arg_min(threshold, (-(2 * precision * recall / (precision + recall + 1e-9)), threshold)) AS threshold
  FROM pr GROUP BY ALL
), recbest AS (
  SELECT m.model, m.split, coalesce(b.t, 0.5) AS threshold, b.t IS NOT NULL AS found
  FROM (SELECT DISTINCT model, split FROM pr) m LEFT JOIN
    (SELECT model, split, arg_min(threshold, (-recall, threshold)) AS t FROM pr WHERE precision >= 0.4 GROUP BY ALL) b
    ON m.model = b.model AND m.split = b.split
)"""


def CM(src: str, thr: str, by: str = "model") -> str:
    """Confusion counts and rates of ``score >= thr`` over ``src``."""
    return f"""(SELECT {by}, tp, fp, tn, fn, round_even((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy,
    CASE WHEN tp + fp = 0 THEN 0.0 ELSE round_even(tp / (tp + fp), 4) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE round_even(tp / (tp + fn), 4) END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round_even(2 * tp / (2 * tp + fp + fn), 4) END AS f1
  FROM (SELECT {by}, CAST(count(*) FILTER (WHERE score >= {thr} AND label = 1) AS BIGINT) AS tp,
    CAST(count(*) FILTER (WHERE score >= {thr} AND label <> 1) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE score < {thr} AND label <> 1) AS BIGINT) AS tn,
    CAST(count(*) FILTER (WHERE score < {thr} AND label = 1) AS BIGINT) AS fn FROM {src} GROUP BY {by}))"""


MODEL_RANK = "list_position(['lr', 'rf', 'xgb', 'ensemble'], model)"
W = with_("cards", extra=LG)

# ---------------------------------------------------------------- keys
SPLIT2 = stratified_sql("ft", "No_Show", TWO, "train", h("Booking_ID", "split"))
query("split_stratified_2", with_("ft") + f"SELECT Booking_ID, No_Show, split FROM {SPLIT2}")(
    lambda spark, sf: M.split_two(FE.build_base(C.bk(spark, sf))).select("Booking_ID", "No_Show", "split"))

query("split_stratified_3", W + "SELECT Booking_ID, No_Show, split FROM sl")(
    lambda spark, sf: wide(spark, sf).select("Booking_ID", "No_Show", "split"))

query("agg_target_rate", W + """
SELECT split, CAST(count(*) AS BIGINT) AS n, round(avg(No_Show), 6) AS target_rate FROM sl GROUP BY split""")(
    lambda spark, sf: r6(M.split_rates(wide(spark, sf))))

_TRAIN2 = f"(SELECT * FROM {SPLIT2} WHERE split = 'train')"
query("scale_standard", with_("ft") + ", p AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{i}"
    for i, c in enumerate(SCALED)) + f" FROM {_TRAIN2})\nSELECT Booking_ID, " + ", ".join(
    f"round(({c} - m_{i}) / s_{i}, 6) AS {c}" for i, c in enumerate(SCALED)) + " FROM ft CROSS JOIN p")(
    lambda spark, sf: (lambda d: r6(M.apply_standard_scaler(
        d.select("Booking_ID", *SCALED),
        M.fit_standard_scaler(M.split_two(d).where(F.col("split") == "train"), SCALED), SCALED)))(
        FE.build_base(C.bk(spark, sf))))

query("class_weights", with_("ft") + f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE No_Show = 0) AS BIGINT) AS n0,
  CAST(count(*) FILTER (WHERE No_Show = 1) AS BIGINT) AS n1,
  round(count(*) / (2.0 * count(*) FILTER (WHERE No_Show = 0)), 6) AS w0,
  round(count(*) / (2.0 * count(*) FILTER (WHERE No_Show = 1)), 6) AS w1,
  round_even(count(*) FILTER (WHERE No_Show = 0) / count(*) FILTER (WHERE No_Show = 1), 2) AS pos_weight
FROM {_TRAIN2}""")(
    lambda spark, sf: r6(M.class_weights(M.split_two(FE.build_base(C.bk(spark, sf))).where(F.col("split") == "train"))))

query("ensemble_soft_vote", W + "SELECT Booking_ID, score_lr, score_rf, score_xgb, score_ensemble FROM sl")(
    lambda spark, sf: wide(spark, sf).select("Booking_ID", "score_lr", "score_rf", "score_xgb", "score_ensemble"))

query("metrics_at_threshold", W + f"""
SELECT c.*, round_even(a.auc, 4) AS auc FROM {CM("(SELECT * FROM lg WHERE split = 'test')", "0.5")} c
JOIN auc a ON a.model = c.model AND a.split = 'test'""")(
    lambda spark, sf: M.confusion_with_auc(part(spark, sf, "test"), 0.5).withColumn("auc", F.bround("auc", 4)))

query("roc_auc", W + "SELECT model, split, round(auc, 6) AS auc FROM auc")(
    lambda spark, sf: r6(M.roc_auc(long(spark, sf), by=["model", "split"])))

query("roc_curve", W + """
SELECT model, threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM (
  SELECT model, score AS threshold, fp, N, tp, P FROM cum WHERE split = 'test'
  UNION ALL SELECT DISTINCT model, NULL, 0, 1, 0, 1 FROM lg WHERE split = 'test')""")(
    lambda spark, sf: r6(M.roc_curve(part(spark, sf, "test"))))

query("pr_curve", W + """
SELECT model, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr WHERE split = 'val'""")(
    lambda spark, sf: r6(M.pr_curve(part(spark, sf, "val")).select("model", "threshold", "precision", "recall")))

query("threshold_max_recall", W + "SELECT model, threshold, found FROM recbest WHERE split = 'val'")(
    lambda spark, sf: M.threshold_max_recall(M.pr_curve(part(spark, sf, "val"))))

query("threshold_max_f1", W + """
SELECT p.model, p.threshold, round(p.precision, 6) AS precision, round(p.recall, 6) AS recall,
  round(2 * p.precision * p.recall / (p.precision + p.recall + 1e-9), 6) AS f1
FROM pr p JOIN f1best b ON p.model = b.model AND p.split = b.split AND p.threshold = b.threshold WHERE p.split = 'val'""")(
    lambda spark, sf: r6(M.threshold_max_f1(M.pr_curve(part(spark, sf, "val")))))

query("retune_with_floor", W + """
, fl AS (SELECT * FROM pr WHERE split = 'val' AND precision >= 0.4)
SELECT model, arg_min(threshold, (-(2 * precision * recall / (precision + recall + 1e-9)), threshold)) AS threshold
FROM fl GROUP BY model""")(
    lambda spark, sf: M.threshold_max_f1(M.pr_curve(part(spark, sf, "val")).where(F.col("precision") >= 0.4))
    .select("model", "threshold"))

_COMPARE = f"""
, cmp AS (SELECT c.*, a.auc AS auc_raw FROM {CM("(SELECT * FROM lg WHERE split = 'test')", "0.5")} c
  JOIN auc a ON a.model = c.model AND a.split = 'test')"""
query("model_compare", W + _COMPARE + f"""
SELECT model, tp, fp, tn, fn, accuracy, precision, recall, f1, round_even(auc_raw, 4) AS auc,
  CAST(row_number() OVER (ORDER BY auc_raw DESC, {MODEL_RANK}) = 1 AS INTEGER) AS is_best FROM cmp""")(
    lambda spark, sf: M.model_compare(part(spark, sf, "test")))

query("model_tuned_table", W + f"""
, thr AS (SELECT model, threshold AS tuned_threshold FROM f1best WHERE split = 'val'),
tj AS (SELECT lg.*, thr.tuned_threshold FROM lg JOIN thr USING (model) WHERE split = 'test'),
m AS (SELECT c.*, round_even(a.auc, 4) AS auc FROM {CM("tj", "tuned_threshold", "model, tuned_threshold")} c
  JOIN auc a ON a.model = c.model AND a.split = 'test')
SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, {MODEL_RANK}) = 1 AS INTEGER) AS is_best FROM m""")(
    lambda spark, sf: M.tuned_table(part(spark, sf, "val"), part(spark, sf, "test")))

_DVT = W + _COMPARE + f"""
, best AS (SELECT model FROM cmp ORDER BY auc_raw DESC, {MODEL_RANK} LIMIT 1),
thr AS (SELECT model, threshold AS thr FROM recbest WHERE split = 'val' AND model IN (SELECT model FROM best)),
tj AS (SELECT lg.*, thr.thr FROM lg JOIN thr USING (model) WHERE split = 'test'),
d AS (SELECT model, 'default' AS setting, CAST(0.5 AS DOUBLE) AS threshold, accuracy, precision, recall, f1
      FROM cmp WHERE model IN (SELECT model FROM best)),
t AS (SELECT model, 'tuned' AS setting, thr AS threshold, accuracy, precision, recall, f1 FROM {CM("tj", "thr", "model, thr")})
SELECT * FROM d UNION ALL SELECT * FROM t UNION ALL
SELECT d.model, 'delta', round_even(t.threshold - d.threshold, 4), round_even(t.accuracy - d.accuracy, 4),
  round_even(t.precision - d.precision, 4), round_even(t.recall - d.recall, 4), round_even(t.f1 - d.f1, 4)
FROM d JOIN t USING (model)"""
query("model_default_vs_tuned", _DVT)(
    lambda spark, sf: M.default_vs_tuned(part(spark, sf, "val"), part(spark, sf, "test")))

query("overfit_gap", W + """
SELECT model, round(max(auc) FILTER (WHERE split = 'train'), 6) AS train_auc,
  round(max(auc) FILTER (WHERE split = 'test'), 6) AS test_auc,
  round(max(auc) FILTER (WHERE split = 'train') - max(auc) FILTER (WHERE split = 'test'), 6) AS gap FROM auc GROUP BY model""")(
    lambda spark, sf: r6(M.overfit_gap(long(spark, sf))))

def raw(spark, sf) -> DataFrame:
    """Scores with a value of their own in almost every row, like those of a fitted model."""
    return long(spark, sf).withColumn("score", F.col("score") + uniform(F.concat("model", F.lit("/"), "Booking_ID"), "raw") / 64.0)


_RAW = W.replace(
    "), cnt AS (", f"), lr0 AS (SELECT * REPLACE (score + {h("model || '/' || Booking_ID", 'raw')} / 64.0 AS score) FROM lg), cnt AS (").replace(
    "FROM lg GROUP BY ALL", "FROM lr0 GROUP BY ALL", 1)
query("roc_auc_unrounded", _RAW + "SELECT model, split, round(auc, 6) AS auc FROM auc")(
    lambda spark, sf: r6(M.roc_auc(raw(spark, sf), by=["model", "split"])))

query("pr_curve_unrounded", _RAW + """
SELECT model, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM pr WHERE split = 'val'""")(
    lambda spark, sf: M.pr_curve(raw(spark, sf).where(F.col("split") == "val")).select(
        "model", "threshold", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")))

query("threshold_max_recall_unrounded", _RAW + "SELECT model, threshold, found FROM recbest WHERE split = 'val'")(
    lambda spark, sf: M.threshold_max_recall(M.pr_curve(raw(spark, sf).where(F.col("split") == "val"))))

query("brier_score", W + "SELECT model, round(avg(pow(score - label, 2)), 6) AS brier FROM lg WHERE split = 'test' GROUP BY model")(
    lambda spark, sf: r6(M.brier(part(spark, sf, "test"))))

query("calibration_bins", W + """
SELECT model, CAST(least(9, floor(score * 10)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n,
  round(avg(score), 6) AS mean_predicted, round(avg(label), 6) AS observed_rate FROM lg WHERE split = 'test' GROUP BY 1, 2""")(
    lambda spark, sf: r6(M.calibration_bins(part(spark, sf, "test"))))
