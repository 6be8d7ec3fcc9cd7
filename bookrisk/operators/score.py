"""Scoring: a frozen logistic scorecard (exact, oracle-checkable), MLlib
model scoring, risk level, tuned-threshold flag and the soft-vote ensemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookrisk.functions.columns import edge_hour, elapsed_days_floor, raw_ratio, risk_level

# Frozen scorecards (test stand-ins for fitted models; not a quality claim).
FROZEN = {
    "intercept": -2.2, "no_show_rate": 1.6, "cash": 1.3, "upi": -0.2, "new": 0.3,
    "lead": 0.05, "latent": 1.5, "edge": 0.15, "hair_coloring": -0.2,
}
CARDS = {
    "lr": FROZEN,
    "rf": {"intercept": -2.0, "no_show_rate": 1.2, "cash": 1.1, "upi": -0.1, "new": 0.4,
           "lead": 0.03, "latent": 1.8, "edge": 0.10, "hair_coloring": -0.1},
    "xgb": {"intercept": -2.4, "no_show_rate": 2.0, "cash": 1.4, "upi": -0.3, "new": 0.2,
            "lead": 0.06, "latent": 1.3, "edge": 0.20, "hair_coloring": -0.3},
}


def scorecard_z(coef: dict = FROZEN) -> Column:
    """Linear score from raw booking columns (features computed inline)."""
    v = F.col("Past_Visit_Count")
    terms = {
        "no_show_rate": raw_ratio(F.col("Past_No_Show_Count"), v),
        "cash": (F.col("Payment_Method") == "Cash").cast("int"),
        "upi": (F.col("Payment_Method") == "UPI").cast("int"),
        "new": (v == 0).cast("int"),
        "lead": elapsed_days_floor("Booking_Time", "Appointment_Time"),
        "latent": F.col("Customer_Latent_Risk"),
        "edge": edge_hour(F.hour("Appointment_Time")),
        "hair_coloring": (F.col("Service_Type") == "Hair Coloring").cast("int"),
    }
    z = F.lit(coef["intercept"])
    for k, t in terms.items():
        z = z + F.lit(coef[k]) * t
    return z


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_frozen(df: DataFrame, coef: dict = FROZEN, prob_col: str = "no_show_probability",
                 level_col: str = "risk_level") -> DataFrame:
    """Probability rounded half-even to 4 places; level from the unrounded value."""
    raw = sigmoid(scorecard_z(coef))
    return df.withColumn("_p_raw", raw).withColumns({
        prob_col: F.bround(F.col("_p_raw"), 4),
        level_col: risk_level(F.col("_p_raw")),
    }).drop("_p_raw")


def score_cards(df: DataFrame, cards: dict = CARDS) -> DataFrame:
    """One rounded score column per card: ``score_<name>``."""
    return df.withColumns({f"score_{n}": F.bround(sigmoid(scorecard_z(c)), 4) for n, c in cards.items()})


def score_with_flag(df: DataFrame, threshold: float, prob_col: str = "no_show_probability") -> DataFrame:
    """``predicted_no_show`` from the rounded probability."""
    return df.withColumn("predicted_no_show", (F.col(prob_col) >= F.lit(threshold)).cast("int"))


def prediction_record(df: DataFrame) -> DataFrame:
    """booking_id, no_show_probability, risk_level (the predictor's output)."""
    return df.select(F.col("Booking_ID").alias("booking_id"), "no_show_probability", "risk_level")
