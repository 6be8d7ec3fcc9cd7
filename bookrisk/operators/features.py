"""Feature columns. Each function keeps every input column and adds new ones
(narrow projections; Catalyst collapses the chain into one Project)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookrisk.functions.columns import edge_hour, elapsed_days_floor, safe_ratio
from bookrisk.operators.quantiles import in_ranges
from bookrisk.sources import schema as S



def _v():
    return F.col("Past_Visit_Count")


def _ns():
    return F.col("Past_No_Show_Count")


def _c():
    return F.col("Past_Cancellation_Count")


def add_lead_time(df: DataFrame) -> DataFrame:
    """Floor of elapsed days (not the calendar difference)."""
    return df.withColumn("Lead_Time_Days", elapsed_days_floor("Booking_Time", "Appointment_Time"))


def add_appointment_hour(df: DataFrame) -> DataFrame:
    return df.withColumn("Appt_Hour", F.hour("Appointment_Time"))


def add_edge_hour_flag(df: DataFrame, early: int = S.EDGE_EARLY_HOUR, late: int = S.EDGE_LATE_HOUR) -> DataFrame:
    return df.withColumn("Is_Edge_Hour", edge_hour(F.hour("Appointment_Time"), early, late))


def add_no_show_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("Customer_No_Show_Rate", safe_ratio(_ns(), _v()))


def add_cancellation_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("Cancellation_Ratio", safe_ratio(_c(), _v()))


def add_new_customer_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("Is_New_Customer", (_v() == 0).cast("int"))


def add_successful_visit_rate(df: DataFrame) -> DataFrame:
    rate = safe_ratio(_v() - _ns() - _c(), _v())
    return df.withColumn("Successful_Visit_Rate", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)))


def add_target(df: DataFrame) -> DataFrame:
    return df.withColumn("No_Show", F.coalesce(F.col("Outcome") == "No-Show", F.lit(False)).cast("int"))


def add_log_visits(df: DataFrame) -> DataFrame:
    return df.withColumn("Log_Past_Visit_Count", F.bround(F.log1p(_v()), 4))


def global_rate(df: DataFrame) -> DataFrame:
    """One-row table with the no-show share of ``df`` (the smoothing prior)."""
    return df.agg(F.avg(F.coalesce(F.col("Outcome") == "No-Show", F.lit(False)).cast("int")).alias("_prior"))


def add_smoothed_rate(df: DataFrame, prior: float | DataFrame | None = None, alpha: float = 5.0) -> DataFrame:
    """(ns + alpha * g) / (v + alpha), round 4. ``g`` is a fitted parameter:
    pass the training prior at serving time; by default the prior of ``df``
    itself is attached as a one-row broadcast (no shuffle)."""
    if prior is None:
        prior = global_rate(df)
    if isinstance(prior, DataFrame):
        df = df.crossJoin(F.broadcast(prior.select(F.col(prior.columns[0]).alias("_prior"))))
        g = F.col("_prior")
    else:
        g = F.lit(float(prior))
    out = df.withColumn("Smoothed_NoShow_Rate", F.bround((_ns() + alpha * g) / (_v() + alpha), 4))
    return out.drop("_prior") if "_prior" in out.columns else out


def add_capped_good_visits(df: DataFrame, cap: int = 10) -> DataFrame:
    return df.withColumn("Capped_Good_Visits", F.least(F.lit(cap), F.greatest(F.lit(0), _v() - _ns() - _c())).cast("int"))


def add_interactions(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "NoShow_x_LeadTime": F.bround(F.col("Smoothed_NoShow_Rate") * F.col("Lead_Time_Days"), 4),
        "NewCust_x_LeadTime": (F.col("Is_New_Customer") * F.col("Lead_Time_Days")).cast("int"),
    })


def levels(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, level): every distinct non-null level, counted out before the shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in cols]))
    return df.select(each.alias("x")).select("x.*").where("level is not null").distinct()


#: A level becomes a column only up to so many; beyond, see :func:`level_table`.
WIDE_LEVELS = 2000


def fit_levels(df: DataFrame, cols: list[str] = S.ENCODED_COLUMNS) -> dict[str, list[str]]:
    """Sorted distinct levels per categorical (the encoder's fit), for columns
    that become 0/1 columns. Never more than ``WIDE_LEVELS`` of them reach the
    driver: more raise ValueError, since so many columns make no table."""
    cols = [c for c in cols if c in df.columns]
    rows = levels(df, cols).limit(WIDE_LEVELS + 1).collect() if cols else []
    if len(rows) > WIDE_LEVELS:
        raise ValueError(f"more than {WIDE_LEVELS} levels: encode them with level_table and encode_levels")
    return {c: sorted(r["level"] for r in rows if r["column"] == c) for c in cols}


def level_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, level, position): the encoder's fit for columns of any
    cardinality, as a table. Positions count the levels of each column in
    code-point order from 0, on two levels of ranges, so no task orders a whole
    column and nothing reaches the driver."""
    ranged = in_ranges(levels(df, cols), "column", "level")
    sizes = ranged.groupBy("column", "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("column").orderBy("_r")
    sizes = sizes.select(F.col("column").alias("_c"), F.col("_r").alias("_q"), (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("column", "_r").orderBy("level")) - 1
    return (ranged.withColumn("_i", inside).join(sizes, (F.col("column") == F.col("_c")) & (F.col("_r") == F.col("_q")))
            .select("column", "level", (F.col("_before") + F.col("_i")).cast("bigint").alias("position")))


def encode_levels(df: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    """Each column replaced by the position of its level (unknown or null:
    null). The planner sends a small dictionary to the tasks and shuffles for a
    large one; a level with most of the rows is split by AQE."""
    for i, c in enumerate(cols):
        part = table.where(F.col("column") == c).select(F.col("level").alias(f"_l{i}"), F.col("position").alias(f"_p{i}"))
        df = df.join(part, F.col(f"`{c}`").cast("string") == F.col(f"_l{i}"), "left").withColumn(c, F.col(f"_p{i}")).drop(f"_l{i}", f"_p{i}")
    return df


def one_hot(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = True) -> DataFrame:
    """``Col_Level`` 0/1 ints for each level (the alphabetically first level
    dropped); the categorical columns are removed. Unknown or null -> all 0."""
    new = {}
    for c, lv in levels.items():
        for level in (lv[1:] if drop_first else lv):
            new[f"{c}_{level}"] = F.coalesce(F.col(c) == level, F.lit(False)).cast("int")
    return df.withColumns(new).drop(*levels.keys())


def one_hot_names(levels: dict[str, list[str]], drop_first: bool = True) -> list[str]:
    return [f"{c}_{lv}" for c, lvs in levels.items() for lv in (lvs[1:] if drop_first else lvs)]


def align_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fixed column order; absent columns become 0, extra columns are dropped."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(0).alias(c) for c in cols])


def build_base(df: DataFrame, with_target: bool = True) -> DataFrame:
    """The seven engineered columns (+ target) on top of the raw booking."""
    for f in (add_lead_time, add_appointment_hour, add_edge_hour_flag, add_no_show_rate,
              add_cancellation_ratio, add_new_customer_flag, add_successful_visit_rate):
        df = f(df)
    return add_target(df) if with_target else df


def build_features(df: DataFrame, levels: dict[str, list[str]] | None = None, with_target: bool = True) -> DataFrame:
    """All feature steps in order, then one-hot encoding."""
    df = build_base(df, with_target)
    if levels is None:
        levels = fit_levels(df)
    return one_hot(df, levels)


def build_full(df: DataFrame, prior: float | DataFrame | None = None, with_target: bool = True) -> DataFrame:
    """``build_base`` plus the five extra engineered columns."""
    df = build_base(df, with_target)
    df = add_log_visits(df)
    df = add_smoothed_rate(df, prior)
    df = add_capped_good_visits(df)
    return add_interactions(df)


def build_inference(df: DataFrame, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Same function without the target; parses text times first."""
    from bookrisk.operators.clean import parse_ts_coerce
    if dict(df.dtypes).get("Booking_Time") == "string":
        df = parse_ts_coerce(df)
    return build_features(df, levels, with_target=False)


def split_xy(df: DataFrame, drop: list[str] = S.DROP_FOR_X, key: str = "Booking_ID"):
    """(X keyed by ``key``, y keyed by ``key``) -- no positional pairing."""
    x = df.drop(*[c for c in drop if c in df.columns and c != key])
    y = df.select(key, "No_Show")
    return x, y


def matrix(df: DataFrame, drop: list[str] = S.DROP_FOR_X, key: str = "Booking_ID") -> DataFrame:
    """X and y of ``split_xy`` side by side, in one projection of ``df``."""
    return df.select(*[c for c in df.columns if c == key or c not in (*drop, "No_Show")], "No_Show")


def prune(df: DataFrame, keep: list[str] = S.PRUNED) -> DataFrame:
    """Keep the pruned feature list (plus key and label if present)."""
    extra = [c for c in ("Booking_ID", "No_Show") if c in df.columns]
    return align_columns(df, extra + keep)
