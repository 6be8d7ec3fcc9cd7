"""Reporting operators (dashboard and EDA tables).

Every table here is a grouped aggregate over the scored bookings: Spark
aggregates partially on the map side, so only one small row per group and
task crosses the shuffle. Outputs are bounded by the number of groups
(levels, hours, days, months), never by the number of bookings; windows
that rank or share are applied to those small grouped results only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookrisk.operators.features import levels
from bookrisk.operators.quantiles import quantiles, with_quantiles
from bookrisk.sources import schema as S

# ---------------------------------------------------------------------------
# Fixed values (labels the reports print)
# ---------------------------------------------------------------------------
FLAG_LABELS = {
    "Is_New_Customer": ("Returning (0)", "New (1)"),
    "Is_Edge_Hour": ("Mid-day (0)", "Edge hour (1)"),
    "No_Show": ("Show (0)", "No-Show (1)"),
}
CUSTOMER_LABELS = ("Repeat Customer", "New Customer")
RISK_ORDER = ["High", "Medium", "Low"]
TOP_RISK_COLUMNS = ["Booking_ID", "Customer_ID", "Service_Type", "Branch", "Appointment_Time", "Day_of_Week",
                    "Payment_Method", "Booking_Lead_Time_Days", "Past_Visit_Count", "Past_No_Show_Count",
                    "no_show_probability", "risk_level", "Outcome"]
DESCRIBE_COLUMNS = ["Booking_Lead_Time_Days", "Past_Visit_Count", "Past_Cancellation_Count", "Past_No_Show_Count"]
BEHAVIOUR_COLUMNS = ["Past_Visit_Count", "Past_Cancellation_Count", "Past_No_Show_Count"]
CORR_COLUMNS = ["Booking_Lead_Time_Days", "Past_Visit_Count", "Past_Cancellation_Count", "Past_No_Show_Count",
                "Is_NoShow"]


def _n() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def _rate(target: str = "No_Show") -> Column:
    return F.avg(target) * 100


def day_index(day: Column) -> Column:
    """1 for Monday .. 7 for Sunday (null for unknown names)."""
    return F.array_position(F.array(*[F.lit(d) for d in S.DAYS]), day).cast("int")


def unpivot_values(df: DataFrame, cols: list[str], keep: list[str] = (), name: str = "column_name",
                   value: str = "value", cast: str = "double") -> DataFrame:
    """Long form (keep..., name, value) of ``cols`` (a narrow expand, no shuffle)."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(cast).alias(value))
                                                for c in cols])).alias("_kv")).select(*keep, "_kv.*")


def with_order(df: DataFrame, *order: Column, name: str = "ord") -> DataFrame:
    """Position of each row of an already-grouped (small) table."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


# ------------------------------------------------------------------ §2.3 filters
def filter_dashboard(df: DataFrame, date_range: tuple | None = None, branches: list[str] | None = None,
                     services: list[str] | None = None, risk_levels: list[str] | None = None,
                     end_inclusive_day: bool = False) -> DataFrame:
    """Empty or missing lists mean no filter. The date filter needs both ends;
    by default the end compares to midnight of the end day (the dashboard's
    behaviour), ``end_inclusive_day`` keeps the whole last day."""
    out = df
    if date_range is not None and len(date_range) == 2:
        start = F.lit(str(date_range[0])).cast("timestamp_ntz")
        end = F.lit(str(date_range[1])).cast("timestamp_ntz")
        if end_inclusive_day:
            out = out.where((F.col("Appointment_Time") >= start)
                            & (F.col("Appointment_Time") < F.date_add(end.cast("date"), 1).cast("timestamp_ntz")))
        else:
            out = out.where((F.col("Appointment_Time") >= start) & (F.col("Appointment_Time") <= end))
    if branches:
        out = out.where(F.col("Branch").isin(list(branches)))
    if services:
        out = out.where(F.col("Service_Type").isin(list(services)))
    if risk_levels:
        out = out.where(F.col("risk_level").isin(list(risk_levels)))
    return out


def filter_bounds(df: DataFrame) -> DataFrame:
    """Filter choices: date bounds and the sorted distinct branches / services
    (collect_set is bounded by the number of levels)."""
    return df.agg(
        F.min(F.to_date("Appointment_Time")).alias("min_date"),
        F.max(F.to_date("Appointment_Time")).alias("max_date"),
        F.array_join(F.array_sort(F.collect_set("Branch")), ", ").alias("branches"),
        F.array_join(F.array_sort(F.collect_set("Service_Type")), ", ").alias("services"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with at least one null: count and percent (round 2)."""
    one = df.agg(_n().alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = unpivot_values(one, df.columns, keep=["_rows"], value="missing_count", cast="bigint")
    return (long.where(F.col("missing_count") > 0)
            .select("column_name", "missing_count",
                    F.bround(F.col("missing_count") * 100.0 / F.col("_rows"), 2).alias("missing_pct")))


def queue(df: DataFrame, actions: list[str]) -> DataFrame:
    return df.where(F.col("action_type").isin(actions))


def filter_next_day(df: DataFrame, run_date: str) -> DataFrame:
    """Bookings whose appointment falls on the day after ``run_date``."""
    return df.where(F.to_date("Appointment_Time") == F.date_add(F.lit(run_date).cast("date"), 1))


# ------------------------------------------------------------------ §2.5 aggregates
def exec_kpis(df: DataFrame, baseline_pct: float = S.BASELINE_NO_SHOW_PCT) -> DataFrame:
    """Total, no-show %, high-risk count and share, revenue lost and at risk,
    delta vs the baseline rate; zeros on an empty selection."""
    total = F.count(F.lit(1))
    ns_pct = F.coalesce(F.avg("No_Show") * 100, F.lit(0.0))
    high = F.count_if(F.col("risk_level") == "High")
    return df.agg(
        total.cast("bigint").alias("total_bookings"),
        ns_pct.alias("no_show_pct"),
        high.cast("bigint").alias("high_risk"),
        F.when(total > 0, high * 100.0 / total).otherwise(F.lit(0.0)).alias("high_risk_pct"),
        F.coalesce(F.sum(F.when(F.col("No_Show") == 1, F.col("Revenue"))), F.lit(0.0)).alias("revenue_lost"),
        F.coalesce(F.sum("Revenue_At_Risk"), F.lit(0.0)).alias("revenue_at_risk"),
        (ns_pct - F.lit(baseline_pct)).alias("delta_vs_baseline"),
    )


def share_of_total(counts: DataFrame, n: str = "n", by: list[str] | None = None, places: int = 1,
                   out: str = "pct") -> DataFrame:
    """Percent of the group total on an already-grouped (small) table."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return counts.withColumn(out, F.bround(F.col(n) * 100.0 / F.sum(n).over(w), places))


def outcome_counts(df: DataFrame) -> DataFrame:
    c = df.where(F.col("Outcome").isNotNull()).groupBy("Outcome").agg(_n().alias("n"))
    return share_of_total(c)


def monthly_rate(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.date_format("Appointment_Time", "yyyy-MM").alias("month"))
            .agg(_n().alias("total"), F.sum("No_Show").cast("bigint").alias("no_shows"))
            .withColumn("rate", F.col("no_shows") * 100.0 / F.col("total")))


def rate_by(df: DataFrame, key: str, *extra: Column) -> DataFrame:
    """No-show rate (%) and count per value of ``key``."""
    return df.groupBy(key).agg(_rate().alias("no_show_rate"), _n().alias("n"), *extra)


def by_branch(df: DataFrame) -> DataFrame:
    return with_order(rate_by(df, "Branch"), F.col("no_show_rate"), F.col("Branch"))


def by_service(df: DataFrame) -> DataFrame:
    """Rate, mean revenue and count per service, and the median of the mean
    revenues (over at most one row per service)."""
    g = rate_by(df, "Service_Type", F.avg("Revenue").alias("avg_revenue"))
    med = g.agg(F.median("avg_revenue").alias("median_avg_revenue"))
    return with_order(g.crossJoin(F.broadcast(med)), F.col("no_show_rate"), F.col("Service_Type"))


def day_hour_heatmap(df: DataFrame) -> DataFrame:
    """Rate % (round 1) by day x hour, one column per hour h00..h23, Monday first."""
    hours = list(range(24))
    p = (df.groupBy("Day_of_Week").pivot("Appt_Hour", hours)
         .agg(F.bround(F.avg("No_Show") * 100, 1)))
    return p.select("Day_of_Week", day_index(F.col("Day_of_Week")).alias("day_index"),
                    *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])


def new_vs_repeat(df: DataFrame) -> DataFrame:
    return (df.groupBy("Is_New_Customer").agg(_n().alias("n"), F.avg("No_Show").alias("mean"))
            .withColumns({"label": F.when(F.col("Is_New_Customer") == 1, F.lit(CUSTOMER_LABELS[1]))
                                    .otherwise(F.lit(CUSTOMER_LABELS[0])),
                          "no_show_rate": F.bround(F.col("mean") * 100, 1)}))


def by_hour(df: DataFrame) -> DataFrame:
    return rate_by(df, "Appt_Hour")


def by_payment(df: DataFrame) -> DataFrame:
    g = rate_by(df, "Payment_Method", F.sum("Revenue_At_Risk").alias("revenue_at_risk"))
    return with_order(g, F.col("no_show_rate").desc(), F.col("Payment_Method"))


def by_lead(df: DataFrame) -> DataFrame:
    return rate_by(df, "Booking_Lead_Time_Days")


def risk_histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    """Fixed ``bins`` equal bins on [0, 1] (1.0 falls in the last), by level."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("no_show_probability") * bins)).cast("int")
    return df.groupBy(b.alias("bin"), "risk_level").agg(_n().alias("n")).withColumns({
        "bin_lo": F.bround(F.col("bin") / F.lit(float(bins)), 6),
        "bin_hi": F.bround((F.col("bin") + 1) / F.lit(float(bins)), 6)})


def lead_histogram(df: DataFrame) -> DataFrame:
    """One-day bins of the supplied lead, by level."""
    return df.groupBy(F.col("Booking_Lead_Time_Days").alias("lead_days"), "risk_level").agg(_n().alias("n"))


def distinct_branches(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("Branch").cast("bigint").alias("n_branches"))


def day_rate(df: DataFrame) -> DataFrame:
    return (df.groupBy("Day_of_Week").agg(F.bround(F.avg("No_Show") * 100, 1).alias("no_show_rate"))
            .withColumn("day_index", day_index(F.col("Day_of_Week"))))


def describe(df: DataFrame, cols: list[str] = DESCRIBE_COLUMNS, places: int = 2) -> DataFrame:
    """count, mean, std (n-1), min, quartiles (linear, exact), max per column."""
    long = unpivot_values(df, cols).where(F.col("value").isNotNull())
    g = long.groupBy("column_name").agg(_n().alias("count"), F.avg("value").alias("mean"),
                                        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                        F.max("value").alias("max"))
    q = quantiles(long, ["column_name"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return with_quantiles(g, q, ["column_name"]).select("column_name", "count", *[
        F.bround(c, places).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def value_counts(df: DataFrame, cols: list[str] = S.CATEGORICAL_COLUMNS) -> DataFrame:
    long = unpivot_values(df, cols, cast="string").where(F.col("value").isNotNull())
    return share_of_total(long.groupBy("column_name", "value").agg(_n().alias("n")), by=["column_name"])


def flag_distribution(df: DataFrame, labels: dict = FLAG_LABELS) -> DataFrame:
    cols = [c for c in labels if c in df.columns]
    long = unpivot_values(df, cols, name="flag", cast="int")
    g = share_of_total(long.groupBy("flag", "value").agg(_n().alias("n")), by=["flag"])
    lab = F.coalesce(*[F.when((F.col("flag") == f) & (F.col("value") == v), F.lit(labels[f][v]))
                       for f in cols for v in (0, 1)])
    return g.withColumn("label", lab)


def capped_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("Capped_Good_Visits").agg(_n().alias("n"))


def nunique_levels(df: DataFrame, cols: list[str] = S.ENCODED_COLUMNS) -> DataFrame:
    """Number and list of the distinct levels of each column. Levels are made
    distinct before they are gathered; the list is a cell of the report, so it
    suits columns that are read by people (else see :mod:`bookrisk.operators.distinct`)."""
    found = levels(df, cols).groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("n_levels"),
                                                   F.array_join(F.array_sort(F.collect_list("level")), ", ").alias("levels"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(found, F.col("column_name") == F.col("column"), "left").select(
        "column_name", F.coalesce("n_levels", F.lit(0)).cast("bigint").alias("n_levels"), F.coalesce("levels", F.lit("")).alias("levels"))


def min_max_mean(df: DataFrame, cols: list[str] = ("Lead_Time_Days", "Appt_Hour"), places: int = 2) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max"),
                 F.bround(F.avg(c), places).alias(f"{c}_mean")]
    return df.agg(*aggs)


def behaviour_by_outcome(df: DataFrame, cols: list[str] = BEHAVIOUR_COLUMNS, places: int = 3) -> DataFrame:
    long = unpivot_values(df, cols, keep=["Outcome"])
    by = ["Outcome", "column_name"]
    g = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return with_quantiles(g, quantiles(long, by, "value", {"median": 0.5}), by).select(*by, *[
        F.bround(c, places).alias(c) for c in ("mean", "median", "std")])


def correlation(df: DataFrame, cols: list[str] = CORR_COLUMNS, places: int = 3) -> DataFrame:
    """Pearson matrix in long form; all pairs from one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                                   F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x"))
    half = long.select("x.*")
    full = half.unionByName(half.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return full.select("a", "b", F.bround("r", places).alias("corr"))


def target_corr(df: DataFrame, feature: str = "Customer_Latent_Risk", target: str = "No_Show",
                places: int = 4) -> DataFrame:
    return df.agg(F.bround(F.corr(F.col(feature).cast("double"), F.col(target).cast("double")), places)
                  .alias("corr_with_target"))


def boxplot(df: DataFrame, cols: list[str] = BEHAVIOUR_COLUMNS, by: str = "Outcome", k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the furthest datum within k*IQR, outlier count,
    per (group, column). The quartile table has one row per group and column;
    the planner sends it to the tasks while it is small."""
    long = unpivot_values(df, cols, keep=[by]).where(F.col("value").isNotNull())
    q = quantiles(long, [by, "column_name"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    lo = F.col("q1") - k * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + k * (F.col("q3") - F.col("q1"))
    j = long.join(q, [by, "column_name"])
    return j.groupBy(by, "column_name", "q1", "median", "q3").agg(
        F.min(F.when(F.col("value") >= lo, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(F.col("value") <= hi, F.col("value"))).alias("whisker_hi"),
        F.count_if((F.col("value") < lo) | (F.col("value") > hi)).cast("bigint").alias("n_outliers"))


def exec_summary(df: DataFrame) -> DataFrame:
    """Counts by action and by level, plus overall count and mean probability."""
    by_action = df.groupBy(F.col("action_type").alias("label")).agg(_n().alias("n"))
    by_level = df.groupBy(F.col("risk_level").alias("label")).agg(_n().alias("n"))
    overall = df.agg(_n().alias("n"), F.round(F.avg("no_show_probability"), 6).alias("mean_probability"))
    return (by_action.select(F.lit("action").alias("kind"), "label", "n", F.lit(None).cast("double").alias("mean_probability"))
            .unionByName(by_level.select(F.lit("level").alias("kind"), "label", "n",
                                         F.lit(None).cast("double").alias("mean_probability")))
            .unionByName(overall.select(F.lit("overall").alias("kind"), F.lit("all").alias("label"), "n",
                                        "mean_probability")))


def exec_summary_table(df: DataFrame) -> DataFrame:
    """Actions sorted by name, levels High/Medium/Low with zero rows skipped,
    then the high-risk count and the mean probability (with the row count),
    in one long table."""
    by_action = df.groupBy(F.col("action_type").alias("label")).agg(_n().alias("n"))
    by_level = df.groupBy(F.col("risk_level").alias("label")).agg(_n().alias("n"))
    overall = df.agg(F.count_if(F.col("risk_level") == "High").cast("bigint").alias("high"),
                     F.avg("no_show_probability").alias("mean_p"), _n().alias("total"))
    lvl_ord = F.array_position(F.array(*[F.lit(x) for x in RISK_ORDER]), F.col("label"))
    rows = (with_order(by_action, F.col("label")).select(F.lit("action").alias("section"), "label", "n", "ord",
                                                         F.lit(None).cast("double").alias("value"))
            .unionByName(by_level.where(F.col("n") > 0).select(F.lit("level").alias("section"), "label", "n",
                                                               lvl_ord.cast("int").alias("ord"),
                                                               F.lit(None).cast("double").alias("value")))
            .unionByName(overall.select(F.lit("high_risk").alias("section"), F.lit("High").alias("label"),
                                        F.col("high").alias("n"), F.lit(1).alias("ord"),
                                        F.lit(None).cast("double").alias("value")))
            .unionByName(overall.select(F.lit("mean_probability").alias("section"), F.lit("all").alias("label"),
                                        F.col("total").alias("n"), F.lit(1).alias("ord"),
                                        F.round("mean_p", 6).alias("value"))))
    return rows


# ------------------------------------------------------------------ §2.7 order / top-k
def top_riskiest(df: DataFrame, n: int = 500) -> DataFrame:
    """Highest probabilities first (Booking_ID breaks ties): TakeOrderedAndProject,
    each task keeps only its own top ``n``."""
    cols = [c for c in TOP_RISK_COLUMNS if c in df.columns]
    return df.select(*cols).orderBy(F.col("no_show_probability").desc(), F.col("Booking_ID")).limit(n)


def preview(df: DataFrame, n: int = 5, key: str = "Booking_ID") -> DataFrame:
    return df.orderBy(key).limit(n)


def argmax_day_hour(df: DataFrame) -> DataFrame:
    """Highest / lowest rounded no-show rate by day (Monday-first order wins
    ties) and by hour (earliest hour wins ties)."""
    d = df.groupBy("Day_of_Week").agg(F.bround(F.avg("No_Show") * 100, 1).alias("r")) \
        .withColumn("i", day_index(F.col("Day_of_Week")))
    h = df.groupBy("Appt_Hour").agg(F.bround(F.avg("No_Show") * 100, 1).alias("r"))
    dd = d.agg(F.max_by("Day_of_Week", F.struct(F.col("r"), -F.col("i"))).alias("worst_day"), F.max("r").alias("worst_day_rate"),
               F.min_by("Day_of_Week", F.struct(F.col("r"), F.col("i"))).alias("best_day"), F.min("r").alias("best_day_rate"))
    hh = h.agg(F.max_by("Appt_Hour", F.struct(F.col("r"), -F.col("Appt_Hour"))).alias("worst_hour"),
               F.max("r").alias("worst_hour_rate"),
               F.min_by("Appt_Hour", F.struct(F.col("r"), F.col("Appt_Hour"))).alias("best_hour"),
               F.min("r").alias("best_hour_rate"))
    return dd.crossJoin(hh)


def distinct_sorted_sample(df: DataFrame, cols: list[str], n: int = 12) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols).limit(n)


def intervention_queue(df: DataFrame) -> DataFrame:
    """Rows needing a touch, ordered by day, priority (highest first) and
    appointment time: a range-partitioned global sort, no single-task window."""
    return (df.where(F.col("action_type") != "NO_ACTION")
            .select(F.to_date("Appointment_Time").alias("queue_date"), "Booking_ID", "Appointment_Time",
                    "action_type", "priority", "risk_level", "no_show_probability")
            .orderBy("queue_date", F.col("priority").desc(), "Appointment_Time", "Booking_ID"))
