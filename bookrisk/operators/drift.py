"""Drift, monitoring, retraining signals and business KPIs (README-specified).

Pattern throughout: one grouped aggregate per statistic (partial on the
map side), then arithmetic on the small grouped result. Reference values
(bin edges, reference shares) are one-row tables broadcast to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookrisk.functions.stats import chi2_sf, ks_p_value
from bookrisk.operators import metrics as M
from bookrisk.operators.quantiles import in_ranges, quantiles
from bookrisk.sources import schema as S

# ---------------------------------------------------------------------------
# Fixed values (monitoring thresholds stated by the reference)
# ---------------------------------------------------------------------------
PSI_MODERATE = 0.10
PSI_SIGNIFICANT = 0.20
PSI_CLIP = 1e-6
P_ALERT = 0.01
Z_ALERT = 2.0
LEAD_MEAN_REF = 3.08
LEAD_MEAN_SHIFT = 1.0
NEW_SHARE_REF = 0.10
NEW_SHARE_SHIFT = 0.05
CASH_SHARE_SHIFT = 0.08
NO_SHOW_BAND_PP = 4.0
RETRAIN_RECALL = 0.55
RETRAIN_PRECISION = 0.35
RETRAIN_VOLUME = 0.20
READINESS = [("full_retrain", 20000), ("threshold_retune", 5000), ("emergency_patch", 2000)]
PROMOTE_F1_GAIN = 0.02
# metric -> (target, alert, higher_is_better)
WEEKLY_TARGETS = {
    "recall": (0.65, 0.55, True),
    "precision": (0.45, 0.35, True),
    "f1": (0.55, 0.45, True),
    "auc": (0.82, 0.75, True),
    "brier": (0.15, 0.22, False),
}


def period(df: DataFrame, split_date: str, ts: str = "Appointment_Time") -> DataFrame:
    """'reference' before ``split_date``, 'current' from it on."""
    return df.withColumn("period", F.when(F.col(ts) < F.lit(split_date).cast("timestamp_ntz"), "reference")
                         .otherwise("current"))


# ------------------------------------------------------------------ PSI
def psi(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """Population stability index per feature between the 'reference' and
    'current' rows of ``df`` (column ``period``). Equal-width bins over the
    reference min..max (a constant reference widens to +-0.5), last bin
    closed, current values outside the range ignored, shares clipped at 1e-6. A side
    without values in range has no shares: the index is null, the status
    'not enough data'."""
    long = df.select("period", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                            F.col(f).cast("double").alias("x")) for f in features]))
                     .alias("kv")).select("period", "kv.*").where(F.col("x").isNotNull())
    rng = (long.where(F.col("period") == "reference").groupBy("feature")
           .agg(F.min("x").alias("lo0"), F.max("x").alias("hi0"))
           .select("feature", F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
                   F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi")))
    step = (F.col("hi") - F.col("lo")) / float(bins)
    # interior edges lo + i*step (i = 1..bins-1); bin = number of edges <= x
    bin_of = sum(((F.lit(float(i)) * step + F.col("lo") <= F.col("x")).cast("int") for i in range(1, bins)), F.lit(0))
    j = long.join(F.broadcast(rng), "feature").where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    # a bin without rows on either side adds nothing: both shares are clipped to the same value
    g = j.groupBy("feature", bin_of.alias("bin")).agg(
        F.count_if(F.col("period") == "reference").alias("e"), F.count_if(F.col("period") == "current").alias("a"))
    w = Window.partitionBy("feature")  # bins rows per feature
    g = g.withColumns({"ep": F.col("e") / F.nullif(F.sum("e").over(w), F.lit(0)), "ap": F.col("a") / F.nullif(F.sum("a").over(w), F.lit(0))})
    g = g.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(PSI_CLIP), F.col(c))) for c in ("ep", "ap")})
    out = g.groupBy("feature").agg(F.sum((F.col("ap") - F.col("ep")) * F.log(F.col("ap") / F.col("ep"))).alias("psi"))
    return out.withColumn("status", psi_status(F.col("psi")))


def psi_status(p: Column) -> Column:
    return (F.when(p.isNull(), "not enough data").when(p < PSI_MODERATE, "no significant drift").when(p <= PSI_SIGNIFICANT, "moderate drift")
            .otherwise("significant drift"))


# ------------------------------------------------------------------ KS / chi-square / z
def ks_two_sample(df: DataFrame, feature: str) -> DataFrame:
    """Two-sample KS statistic between periods and its asymptotic p-value.
    Counts per distinct value first; the running shares add up on two levels,
    inside ranges of values and over the totals of the ranges, so that a
    continuous feature spreads over many tasks. Without rows on a side the
    statistic is null."""
    c = (df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("double").alias("v"))
         .agg(F.count_if(F.col("period") == "reference").alias("r"), F.count_if(F.col("period") == "current").alias("c")))
    c = in_ranges(c, "v")
    earlier = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    every = Window.partitionBy(F.lit(0))
    before = c.groupBy("_r").agg(F.sum("r").alias("rr"), F.sum("c").alias("rc")).select(
        F.col("_r").alias("_gr"), *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_b{s}") for s in ("rr", "rc")],
        F.nullif(F.sum("rr").over(every), F.lit(0)).alias("nr"), F.nullif(F.sum("rc").over(every), F.lit(0)).alias("nc"))
    inside = Window.partitionBy("_r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = (c.withColumns({"cr": F.sum("r").over(inside), "cc": F.sum("c").over(inside)})
         .join(before, F.col("_r") == F.col("_gr")))
    d = c.agg(F.max(F.abs((F.col("_brr") + F.col("cr")) / F.col("nr") - (F.col("_brc") + F.col("cc")) / F.col("nc"))).alias("d"),
              F.first("nr").alias("n1"), F.first("nc").alias("n2"))
    p = ks_p_value(F.col("d"), F.col("n1").cast("double"), F.col("n2").cast("double"))
    return d.select(F.lit(feature).alias("feature"), "d", p.alias("p_value"), (p < P_ALERT).cast("int").alias("alert"))


def chi2_drift(df: DataFrame, features: list[str]) -> DataFrame:
    """Homogeneity of each categorical across the two periods: statistic,
    degrees of freedom, p-value and alert (p < 0.01)."""
    long = df.select("period", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                            F.col(f).cast("string").alias("level")) for f in features]))
                     .alias("kv")).select("period", "kv.*").where(F.col("level").isNotNull())
    cnt = long.groupBy("feature", "level").agg(F.count_if(F.col("period") == "reference").alias("o_r"),
                                                F.count_if(F.col("period") == "current").alias("o_c"))
    w = Window.partitionBy("feature")  # levels rows per feature
    cnt = cnt.withColumns({"row": F.col("o_r") + F.col("o_c"), "tr": F.sum("o_r").over(w),
                           "tc": F.sum("o_c").over(w), "k": F.count(F.lit(1)).over(w)})
    n = F.col("tr") + F.col("tc")
    er, ec = F.col("row") * F.col("tr") / n, F.col("row") * F.col("tc") / n
    term = F.pow(F.col("o_r") - er, 2) / er + F.pow(F.col("o_c") - ec, 2) / ec
    g = cnt.groupBy("feature").agg(F.sum(term).alias("statistic"), F.first("k").alias("k"))
    g = g.withColumn("dof", (F.col("k") - 1).cast("int"))
    p = chi2_sf(F.col("statistic"), F.col("dof"))
    return g.select("feature", "statistic", "dof", p.alias("p_value"), (p < P_ALERT).cast("int").alias("alert"))


def ztest_rate(rolling: DataFrame, baseline: float = S.BASELINE_NO_SHOW_PCT / 100.0) -> DataFrame:
    """z of the rolling 4-week no-show rate against the baseline; alert beyond 2 sigma."""
    se = F.sqrt(F.lit(baseline * (1 - baseline)) / F.col("rolling_n"))
    z = (F.col("rolling_no_show_rate") - F.lit(baseline)) / se
    return rolling.select("week", "rolling_n", "rolling_no_show_rate", z.alias("z"),
                          (F.abs(z) > Z_ALERT).cast("int").alias("alert"))


# ------------------------------------------------------------------ shift checks
def mean_and_shares(df: DataFrame) -> DataFrame:
    """Per period: rows, mean computed lead, new-customer share, cash share."""
    from bookrisk.functions.columns import elapsed_days_floor
    return df.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(elapsed_days_floor("Booking_Time", "Appointment_Time")).alias("lead_mean"),
        F.avg((F.col("Past_Visit_Count") == 0).cast("int")).alias("new_share"),
        F.avg((F.col("Payment_Method") == "Cash").cast("int")).alias("cash_share"))


def drift_report(df: DataFrame, psi_table: DataFrame, ks_table: DataFrame, chi_table: DataFrame) -> DataFrame:
    """One row per check: feature, metric, value, reference, alert."""
    ms = mean_and_shares(df)
    cur = ms.where(F.col("period") == "current")
    ref = ms.where(F.col("period") == "reference").select(F.col("cash_share").alias("ref_cash"))
    row = cur.crossJoin(F.broadcast(ref))
    shifts = row.select(F.explode(F.array(
        F.struct(F.lit("Lead_Time_Days").alias("feature"), F.lit("mean").alias("metric"),
                 F.col("lead_mean").alias("value"), F.lit(LEAD_MEAN_REF).alias("reference"),
                 (F.abs(F.col("lead_mean") - LEAD_MEAN_REF) > LEAD_MEAN_SHIFT).cast("int").alias("alert")),
        F.struct(F.lit("Is_New_Customer").alias("feature"), F.lit("share").alias("metric"),
                 F.col("new_share").alias("value"), F.lit(NEW_SHARE_REF).alias("reference"),
                 (F.abs(F.col("new_share") - NEW_SHARE_REF) > NEW_SHARE_SHIFT).cast("int").alias("alert")),
        F.struct(F.lit("Payment_Method_Cash").alias("feature"), F.lit("share").alias("metric"),
                 F.col("cash_share").alias("value"), F.col("ref_cash").alias("reference"),
                 (F.abs(F.col("cash_share") - F.col("ref_cash")) > CASH_SHARE_SHIFT).cast("int").alias("alert")),
    )).alias("x")).select("x.*")
    none = F.lit(None).cast("double")
    return (shifts
            .unionByName(psi_table.select("feature", F.lit("psi").alias("metric"), F.col("psi").alias("value"),
                                          none.alias("reference"), (F.col("psi") > PSI_SIGNIFICANT).cast("int").alias("alert")))
            .unionByName(ks_table.select("feature", F.lit("ks_p_value").alias("metric"), F.col("p_value").alias("value"),
                                         none.alias("reference"), "alert"))
            .unionByName(chi_table.select("feature", F.lit("chi2_p_value").alias("metric"),
                                          F.col("p_value").alias("value"), none.alias("reference"), "alert")))


def weekly_drift(df: DataFrame, rolling: DataFrame, feature: str = "Customer_No_Show_Rate", bins: int = 10,
                 run: int = 3) -> DataFrame:
    """The weekly report over the appointment weeks of the current period, five
    rows a week (week, feature, metric, value, reference, alert): PSI of
    ``feature`` against the reference period (binned as in :func:`psi`; null
    when a side has no value in range), mean lead, share of new customers, cash
    share, and the rolling 4-week no-show rate, which alerts after ``run``
    weeks in a row outside the band. ``rolling`` has the rate per week."""
    from bookrisk.functions.columns import elapsed_days_floor
    ref = F.col("period") == "reference"
    x = F.col(feature).cast("double")
    rng = df.where(ref).agg(F.min(x).alias("lo0"), F.max(x).alias("hi0")).select(
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("_lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / float(bins)
    edge = [F.lit(float(i)) * step + F.col("_lo") for i in range(bins)]
    inside = [(x >= edge[i]) & ((x < edge[i + 1]) if i + 1 < bins else (x <= F.col("_hi"))) for i in range(bins)]
    wk = F.date_trunc("week", F.col("Appointment_Time").cast("timestamp")).cast("date").alias("week")
    weeks = df.crossJoin(F.broadcast(rng)).groupBy("period", wk).agg(  # one row per period and week
        F.count(F.lit(1)).alias("n"), F.avg(elapsed_days_floor("Booking_Time", "Appointment_Time")).alias("lead"),
        F.avg((F.col("Past_Visit_Count") == 0).cast("int")).alias("new"), F.count_if(F.col("Payment_Method") == "Cash").alias("cash"),
        F.count("Payment_Method").alias("paid"), *[F.count_if(c).alias(f"b{i}") for i, c in enumerate(inside)])
    base = weeks.where(ref).agg((F.sum("cash") / F.nullif(F.sum("paid"), F.lit(0))).alias("ref_cash"),
                                *[F.sum(f"b{i}").alias(f"e{i}") for i in range(bins)])
    w = Window.orderBy((F.datediff("week", F.lit("1970-01-05").cast("date")) / 7).cast("int")).rangeBetween(-(run - 1), 0)
    out = (F.abs(F.col("rolling_no_show_rate") * 100 - S.BASELINE_NO_SHOW_PCT) > NO_SHOW_BAND_PP).cast("int")
    rate = rolling.select("week", "rolling_no_show_rate", out.alias("_out")).select(
        "week", "rolling_no_show_rate", ((F.count(F.lit(1)).over(w) == run) & (F.min("_out").over(w) == 1)).alias("_run"))

    def total(prefix):
        return F.nullif(sum((F.col(f"{prefix}{i}") for i in range(bins)), F.lit(0)), F.lit(0))

    def share(prefix):
        return [F.greatest(F.lit(PSI_CLIP), F.col(f"{prefix}{i}") / F.col(f"_{prefix}")) for i in range(bins)]
    both = F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in zip(share("e"), share("b"), strict=True)])
    terms = F.aggregate(both, F.lit(0.0), lambda acc, x: acc + (x["q"] - x["p"]) * F.log(x["q"] / x["p"]))
    index, cash, none = F.col("_index"), F.col("cash") / F.nullif("paid", F.lit(0)), F.lit(None).cast("double")

    def row(name, metric, value, reference, alert):
        return F.struct(F.lit(name).alias("feature"), F.lit(metric).alias("metric"), value.alias("value"),
                        reference.alias("reference"), F.coalesce(alert.cast("int"), F.lit(0)).alias("alert"))
    rows = [row(feature, "psi", index, none, index > PSI_SIGNIFICANT),
            row("Lead_Time_Days", "mean", F.col("lead"), F.lit(LEAD_MEAN_REF), F.abs(F.col("lead") - LEAD_MEAN_REF) > LEAD_MEAN_SHIFT),
            row("Is_New_Customer", "share", F.col("new"), F.lit(NEW_SHARE_REF), F.abs(F.col("new") - NEW_SHARE_REF) > NEW_SHARE_SHIFT),
            row("Payment_Method_Cash", "share", cash, F.col("ref_cash"), F.abs(cash - F.col("ref_cash")) > CASH_SHARE_SHIFT),
            row("No_Show_Rate", "rolling_4wk", F.col("rolling_no_show_rate"), F.lit(S.BASELINE_NO_SHOW_PCT / 100.0), F.col("_run"))]
    return (weeks.where(F.col("period") == "current").crossJoin(F.broadcast(base)).join(rate, "week", "left")
            .withColumns({"_e": total("e"), "_b": total("b")})
            .withColumn("_index", F.when(F.col("_e").isNotNull() & F.col("_b").isNotNull(), terms))
            .select("week", F.explode(F.array(*rows)).alias("x")).select("week", "x.*"))


# ------------------------------------------------------------------ weekly performance
def weekly_performance(scored: DataFrame, threshold: float) -> DataFrame:
    """Per appointment week: recall, precision, F1, AUC and Brier, each with
    a status against the stated target and alert levels."""
    wk = F.date_trunc("week", F.col("Appointment_Time").cast("timestamp")).cast("date")
    s = scored.select(wk.alias("week"), F.col("no_show_probability").alias("score"), F.col("No_Show").alias("label"))
    m = M.confusion_with_auc(s, threshold, by=["week"]).join(M.brier(s, by=["week"]), "week")
    long = m.select("week", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"))
                                                for k in WEEKLY_TARGETS])).alias("x")).select("week", "x.*")
    tgt = long.sparkSession.createDataFrame([(k, t, a, hb) for k, (t, a, hb) in WEEKLY_TARGETS.items()],
                                            "metric string, target double, alert_level double, higher boolean")
    j = long.join(F.broadcast(tgt), "metric")
    good = F.when(F.col("higher"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    bad = F.when(F.col("higher"), F.col("value") < F.col("alert_level")).otherwise(F.col("value") > F.col("alert_level"))
    return j.select("week", "metric", "value", "target", "alert_level",
                    F.when(F.col("value").isNull(), "n/a").when(good, "ok").when(bad, "alert").otherwise("watch")
                    .alias("status"))


# ------------------------------------------------------------------ retraining
def retrain_triggers(rolling: DataFrame, psi_table: DataFrame, df: DataFrame,
                     psi_feature: str = "Customer_No_Show_Rate") -> DataFrame:
    """Latest rolling week's recall / precision, the PSI of the strongest
    feature and the monthly volume growth of the current period over the
    reference period, each against its trigger."""
    last = rolling.agg(F.max_by(F.struct("rolling_recall", "rolling_precision"), F.col("week")).alias("r"))
    vol = (df.groupBy("period").agg((F.count(F.lit(1)) / F.countDistinct(F.date_format("Appointment_Time", "yyyy-MM")))
                                    .alias("per_month"))
           .agg(F.max(F.when(F.col("period") == "current", F.col("per_month"))).alias("cur"),
                F.max(F.when(F.col("period") == "reference", F.col("per_month"))).alias("ref")))
    p = psi_table.where(F.col("feature") == psi_feature).select(F.col("psi"))
    row = last.crossJoin(vol).crossJoin(p)
    growth = F.col("cur") / F.col("ref") - 1.0
    return row.select(F.explode(F.array(
        F.struct(F.lit("rolling_recall").alias("trigger"), F.col("r.rolling_recall").alias("value"),
                 F.lit(RETRAIN_RECALL).alias("threshold"), (F.col("r.rolling_recall") < RETRAIN_RECALL).alias("fired")),
        F.struct(F.lit("rolling_precision").alias("trigger"), F.col("r.rolling_precision").alias("value"),
                 F.lit(RETRAIN_PRECISION).alias("threshold"),
                 (F.col("r.rolling_precision") < RETRAIN_PRECISION).alias("fired")),
        F.struct(F.lit(f"psi_{psi_feature}").alias("trigger"), F.col("psi").alias("value"),
                 F.lit(PSI_SIGNIFICANT).alias("threshold"), (F.col("psi") > PSI_SIGNIFICANT).alias("fired")),
        F.struct(F.lit("monthly_volume_growth").alias("trigger"), growth.alias("value"),
                 F.lit(RETRAIN_VOLUME).alias("threshold"), (growth > RETRAIN_VOLUME).alias("fired")),
    )).alias("x")).select("x.trigger", "x.value", "x.threshold", F.col("x.fired").cast("int").alias("fired"))


def training_readiness(df: DataFrame, val_rows: DataFrame, recent_rows: DataFrame) -> DataFrame:
    """Record gates: labelled rows for a full retrain, validation rows for a
    threshold retune, recent labelled rows for an emergency patch."""
    lab = df.agg(F.count_if(F.col("Outcome").isNotNull()).alias("v"))
    val = val_rows.agg(F.count(F.lit(1)).alias("v"))
    rec = recent_rows.agg(F.count_if(F.col("Outcome").isNotNull()).alias("v"))
    parts = []
    for (gate, need), src in zip(READINESS, (lab, val, rec)):
        parts.append(src.select(F.lit(gate).alias("gate"), F.lit(need).cast("bigint").alias("required"),
                                F.col("v").cast("bigint").alias("available"),
                                (F.col("v") >= need).cast("int").alias("ready")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def champion_challenger(table: DataFrame, champion: str, challenger: str) -> DataFrame:
    """Promote the challenger when its F1 beats the champion's by > 0.02."""
    f = table.agg(F.max(F.when(F.col("model") == champion, F.col("f1"))).alias("champion_f1"),
                  F.max(F.when(F.col("model") == challenger, F.col("f1"))).alias("challenger_f1"))
    gain = F.col("challenger_f1") - F.col("champion_f1")
    return f.select(F.lit(champion).alias("champion"), F.lit(challenger).alias("challenger"), "champion_f1",
                    "challenger_f1", gain.alias("f1_gain"), (gain > PROMOTE_F1_GAIN).cast("int").alias("promote"))


def ab_by_version(scores: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics per model_version of the stored scores joined to outcomes."""
    s = scores.join(labels, "booking_id").select("model_version", F.col("no_show_probability").alias("score"),
                                                 F.col("No_Show").alias("label"))
    by = ["model_version"]
    return M.confusion_with_auc(s, threshold, by).join(M.brier(s, by), by)


# ------------------------------------------------------------------ KPIs
def kpi_monthly(rp: DataFrame) -> DataFrame:
    """By month: overall no-show rate, no-show rate of High-risk bookings,
    revenue recovered (price of attended High-risk bookings)."""
    high = F.col("risk_level") == "High"
    return rp.groupBy(F.date_format("Appointment_Time", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg("No_Show").alias("no_show_rate"),
        F.avg(F.when(high, F.col("No_Show"))).alias("high_risk_no_show_rate"),
        F.coalesce(F.sum(F.when(high & (F.col("No_Show") == 0), F.col("Revenue"))), F.lit(0.0)).alias("revenue_recovered"))


def kpi_deposit_rate(actions: DataFrame, log: DataFrame) -> DataFrame:
    """Deposit requests and the share paid (a confirmed log row), by action."""
    paid = log.where(F.col("outcome") == "confirmed").select(F.col("booking_id").alias("Booking_ID")).distinct()
    req = actions.where(F.col("action_type").isin(S.DEPOSIT_ACTIONS)).select("Booking_ID", "action_type")
    j = req.join(paid.withColumn("paid", F.lit(1)), "Booking_ID", "left")
    return j.groupBy("action_type").agg(F.count(F.lit(1)).cast("bigint").alias("requested"),
                                        F.count("paid").cast("bigint").alias("paid")) \
        .withColumn("collection_rate", F.col("paid") / F.col("requested"))


def kpi_deposit_churn(actions: DataFrame) -> DataFrame:
    """Share of deposit-requested bookings whose customer books nothing later.
    Requests are counted per (customer, appointment), then per customer in all
    and at the last appointment: grouped sums with partial aggregation, no join
    and no sort, so a customer with many rows needs no task of its own."""
    asked = F.count_if(F.col("action_type").isin(S.DEPOSIT_ACTIONS))
    at = actions.where(F.col("Customer_ID").isNotNull()).groupBy("Customer_ID", "Appointment_Time").agg(asked.alias("n"))
    per = at.groupBy("Customer_ID").agg(F.sum("n").alias("n"), F.max_by("n", "Appointment_Time").alias("last"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("requested"),
                   F.coalesce(F.sum("last"), F.lit(0)).cast("bigint").alias("churned")) \
        .withColumn("churn_rate", F.col("churned") / F.nullif("requested", F.lit(0)))


# ------------------------------------------------------------------ operations
def ops_latency(log: DataFrame) -> DataFrame:
    """Requests and exact P50 / P99 of scoring latency (ms); null for an empty log."""
    q = quantiles(log.withColumn("_all", F.lit(0)), ["_all"], "latency_ms", {"p50_ms": 0.5, "p99_ms": 0.99})
    n = log.agg(F.count(F.lit(1)).cast("bigint").alias("n")).withColumn("_all", F.lit(0))
    return n.join(q, "_all", "left").select("n", "p50_ms", "p99_ms")


def ops_failure_null_rate(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.avg("failed").alias("failure_rate"),
                   F.avg("null_feature").alias("null_feature_rate"))
