"""Queries: sources, cleaning, features, scoring and actions (SURVEY §2.1,
§2.2, §2.10 scoring, §2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookrisk.operators import clean as CL
from bookrisk.operators import features as FE
from bookrisk.operators import rules as RU
from bookrisk.operators.score import score_with_flag
from bookrisk.plans import common as C
from bookrisk.plans.catalog import query
from bookrisk.plans.common import DIRTY, TS, sel_text
from bookrisk.plans.sql import with_
from bookrisk.sources import schema as S
from bookrisk.sources.bookings import read_bookings_csv

BCOLS = C.BOOKING_COLS


def _ts_out(df):
    return C.texts(df)


# ------------------------------------------------------------------ flagship
FLAGSHIP_SQL = with_("ac", extra="") + """
SELECT Branch, action_type, CAST(count(*) AS BIGINT) AS n_bookings,
  round(avg(no_show_probability), 6) AS mean_probability,
  round(sum(no_show_probability * (CASE Service_Type WHEN 'Bridal Makeup' THEN 8000 WHEN 'Hair Coloring' THEN 3000
    WHEN 'Hair Spa' THEN 2000 WHEN 'Facial' THEN 1200 WHEN 'Pedicure' THEN 800 WHEN 'Manicure' THEN 700 ELSE 600 END)), 2)
    AS revenue_at_risk
FROM ac GROUP BY Branch, action_type"""


def flagship(spark, sf):
    """bookings -> frozen score -> actions -> count, mean p, revenue at risk by (branch, action)."""
    a = C.report_columns(C.ac(spark, sf))
    return (a.groupBy("Branch", "action_type")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_bookings"),
                 F.round(F.avg("no_show_probability"), 6).alias("mean_probability"),
                 F.round(F.sum("Revenue_At_Risk"), 2).alias("revenue_at_risk")))


query("flagship_branch_actions", FLAGSHIP_SQL)(flagship)

# ------------------------------------------------------------------ §2.1


@query("scan_bookings_csv", with_("bk") + f"SELECT {sel_text(BCOLS)} FROM bk")
def scan_bookings_csv(spark, sf):
    """Bookings written as CSV with a header, read back with the fixed schema."""
    path = C.scratch_path(spark, "bookings-csv")
    C.texts(C.bk(spark, sf)).write.mode("overwrite").option("header", True).csv(path)
    return read_bookings_csv(spark, path)


def scan_feature_matrix(spark, sf):
    """Feature matrix and label in one table keyed by Booking_ID (no positional pairing)."""
    path = C.scratch_path(spark, "features")
    FE.matrix(FE.build_features(C.bk(spark, sf))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


query("parse_ts_coerce", with_("bk", extra=DIRTY) + f"""
SELECT Booking_ID, {TS('Booking_Time')} AS Booking_Time, {TS('Appointment_Time')} AS Appointment_Time FROM pdirty""")(
    lambda spark, sf: _ts_out(C.parsed_dirty(spark, sf).select("Booking_ID", "Booking_Time", "Appointment_Time")))


@query("parse_ts_strict", with_("bk") + f"SELECT {sel_text(BCOLS)} FROM bk")
def parse_ts_strict(spark, sf):
    """Strict parse of clean text times (a bad value fails the job)."""
    return C.texts(CL.parse_ts_strict(C.texts(C.bk(spark, sf))))


query("missing_drop", with_("bk", extra=DIRTY) + f"SELECT {sel_text(BCOLS)} FROM pdirty WHERE "
      + " AND ".join(f"{c} IS NOT NULL" for c in BCOLS))(
    lambda spark, sf: _ts_out(CL.missing_drop(C.parsed_dirty(spark, sf))))

_FF = ", ".join(
    (f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY Booking_ID ROWS UNBOUNDED PRECEDING), "
     f"first_value({c} IGNORE NULLS) OVER (ORDER BY Booking_ID ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
     f" AS {c}") for c in BCOLS if c != "Booking_ID")
query("missing_ffill", with_("bk", extra=DIRTY) + f"""
, ff AS (SELECT Booking_ID, {_FF} FROM pdirty)
SELECT {sel_text(BCOLS)} FROM ff""")(
    lambda spark, sf: _ts_out(CL.missing_ffill(C.parsed_dirty(spark, sf))))


def _mode_sql(c: str) -> str:
    return (f"(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM pdirty WHERE {c} IS NOT NULL GROUP BY {c}) "
            f"ORDER BY n DESC, {c} LIMIT 1)")


_MEAN_SEL = ", ".join(
    (f"coalesce(CAST({c} AS DOUBLE), (SELECT avg({c}) FROM pdirty)) AS {c}" if c in S.NUMERIC_COLUMNS else
     f"coalesce({c}, {_mode_sql(c)}) AS {c}" if c in S.CATEGORICAL_COLUMNS else
     (TS(c) + f" AS {c}" if c in S.DATETIME_COLUMNS else c)) for c in BCOLS)
query("missing_mean", with_("bk", extra=DIRTY) + f"SELECT {_MEAN_SEL} FROM pdirty")(
    lambda spark, sf: _ts_out(CL.missing_mean(C.parsed_dirty(spark, sf))).withColumns(
        {c: F.round(c, 6) for c in S.NUMERIC_COLUMNS}))

# numeric columns keep their nulls here; emitted as DOUBLE so both engines
# hand the same value type to the compare
_MODE_SEL = ", ".join((f"coalesce({c}, {_mode_sql(c)}) AS {c}" if c in S.CATEGORICAL_COLUMNS else
                       (TS(c) + f" AS {c}" if c in S.DATETIME_COLUMNS else
                        (f"CAST({c} AS DOUBLE) AS {c}" if c in S.NUMERIC_COLUMNS else c))) for c in BCOLS)
query("missing_mode", with_("bk", extra=DIRTY) + f"SELECT {_MODE_SEL} FROM pdirty")(
    lambda spark, sf: _ts_out(CL.missing_mode(C.parsed_dirty(spark, sf))).withColumns(
        {c: F.col(c).cast("double") for c in S.NUMERIC_COLUMNS}))

_VAL_ROWS = []
for g, cols in (("datetime_columns", S.DATETIME_COLUMNS), ("numeric_columns", S.NUMERIC_COLUMNS),
                ("categorical_columns", S.CATEGORICAL_COLUMNS), ("id_columns", S.ID_COLUMNS)):
    for c in cols:
        fail = (f"(SELECT count(*) FROM dirty WHERE try_cast({c} AS TIMESTAMP) IS NULL AND {c} IS NOT NULL)"
                if c in S.DATETIME_COLUMNS else "0")
        _VAL_ROWS.append(f"SELECT '{g}' AS grp, '{c}' AS column_name, 1 AS type_ok, CAST({fail} AS BIGINT) AS cast_failures")
query("validate_types", with_("bk", extra=DIRTY) + " UNION ALL ".join(_VAL_ROWS))(
    lambda spark, sf: CL.validate_types(C.parsed_dirty(spark, sf), raw=C.dirty(spark, sf)))

_SUM_ROWS = ["SELECT 'rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM pdirty",
             f"SELECT 'columns', CAST({len(BCOLS)} AS BIGINT)",
             "SELECT 'duplicates', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM pdirty GROUP BY ALL_COLS)"
             .replace("ALL_COLS", ", ".join(BCOLS))]
_SUM_ROWS += [f"SELECT 'null:{c}', CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) FROM pdirty" for c in BCOLS]
query("data_summary", with_("bk", extra=DIRTY) + " UNION ALL ".join(_SUM_ROWS))(
    lambda spark, sf: CL.data_summary(C.parsed_dirty(spark, sf)))

_DROP_SQL = (with_("bk", extra=DIRTY) + f"SELECT {sel_text(BCOLS)} FROM pdirty WHERE "
             + " AND ".join(f"{c} IS NOT NULL" for c in BCOLS))


@query("clean_pipeline", _DROP_SQL)
def clean_pipeline(spark, sf):
    """load_and_clean_data: the dirty bookings as a CSV file, read with the
    fixed schema, times parsed (bad -> null), rows with a null dropped."""
    path = C.scratch_path(spark, "dirty-csv")
    C.dirty(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return _ts_out(CL.clean(read_bookings_csv(spark, path), "drop"))


query("clean_process", with_("bk", extra=DIRTY) + f"SELECT {sel_text(BCOLS)} FROM pdirty WHERE "
      + " AND ".join(f"{c} IS NOT NULL" for c in BCOLS))(
    lambda spark, sf: _ts_out(CL.clean(C.dirty(spark, sf), "drop")))

_LEAD = "CAST(floor(date_diff('microsecond', Booking_Time, Appointment_Time) / 86400000000.0) AS INTEGER)"
query("lead_time_audit", with_("bk") + f"""
, d AS (SELECT Booking_ID, Booking_Lead_Time_Days AS supplied, {_LEAD} AS computed FROM bk),
bad AS (SELECT * FROM d WHERE supplied IS DISTINCT FROM computed)
SELECT b.*, (SELECT CAST(count(*) AS BIGINT) FROM bad) AS n_mismatch FROM (SELECT * FROM bad ORDER BY Booking_ID LIMIT 10) b""")(
    lambda spark, sf: CL.lead_time_audit(C.bk(spark, sf)).withColumn("n_mismatch", F.col("n_mismatch").cast("bigint")))


def sink_features(spark, sf):
    """Featured table written as Parquet and X / y as CSV; returns the Parquet read-back."""
    feats = FE.build_features(C.bk(spark, sf))
    base = C.scratch_path(spark, "featured")
    C.texts(feats).write.mode("overwrite").parquet(base + "/featured")
    x, y = FE.split_xy(feats)
    x.write.mode("overwrite").option("header", True).csv(base + "/X")
    y.write.mode("overwrite").option("header", True).csv(base + "/y")
    return spark.read.parquet(base + "/featured")


# ------------------------------------------------------------------ §2.2 features
def _feat(key, spark_cols, sql_cols, cte="ft", builder=None):
    names = list(spark_cols)
    query(key, with_(cte) + f"SELECT Booking_ID, {sql_cols} FROM {cte}")(
        lambda spark, sf: (builder or FE.build_base)(C.bk(spark, sf)).select("Booking_ID", *names))


_feat("feat_lead_time", ["Lead_Time_Days"], "Lead_Time_Days")
_feat("feat_appt_hour", ["Appt_Hour"], "Appt_Hour")
_feat("feat_edge_hour", ["Is_Edge_Hour"], "Is_Edge_Hour")
_feat("feat_no_show_rate", ["Customer_No_Show_Rate"], "Customer_No_Show_Rate")
_feat("feat_cancel_ratio", ["Cancellation_Ratio"], "Cancellation_Ratio")
_feat("feat_new_customer", ["Is_New_Customer"], "Is_New_Customer")
_feat("feat_success_rate", ["Successful_Visit_Rate"], "Successful_Visit_Rate")
_feat("feat_target", ["No_Show"], "No_Show")

FULL_SQL = """
, g AS (SELECT avg(CAST(coalesce(Outcome = 'No-Show', false) AS INTEGER)) AS prior FROM bk),
full_ft AS (
  SELECT ft.*, round_even(ln(1 + Past_Visit_Count), 4) AS Log_Past_Visit_Count,
    round_even((Past_No_Show_Count + 5.0 * g.prior) / (Past_Visit_Count + 5.0), 4) AS Smoothed_NoShow_Rate,
    CAST(least(10, greatest(0, Past_Visit_Count - Past_No_Show_Count - Past_Cancellation_Count)) AS INTEGER)
      AS Capped_Good_Visits
  FROM ft CROSS JOIN g
), full2 AS (
  SELECT *, round_even(Smoothed_NoShow_Rate * Lead_Time_Days, 4) AS NoShow_x_LeadTime,
    CAST(Is_New_Customer * Lead_Time_Days AS INTEGER) AS NewCust_x_LeadTime FROM full_ft
)"""


def _full(key, col):
    query(key, with_("ft") + FULL_SQL + f"SELECT Booking_ID, {col} FROM full2")(
        lambda spark, sf: FE.build_full(C.bk(spark, sf)).select("Booking_ID", col))


_full("feat_log_visits", "Log_Past_Visit_Count")
_full("feat_smoothed_rate", "Smoothed_NoShow_Rate")
_full("feat_capped_good_visits", "Capped_Good_Visits")
_full("feat_ns_x_lead", "NoShow_x_LeadTime")
_full("feat_new_x_lead", "NewCust_x_LeadTime")

_OHE = {c: sorted(v) for c, v in (("Service_Type", S.SERVICES), ("Branch", S.BRANCHES), ("Payment_Method", S.PAYMENTS),
                                  ("Day_of_Week", S.DAYS))}
_OHE_SQL = ", ".join(f"CAST(coalesce({c} = '{lv}', false) AS INTEGER) AS \"{c}_{lv}\""
                     for c, lvs in _OHE.items() for lv in lvs[1:])
query("feat_one_hot", with_("bk") + f"SELECT Booking_ID, {_OHE_SQL} FROM bk")(
    lambda spark, sf: FE.one_hot(C.bk(spark, sf), FE.fit_levels(C.bk(spark, sf)))
    .select("Booking_ID", *FE.one_hot_names(_OHE)))

_ALIGN = ["Booking_ID", "Lead_Time_Days", "Service_Type_Hair Coloring", "Branch_Bangalore_MG", "Payment_Method_Cash"]
query("feat_align_columns", with_("bk") + """
SELECT Booking_ID, """ + ", ".join([
    "CAST(floor(date_diff('microsecond', Booking_Time, Appointment_Time) / 86400000000.0) AS INTEGER) AS Lead_Time_Days",
    "CAST(coalesce(Service_Type = 'Hair Coloring', false) AS INTEGER) AS \"Service_Type_Hair Coloring\"",
    "0 AS Branch_Bangalore_MG", "CAST(coalesce(Payment_Method = 'Cash', false) AS INTEGER) AS Payment_Method_Cash"])
      + " FROM bk")(
    lambda spark, sf: FE.align_columns(FE.build_features(C.bk(spark, sf), _OHE), _ALIGN)
    .withColumn("Branch_Bangalore_MG", F.col("Branch_Bangalore_MG").cast("int")))

_BUILD_COLS = [c for c in BCOLS if c not in S.ENCODED_COLUMNS] + S.ENGINEERED + ["No_Show"]
query("feat_build", with_("ft") + f"SELECT {sel_text(_BUILD_COLS)}, {_OHE_SQL} FROM ft")(
    lambda spark, sf: _ts_out(FE.build_features(C.bk(spark, sf))))

_INF_COLS = [c for c in BCOLS if c not in S.ENCODED_COLUMNS] + S.ENGINEERED
query("feat_build_inference", with_("ft") + f"SELECT {sel_text(_INF_COLS)}, {_OHE_SQL} FROM ft")(
    lambda spark, sf: _ts_out(FE.build_inference(C.texts(C.bk(spark, sf)), _OHE)))

_X_COLS = ["Customer_Latent_Risk"] + S.ENGINEERED
query("feat_split_xy", with_("ft") + f"SELECT Booking_ID, {', '.join(_X_COLS)}, {_OHE_SQL}, No_Show FROM ft")(
    lambda spark, sf: FE.matrix(FE.build_features(C.bk(spark, sf))))

query("feat_prune", with_("ft") + "SELECT Booking_ID, No_Show, " + ", ".join(
    f'"{c}"' if c not in ("Service_Type_Hair Coloring", "Payment_Method_Cash", "Payment_Method_UPI") else
    f"CAST(coalesce({c.rsplit('_', 1)[0]} = '{c.rsplit('_', 1)[1]}', false) AS INTEGER) AS \"{c}\""
    for c in S.PRUNED) + " FROM ft")(
    lambda spark, sf: FE.prune(FE.build_features(C.bk(spark, sf))))


def feat_run(spark, sf):
    """Build, split, save X / y; returns X joined to y."""
    path = C.scratch_path(spark, "xy")
    FE.matrix(FE.build_features(C.bk(spark, sf))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


query("proj_revenue", with_("rp") + "SELECT Booking_ID, Revenue, round(Revenue_At_Risk, 4) AS Revenue_At_Risk FROM rp")(
    lambda spark, sf: C.rp(spark, sf).select("Booking_ID", "Revenue", F.round("Revenue_At_Risk", 4).alias("Revenue_At_Risk")))

query("proj_report_cols", with_("rp") + "SELECT Booking_ID, No_Show, Is_New_Customer, Appt_Hour, "
      "CAST(Appt_Date AS VARCHAR) AS Appt_Date FROM rp")(
    lambda spark, sf: C.rp(spark, sf).select("Booking_ID", "No_Show", "Is_New_Customer", "Appt_Hour",
                                             F.col("Appt_Date").cast("string").alias("Appt_Date")))

# ------------------------------------------------------------------ scoring
query("score_frozen", with_("sc") + "SELECT Booking_ID, no_show_probability, risk_level FROM sc")(
    lambda spark, sf: C.sc(spark, sf).select("Booking_ID", "no_show_probability", "risk_level"))

query("risk_level", with_("sc") + "SELECT risk_level, CAST(count(*) AS BIGINT) AS n FROM sc GROUP BY risk_level")(
    lambda spark, sf: C.sc(spark, sf).groupBy("risk_level").agg(F.count(F.lit(1)).cast("bigint").alias("n")))

query("score_with_flag", with_("sc") + "SELECT Booking_ID, no_show_probability, "
      "CAST(no_show_probability >= 0.35 AS INTEGER) AS predicted_no_show FROM sc")(
    lambda spark, sf: score_with_flag(C.sc(spark, sf), 0.35).select("Booking_ID", "no_show_probability",
                                                                      "predicted_no_show"))

# ------------------------------------------------------------------ §2.11 actions
_AC_TXT = """SELECT Booking_ID AS booking_id, no_show_probability, risk_level, action_type, channels_txt AS channels,
  timing_txt AS timing_days_before, deposit_pct, reason, drivers_txt AS risk_drivers, priority, escalation_note FROM ac"""


def action_text(df):
    return RU.action_record(df).withColumns({
        "channels": F.array_join("channels", ","),
        "timing_days_before": F.array_join(F.col("timing_days_before").cast("array<string>"), ","),
        "risk_drivers": F.array_join("risk_drivers", " | "),
    })


query("evaluate", with_("ac") + _AC_TXT)(lambda spark, sf: action_text(C.ac(spark, sf)))

query("select_action", with_("ac") + "SELECT Booking_ID, action_type FROM ac")(
    lambda spark, sf: C.ac(spark, sf).select("Booking_ID", "action_type"))

query("risk_drivers", with_("ac") + "SELECT Booking_ID, drivers_txt AS risk_drivers FROM ac")(
    lambda spark, sf: C.ac(spark, sf).select("Booking_ID", F.array_join("risk_drivers", " | ").alias("risk_drivers")))

query("diagnose", with_("ac") + """SELECT Booking_ID, CASE WHEN _premium THEN 'premium' ELSE 'standard' END AS service_tier,
  CAST(_is_cash AS INTEGER) AS is_cash, CAST(_is_weekend AS INTEGER) AS is_weekend, CAST(_is_new AS INTEGER) AS is_new_customer,
  CAST(_is_edge AS INTEGER) AS is_edge_hour, CAST(_is_long AS INTEGER) AS is_long_lead,
  CAST(_is_chronic AS INTEGER) AS is_chronic, _ns_rate AS no_show_rate, _cancel_rate AS cancellation_ratio,
  CAST(_lead AS DOUBLE) AS lead_time_days FROM ac""")(
    lambda spark, sf: RU.diagnose(C.sc(spark, sf)).select(
        "Booking_ID", F.col("_tier").alias("service_tier"),
        *[F.col(f"_{c}").cast("int").alias(n) for c, n in (("is_cash", "is_cash"), ("is_weekend", "is_weekend"),
                                                            ("is_new", "is_new_customer"), ("is_edge", "is_edge_hour"),
                                                            ("is_long", "is_long_lead"), ("is_chronic", "is_chronic"))],
        F.col("_ns_rate").alias("no_show_rate"), F.col("_cancel_rate").alias("cancellation_ratio"),
        F.col("_lead").cast("double").alias("lead_time_days")))

query("action_details", with_("ac") + """SELECT Booking_ID, channels_txt AS channels, timing_txt AS timing_days_before,
  deposit_pct, priority, reason, escalation_note FROM ac""")(
    lambda spark, sf: action_text(C.ac(spark, sf)).select(
        F.col("booking_id").alias("Booking_ID"), "channels", "timing_days_before", "deposit_pct", "priority", "reason",
        "escalation_note"))

query("action_to_json")(lambda spark, sf: RU.action_to_json(C.ac(spark, sf)))

_SUMMARY_SQL = with_("ac") + """SELECT Booking_ID AS booking_id,
  'Booking ' || CAST(Booking_ID AS VARCHAR) || '  |  P=' || printf('%.4f', no_show_probability) || '  |  ' || risk_level
  || ' risk' || chr(10) || '  Action        : ' || action_type || chr(10) || '  Channels      : '
  || replace(channels_txt, ',', ', ') || chr(10) || '  Timing        : '
  || CASE WHEN timing_txt = '' THEN 'N/A' ELSE replace(timing_txt, ',', 'd before, ') || 'd before' END || chr(10)
  || CASE WHEN deposit_pct <> 0 THEN '  Deposit       : ' || CAST(deposit_pct AS VARCHAR) || '%' || chr(10) ELSE '' END
  || '  Priority      : ' || CAST(priority AS VARCHAR) || '/5' || chr(10) || '  Reason        : ' || reason || chr(10)
  || '  Risk drivers  :' || chr(10)
  || CASE WHEN drivers_txt = '' THEN '    (none)' ELSE '    - ' || replace(drivers_txt, ' | ', chr(10) || '    - ') END
  || chr(10) || '  If no response: ' || escalation_note AS summary
FROM ac"""
query("action_summary", _SUMMARY_SQL)(
    lambda spark, sf: RU.action_record(C.ac(spark, sf)).select("booking_id", RU.action_summary(None).alias("summary")))

query("demo_flow", with_("ac") + """SELECT 'action' AS kind, action_type AS label, CAST(count(*) AS BIGINT) AS n,
  CAST(NULL AS DOUBLE) AS mean_probability FROM ac GROUP BY action_type
UNION ALL SELECT 'level', risk_level, CAST(count(*) AS BIGINT), NULL FROM ac GROUP BY risk_level
UNION ALL SELECT 'overall', 'all', CAST(count(*) AS BIGINT), round(avg(no_show_probability), 6) FROM ac""")(
    lambda spark, sf: __import__("bookrisk.operators.report", fromlist=["x"]).exec_summary(C.ac(spark, sf)))


# read-backs of written tables: same rows as the in-memory keys
query("sink_features", with_("ft") + f"SELECT {sel_text(_BUILD_COLS)}, {_OHE_SQL} FROM ft")(sink_features)
query("scan_feature_matrix", with_("ft") + f"SELECT Booking_ID, {', '.join(_X_COLS)}, {_OHE_SQL}, No_Show FROM ft")(
    scan_feature_matrix)
query("feat_run", with_("ft") + f"SELECT Booking_ID, {', '.join(_X_COLS)}, {_OHE_SQL}, No_Show FROM ft")(feat_run)
