"""Queries: filters (§2.3), aggregations (§2.5) and ordering / top-k (§2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.operators import distinct as DS
from bookrisk.operators import features as FE
from bookrisk.operators import report as RP
from bookrisk.plans import common as C
from bookrisk.plans.catalog import query
from bookrisk.plans.common import DIRTY, TS, sel_text
from bookrisk.plans.q_core import FULL_SQL
from bookrisk.plans.sql import with_
from bookrisk.sources import schema as S

# Dashboard filter used by the filtered keys.
DATES = ("1996-01-01", "1997-12-31")
BRANCHES = ["Chennai", "Delhi_CP", "Surat"]
SERVICES = ["Facial", "Hair Spa", "Haircut"]
LEVELS = ["High", "Medium"]
RUN_DATE = "1996-03-14"


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (engine-neutral output)."""
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema.fields if f.dataType.typeName() == "double"})


def _in(vals):
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


DAY_IDX = "list_position(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'], Day_of_Week)"
EDA = ("eda AS (SELECT *, CAST(coalesce(Outcome = 'No-Show', false) AS INTEGER) AS Is_NoShow, "
       "CAST(coalesce(Outcome = 'No-Show', false) AS INTEGER) AS No_Show FROM bk)")


def eda(spark, sf):
    return C.bk(spark, sf).withColumn("Is_NoShow", F.coalesce(F.col("Outcome") == "No-Show", F.lit(False)).cast("int")) \
        .withColumn("No_Show", F.col("Is_NoShow"))


# ------------------------------------------------------------------ §2.3
query("filter_dashboard", with_("rp") + f"""
SELECT Booking_ID, Branch, Service_Type, risk_level, {TS('Appointment_Time')} AS Appointment_Time FROM rp
WHERE Appointment_Time >= TIMESTAMP '{DATES[0]}' AND Appointment_Time <= TIMESTAMP '{DATES[1]}'
  AND Branch IN {_in(BRANCHES)} AND Service_Type IN {_in(SERVICES)} AND risk_level IN {_in(LEVELS)}""")(
    lambda spark, sf: C.texts(RP.filter_dashboard(C.rp(spark, sf), DATES, BRANCHES, SERVICES, LEVELS)
                              .select("Booking_ID", "Branch", "Service_Type", "risk_level", "Appointment_Time")))

query("filter_dashboard_full_day", with_("rp") + f"""
SELECT Booking_ID, {TS('Appointment_Time')} AS Appointment_Time FROM rp
WHERE Appointment_Time >= TIMESTAMP '{DATES[0]}' AND Appointment_Time < TIMESTAMP '{DATES[1]}' + INTERVAL 1 DAY""")(
    lambda spark, sf: C.texts(RP.filter_dashboard(C.rp(spark, sf), DATES, [], None, [], end_inclusive_day=True)
                              .select("Booking_ID", "Appointment_Time")))

query("filter_bounds", with_("bk") + """
SELECT CAST(min(CAST(Appointment_Time AS DATE)) AS VARCHAR) AS min_date,
  CAST(max(CAST(Appointment_Time AS DATE)) AS VARCHAR) AS max_date,
  array_to_string(list_sort(list_distinct(list(Branch))), ', ') AS branches,
  array_to_string(list_sort(list_distinct(list(Service_Type))), ', ') AS services FROM bk""")(
    lambda spark, sf: RP.filter_bounds(C.bk(spark, sf)).withColumns(
        {"min_date": F.col("min_date").cast("string"), "max_date": F.col("max_date").cast("string")}))

query("filter_missing_report", with_("bk", extra=DIRTY) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing_count, "
    f"round_even(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS missing_pct FROM pdirty "
    f"HAVING count(*) FILTER (WHERE {c} IS NULL) > 0" for c in C.BOOKING_COLS))(
    lambda spark, sf: RP.missing_report(C.parsed_dirty(spark, sf)))

query("filter_deposit_queue", with_("ac") + f"""
SELECT Booking_ID, action_type, deposit_pct FROM ac WHERE action_type IN {_in(S.DEPOSIT_ACTIONS)}""")(
    lambda spark, sf: RP.queue(C.ac(spark, sf), S.DEPOSIT_ACTIONS).select("Booking_ID", "action_type", "deposit_pct"))

query("filter_reminder_queue", with_("ac") + f"""
SELECT Booking_ID, action_type, priority FROM ac WHERE action_type IN {_in(S.REMINDER_ACTIONS)}""")(
    lambda spark, sf: RP.queue(C.ac(spark, sf), S.REMINDER_ACTIONS).select("Booking_ID", "action_type", "priority"))

query("filter_no_action", with_("ac") + """
SELECT Booking_ID, no_show_probability, (SELECT CAST(count(*) AS BIGINT) FROM ac WHERE action_type = 'NO_ACTION')
  AS n_no_action FROM ac WHERE action_type = 'NO_ACTION'""")(
    lambda spark, sf: (lambda q: q.select("Booking_ID", "no_show_probability").crossJoin(
        F.broadcast(q.agg(F.count(F.lit(1)).cast("bigint").alias("n_no_action")))))(
        RP.queue(C.ac(spark, sf), ["NO_ACTION"])))

query("filter_outcome_split", with_("bk") + """
SELECT Booking_ID, Outcome AS part FROM bk WHERE Outcome IN ('Show', 'No-Show')""")(
    lambda spark, sf: C.bk(spark, sf).where(F.col("Outcome") == "Show").select("Booking_ID", F.col("Outcome").alias("part"))
    .unionByName(C.bk(spark, sf).where(F.col("Outcome") == "No-Show").select("Booking_ID", F.col("Outcome").alias("part"))))

query("filter_next_day", with_("ac") + f"""
SELECT Booking_ID, {TS('Appointment_Time')} AS Appointment_Time, no_show_probability, action_type FROM ac
WHERE CAST(Appointment_Time AS DATE) = DATE '{RUN_DATE}' + INTERVAL 1 DAY""")(
    lambda spark, sf: C.texts(RP.filter_next_day(C.ac(spark, sf), RUN_DATE)
                              .select("Booking_ID", "Appointment_Time", "no_show_probability", "action_type")))

# ------------------------------------------------------------------ §2.5
query("agg_exec_kpis", with_("rp") + f"""
SELECT CAST(count(*) AS BIGINT) AS total_bookings, round(coalesce(avg(No_Show) * 100, 0), 6) AS no_show_pct,
  CAST(count(*) FILTER (WHERE risk_level = 'High') AS BIGINT) AS high_risk,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE risk_level = 'High') * 100.0 / count(*) ELSE 0 END, 6)
    AS high_risk_pct,
  round(coalesce(sum(Revenue) FILTER (WHERE No_Show = 1), 0), 6) AS revenue_lost,
  round(coalesce(sum(Revenue_At_Risk), 0), 6) AS revenue_at_risk,
  round(coalesce(avg(No_Show) * 100, 0) - {S.BASELINE_NO_SHOW_PCT}, 6) AS delta_vs_baseline FROM rp""")(
    lambda spark, sf: r6(RP.exec_kpis(C.rp(spark, sf))))

query("agg_exec_kpis_empty", with_("rp") + f"""
SELECT CAST(count(*) AS BIGINT) AS total_bookings, round(coalesce(avg(No_Show) * 100, 0), 6) AS no_show_pct,
  CAST(count(*) FILTER (WHERE risk_level = 'High') AS BIGINT) AS high_risk, 0.0 AS high_risk_pct,
  round(coalesce(sum(Revenue) FILTER (WHERE No_Show = 1), 0), 6) AS revenue_lost,
  round(coalesce(sum(Revenue_At_Risk), 0), 6) AS revenue_at_risk,
  round(coalesce(avg(No_Show) * 100, 0) - {S.BASELINE_NO_SHOW_PCT}, 6) AS delta_vs_baseline
FROM rp WHERE Branch = 'Nowhere'""")(
    lambda spark, sf: r6(RP.exec_kpis(RP.filter_dashboard(C.rp(spark, sf), branches=["Nowhere"]))))

query("agg_outcome_counts", with_("bk") + """
SELECT Outcome, CAST(count(*) AS BIGINT) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
FROM bk WHERE Outcome IS NOT NULL GROUP BY Outcome""")(lambda spark, sf: RP.outcome_counts(C.bk(spark, sf)))

query("agg_monthly_rate", with_("rp") + """
SELECT strftime(Appointment_Time, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS total,
  CAST(sum(No_Show) AS BIGINT) AS no_shows, round(sum(No_Show) * 100.0 / count(*), 6) AS rate FROM rp GROUP BY 1""")(
    lambda spark, sf: r6(RP.monthly_rate(C.rp(spark, sf))))

query("agg_by_branch", with_("rp") + """
SELECT Branch, round(avg(No_Show) * 100, 6) AS no_show_rate, CAST(count(*) AS BIGINT) AS n,
  CAST(row_number() OVER (ORDER BY avg(No_Show) * 100, Branch) AS INTEGER) AS ord FROM rp GROUP BY Branch""")(
    lambda spark, sf: r6(RP.by_branch(C.rp(spark, sf))))

query("agg_by_service", with_("rp") + """
, g AS (SELECT Service_Type, avg(No_Show) * 100 AS no_show_rate, CAST(count(*) AS BIGINT) AS n,
  avg(Revenue) AS avg_revenue FROM rp GROUP BY Service_Type)
SELECT Service_Type, round(no_show_rate, 6) AS no_show_rate, n, round(avg_revenue, 6) AS avg_revenue,
  round((SELECT median(avg_revenue) FROM g), 6) AS median_avg_revenue,
  CAST(row_number() OVER (ORDER BY no_show_rate, Service_Type) AS INTEGER) AS ord FROM g""")(
    lambda spark, sf: r6(RP.by_service(C.rp(spark, sf))))

query("agg_day_hour_heatmap", with_("rp") + "SELECT Day_of_Week, CAST(" + DAY_IDX + " AS INTEGER) AS day_index, "
      + ", ".join(f"round_even(avg(No_Show) FILTER (WHERE Appt_Hour = {h}) * 100, 1) AS h{h:02d}" for h in range(24))
      + " FROM rp GROUP BY Day_of_Week")(lambda spark, sf: RP.day_hour_heatmap(C.rp(spark, sf)))

query("agg_new_vs_repeat", with_("rp") + """
SELECT Is_New_Customer, CAST(count(*) AS BIGINT) AS n, round(avg(No_Show), 6) AS mean,
  CASE WHEN Is_New_Customer = 1 THEN 'New Customer' ELSE 'Repeat Customer' END AS label,
  round_even(avg(No_Show) * 100, 1) AS no_show_rate FROM rp GROUP BY Is_New_Customer""")(
    lambda spark, sf: r6(RP.new_vs_repeat(C.rp(spark, sf))))

query("agg_by_hour", with_("rp") + """
SELECT Appt_Hour, round(avg(No_Show) * 100, 6) AS no_show_rate, CAST(count(*) AS BIGINT) AS n FROM rp GROUP BY 1""")(
    lambda spark, sf: r6(RP.by_hour(C.rp(spark, sf))))

query("agg_by_payment", with_("rp") + """
SELECT Payment_Method, round(avg(No_Show) * 100, 6) AS no_show_rate, CAST(count(*) AS BIGINT) AS n,
  round(sum(Revenue_At_Risk), 6) AS revenue_at_risk,
  CAST(row_number() OVER (ORDER BY avg(No_Show) * 100 DESC, Payment_Method) AS INTEGER) AS ord
FROM rp GROUP BY Payment_Method""")(lambda spark, sf: r6(RP.by_payment(C.rp(spark, sf))))

query("agg_by_lead", with_("rp") + """
SELECT Booking_Lead_Time_Days, round(avg(No_Show) * 100, 6) AS no_show_rate, CAST(count(*) AS BIGINT) AS n
FROM rp GROUP BY 1""")(lambda spark, sf: r6(RP.by_lead(C.rp(spark, sf))))

query("agg_risk_histogram", with_("rp") + """
SELECT bin, risk_level, CAST(count(*) AS BIGINT) AS n, round(bin / 40.0, 6) AS bin_lo, round((bin + 1) / 40.0, 6) AS bin_hi
FROM (SELECT CAST(least(39, floor(no_show_probability * 40)) AS INTEGER) AS bin, risk_level FROM rp) GROUP BY 1, 2""")(
    lambda spark, sf: RP.risk_histogram(C.rp(spark, sf)))

query("agg_lead_histogram", with_("rp") + """
SELECT Booking_Lead_Time_Days AS lead_days, risk_level, CAST(count(*) AS BIGINT) AS n FROM rp GROUP BY 1, 2""")(
    lambda spark, sf: RP.lead_histogram(C.rp(spark, sf)))

query("agg_distinct_branches", with_("bk") + "SELECT CAST(count(DISTINCT Branch) AS BIGINT) AS n_branches FROM bk")(
    lambda spark, sf: RP.distinct_branches(C.bk(spark, sf)))


@query("agg_distinct_sketched")
def agg_distinct_sketched(spark, sf):
    """Levels and customers per year, from the monthly sketches."""
    cols = ["Customer_ID", *S.ENCODED_COLUMNS]
    months = DS.monthly(C.bk(spark, sf), cols, "Appointment_Time")
    return DS.counts(DS.merged(months, F.substring("month", 1, 4).alias("year")))


query("agg_day_rate", with_("bk", extra=EDA) + f"""
SELECT Day_of_Week, round_even(avg(No_Show) * 100, 1) AS no_show_rate, CAST({DAY_IDX} AS INTEGER) AS day_index
FROM eda GROUP BY Day_of_Week""")(lambda spark, sf: RP.day_rate(eda(spark, sf)))

query("agg_describe", with_("bk") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, round_even(avg({c}), 2) AS mean, "
    f"round_even(stddev_samp({c}), 2) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    f"round_even(quantile_cont({c}, 0.25), 2) AS q25, round_even(quantile_cont({c}, 0.5), 2) AS q50, "
    f"round_even(quantile_cont({c}, 0.75), 2) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM bk"
    for c in RP.DESCRIBE_COLUMNS))(lambda spark, sf: RP.describe(C.bk(spark, sf)))

_ENG = ["Lead_Time_Days", "Appt_Hour", "Past_Visit_Count", "Past_No_Show_Count", "Past_Cancellation_Count",
        "Log_Past_Visit_Count", "Customer_No_Show_Rate", "Cancellation_Ratio", "Is_New_Customer",
        "Successful_Visit_Rate", "Is_Edge_Hour"]
query("agg_describe_engineered", with_("ft") + FULL_SQL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, round_even(avg({c}), 4) AS mean, "
    f"round_even(stddev_samp({c}), 4) AS std, round_even(min({c}), 4) AS min, "
    f"round_even(quantile_cont({c}, 0.25), 4) AS q25, round_even(quantile_cont({c}, 0.5), 4) AS q50, "
    f"round_even(quantile_cont({c}, 0.75), 4) AS q75, round_even(max({c}), 4) AS max FROM full2"
    for c in _ENG))(lambda spark, sf: RP.describe(FE.build_full(C.bk(spark, sf)), _ENG, places=4))

query("agg_value_counts", with_("bk") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n, "
    f"round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM bk WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in S.CATEGORICAL_COLUMNS))(lambda spark, sf: RP.value_counts(C.bk(spark, sf)))

_FLAG_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS flag, {f} AS value, CAST(count(*) AS BIGINT) AS n, "
    f"round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct, "
    f"CASE WHEN {f} = 1 THEN '{lab[1]}' ELSE '{lab[0]}' END AS label FROM ft GROUP BY {f}"
    for f, lab in RP.FLAG_LABELS.items())
query("agg_flag_distribution", with_("ft") + _FLAG_SQL)(
    lambda spark, sf: RP.flag_distribution(FE.build_base(C.bk(spark, sf))))

query("agg_capped_distribution", with_("ft") + FULL_SQL + """
SELECT Capped_Good_Visits, CAST(count(*) AS BIGINT) AS n FROM full2 GROUP BY 1""")(
    lambda spark, sf: RP.capped_distribution(FE.build_full(C.bk(spark, sf))))

query("agg_nunique_levels", with_("bk") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_levels, "
    f"array_to_string(list_sort(list_distinct(list({c}))), ', ') AS levels FROM bk" for c in S.ENCODED_COLUMNS))(
    lambda spark, sf: RP.nunique_levels(C.bk(spark, sf)))

query("agg_min_max_mean", with_("ft") + """
SELECT CAST(min(Lead_Time_Days) AS DOUBLE) AS Lead_Time_Days_min, CAST(max(Lead_Time_Days) AS DOUBLE) AS Lead_Time_Days_max,
  round_even(avg(Lead_Time_Days), 2) AS Lead_Time_Days_mean, CAST(min(Appt_Hour) AS DOUBLE) AS Appt_Hour_min,
  CAST(max(Appt_Hour) AS DOUBLE) AS Appt_Hour_max, round_even(avg(Appt_Hour), 2) AS Appt_Hour_mean FROM ft""")(
    lambda spark, sf: RP.min_max_mean(FE.build_base(C.bk(spark, sf))))

query("agg_behaviour_by_outcome", with_("bk") + " UNION ALL ".join(
    f"SELECT Outcome, '{c}' AS column_name, round_even(avg({c}), 3) AS mean, round_even(median({c}), 3) AS median, "
    f"round_even(stddev_samp({c}), 3) AS std FROM bk GROUP BY Outcome" for c in RP.BEHAVIOUR_COLUMNS))(
    lambda spark, sf: RP.behaviour_by_outcome(C.bk(spark, sf)))

query("agg_correlation", with_("bk", extra=EDA) + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round_even(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 3) AS corr FROM eda"
    for a in RP.CORR_COLUMNS for b in RP.CORR_COLUMNS))(lambda spark, sf: RP.correlation(eda(spark, sf)))

query("agg_target_corr", with_("ft") + """
SELECT round_even(corr(Customer_Latent_Risk, CAST(No_Show AS DOUBLE)), 4) AS corr_with_target FROM ft""")(
    lambda spark, sf: RP.target_corr(FE.build_base(C.bk(spark, sf))))

_BOX = " UNION ALL ".join(f"""SELECT Outcome, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM bk""" for c in RP.BEHAVIOUR_COLUMNS)
query("agg_boxplot", with_("bk") + f"""
, long AS ({_BOX}),
q AS (SELECT Outcome, column_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2)
SELECT q.Outcome, q.column_name, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
  max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
  CAST(count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM q JOIN long l ON q.Outcome = l.Outcome AND q.column_name = l.column_name GROUP BY 1, 2, 3, 4, 5""")(
    lambda spark, sf: r6(RP.boxplot(C.bk(spark, sf))))

query("agg_exec_summary", with_("ac") + """
SELECT 'action' AS section, action_type AS label, CAST(count(*) AS BIGINT) AS n,
  CAST(row_number() OVER (ORDER BY action_type) AS INTEGER) AS ord, CAST(NULL AS DOUBLE) AS value FROM ac GROUP BY action_type
UNION ALL SELECT 'level', risk_level, CAST(count(*) AS BIGINT),
  CAST(list_position(['High', 'Medium', 'Low'], risk_level) AS INTEGER), NULL FROM ac GROUP BY risk_level
UNION ALL SELECT 'high_risk', 'High', CAST(count(*) FILTER (WHERE risk_level = 'High') AS BIGINT), 1, NULL FROM ac
UNION ALL SELECT 'mean_probability', 'all', CAST(count(*) AS BIGINT), 1, round(avg(no_show_probability), 6) FROM ac""")(
    lambda spark, sf: RP.exec_summary_table(C.ac(spark, sf)))

# ------------------------------------------------------------------ §2.7
_TOP = [c for c in RP.TOP_RISK_COLUMNS]
query("topk_riskiest", with_("sc") + f"""
SELECT {sel_text(_TOP)} FROM sc ORDER BY no_show_probability DESC, Booking_ID LIMIT 500""")(
    lambda spark, sf: C.texts(RP.top_riskiest(C.sc(spark, sf))))

query("topk_preview", with_("bk") + f"SELECT {sel_text(C.BOOKING_COLS)} FROM bk ORDER BY Booking_ID LIMIT 5")(
    lambda spark, sf: C.texts(RP.preview(C.bk(spark, sf))))

query("argmax_day_hour", with_("bk", extra=EDA) + f"""
, d AS (SELECT Day_of_Week, round_even(avg(No_Show) * 100, 1) AS r, {DAY_IDX} AS i FROM eda GROUP BY 1),
h AS (SELECT hour(Appointment_Time) AS hr, round_even(avg(No_Show) * 100, 1) AS r FROM eda GROUP BY 1)
SELECT (SELECT Day_of_Week FROM d ORDER BY r DESC, i LIMIT 1) AS worst_day, (SELECT max(r) FROM d) AS worst_day_rate,
  (SELECT Day_of_Week FROM d ORDER BY r, i LIMIT 1) AS best_day, (SELECT min(r) FROM d) AS best_day_rate,
  (SELECT CAST(hr AS INTEGER) FROM h ORDER BY r DESC, hr LIMIT 1) AS worst_hour, (SELECT max(r) FROM h) AS worst_hour_rate,
  (SELECT CAST(hr AS INTEGER) FROM h ORDER BY r, hr LIMIT 1) AS best_hour, (SELECT min(r) FROM h) AS best_hour_rate""")(
    lambda spark, sf: RP.argmax_day_hour(FE.add_appointment_hour(eda(spark, sf))))

_SAMPLE = ["Past_Visit_Count", "Past_No_Show_Count", "Customer_No_Show_Rate", "Smoothed_NoShow_Rate"]
query("distinct_sorted_sample", with_("ft") + FULL_SQL + f"""
SELECT DISTINCT {', '.join(_SAMPLE)} FROM full2 ORDER BY {', '.join(_SAMPLE)} LIMIT 12""")(
    lambda spark, sf: RP.distinct_sorted_sample(FE.build_full(C.bk(spark, sf)), _SAMPLE, 12))

query("distinct_sorted_log_sample", with_("ft") + FULL_SQL + """
SELECT DISTINCT Past_Visit_Count, Log_Past_Visit_Count FROM full2 ORDER BY 1, 2 LIMIT 10""")(
    lambda spark, sf: RP.distinct_sorted_sample(FE.build_full(C.bk(spark, sf)),
                                                ["Past_Visit_Count", "Log_Past_Visit_Count"], 10))

query("intervention_queue", with_("ac") + f"""
SELECT CAST(CAST(Appointment_Time AS DATE) AS VARCHAR) AS queue_date, Booking_ID, {TS('Appointment_Time')} AS Appointment_Time,
  action_type, priority, risk_level, no_show_probability FROM ac WHERE action_type <> 'NO_ACTION'""")(
    lambda spark, sf: C.texts(RP.intervention_queue(C.ac(spark, sf))).withColumn("queue_date",
                                                                                 F.col("queue_date").cast("string")))
