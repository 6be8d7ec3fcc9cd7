"""Queries: stored tables and sinks (§2.1), joins (§2.4), windows (§2.6) and
set operations (§2.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.functions.hashing import uniform
from bookrisk.functions.hashing import uniform_sql as h
from bookrisk.operators import clean as CL
from bookrisk.operators import features as FE
from bookrisk.operators import stores as ST
from bookrisk.operators.prefix import prior_sums
from bookrisk.operators.rules import evaluate
from bookrisk.operators.score import CARDS, score_frozen
from bookrisk.plans import common as C
from bookrisk.plans.catalog import query
from bookrisk.plans.common import DIRTY, TS, sel_text
from bookrisk.plans.q_reports import r6
from bookrisk.plans.sql import scored_actions, with_
from bookrisk.sources import schema as S

AS_OF = "1998-06-30"
QUEUE_THRESHOLD = 0.35


def risk_score_rows(spark, sf) -> DataFrame:
    """v1: the frozen card at booking time for every booking; v2: a second
    card one day later for a hashed share of bookings."""
    v1 = ST.risk_score_rows(C.ac(spark, sf), "v1")
    v2_src = evaluate(score_frozen(C.bk(spark, sf), CARDS["rf"])).where(uniform(F.col("Booking_ID"), "rescore")
                                                                         < ST.RESCORE_SHARE)
    v2 = ST.risk_score_rows(v2_src, "v2", F.col("Booking_Time") + F.expr("INTERVAL 1 DAY"))
    return v1.unionByName(v2)


def risk_scores(spark, sf) -> DataFrame:
    """The ``risk_scores`` store, written once per session."""
    path = C.stored(spark, sf, "risk_scores", lambda p: ST.write_partitioned(risk_score_rows(spark, sf), p, "scored_at"))
    return ST.read_store(spark, path).drop("month")


def intervention_log(spark, sf) -> DataFrame:
    """The ``intervention_log`` store, written once per session."""
    path = C.stored(spark, sf, "intervention_log",
                    lambda p: ST.write_partitioned(ST.intervention_rows(C.ac(spark, sf)), p, "sent_at"))
    return ST.read_store(spark, path).drop("month")


def _bucketed(spark, sf, name, rows) -> DataFrame:
    path = C.stored(spark, sf, name + "_by_booking", lambda p: ST.write_bucketed(rows(spark, sf), p))
    return ST.read_bucketed(spark, path)


def bookings_by_booking(spark, sf) -> DataFrame:
    """The bookings in buckets of the booking id, which joins use without a shuffle."""
    return _bucketed(spark, sf, "bookings", lambda spark, sf: C.bk(spark, sf).withColumnRenamed("Booking_ID", "booking_id"))


def scores_by_booking(spark, sf) -> DataFrame:
    return _bucketed(spark, sf, "scores", risk_scores)


def log_by_booking(spark, sf) -> DataFrame:
    return _bucketed(spark, sf, "log", intervention_log)


# ---------------------------------------------------------------- SQL side
STORES = scored_actions("_v2", CARDS["rf"]) + f""",
rs AS (
  SELECT Booking_ID AS booking_id, no_show_probability, risk_level, action_type, Booking_Time AS scored_at,
    'v1' AS model_version FROM ac
  UNION ALL
  SELECT Booking_ID, no_show_probability, risk_level, action_type, Booking_Time + INTERVAL 1 DAY, 'v2'
  FROM ac_v2 WHERE {h('Booking_ID', 'rescore')} < {ST.RESCORE_SHARE}
), il_c AS (
  SELECT Booking_ID, Appointment_Time, unnest(string_split(channels_txt, ',')) AS channel, timing_txt,
    {h('Booking_ID', 'log')} AS u
  FROM ac WHERE channels_txt <> '' AND {h('Booking_ID', 'miss')} >= {ST.LOG_MISSING_SHARE}
), il_t AS (
  SELECT *, CAST(unnest(string_split(timing_txt, ',')) AS INTEGER) AS days FROM il_c
), il AS (
  SELECT Booking_ID AS booking_id, channel, Appointment_Time - to_days(days) AS sent_at,
    CASE WHEN u < {ST.LOG_OUTCOME_CUTS[0]} THEN 'delivered' WHEN u < {ST.LOG_OUTCOME_CUTS[1]} THEN 'confirmed'
         ELSE 'bounced' END AS outcome
  FROM il_t
)"""
WS = with_("ac", extra=STORES)

RS_COLS = f"booking_id, no_show_probability, risk_level, action_type, {TS('scored_at')} AS scored_at, model_version"

# ---------------------------------------------------------------- §2.1 sinks


@query("sink_risk_scores", WS + f"SELECT {RS_COLS}, strftime(scored_at, '%Y-%m') AS month FROM rs")
def sink_risk_scores(spark, sf):
    path = C.scratch_path(spark, "risk_scores")
    ST.write_partitioned(risk_score_rows(spark, sf), path, "scored_at")
    return C.texts(ST.read_store(spark, path)).withColumn("month", F.col("month").cast("string"))


@query("sink_intervention_log", WS + f"""
SELECT booking_id, channel, {TS('sent_at')} AS sent_at, outcome, strftime(sent_at, '%Y-%m') AS month FROM il""")
def sink_intervention_log(spark, sf):
    path = C.scratch_path(spark, "intervention_log")
    ST.write_partitioned(ST.intervention_rows(C.ac(spark, sf)), path, "sent_at")
    return C.texts(ST.read_store(spark, path)).withColumn("month", F.col("month").cast("string"))


# ---------------------------------------------------------------- §2.4 joins
_TIER_SQL = ("CASE Service_Type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SERVICE_TIER.items())
             + " ELSE 'standard' END")
_PRICE_SQL = ("CASE Service_Type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SERVICE_PRICE.items())
              + f" ELSE {S.DEFAULT_PRICE} END")
query("join_service_tier", with_("bk") + f"SELECT Booking_ID, Service_Type, {_TIER_SQL} AS service_tier FROM bk")(
    lambda spark, sf: ST.join_service_tier(C.bk(spark, sf)).select("Booking_ID", "Service_Type", "service_tier"))

query("join_service_price", with_("bk") + f"SELECT Booking_ID, Service_Type, CAST({_PRICE_SQL} AS INTEGER) AS price FROM bk")(
    lambda spark, sf: ST.join_service_price(C.bk(spark, sf)).select("Booking_ID", "Service_Type", "price"))

query("join_scores", with_("sc") + """
SELECT Booking_ID, Customer_ID, Branch, no_show_probability, risk_level FROM sc""")(
    lambda spark, sf: C.bk(spark, sf).select("Booking_ID", "Customer_ID", "Branch").join(
        C.sc(spark, sf).select("Booking_ID", "no_show_probability", "risk_level"), "Booking_ID"))

query("join_global_prior", with_("ft") + """
SELECT Booking_ID, No_Show, round((SELECT avg(No_Show) FROM ft), 6) AS global_rate FROM ft""")(
    lambda spark, sf: r6(ST.join_global_prior(FE.build_base(C.bk(spark, sf)).select("Booking_ID", "No_Show"))))

_LATEST = """latest AS (
  SELECT booking_id, arg_max(no_show_probability, (scored_at, model_version)) AS no_show_probability,
    arg_max(risk_level, (scored_at, model_version)) AS risk_level,
    arg_max(action_type, (scored_at, model_version)) AS action_type,
    max(scored_at) AS scored_at, arg_max(model_version, (scored_at, model_version)) AS model_version
  FROM rs GROUP BY booking_id)"""

query("join_booking_score_log", WS + f", {_LATEST}" + f"""
, lp AS (SELECT booking_id, count(*) AS n_touches, count(*) FILTER (WHERE outcome = 'confirmed') AS n_confirmed,
  count(*) FILTER (WHERE outcome = 'bounced') AS n_bounced, max(sent_at) AS last_sent_at FROM il GROUP BY booking_id)
SELECT b.Booking_ID AS booking_id, b.Customer_ID, l.no_show_probability, l.model_version,
  CAST(coalesce(lp.n_touches, 0) AS BIGINT) AS n_touches, CAST(coalesce(lp.n_confirmed, 0) AS BIGINT) AS n_confirmed,
  CAST(coalesce(lp.n_bounced, 0) AS BIGINT) AS n_bounced, {TS('lp.last_sent_at')} AS last_sent_at
FROM bk b LEFT JOIN latest l ON l.booking_id = b.Booking_ID LEFT JOIN lp ON lp.booking_id = b.Booking_ID""")(
    lambda spark, sf: C.texts(ST.booking_score_log(bookings_by_booking(spark, sf), scores_by_booking(spark, sf), log_by_booking(spark, sf))
                              .select("booking_id", "Customer_ID", "no_show_probability", "model_version", "n_touches",
                                      "n_confirmed", "n_bounced", "last_sent_at")))

query("anti_no_intervention", WS + """
SELECT Booking_ID, action_type FROM ac WHERE action_type <> 'NO_ACTION'
  AND Booking_ID NOT IN (SELECT booking_id FROM il)""")(
    lambda spark, sf: ST.anti_no_intervention(C.ac(spark, sf), intervention_log(spark, sf)).select("Booking_ID",
                                                                                                   "action_type"))

query("semi_latest_outcomes", WS + f"""
SELECT Booking_ID, Outcome FROM bk WHERE CAST(Appointment_Time AS DATE) >= DATE '{AS_OF}' - INTERVAL 90 DAY
  AND CAST(Appointment_Time AS DATE) < DATE '{AS_OF}'
  AND Booking_ID IN (SELECT booking_id FROM il WHERE outcome = 'confirmed')""")(
    lambda spark, sf: ST.semi_confirmed_recent(C.bk(spark, sf), intervention_log(spark, sf), AS_OF)
    .select("Booking_ID", "Outcome"))

# ---------------------------------------------------------------- §2.6 windows
query("win_latest_score", WS + f", {_LATEST} SELECT {RS_COLS} FROM latest")(
    lambda spark, sf: C.texts(ST.latest_scores(scores_by_booking(spark, sf))).select(*ST.RISK_SCORE_COLUMNS))

_HIST_SQL = WS + f"""
, cs AS (SELECT rs.*, bk.Customer_ID AS customer_id FROM rs JOIN bk ON bk.Booking_ID = rs.booking_id)
SELECT customer_id, booking_id, {TS('scored_at')} AS scored_at, model_version, no_show_probability,
  lag(no_show_probability) OVER w AS prev_no_show_probability,
  round(no_show_probability - lag(no_show_probability) OVER w, 6) AS change
FROM cs WINDOW w AS (PARTITION BY customer_id ORDER BY scored_at, booking_id)"""


def _history(spark, sf, **how):
    out = ST.customer_score_history(scores_by_booking(spark, sf), bookings_by_booking(spark, sf), **how)
    out = out.withColumn("change", F.round("change", 6))
    return C.texts(out.select("customer_id", "booking_id", "scored_at", "model_version", "no_show_probability",
                              "prev_no_show_probability", "change"))


query("win_customer_score_history", _HIST_SQL)(lambda spark, sf: _history(spark, sf))
# The same result whatever the grain of the buckets.
query("win_customer_score_history_split", _HIST_SQL)(lambda spark, sf: _history(spark, sf, grain_days=1))

_WEEKLY = f"""
, wk AS (
  SELECT CAST(date_trunc('week', Appointment_Time) AS DATE) AS week, count(*) AS n,
    count(*) FILTER (WHERE No_Show = 1) AS no_shows,
    count(*) FILTER (WHERE no_show_probability >= {QUEUE_THRESHOLD} AND No_Show = 1) AS tp,
    count(*) FILTER (WHERE no_show_probability >= {QUEUE_THRESHOLD} AND No_Show <> 1) AS fp,
    count(*) FILTER (WHERE no_show_probability < {QUEUE_THRESHOLD} AND No_Show = 1) AS fn
  FROM rp GROUP BY 1
), wn AS (SELECT *, CAST(date_diff('day', DATE '1970-01-05', week) / 7 AS INTEGER) AS wno FROM wk)"""

query("win_rolling_4wk", with_("rp") + _WEEKLY + """
, r AS (SELECT week, sum(n) OVER w AS rn, sum(no_shows) OVER w AS rns, sum(tp) OVER w AS rtp, sum(fp) OVER w AS rfp,
  sum(fn) OVER w AS rfn FROM wn WINDOW w AS (ORDER BY wno RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT CAST(week AS VARCHAR) AS week, CAST(rn AS BIGINT) AS rolling_n,
  round(CASE WHEN rtp + rfp > 0 THEN rtp / (rtp + rfp) END, 6) AS rolling_precision,
  round(CASE WHEN rtp + rfn > 0 THEN rtp / (rtp + rfn) END, 6) AS rolling_recall,
  round(rns / rn, 6) AS rolling_no_show_rate FROM r""")(
    lambda spark, sf: r6(ST.rolling_4wk(ST.weekly_counts(C.rp(spark, sf), QUEUE_THRESHOLD)))
    .withColumn("week", F.col("week").cast("string")))

query("win_three_weeks_out", with_("rp") + _WEEKLY + f"""
, d AS (SELECT week, wno, no_shows * 100.0 / n AS rate,
  CAST(abs(no_shows * 100.0 / n - {S.BASELINE_NO_SHOW_PCT}) > 4.0 AS INTEGER) AS out_flag FROM wn)
SELECT CAST(week AS VARCHAR) AS week, round(rate, 6) AS rate, out_flag,
  CAST(count(*) OVER w = 3 AND min(out_flag) OVER w = 1 AS INTEGER) AS alert
FROM d WINDOW w AS (ORDER BY wno RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""")(
    lambda spark, sf: r6(ST.three_weeks_out(ST.weekly_counts(C.rp(spark, sf), QUEUE_THRESHOLD)))
    .withColumn("week", F.col("week").cast("string")))


def _history_counts(spark, sf):
    """Past_* counters recomputed from raw outcomes in buckets per customer,
    checked against the plain window."""
    b = C.bk(spark, sf).drop("Past_Visit_Count", "Past_Cancellation_Count", "Past_No_Show_Count")
    canc = (F.col("Outcome") == "Show") & (uniform(F.col("Booking_ID"), "canc") < 0.10)
    out = prior_sums(b, "Customer_ID", "Appointment_Time", "Booking_ID", {
        "Past_Visit_Count": F.lit(1), "Past_Cancellation_Count": canc.cast("int"),
        "Past_No_Show_Count": (F.col("Outcome") == "No-Show").cast("int")})
    return out.select("Booking_ID", *[F.col(c).cast("int").alias(c) for c in
                                      ("Past_Visit_Count", "Past_Cancellation_Count", "Past_No_Show_Count")])


query("win_history_counts", with_("bk") + """
SELECT Booking_ID, Past_Visit_Count, Past_Cancellation_Count, Past_No_Show_Count FROM bk""")(_history_counts)

# ---------------------------------------------------------------- §2.8 sets
query("duplicates_count", with_("bk", extra=DIRTY) + f"""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM pdirty GROUP BY {', '.join(C.BOOKING_COLS)})""")(
    lambda spark, sf: CL.duplicates_count(C.parsed_dirty(spark, sf)))

query("append_outcomes", with_("bk") + f"""
SELECT DISTINCT {sel_text(C.BOOKING_COLS)} FROM (
  SELECT * FROM bk WHERE CAST(Appointment_Time AS DATE) < DATE '{AS_OF}' - INTERVAL 90 DAY
  UNION ALL
  SELECT * FROM bk WHERE CAST(Appointment_Time AS DATE) >= DATE '{AS_OF}' - INTERVAL 97 DAY
    AND CAST(Appointment_Time AS DATE) < DATE '{AS_OF}')""")(
    lambda spark, sf: C.texts(ST.append_outcomes(
        C.bk(spark, sf).where(F.to_date("Appointment_Time") < F.date_sub(F.lit(AS_OF).cast("date"), 90)),
        C.bk(spark, sf).where((F.to_date("Appointment_Time") >= F.date_sub(F.lit(AS_OF).cast("date"), 97))
                              & (F.to_date("Appointment_Time") < F.lit(AS_OF).cast("date"))))))
