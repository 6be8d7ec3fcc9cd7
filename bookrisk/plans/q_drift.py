"""Queries: drift, monitoring, retraining and KPIs.

Reference period: appointments before ``DRIFT_DATE``; current: from it on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.functions.hashing import uniform_sql as h
from bookrisk.operators import drift as D
from bookrisk.operators import features as FE
from bookrisk.operators import metrics as M
from bookrisk.operators import stores as ST
from bookrisk.operators import summaries as SU
from bookrisk.operators.split import stratified_sql
from bookrisk.plans import common as C
from bookrisk.plans.catalog import query
from bookrisk.plans.q_metrics import W as METRICS_W
from bookrisk.plans.q_metrics import CM, part
from bookrisk.plans.q_reports import r6
from bookrisk.plans.q_stores import QUEUE_THRESHOLD, STORES, _WEEKLY, intervention_log, risk_scores
from bookrisk.plans.sql import with_
from bookrisk.sources.bookings import scoring_log

DRIFT_DATE = "2000-01-01"
PSI_FEATURES = ["Customer_No_Show_Rate", "Customer_Latent_Risk"]
CHI_FEATURES = ["Payment_Method", "Is_New_Customer", "Is_Edge_Hour"]


def periods(spark, sf) -> DataFrame:
    return D.period(FE.build_base(C.bk(spark, sf)), DRIFT_DATE)


def psi_table(spark, sf):
    return D.psi(periods(spark, sf), PSI_FEATURES)


def ks_table(spark, sf):
    return D.ks_two_sample(periods(spark, sf), "Lead_Time_Days")


def chi_table(spark, sf):
    return D.chi2_drift(periods(spark, sf), CHI_FEATURES)


def rolling(spark, sf):
    return ST.rolling_4wk(ST.weekly_counts(C.rp(spark, sf), QUEUE_THRESHOLD))


# ---------------------------------------------------------------- SQL side
PD = f"pd AS (SELECT *, CASE WHEN Appointment_Time < TIMESTAMP '{DRIFT_DATE}' THEN 'reference' ELSE 'current' END AS period FROM ft)"
_EDGES = ", ".join(f"CAST({i} AS DOUBLE) * ((hi - lo) / 10.0) + lo" for i in range(1, 10))
PSI = PD + f""",
plg AS ({' UNION ALL '.join(f"SELECT period, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM pd" for f in PSI_FEATURES)}),
rng AS (SELECT feature, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
  CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM plg WHERE period = 'reference' AND x IS NOT NULL GROUP BY feature),
pj AS (SELECT plg.feature, period, len(list_filter([{_EDGES}], lambda e: e <= x)) AS bin
  FROM plg JOIN rng USING (feature) WHERE x >= lo AND x <= hi),
pc AS (SELECT feature, bin, count(*) FILTER (WHERE period = 'reference') AS e, count(*) FILTER (WHERE period = 'current') AS a
  FROM pj GROUP BY ALL),
pg AS (SELECT r.feature, b.bin, coalesce(pc.e, 0) AS e, coalesce(pc.a, 0) AS a
  FROM rng r CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b
  LEFT JOIN pc ON pc.feature = r.feature AND pc.bin = b.bin),
ps AS (SELECT feature, greatest(1e-6, e / sum(e) OVER (PARTITION BY feature)) AS ep,
  greatest(1e-6, a / sum(a) OVER (PARTITION BY feature)) AS ap FROM pg),
psi AS (SELECT feature, sum((ap - ep) * ln(ap / ep)) AS psi FROM ps GROUP BY feature)"""

KS = PD + """,
kc AS (SELECT CAST(Lead_Time_Days AS DOUBLE) AS v, count(*) FILTER (WHERE period = 'reference') AS r,
  count(*) FILTER (WHERE period = 'current') AS c FROM pd WHERE Lead_Time_Days IS NOT NULL GROUP BY 1),
kcc AS (SELECT sum(r) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cr, sum(c) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cc,
  sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM kc),
kd AS (SELECT max(abs(cr / nr - cc / nc)) AS d, CAST(max(nr) AS DOUBLE) AS n1, CAST(max(nc) AS DOUBLE) AS n2 FROM kcc),
kl AS (SELECT d, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS lam FROM kd),
ks AS (SELECT 'Lead_Time_Days' AS feature, d, CASE WHEN lam <= 0 THEN 1.0 WHEN lam < 1 THEN greatest(0.0, least(1.0, 1 - sqrt(2 * pi()) / lam
  * list_sum(list_transform(range(1, 21), lambda k: exp(-pow(2 * k - 1, 2) * pi() * pi() / (8 * lam * lam)))))) ELSE greatest(0.0, least(1.0,
  2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam))))) END AS p_value FROM kl)"""

CHI = PD + f""",
clg AS ({' UNION ALL '.join(f"SELECT period, '{f}' AS feature, CAST({f} AS VARCHAR) AS level FROM pd" for f in CHI_FEATURES)}),
cc AS (SELECT feature, level, count(*) FILTER (WHERE period = 'reference') AS o_r, count(*) FILTER (WHERE period = 'current') AS o_c
  FROM clg WHERE level IS NOT NULL GROUP BY ALL),
ce AS (SELECT *, o_r + o_c AS rw, sum(o_r) OVER (PARTITION BY feature) AS tr, sum(o_c) OVER (PARTITION BY feature) AS tc,
  count(*) OVER (PARTITION BY feature) AS k FROM cc),
cs AS (SELECT feature, sum(pow(o_r - rw * tr / (tr + tc), 2) / (rw * tr / (tr + tc))
  + pow(o_c - rw * tc / (tr + tc), 2) / (rw * tc / (tr + tc))) AS statistic, CAST(max(k) - 1 AS INTEGER) AS dof FROM ce GROUP BY feature),
chi AS (SELECT feature, statistic, dof, CASE WHEN statistic <= 0 THEN 1.0 WHEN statistic > 200 + 2 * dof THEN 0.0 ELSE  -- below 1e-20 there
 
  greatest(0.0, least(1.0, 1.0 - exp((dof / 2.0) * ln(statistic / 2.0) - statistic / 2.0) *
  list_sum(list_transform(range(0, 400), lambda n: exp(n * ln(statistic / 2.0) - lgamma(dof / 2.0 + n + 1)))))) END AS p_value
  FROM cs)"""

ROLL = _WEEKLY + """
, r AS (SELECT week, sum(n) OVER w AS rn, sum(no_shows) OVER w AS rns, sum(tp) OVER w AS rtp, sum(fp) OVER w AS rfp,
  sum(fn) OVER w AS rfn FROM wn WINDOW w AS (ORDER BY wno RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)),
roll AS (SELECT week, rn AS rolling_n, CASE WHEN rtp + rfp > 0 THEN rtp / (rtp + rfp) END AS rolling_precision,
  CASE WHEN rtp + rfn > 0 THEN rtp / (rtp + rfn) END AS rolling_recall, rns / rn AS rolling_no_show_rate FROM r)"""

# ---------------------------------------------------------------- keys
query("psi", with_("ft") + ", " + PSI + """
SELECT feature, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'no significant drift' WHEN psi <= 0.2
  THEN 'moderate drift' ELSE 'significant drift' END AS status FROM psi""")(
    lambda spark, sf: r6(psi_table(spark, sf)))


def psi_summaries_table(spark, sf):
    """Counts per day, feature and cell, stored once per session."""
    path = C.stored(spark, sf, "psi_summaries", lambda p: SU.summarise(FE.build_base(C.bk(spark, sf)), PSI_FEATURES).write.parquet(p))
    return spark.read.parquet(path)


_REFERENCE, _CURRENT = f"day < DATE '{DRIFT_DATE}'", f"CASE WHEN day >= DATE '{DRIFT_DATE}' THEN {{}} END"


@query("psi_summaries", with_("ft") + ", " + PSI + """
SELECT 'current' AS period, feature, round(psi, 6) AS psi, CAST(1 AS INTEGER) AS between, CASE WHEN psi < 0.1 THEN 'no significant drift'
  WHEN psi <= 0.2 THEN 'moderate drift' ELSE 'significant drift' END AS status FROM psi""")
def psi_summaries(spark, sf):
    """The index of the rows from the stored counts, and whether its bounds hold it."""
    d = SU.psi_between(psi_summaries_table(spark, sf), F.expr(_REFERENCE), F.expr(_CURRENT.format("'current'")))
    held = F.col("psi").between(F.col("psi_low") - 1e-9, F.col("psi_high") + 1e-9).cast("int").alias("between")
    return r6(d.select("period", "feature", "psi", held, "status"))


@query("psi_weekly_summaries")
def psi_weekly_summaries(spark, sf):
    """The index of every week from the same counts, with its bounds."""
    week = F.expr(_CURRENT.format("CAST(date_trunc('week', day) AS DATE)"))
    return SU.psi_between(psi_summaries_table(spark, sf), F.expr(_REFERENCE), week, "week").withColumn("week", F.col("week").cast("string"))


query("psi_status", with_("ft") + ", " + PSI + """
SELECT feature, CASE WHEN psi < 0.1 THEN 'no significant drift' WHEN psi <= 0.2 THEN 'moderate drift'
  ELSE 'significant drift' END AS status, CAST(psi > 0.2 AS INTEGER) AS retrain FROM psi""")(
    lambda spark, sf: psi_table(spark, sf).select("feature", "status",
                                                  (F.col("psi") > D.PSI_SIGNIFICANT).cast("int").alias("retrain")))

query("ks_two_sample", with_("ft") + ", " + KS + """
SELECT feature, round(d, 6) AS d, round(p_value, 6) AS p_value, CAST(p_value < 0.01 AS INTEGER) AS alert FROM ks""")(
    lambda spark, sf: r6(ks_table(spark, sf)))

query("chi2_drift", with_("ft") + ", " + CHI + """
SELECT feature, round(statistic, 6) AS statistic, dof, round(p_value, 6) AS p_value,
  CAST(p_value < 0.01 AS INTEGER) AS alert FROM chi""")(lambda spark, sf: r6(chi_table(spark, sf)))

query("ztest_rate", with_("rp") + ROLL + f"""
SELECT CAST(week AS VARCHAR) AS week, CAST(rolling_n AS BIGINT) AS rolling_n, round(rolling_no_show_rate, 6) AS rolling_no_show_rate,
  round((rolling_no_show_rate - 0.241) / sqrt(0.241 * (1 - 0.241) / rolling_n), 6) AS z,
  CAST(abs((rolling_no_show_rate - 0.241) / sqrt(0.241 * (1 - 0.241) / rolling_n)) > 2.0 AS INTEGER) AS alert FROM roll""")(
    lambda spark, sf: r6(D.ztest_rate(rolling(spark, sf))).withColumn("week", F.col("week").cast("string")))

_SHARES = f"""
, ms AS (SELECT period, avg(Lead_Time_Days) AS lead_mean, avg(CAST(Past_Visit_Count = 0 AS INTEGER)) AS new_share,
  avg(CAST(Payment_Method = 'Cash' AS INTEGER)) AS cash_share FROM pd GROUP BY period),
shifts AS (
  SELECT 'Lead_Time_Days' AS feature, 'mean' AS metric, lead_mean AS value, {D.LEAD_MEAN_REF} AS reference,
    CAST(abs(lead_mean - {D.LEAD_MEAN_REF}) > {D.LEAD_MEAN_SHIFT} AS INTEGER) AS alert FROM ms WHERE period = 'current'
  UNION ALL SELECT 'Is_New_Customer', 'share', new_share, {D.NEW_SHARE_REF},
    CAST(abs(new_share - {D.NEW_SHARE_REF}) > {D.NEW_SHARE_SHIFT} AS INTEGER) FROM ms WHERE period = 'current'
  UNION ALL SELECT 'Payment_Method_Cash', 'share', c.cash_share, r.cash_share,
    CAST(abs(c.cash_share - r.cash_share) > {D.CASH_SHARE_SHIFT} AS INTEGER)
    FROM ms c, ms r WHERE c.period = 'current' AND r.period = 'reference')"""

query("drift_mean_shift", with_("ft") + ", " + PD + _SHARES + """
SELECT feature, metric, round(value, 6) AS value, round(reference, 6) AS reference, alert FROM shifts WHERE metric = 'mean'""")(
    lambda spark, sf: r6(_shift_rows(spark, sf).where(F.col("metric") == "mean")))

query("drift_share_shift", with_("ft") + ", " + PD + _SHARES + """
SELECT feature, metric, round(value, 6) AS value, round(reference, 6) AS reference, alert FROM shifts WHERE metric = 'share'""")(
    lambda spark, sf: r6(_shift_rows(spark, sf).where(F.col("metric") == "share")))


def _shift_rows(spark, sf):
    p = periods(spark, sf)
    empty = p.sparkSession.createDataFrame([], "feature string, psi double")
    e2 = p.sparkSession.createDataFrame([], "feature string, p_value double, alert int")
    return D.drift_report(p, empty, e2, e2).where(F.col("metric").isin("mean", "share"))


query("drift_report", with_("ft") + ", " + PSI + ", " + KS.replace(PD + ",", "") + ", " + CHI.replace(PD + ",", "")
      + _SHARES + """
SELECT feature, metric, round(value, 6) AS value, round(reference, 6) AS reference, alert FROM shifts
UNION ALL SELECT feature, 'psi', round(psi, 6), NULL, CAST(psi > 0.2 AS INTEGER) FROM psi
UNION ALL SELECT feature, 'ks_p_value', round(p_value, 6), NULL, CAST(p_value < 0.01 AS INTEGER) FROM ks
UNION ALL SELECT feature, 'chi2_p_value', round(p_value, 6), NULL, CAST(p_value < 0.01 AS INTEGER) FROM chi""")(
    lambda spark, sf: r6(D.drift_report(periods(spark, sf), psi_table(spark, sf), ks_table(spark, sf),
                                        chi_table(spark, sf))))

query("drift_report_weekly", with_("ft", "rp") + ROLL + ", " + PD + """,
wx AS (SELECT period, CAST(date_trunc('week', Appointment_Time) AS DATE) AS week, Lead_Time_Days, Past_Visit_Count, Payment_Method,
  CAST(Customer_No_Show_Rate AS DOUBLE) AS x FROM pd),
wr AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
  CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM wx WHERE period = 'reference'),
wb AS (SELECT period, week, least(9, len(list_filter([""" + _EDGES + """], lambda e: e <= x))) AS bin FROM wx, wr WHERE x BETWEEN lo AND hi),
we AS (SELECT bin, count(*) AS e FROM wb WHERE period = 'reference' GROUP BY bin),
wa AS (SELECT week, bin, count(*) AS a FROM wb WHERE period = 'current' GROUP BY ALL),
wg AS (SELECT w.week, greatest(1e-6, coalesce(e, 0) / (SELECT sum(e) FROM we)) AS ep,
  greatest(1e-6, coalesce(a, 0) / sum(a) OVER (PARTITION BY w.week)) AS ap
  FROM (SELECT DISTINCT week FROM wa) w CROSS JOIN range(10) b(bin) LEFT JOIN we ON we.bin = b.bin
  LEFT JOIN wa ON wa.week = w.week AND wa.bin = b.bin),
wp AS (SELECT week, sum((ap - ep) * ln(ap / ep)) AS psi FROM wg GROUP BY week),
wm AS (SELECT week, avg(Lead_Time_Days) AS lead, avg(CAST(Past_Visit_Count = 0 AS INTEGER)) AS new,
  avg(CAST(Payment_Method = 'Cash' AS INTEGER)) AS cash FROM wx WHERE period = 'current' GROUP BY week),
wc AS (SELECT avg(CAST(Payment_Method = 'Cash' AS INTEGER)) AS ref FROM wx WHERE period = 'reference'),
wo AS (SELECT roll.week, rolling_no_show_rate AS v, CAST(date_diff('day', DATE '1970-01-05', roll.week) / 7 AS INTEGER) AS wno FROM roll),
wt AS (SELECT week, v, CAST(count(*) OVER w = 3 AND min(CAST(abs(v * 100 - 24.1) > 4.0 AS INTEGER)) OVER w = 1 AS INTEGER) AS alert
  FROM wo WINDOW w AS (ORDER BY wno RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
rows5 AS (
  SELECT m.week, 'Customer_No_Show_Rate' AS feature, 'psi' AS metric, psi AS value, NULL::DOUBLE AS reference, coalesce(psi > 0.2, false)::INTEGER AS alert
    FROM wm m LEFT JOIN wp USING (week)
  UNION ALL SELECT week, 'Lead_Time_Days', 'mean', lead, 3.08, (abs(lead - 3.08) > 1.0)::INTEGER FROM wm
  UNION ALL SELECT week, 'Is_New_Customer', 'share', new, 0.10, (abs(new - 0.10) > 0.05)::INTEGER FROM wm
  UNION ALL SELECT week, 'Payment_Method_Cash', 'share', cash, ref, (abs(cash - ref) > 0.08)::INTEGER FROM wm, wc
  UNION ALL SELECT m.week, 'No_Show_Rate', 'rolling_4wk', v, 0.241, alert FROM wm m LEFT JOIN wt USING (week))
SELECT CAST(week AS VARCHAR) AS week, feature, metric, round(value, 6) AS value, round(reference, 6) AS reference, alert FROM rows5""")(
    lambda spark, sf: r6(D.weekly_drift(periods(spark, sf), rolling(spark, sf))).withColumn("week", F.col("week").cast("string")))

_WEEK_SQL = """
, sw AS (SELECT CAST(date_trunc('week', Appointment_Time) AS DATE) AS week, no_show_probability AS score, No_Show AS label FROM rp),
wc AS """ + CM("sw", str(QUEUE_THRESHOLD), "week") + """,
wcnt AS (SELECT week, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM sw GROUP BY ALL),
wcum AS (SELECT *, sum(pos) OVER (PARTITION BY week ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(pos) OVER (PARTITION BY week) AS P, sum(neg) OVER (PARTITION BY week) AS N FROM wcnt),
wauc AS (SELECT week, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(N)) END AS auc
  FROM wcum GROUP BY week),
wbr AS (SELECT week, avg(pow(score - label, 2)) AS brier FROM sw GROUP BY week),
wl AS (SELECT wc.week, m.metric, m.value FROM wc JOIN wauc USING (week) JOIN wbr USING (week),
  LATERAL (VALUES ('recall', CAST(recall AS DOUBLE)), ('precision', CAST(precision AS DOUBLE)), ('f1', CAST(f1 AS DOUBLE)),
    ('auc', auc), ('brier', brier)) m(metric, value)),
tg AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', {t}, {a}, {str(hb).lower()})" for k, (t, a, hb) in
                                          D.WEEKLY_TARGETS.items()) + """) t(metric, target, alert_level, higher))"""

query("weekly_performance", with_("rp") + _WEEK_SQL + """
SELECT CAST(week AS VARCHAR) AS week, wl.metric, round(value, 6) AS value, CAST(target AS DOUBLE) AS target,
  CAST(alert_level AS DOUBLE) AS alert_level,
  CASE WHEN value IS NULL THEN 'n/a' WHEN (higher AND value >= target) OR (NOT higher AND value <= target) THEN 'ok'
       WHEN (higher AND value < alert_level) OR (NOT higher AND value > alert_level) THEN 'alert' ELSE 'watch' END AS status
FROM wl JOIN tg USING (metric)""")(
    lambda spark, sf: r6(D.weekly_performance(C.rp(spark, sf), QUEUE_THRESHOLD)).withColumn("week", F.col("week").cast("string")))

def _retrain(spark, sf):
    return r6(D.retrain_triggers(rolling(spark, sf), psi_table(spark, sf), periods(spark, sf)))


query("retrain_triggers", with_("ft", "rp") + ROLL + ", " + PSI + """
, lastw AS (SELECT arg_max(rolling_recall, week) AS rec, arg_max(rolling_precision, week) AS prec FROM roll),
vol AS (SELECT max(pm) FILTER (WHERE period = 'current') AS cur, max(pm) FILTER (WHERE period = 'reference') AS ref FROM (
  SELECT period, count(*) / count(DISTINCT strftime(Appointment_Time, '%Y-%m')) AS pm FROM pd GROUP BY period)),
p AS (SELECT psi FROM psi WHERE feature = 'Customer_No_Show_Rate')
SELECT 'rolling_recall' AS trigger, round(rec, 6) AS value, 0.55 AS threshold, CAST(rec < 0.55 AS INTEGER) AS fired FROM lastw
UNION ALL SELECT 'rolling_precision', round(prec, 6), 0.35, CAST(prec < 0.35 AS INTEGER) FROM lastw
UNION ALL SELECT 'psi_Customer_No_Show_Rate', round(psi, 6), 0.2, CAST(psi > 0.2 AS INTEGER) FROM p
UNION ALL SELECT 'monthly_volume_growth', round(cur / ref - 1.0, 6), 0.2, CAST(cur / ref - 1.0 > 0.2 AS INTEGER) FROM vol""")(
    _retrain)

query("training_readiness", with_("bk") + f"""
SELECT 'full_retrain' AS gate, CAST(20000 AS BIGINT) AS required, CAST(count(Outcome) AS BIGINT) AS available,
  CAST(count(Outcome) >= 20000 AS INTEGER) AS ready FROM bk
UNION ALL SELECT 'threshold_retune', 5000, CAST(count(*) AS BIGINT), CAST(count(*) >= 5000 AS INTEGER) 
  FROM {stratified_sql("(SELECT *, CAST(coalesce(Outcome = 'No-Show', false) AS INTEGER) AS No_Show FROM bk)", "No_Show", {"test": 0.2, "val": 0.2}, "train", h("Booking_ID", "split"))}
  WHERE split = 'val'
UNION ALL SELECT 'emergency_patch', 2000, CAST(count(Outcome) AS BIGINT), CAST(count(Outcome) >= 2000 AS INTEGER) FROM bk
  WHERE Appointment_Time >= TIMESTAMP '{DRIFT_DATE}'""")(
    lambda spark, sf: D.training_readiness(
        C.bk(spark, sf), M.split_three(FE.add_target(C.bk(spark, sf))).where(F.col("split") == "val"),
        C.bk(spark, sf).where(F.col("Appointment_Time") >= F.lit(DRIFT_DATE).cast("timestamp_ntz"))))

query("champion_challenger", METRICS_W + f"""
, thr AS (SELECT model, threshold AS tuned_threshold FROM f1best WHERE split = 'val'),
tj AS (SELECT lg.*, thr.tuned_threshold FROM lg JOIN thr USING (model) WHERE split = 'test'),
m AS {CM("tj", "tuned_threshold", "model, tuned_threshold")}
SELECT 'lr' AS champion, 'xgb' AS challenger, max(f1) FILTER (WHERE model = 'lr') AS champion_f1,
  max(f1) FILTER (WHERE model = 'xgb') AS challenger_f1,
  round(max(f1) FILTER (WHERE model = 'xgb') - max(f1) FILTER (WHERE model = 'lr'), 6) AS f1_gain,
  CAST(max(f1) FILTER (WHERE model = 'xgb') - max(f1) FILTER (WHERE model = 'lr') > 0.02 AS INTEGER) AS promote FROM m""")(
    lambda spark, sf: r6(D.champion_challenger(M.tuned_table(part(spark, sf, "val"), part(spark, sf, "test")), "lr", "xgb")))

query("ab_by_version", with_("ac", "ft", extra=STORES) + f"""
, s AS (SELECT rs.model_version, rs.no_show_probability AS score, ft.No_Show AS label FROM rs JOIN ft ON ft.Booking_ID = rs.booking_id),
c AS {CM("s", "0.5", "model_version")},
cnt AS (SELECT model_version, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM s GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY model_version ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(pos) OVER (PARTITION BY model_version) AS P, sum(neg) OVER (PARTITION BY model_version) AS N FROM cnt),
a AS (SELECT model_version, sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(N)) AS auc FROM cum GROUP BY ALL),
b AS (SELECT model_version, avg(pow(score - label, 2)) AS brier FROM s GROUP BY ALL)
SELECT c.*, round(a.auc, 6) AS auc, round(b.brier, 6) AS brier FROM c JOIN a USING (model_version) JOIN b USING (model_version)""")(
    lambda spark, sf: r6(D.ab_by_version(risk_scores(spark, sf), FE.build_base(C.bk(spark, sf))
                                         .select(F.col("Booking_ID").alias("booking_id"), "No_Show"))))

query("kpi_monthly", with_("rp") + """
SELECT strftime(Appointment_Time, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n, round(avg(No_Show), 6) AS no_show_rate,
  round(avg(No_Show) FILTER (WHERE risk_level = 'High'), 6) AS high_risk_no_show_rate,
  round(coalesce(sum(Revenue) FILTER (WHERE risk_level = 'High' AND No_Show = 0), 0), 6) AS revenue_recovered
FROM rp GROUP BY 1""")(lambda spark, sf: r6(D.kpi_monthly(C.rp(spark, sf))))

query("kpi_deposit_rate", with_("ac", extra=STORES) + """
SELECT action_type, CAST(count(*) AS BIGINT) AS requested,
  CAST(count(*) FILTER (WHERE Booking_ID IN (SELECT booking_id FROM il WHERE outcome = 'confirmed')) AS BIGINT) AS paid,
  round(count(*) FILTER (WHERE Booking_ID IN (SELECT booking_id FROM il WHERE outcome = 'confirmed')) / count(*), 6)
    AS collection_rate
FROM ac WHERE action_type IN ('SOFT_DEPOSIT', 'HARD_DEPOSIT', 'PREPAYMENT') GROUP BY action_type""")(
    lambda spark, sf: r6(D.kpi_deposit_rate(C.ac(spark, sf), intervention_log(spark, sf))))

query("kpi_deposit_churn", with_("ac") + """
, last AS (SELECT Customer_ID, max(Appointment_Time) AS lt FROM ac GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS requested, CAST(count(*) FILTER (WHERE Appointment_Time >= lt) AS BIGINT) AS churned,
  round(count(*) FILTER (WHERE Appointment_Time >= lt) / count(*), 6) AS churn_rate
FROM ac JOIN last USING (Customer_ID) WHERE action_type IN ('SOFT_DEPOSIT', 'HARD_DEPOSIT', 'PREPAYMENT')""")(
    lambda spark, sf: r6(D.kpi_deposit_churn(C.ac(spark, sf))))

query("ops_latency", """
SELECT CAST(count(*) AS BIGINT) AS n, round(quantile_cont(value, 0.5), 6) AS p50_ms,
  round(quantile_cont(value, 0.99), 6) AS p99_ms FROM events""")(
    lambda spark, sf: r6(D.ops_latency(scoring_log(spark, sf))))

query("ops_failure_null_rate", f"""
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS failure_rate,
  round(avg(CAST({h('event_id', 'nul')} < 0.01 AS INTEGER)), 6) AS null_feature_rate FROM events""")(
    lambda spark, sf: r6(D.ops_failure_null_rate(scoring_log(spark, sf))))
