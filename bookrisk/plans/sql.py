"""DuckDB twins of the core operators, used as the oracle (``oracle_sql``).

Plain SQL over the driver tables. Texts, scorecards, tiers and prices are the
same fixed values as on the Spark side, so tests state expected texts and
tail values by hand as well.
Named CTEs: ``bk`` bookings, ``ft`` base features, ``sc`` frozen score,
``ac`` actions (diagnosis + tree + catalog + texts).
"""

from __future__ import annotations

from bookrisk.functions import text as X
from bookrisk.functions.hashing import uniform_sql as h
from bookrisk.functions.text import render_sql as R
from bookrisk.functions.text import sql_lit as L
from bookrisk.operators.score import CARDS, FROZEN
from bookrisk.sources import schema as S
from bookrisk.sources.bookings import CANCEL_SHARE, MAX_LEAD_MINUTES, OUTCOME_BASE


def _list(vals) -> str:
    return "[" + ", ".join(L(v) for v in vals) + "]"


BK = f"""
bk_base AS (
  SELECT o.o_orderkey AS ok, o.o_custkey AS ck, o.o_orderdate AS od, c.c_nationkey AS nk
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
), bk_t AS (
  SELECT ok, ck,
    od + to_minutes(CAST(60 * (8 + floor(13 * {h('ok', 'hour')})) + 30 * floor(2 * {h('ok', 'half')}) AS BIGINT)) AS appt,
    CAST(floor({MAX_LEAD_MINUTES} * {h('ok', 'lead')} * {h('ok', 'lead')}) AS BIGINT) AS lead_min,
    list_extract({_list(S.SERVICES)}, CAST(floor(7 * {h('ok', 'svc')}) AS INTEGER) + 1) AS svc,
    list_extract({_list(S.BRANCHES)}, CAST(nk % 7 AS INTEGER) + 1) AS branch,
    list_extract({_list(S.PAYMENTS)}, CAST(floor(4 * {h('ok', 'pay')}) AS INTEGER) + 1) AS pay,
    round_even({h('ck', 'risk')}, 2) AS risk,
    {h('ok', 'out')} AS u_out, {h('ok', 'canc')} AS u_canc
  FROM bk_base
), bk_o AS (
  SELECT *, appt - to_minutes(lead_min) AS book,
    CASE WHEN u_out < (CASE pay {' '.join(f"WHEN {L(k)} THEN {v}" for k, v in OUTCOME_BASE.items())} END) * (0.5 + risk)
         THEN 'No-Show' ELSE 'Show' END AS outcome
  FROM bk_t
), bk AS (
  SELECT ok AS Booking_ID, ck AS Customer_ID, svc AS Service_Type, branch AS Branch,
    book AS Booking_Time, appt AS Appointment_Time,
    CAST(date_diff('day', CAST(book AS DATE), CAST(appt AS DATE)) AS INTEGER) AS Booking_Lead_Time_Days,
    CAST(count(*) OVER w AS INTEGER) AS Past_Visit_Count,
    CAST(coalesce(sum(CASE WHEN outcome = 'Show' AND u_canc < {CANCEL_SHARE} THEN 1 ELSE 0 END) OVER w, 0) AS INTEGER)
      AS Past_Cancellation_Count,
    CAST(coalesce(sum(CASE WHEN outcome = 'No-Show' THEN 1 ELSE 0 END) OVER w, 0) AS INTEGER) AS Past_No_Show_Count,
    pay AS Payment_Method, dayname(appt) AS Day_of_Week, risk AS Customer_Latent_Risk, outcome AS Outcome
  FROM bk_o
  WINDOW w AS (PARTITION BY ck ORDER BY appt, ok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""

LEAD = "CAST(floor(date_diff('microsecond', Booking_Time, Appointment_Time) / 86400000000.0) AS INTEGER)"
EDGE = "CAST(coalesce(hour(Appointment_Time) <= 9 OR hour(Appointment_Time) >= 18, false) AS INTEGER)"


def ratio(num: str, den: str = "Past_Visit_Count", places: int | None = 4) -> str:
    r = f"CAST({num} AS DOUBLE) / {den}"
    r = f"round_even({r}, {places})" if places is not None else r
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE {r} END)"


FT = f"""
ft AS (
  SELECT *,
    {LEAD} AS Lead_Time_Days,
    CAST(hour(Appointment_Time) AS INTEGER) AS Appt_Hour,
    {EDGE} AS Is_Edge_Hour,
    {ratio('Past_No_Show_Count')} AS Customer_No_Show_Rate,
    {ratio('Past_Cancellation_Count')} AS Cancellation_Ratio,
    CAST(Past_Visit_Count = 0 AS INTEGER) AS Is_New_Customer,
    greatest(0.0, least(1.0, {ratio('(Past_Visit_Count - Past_No_Show_Count - Past_Cancellation_Count)')})) AS Successful_Visit_Rate,
    CAST(coalesce(Outcome = 'No-Show', false) AS INTEGER) AS No_Show
  FROM bk
)"""


def z_sql(coef: dict) -> str:
    terms = {
        "no_show_rate": ratio("Past_No_Show_Count", places=None),
        "cash": "CAST(Payment_Method = 'Cash' AS INTEGER)",
        "upi": "CAST(Payment_Method = 'UPI' AS INTEGER)",
        "new": "CAST(Past_Visit_Count = 0 AS INTEGER)",
        "lead": LEAD,
        "latent": "Customer_Latent_Risk",
        "edge": EDGE,
        "hair_coloring": "CAST(Service_Type = 'Hair Coloring' AS INTEGER)",
    }
    return f"({coef['intercept']}" + "".join(f" + ({coef[k]}) * {t}" for k, t in terms.items()) + ")"


def sig(z: str) -> str:
    return f"(1.0 / (1.0 + exp(-{z})))"


def level_sql(p: str) -> str:
    return f"(CASE WHEN {p} >= 0.6 THEN 'High' WHEN {p} >= 0.4 THEN 'Medium' ELSE 'Low' END)"


SC = f"""
sc_raw AS (SELECT *, {sig(z_sql(FROZEN))} AS p_raw FROM bk),
sc AS (
  SELECT * EXCLUDE (p_raw), round_even(p_raw, 4) AS no_show_probability, {level_sql('p_raw')} AS risk_level FROM sc_raw
)"""

CARDS_SQL = ("cards AS (SELECT *, " + ", ".join(f"round_even({sig(z_sql(c))}, 4) AS score_{n}" for n, c in CARDS.items())
             + " FROM ft)")


def pct2(x: str) -> str:
    return f"(printf('%.2f', ({x}) * 100) || '%')"


def pct0(x: str) -> str:
    return f"(CAST(CAST(round_even(({x}) * 100, 0) AS BIGINT) AS VARCHAR) || '%')"


_PREM = "(" + " OR ".join(f"Service_Type = {L(k)}" for k, v in S.SERVICE_TIER.items() if v == "premium") + ")"

DG = f"""
dg AS (
  SELECT *,
    coalesce(no_show_probability, 0.0) AS _p,
    coalesce({_PREM}, false) AS _premium,
    coalesce(Payment_Method = 'Cash', false) AS _is_cash,
    coalesce(Day_of_Week IN ('Saturday', 'Sunday'), false) AS _is_weekend,
    coalesce(Past_Visit_Count, 0) = 0 AS _is_new,
    coalesce(hour(Appointment_Time) <= 9 OR hour(Appointment_Time) >= 18, false) AS _is_edge,
    nullif(Booking_Lead_Time_Days, 0) AS _lead,
    coalesce(nullif(Booking_Lead_Time_Days, 0), 0) >= 7 AS _is_long,
    {ratio('coalesce(Past_No_Show_Count, 0)', 'coalesce(Past_Visit_Count, 0)', None)} >= 0.4 AS _is_chronic,
    round_even({ratio('coalesce(Past_No_Show_Count, 0)', 'coalesce(Past_Visit_Count, 0)', None)}, 4) AS _ns_rate,
    round_even({ratio('coalesce(Past_Cancellation_Count, 0)', 'coalesce(Past_Visit_Count, 0)', None)}, 4) AS _cancel_rate
  FROM sc
), dg2 AS (
  SELECT *,
    CASE
      WHEN _p < 0.25 THEN 'NO_ACTION'
      WHEN _p < 0.40 THEN CASE WHEN _is_cash THEN 'SOFT_DEPOSIT' WHEN _is_long THEN 'SMS_REMINDER'
                               WHEN _is_new AND _is_edge THEN 'MULTI_REMINDER' ELSE 'SMS_REMINDER' END
      WHEN _p < 0.60 THEN CASE WHEN _is_chronic THEN 'HARD_DEPOSIT' WHEN _is_cash AND _is_weekend THEN 'HARD_DEPOSIT'
                               WHEN _is_cash AND _premium THEN 'HARD_DEPOSIT' WHEN _is_new AND _is_cash THEN 'SOFT_DEPOSIT'
                               WHEN _premium AND _is_edge THEN 'CALL_REMINDER' ELSE 'MULTI_REMINDER' END
      WHEN _p < 0.75 THEN 'HARD_DEPOSIT'
      ELSE CASE WHEN _is_chronic THEN 'PREPAYMENT' WHEN _is_cash AND _premium THEN 'PREPAYMENT' ELSE 'HARD_DEPOSIT' END
    END AS action_type,
    list_filter([
      CASE WHEN _is_chronic THEN {R(X.DRIVER_CHRONIC, rate=pct0('_ns_rate'))} END,
      CASE WHEN _is_cash THEN {L(X.DRIVER_CASH)} END,
      CASE WHEN _is_new THEN {L(X.DRIVER_NEW)} END,
      CASE WHEN _is_long THEN {R(X.DRIVER_LONG, lead='CAST(_lead AS VARCHAR)')} END,
      CASE WHEN _is_edge THEN {L(X.DRIVER_EDGE)} END,
      CASE WHEN _is_weekend THEN {R(X.DRIVER_WEEKEND, day='Day_of_Week')} END,
      CASE WHEN _cancel_rate > 0.25 THEN {R(X.DRIVER_CANCEL, rate=pct0('_cancel_rate'))} END
    ], lambda x: x IS NOT NULL) AS _drivers
  FROM dg
)"""


def _reason() -> str:
    p = pct2("_p")
    trig = "_drivers[1]"
    return f"""CASE action_type
      WHEN 'NO_ACTION' THEN {R(X.REASON_NO_ACTION, p=p)}
      WHEN 'SMS_REMINDER' THEN {R(X.REASON_SMS, p=p, trigger=f"coalesce({trig}, {R(X.TRIGGER_SMS_DEFAULT, p=p)})")}
      WHEN 'MULTI_REMINDER' THEN {R(X.REASON_MULTI, p=p)}
      WHEN 'CALL_REMINDER' THEN {R(X.REASON_CALL, p=p, service="coalesce(Service_Type, '')")}
      WHEN 'SOFT_DEPOSIT' THEN {R(X.REASON_SOFT, p=p, trigger=f"coalesce({trig}, {L(X.TRIGGER_SOFT_DEFAULT)})")}
      WHEN 'HARD_DEPOSIT' THEN CASE WHEN _is_cash
           THEN {R(X.REASON_HARD_CASH, p=p, trigger=f"coalesce({trig}, {L(X.TRIGGER_HARD_DEFAULT)})")}
           ELSE {R(X.REASON_HARD, p=p, trigger=f"coalesce({trig}, {L(X.TRIGGER_HARD_DEFAULT)})")} END
      ELSE {R(X.REASON_PREPAY, p=p, drivers="array_to_string(_drivers[1:3], '; ')")}
    END"""


AC = DG + f""",
ac AS (
  SELECT * EXCLUDE (_drivers),
    CASE action_type WHEN 'NO_ACTION' THEN '' WHEN 'SMS_REMINDER' THEN 'SMS' WHEN 'MULTI_REMINDER' THEN 'SMS,Email'
      WHEN 'CALL_REMINDER' THEN 'Call,SMS' WHEN 'SOFT_DEPOSIT' THEN 'SMS,Email' WHEN 'HARD_DEPOSIT' THEN 'SMS,Email,Call'
      ELSE 'Call,SMS,Email' END AS channels_txt,
    CASE action_type WHEN 'NO_ACTION' THEN ''
      WHEN 'SMS_REMINDER' THEN CASE WHEN _is_long THEN '3,1' ELSE '1' END
      WHEN 'MULTI_REMINDER' THEN CASE WHEN _is_long OR coalesce(_lead, 0) >= 3 THEN '3,1' ELSE '1' END
      WHEN 'CALL_REMINDER' THEN '1' WHEN 'SOFT_DEPOSIT' THEN '2,1' ELSE '3,1' END AS timing_txt,
    CASE action_type WHEN 'SOFT_DEPOSIT' THEN 25 WHEN 'HARD_DEPOSIT' THEN 50 WHEN 'PREPAYMENT' THEN 100 ELSE 0 END AS deposit_pct,
    CASE action_type WHEN 'NO_ACTION' THEN 1 WHEN 'SMS_REMINDER' THEN 2 WHEN 'HARD_DEPOSIT' THEN 4
      WHEN 'PREPAYMENT' THEN 5 ELSE 3 END AS priority,
    {_reason()} AS reason,
    CASE WHEN action_type = 'NO_ACTION' THEN '' ELSE array_to_string(_drivers, ' | ') END AS drivers_txt,
    CASE action_type
      WHEN 'NO_ACTION' THEN {L(X.NOTE_NO_ACTION)} WHEN 'SMS_REMINDER' THEN {L(X.NOTE_SMS)}
      WHEN 'MULTI_REMINDER' THEN {L(X.NOTE_MULTI)} WHEN 'CALL_REMINDER' THEN {L(X.NOTE_CALL)}
      WHEN 'SOFT_DEPOSIT' THEN {L(X.NOTE_SOFT)}
      WHEN 'HARD_DEPOSIT' THEN CASE WHEN _premium AND _p >= 0.6
           THEN {R(X.NOTE_HARD_PREMIUM, service="coalesce(Service_Type, '')")} ELSE {L(X.NOTE_HARD)} END
      ELSE {L(X.NOTE_PREPAY)} END AS escalation_note,
    CASE WHEN action_type = 'NO_ACTION' THEN 0 ELSE len(_drivers) END AS n_drivers
  FROM dg2
)"""

PRICE = ("(CASE Service_Type " + " ".join(f"WHEN {L(k)} THEN {v}" for k, v in S.SERVICE_PRICE.items())
         + f" ELSE {S.DEFAULT_PRICE} END)")

RP = f"""
rp AS (
  SELECT *, CAST(coalesce(Outcome = 'No-Show', false) AS INTEGER) AS No_Show,
    CAST(Past_Visit_Count = 0 AS INTEGER) AS Is_New_Customer,
    CAST({PRICE} AS DOUBLE) AS Revenue, CAST({PRICE} AS DOUBLE) * no_show_probability AS Revenue_At_Risk,
    CAST(hour(Appointment_Time) AS INTEGER) AS Appt_Hour, CAST(Appointment_Time AS DATE) AS Appt_Date
  FROM sc
)"""

CTES = {"bk": BK, "ft": FT, "sc": SC, "ac": AC, "rp": RP, "cards": CARDS_SQL}
ORDER = ["bk", "ft", "sc", "ac", "rp", "cards"]
NEEDS = {"bk": [], "ft": ["bk"], "sc": ["bk"], "ac": ["sc"], "rp": ["sc"], "cards": ["ft"]}


def with_(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named CTEs and their dependencies."""
    need: set[str] = set()

    def add(n):
        if n not in need:
            need.add(n)
            for d in NEEDS[n]:
                add(d)
    for n in names:
        add(n)
    body = ",\n".join(CTES[n].strip() for n in ORDER if n in need)
    if extra:
        body = body + ",\n" + extra.strip() if body else extra.strip()
    return "WITH " + body + "\n"


def scored_actions(suffix: str, coef: dict) -> str:
    """The ``sc`` and ``ac`` CTEs for another scorecard, renamed with ``suffix``."""
    import re
    sc = (f"sc_raw{suffix} AS (SELECT *, {sig(z_sql(coef))} AS p_raw FROM bk),\n"
          f"sc{suffix} AS (SELECT * EXCLUDE (p_raw), round_even(p_raw, 4) AS no_show_probability, "
          f"{level_sql('p_raw')} AS risk_level FROM sc_raw{suffix})")
    ac = re.sub(r"\b(dg2|dg|ac|sc)\b", lambda m: m.group(1) + suffix, AC.strip())
    return sc + ",\n" + ac
