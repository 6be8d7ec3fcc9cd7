"""The action engine as column expressions: diagnosis facts, ordered risk
drivers, the band tree (one CASE), the action catalog and the texts.

A row-wise rule engine becomes one narrow projection, so scoring and
acting is a single map-only stage for batch and stream alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookrisk.functions import text as X
from bookrisk.functions.columns import lookup, pct0, pct2, raw_ratio
from bookrisk.sources import schema as S

FACTS = ["_tier", "_is_cash", "_is_weekend", "_is_new", "_is_edge", "_lead", "_is_long", "_is_chronic",
         "_ns_rate", "_cancel_rate"]


def diagnose(df: DataFrame, prob_col: str = "no_show_probability") -> DataFrame:
    """Facts used by the tree. Lead: the supplied lead, but 0 falls through
    to the computed ``Lead_Time_Days`` when that column exists."""
    v = F.coalesce(F.col("Past_Visit_Count"), F.lit(0))
    ns = F.coalesce(F.col("Past_No_Show_Count"), F.lit(0))
    c = F.coalesce(F.col("Past_Cancellation_Count"), F.lit(0))
    supplied = F.col("Booking_Lead_Time_Days") if "Booking_Lead_Time_Days" in df.columns else F.lit(None).cast("int")
    computed = F.col("Lead_Time_Days") if "Lead_Time_Days" in df.columns else F.lit(None).cast("int")
    lead = F.coalesce(F.nullif(supplied, F.lit(0)), computed)
    hour = F.hour("Appointment_Time")
    given_edge = (F.coalesce(F.col("Is_Edge_Hour"), F.lit(0)) == 1) if "Is_Edge_Hour" in df.columns else F.lit(False)
    ns_rate = raw_ratio(ns, v)
    return df.withColumns({
        "_p": F.coalesce(F.col(prob_col), F.lit(0.0)),
        "_tier": lookup(S.SERVICE_TIER, F.col("Service_Type"), "standard"),
        "_is_cash": F.coalesce(F.col("Payment_Method").isin(S.HIGH_RISK_PAYMENTS), F.lit(False)),
        "_is_weekend": F.coalesce(F.col("Day_of_Week").isin(S.WEEKEND_DAYS), F.lit(False)),
        "_is_new": v == 0,
        "_is_edge": given_edge | F.coalesce((hour <= S.EDGE_EARLY_HOUR) | (hour >= S.EDGE_LATE_HOUR), F.lit(False)),
        "_lead": lead.cast("int"),
        "_is_long": F.coalesce(lead, F.lit(0)) >= S.LONG_LEAD_DAYS,
        "_is_chronic": ns_rate >= S.CHRONIC_RATE,
        "_ns_rate": F.bround(ns_rate, 4),
        "_cancel_rate": F.bround(raw_ratio(c, v), 4),
    })


def risk_drivers(df: DataFrame) -> Column:
    """Ordered list of active drivers (needs :func:`diagnose` columns).
    A concat of zero-or-one-element arrays, not a lambda filter: higher-order
    functions are interpreted and would split the whole-stage codegen."""
    def item(cond: Column, text: Column) -> Column:
        return F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))

    return F.concat(
        item(F.col("_is_chronic"), X.render(X.DRIVER_CHRONIC, rate=pct0(F.col("_ns_rate")))),
        item(F.col("_is_cash"), F.lit(X.DRIVER_CASH)),
        item(F.col("_is_new"), F.lit(X.DRIVER_NEW)),
        item(F.col("_is_long"), X.render(X.DRIVER_LONG, lead=F.col("_lead").cast("string"))),
        item(F.col("_is_edge"), F.lit(X.DRIVER_EDGE)),
        item(F.col("_is_weekend"), X.render(X.DRIVER_WEEKEND, day=F.coalesce(F.col("Day_of_Week"), F.lit("")))),
        item(F.col("_cancel_rate") > S.CANCEL_DRIVER_RATIO, X.render(X.DRIVER_CANCEL, rate=pct0(F.col("_cancel_rate")))),
    )


def select_action(p: Column | None = None) -> Column:
    """The band tree, first match wins (collapsed where branches agree)."""
    p = F.col("_p") if p is None else p
    cash, weekend, new, edge, long_, chronic = (F.col(c) for c in
                                                ("_is_cash", "_is_weekend", "_is_new", "_is_edge", "_is_long", "_is_chronic"))
    premium = F.col("_tier") == "premium"
    band1 = (F.when(cash, "SOFT_DEPOSIT").when(long_, "SMS_REMINDER")
             .when(new & edge, "MULTI_REMINDER").otherwise("SMS_REMINDER"))
    band2 = (F.when(chronic | (cash & weekend) | (cash & premium), "HARD_DEPOSIT")
             .when(new & cash, "SOFT_DEPOSIT").when(premium & edge, "CALL_REMINDER").otherwise("MULTI_REMINDER"))
    band4 = F.when(chronic | (cash & premium), "PREPAYMENT").otherwise("HARD_DEPOSIT")
    return (F.when(p < S.BAND_CAUTION, "NO_ACTION").when(p < S.BAND_ELEVATED, band1)
            .when(p < S.BAND_HIGH, band2).when(p < S.BAND_CRITICAL, "HARD_DEPOSIT").otherwise(band4))


def _int_array(vals: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in vals]).cast("array<int>") if vals else F.array().cast("array<int>")


def _str_array(vals: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in vals]).cast("array<string>") if vals else F.array().cast("array<string>")


def _by_action(values: dict[str, Column]) -> Column:
    a = F.col("action_type")
    out = None
    for k, v in values.items():
        out = F.when(a == k, v) if out is None else out.when(a == k, v)
    return out


def action_details(df: DataFrame) -> DataFrame:
    """Channels, timing, deposit, priority, reason and escalation note."""
    p2 = pct2(F.col("_p"))
    drv = F.col("risk_drivers")
    first = F.get(drv, 0)
    svc = F.coalesce(F.col("Service_Type"), F.lit(""))
    multi_days = F.when(F.col("_is_long") | (F.coalesce(F.col("_lead"), F.lit(0)) >= 3), _int_array([3, 1])) \
        .otherwise(_int_array([1]))
    sms_days = F.when((F.col("_p") >= S.BAND_CAUTION) & (F.col("_p") < S.BAND_ELEVATED) & F.col("_is_long"),
                      _int_array([3, 1])).otherwise(_int_array([1]))
    reason = {
        "NO_ACTION": X.render(X.REASON_NO_ACTION, p=p2),
        "SMS_REMINDER": X.render(X.REASON_SMS, p=p2,
                                 trigger=F.coalesce(first, X.render(X.TRIGGER_SMS_DEFAULT, p=p2))),
        "MULTI_REMINDER": X.render(X.REASON_MULTI, p=p2),
        "CALL_REMINDER": X.render(X.REASON_CALL, p=p2, service=svc),
        "SOFT_DEPOSIT": X.render(X.REASON_SOFT, p=p2, trigger=F.coalesce(first, F.lit(X.TRIGGER_SOFT_DEFAULT))),
        "HARD_DEPOSIT": F.when(F.col("_is_cash"), X.render(X.REASON_HARD_CASH, p=p2,
                                                             trigger=F.coalesce(first, F.lit(X.TRIGGER_HARD_DEFAULT))))
                         .otherwise(X.render(X.REASON_HARD, p=p2, trigger=F.coalesce(first, F.lit(X.TRIGGER_HARD_DEFAULT)))),
        "PREPAYMENT": X.render(X.REASON_PREPAY, p=p2, drivers=F.array_join(F.slice(drv, 1, 3), "; ")),
    }
    note = {
        "NO_ACTION": F.lit(X.NOTE_NO_ACTION),
        "SMS_REMINDER": F.lit(X.NOTE_SMS),
        "MULTI_REMINDER": F.lit(X.NOTE_MULTI),
        "CALL_REMINDER": F.lit(X.NOTE_CALL),
        "SOFT_DEPOSIT": F.lit(X.NOTE_SOFT),
        "HARD_DEPOSIT": F.when((F.col("_tier") == "premium") & (F.col("_p") >= S.BAND_HIGH),
                               X.render(X.NOTE_HARD_PREMIUM, service=svc)).otherwise(F.lit(X.NOTE_HARD)),
        "PREPAYMENT": F.lit(X.NOTE_PREPAY),
    }
    a = F.col("action_type")

    def catalog(i: int, cast: str) -> Column:
        # one reference to action_type (a literal map), not one per action
        m = F.create_map(*[x for k, spec in S.ACTIONS.items() for x in (F.lit(k), F.lit(spec[i]).cast(cast))])
        return F.element_at(m, a)

    return df.withColumns({
        "channels": catalog(0, "array<string>"),
        "timing_days_before": F.when(a == "SMS_REMINDER", sms_days).when(a == "MULTI_REMINDER", multi_days)
                                .otherwise(catalog(1, "array<int>")),
        "deposit_pct": catalog(2, "int"),
        "reason": _by_action(reason),
        "priority": catalog(3, "int"),
        "escalation_note": _by_action(note),
    })


def evaluate(df: DataFrame, prob_col: str = "no_show_probability", keep_facts: bool = False) -> DataFrame:
    """Scored bookings -> bookings with the 8 action fields added."""
    d = diagnose(df, prob_col)
    d = d.withColumn("action_type", select_action())
    d = d.withColumn("risk_drivers", F.when(F.col("action_type") == "NO_ACTION", F.array().cast("array<string>"))
                     .otherwise(risk_drivers(d)))
    d = action_details(d)
    return d if keep_facts else d.drop("_p", *FACTS)


ACTION_FIELDS = ["booking_id", "no_show_probability", "risk_level", "action_type", "channels",
                 "timing_days_before", "deposit_pct", "reason", "risk_drivers", "priority", "escalation_note"]


def action_record(df: DataFrame) -> DataFrame:
    """The 11-field result record."""
    return df.withColumnRenamed("Booking_ID", "booking_id").select(*ACTION_FIELDS)


def action_to_json(df: DataFrame) -> DataFrame:
    return action_record(df).select("booking_id", F.to_json(F.struct(*ACTION_FIELDS)).alias("action_json"))


def action_summary(df: DataFrame) -> Column:
    """Multi-line text card of an action record."""
    p4 = F.format_string("%.4f", F.col("no_show_probability"))
    head = X.render(X.SUMMARY_HEAD, id=F.col("booking_id").cast("string"), p4=p4, level=F.col("risk_level"))
    timing = F.concat(F.array_join(F.col("timing_days_before").cast("array<string>"), "d before, "), F.lit("d before"))
    timing = F.when(F.size("timing_days_before") == 0, F.lit(X.SUMMARY_NO_TIMING)).otherwise(timing)
    drivers = F.concat(F.lit("    - "), F.array_join("risk_drivers", "\n    - "))
    drivers = F.when(F.size("risk_drivers") == 0, F.lit(X.SUMMARY_NO_DRIVERS)).otherwise(drivers)
    dep = F.when(F.col("deposit_pct") != 0, F.concat(F.lit("  Deposit       : "), F.col("deposit_pct").cast("string"),
                                                     F.lit("%\n"))).otherwise(F.lit(""))
    return F.concat(
        head, F.lit("\n  Action        : "), F.col("action_type"),
        F.lit("\n  Channels      : "), F.array_join("channels", ", "),
        F.lit("\n  Timing        : "), timing, F.lit("\n"), dep,
        F.lit("  Priority      : "), F.col("priority").cast("string"), F.lit("/5\n"),
        F.lit("  Reason        : "), F.col("reason"), F.lit("\n"),
        F.lit("  Risk drivers  :\n"), drivers, F.lit("\n"),
        F.lit("  If no response: "), F.col("escalation_note"),
    )
