"""Text of the action engine.

Fixed values: the wording below must equal the reference's word for word
(drivers, reasons and escalation notes), listed in the engine's order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
DRIVER_CHRONIC = "chronic no-show history ({rate} rate)"
DRIVER_CASH = "cash payment (39.4% dataset no-show rate vs 14.9% for card)"
DRIVER_NEW = "first-time customer -- no prior visit history"
DRIVER_LONG = "booked {lead}d in advance (mean=3.6d) -- higher likelihood of forgetting"
DRIVER_EDGE = "edge-hour slot (<=9h or >=18h) -- inconvenient timing"
DRIVER_WEEKEND = "{day} slot (25.2% weekend no-show rate)"
DRIVER_CANCEL = "high cancellation history ({rate} rate)"

REASON_NO_ACTION = "P={p} is below the caution threshold (25%). All booking signals are within normal range."
REASON_SMS = ("Mildly elevated risk (P={p}). Primary driver: {trigger}. "
              "A timely automated reminder is the lowest-friction effective intervention.")
TRIGGER_SMS_DEFAULT = "P={p} in caution zone"
REASON_MULTI = ("Elevated risk (P={p}) without a single dominant override factor. Multi-channel reminders "
                "reduce no-show probability without creating friction via deposit.")
REASON_CALL = ("High-value {service} service at an inconvenient edge-hour slot (P={p}). "
               "Personal call maximises confirmation rates for time-intensive bookings.")
REASON_SOFT = ("25% refundable deposit warranted. P={p}. Key driver: {trigger}. A low-friction deposit "
               "filters casual no-shows while remaining fair to genuine customers.")
TRIGGER_SOFT_DEFAULT = "elevated probability"
REASON_HARD_CASH = ("50% refundable deposit required. P={p}. Primary driver: {trigger}. Cash dataset no-show "
                    "rate is 39.4% -- deposit is the most effective deterrent for uncommitted bookings.")
REASON_HARD = "50% refundable deposit required. P={p}. Primary driver: {trigger}."
TRIGGER_HARD_DEFAULT = "high probability"
REASON_PREPAY = ("Full prepayment required. P={p}. This booking combines: {drivers}. The combination of "
                 "chronic no-show history on a premium/high-revenue service slot justifies full upfront "
                 "collection to protect staff time.")

NOTE_NO_ACTION = "No escalation needed."
NOTE_SMS = "If SMS undelivered, send WhatsApp. No deposit required."
NOTE_MULTI = "If both channels undelivered, escalate to CALL_REMINDER. Flag slot for waitlist standby."
NOTE_CALL = "If unreachable by phone, request confirmation SMS reply. Flag for waitlist."
NOTE_SOFT = "If deposit not paid within 24h of booking, send one follow-up. Cancel if unpaid at T-3d."
NOTE_HARD = "If deposit not paid within 12h of booking, offer slot to waitlist."
NOTE_HARD_PREMIUM = "Premium {service} slot. If deposit unpaid within 12h, release to waitlist immediately."
NOTE_PREPAY = ("If customer refuses prepayment, offer: (1) reschedule to weekday midday slot to reduce risk, "
               "or (2) card-on-file authorisation. Do NOT confirm booking without financial commitment.")

SUMMARY_HEAD = "Booking {id}  |  P={p4}  |  {level} risk"
SUMMARY_NO_DRIVERS = "    (none)"
SUMMARY_NO_TIMING = "N/A"


# ---------------------------------------------------------------------------
# Rendering a template as a Spark column or as DuckDB SQL text
# ---------------------------------------------------------------------------
import re as _re

_FIELD = _re.compile(r"\{(\w+)\}")


def render(template: str, **cols):
    """``F.concat`` of the literal parts and the given columns."""
    from pyspark.sql import functions as F
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def render_sql(template: str, **exprs) -> str:
    """SQL string concatenation of the literal parts and the given expressions."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(sql_lit(template[pos:m.start()]))
        parts.append(f"({exprs[m.group(1)]})")
        pos = m.end()
    if pos < len(template):
        parts.append(sql_lit(template[pos:]))
    return "(" + " || ".join(parts) + ")"


def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
