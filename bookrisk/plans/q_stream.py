"""Queries: streaming. Each streaming operator shares its
functions with the batch path; the streamed runs are compared with the same
SQL as the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookrisk.functions.hashing import uniform
from bookrisk.functions.hashing import uniform_sql as h
from bookrisk.operators.sketches import rolled_up
from bookrisk.plans import common as C
from bookrisk.plans.catalog import query
from bookrisk.plans.common import TS, sel_text
from bookrisk.plans.q_reports import r6
from bookrisk.plans.q_stores import RS_COLS, WS
from bookrisk.plans.sql import with_
from bookrisk.sources.bookings import scoring_log
from bookrisk.streaming import stream as SS
from bookrisk.streaming import upsert as UP
from bookrisk.streaming.payload import parse_payload, to_payload

REPLAY_SHARE = 0.01
LATE_SHARE = 0.01


def _append(spark, stream, base):
    SS.run_available_now(stream, base + "/out", base + "/_checkpoint")


def _stream(spark, rows, again, ts, build, name, close_days=0, sink=_append):
    """Stream ``rows`` in two runs of one query and read the sink: the first
    run takes the earlier half of the event time, the second, which resumes
    from the checkpoint, the rest with the rows of ``again`` (replays and late
    copies) and the row that closes the windows."""
    base = C.scratch_path(spark, name)
    half = rows.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).select(
        (F.col("a") + (F.col("b") - F.col("a")) / 2).alias("half")).first()["half"]  # one value

    def run():
        sink(spark, build(SS.read_files(spark, base + "/feed", rows.schema)), base)
    early = F.coalesce(F.col(ts) < F.lit(half).cast(rows.schema[ts].dataType), F.lit(False))
    SS.write_feed(rows, base + "/feed", ts, early)
    run()
    rest = rows.where(~early).unionByName(again)
    SS.write_feed(rest.unionByName(SS.closing_row(rows, ts, close_days)) if close_days else rest, base + "/feed", ts)
    run()
    return spark.read.parquet(base + "/out") if sink is _append else UP.read(spark, base + "/out", SCORES)


def _copies(b):
    """Bookings that arrive once more with the second run, and late ones."""
    ok = F.col("Booking_ID")
    return b.where(uniform(ok, "rep") < REPLAY_SHARE).unionByName(b.where(uniform(ok, "late") < LATE_SHARE))


SCORES = "booking_id bigint, no_show_probability double, risk_level string, action_type string, scored_at timestamp_ntz, model_version string"


def _store(spark, stream, base):
    UP.run_available_now(stream, base + "/out", base + "/_checkpoint", lambda batch: SS.score_to_store(batch, "v1"))


@query("stream_score", WS + f"SELECT {RS_COLS} FROM rs WHERE model_version = 'v1'")
def stream_score(spark, sf):
    """File stream -> score -> act -> ``risk_scores`` rows, put into a store
    that holds one row per booking, version and time: replays, also those that
    come after any watermark, change nothing."""
    b = C.bk(spark, sf)
    return C.texts(_stream(spark, b, _copies(b), "Booking_Time", lambda s: s, "stream-score", sink=_store))


@query("stream_dedup", with_("bk") + f"SELECT Booking_ID, {TS('Booking_Time')} AS Booking_Time FROM bk")
def stream_dedup(spark, sf):
    """Replays and late copies removed: one row per booking."""
    b = C.bk(spark, sf)
    return C.texts(_stream(spark, b, _copies(b), "Booking_Time",
                           lambda s: SS.dedup(s).select("Booking_ID", "Booking_Time"), "stream-dedup"))


query("stream_parse_payload", with_("bk") + f"SELECT {sel_text(C.BOOKING_COLS)} FROM bk")(
    lambda spark, sf: C.texts(parse_payload(to_payload(C.bk(spark, sf)))))


def dispatch(actions):
    """Due time of each touch: appointment minus each timing, per channel."""
    t = (actions.select("Booking_ID", "Appointment_Time", "action_type",
                        F.explode_outer("channels").alias("channel"), "timing_days_before")
         .select("*", F.explode_outer("timing_days_before").alias("days_before"))
         .where(F.col("channel").isNotNull() & F.col("days_before").isNotNull()))
    return t.select("Booking_ID", "action_type", "channel", "days_before",
                    (F.col("Appointment_Time") - F.make_dt_interval(F.col("days_before"))).alias("due_at"))


query("stream_dispatch", with_("ac") + f"""
, c AS (SELECT Booking_ID, Appointment_Time, action_type, unnest(string_split(channels_txt, ',')) AS channel, timing_txt
  FROM ac WHERE channels_txt <> ''),
t AS (SELECT *, CAST(unnest(string_split(timing_txt, ',')) AS INTEGER) AS days_before FROM c)
SELECT Booking_ID, action_type, channel, days_before, {TS('Appointment_Time - to_days(days_before)')} AS due_at FROM t""")(
    lambda spark, sf: C.texts(dispatch(C.ac(spark, sf))))

_OPS_SQL = f"""
WITH e AS (SELECT *, time_bucket(INTERVAL 1 MINUTE, ts) AS w FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY value) AS r, count(value) OVER (PARTITION BY w) AS m FROM e)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS n,
  round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS failure_rate,
  round(avg(CAST({h('event_id', 'nul')} < 0.01 AS INTEGER)), 6)
    AS null_feature_rate, round(avg(value), 6) AS mean_latency_ms,
  round(max(value) FILTER (WHERE r = greatest(1, ceil(0.5 * m))), 6) AS p50_latency_ms,
  round(max(value) FILTER (WHERE r = greatest(1, ceil(0.99 * m))), 6) AS p99_latency_ms FROM r GROUP BY w"""


def _log(spark, sf):
    log = scoring_log(spark, sf)
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def _windows(df):
    return C.texts(r6(df.drop("latency").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))))


query("stream_tumbling_ops", _OPS_SQL)(lambda spark, sf: _windows(SS.tumbling_ops(_log(spark, sf), watermark=None)))


@query("stream_tumbling_ops_stream", _OPS_SQL)
def stream_tumbling_ops_stream(spark, sf):
    """The scoring log as a file stream; a window is emitted once the
    watermark passes it, and the closing row carries it past the last."""
    log = _log(spark, sf)
    return _windows(_stream(spark, log, log.limit(0), "ts", SS.tumbling_ops, "stream-ops", close_days=1))


@query("ops_latency_daily")
def ops_latency_daily(spark, sf):
    """P50 and P99 per day, merged from the sketches of the minutes."""
    return C.texts(rolled_up(SS.tumbling_ops(_log(spark, sf), watermark=None)).drop("latency"))


_DRIFT_SQL = with_("bk") + """
, w AS (SELECT DISTINCT time_bucket(INTERVAL 7 DAY, Appointment_Time, TIMESTAMP '1970-01-01') - INTERVAL (7 * k) DAY AS ws
  FROM bk, range(0, 4) r(k)),
j AS (SELECT ws, count(*) AS n, count(*) FILTER (WHERE Outcome = 'No-Show') AS no_shows FROM w JOIN bk
  ON bk.Appointment_Time >= ws AND bk.Appointment_Time < ws + INTERVAL 28 DAY GROUP BY ws)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 28 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
  CAST(n AS BIGINT) AS n, CAST(no_shows AS BIGINT) AS no_shows, round(no_shows / n, 6) AS no_show_rate FROM j"""
query("stream_sliding_drift", _DRIFT_SQL)(
    lambda spark, sf: C.texts(r6(SS.sliding_rate(C.bk(spark, sf), watermark=None))))


@query("stream_sliding_drift_stream", _DRIFT_SQL)
def stream_sliding_drift_stream(spark, sf):
    """Sliding 4-week no-show rate over the booking file stream in appointment
    order; rows later than the watermark are dropped, closed windows appended."""
    b = C.bk(spark, sf)
    return C.texts(r6(_stream(spark, b, _copies(b), "Appointment_Time",
                              lambda s: SS.sliding_rate(s, dedup_key="Booking_ID"), "stream-drift", close_days=100)))
