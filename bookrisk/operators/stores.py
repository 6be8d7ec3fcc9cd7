"""Stored tables (risk scores, intervention log), joins between them, and
the window / set operators that read them.

Tables are Parquet, partitioned by month and sorted by time inside each
file, so the daily queue and the next-day batch prune to one partition
and then to the matching row groups. Joins between the large tables are on
``booking_id``; one-row and fixed-size lookups are broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookrisk.functions.hashing import uniform
from bookrisk.operators.prefix import previous_values
from bookrisk.sources import schema as S

# Fixture recipe for the intervention log (see FIXTURES.md)
LOG_MISSING_SHARE = 0.05
LOG_OUTCOME_CUTS = (0.85, 0.95)  # delivered below the first, confirmed below the second, else bounced
RESCORE_SHARE = 0.30

RISK_SCORE_COLUMNS = ["booking_id", "no_show_probability", "risk_level", "action_type", "scored_at", "model_version"]


def risk_score_rows(actions: DataFrame, model_version: str, scored_at: Column | None = None) -> DataFrame:
    """Acted-on bookings -> ``risk_scores`` rows (scored at booking time by default)."""
    ts = scored_at if scored_at is not None else F.col("Booking_Time")
    return actions.select(F.col("Booking_ID").alias("booking_id"), "no_show_probability", "risk_level", "action_type",
                          ts.alias("scored_at"), F.lit(model_version).alias("model_version"))


def intervention_rows(actions: DataFrame) -> DataFrame:
    """One row per channel and timing of each action, sent ``timing`` days
    before the appointment; the delivery outcome is a fixture draw."""
    u = uniform(F.col("Booking_ID"), "log")
    t = (actions.where(uniform(F.col("Booking_ID"), "miss") >= LOG_MISSING_SHARE)
         .select("Booking_ID", "Appointment_Time", F.explode_outer("channels").alias("channel"), "timing_days_before",
                 u.alias("_u"))
         .select("*", F.explode_outer("timing_days_before").alias("days"))
         # explode_outer + a filter on the generated columns: a plain explode
         # makes Spark infer size(...) > 0 and push it below the projection,
         # inlining the whole action tree into one oversized predicate
         .where(F.col("channel").isNotNull() & F.col("days").isNotNull()))
    return t.select(F.col("Booking_ID").alias("booking_id"), "channel",
                    (F.col("Appointment_Time") - F.make_dt_interval(F.col("days"))).alias("sent_at"),
                    F.when(F.col("_u") < LOG_OUTCOME_CUTS[0], "delivered")
                    .when(F.col("_u") < LOG_OUTCOME_CUTS[1], "confirmed").otherwise("bounced").alias("outcome"))


def write_partitioned(df: DataFrame, path: str, ts_col: str, mode: str = "append") -> None:
    """Append as Parquet partitioned by the month of ``ts_col``, each file
    sorted by the timestamp so row groups carry tight min/max statistics:
    a day's queue prunes to one partition and, inside it, to the row groups
    of that day. Rows are dealt out by ranges of time, so a large month is
    written by many tasks. (Month, not day: day partitions multiply small files.)"""
    (df.withColumn("month", F.date_format(ts_col, "yyyy-MM"))
     .repartitionByRange("month", ts_col).sortWithinPartitions("month", ts_col)
     .write.mode(mode).partitionBy("month").parquet(path))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _bucketed_name(path: str) -> str:
    return "bucketed_" + hashlib.md5(path.encode()).hexdigest()


def write_bucketed(df: DataFrame, path: str, key: str = "booking_id", buckets: int | None = None) -> None:
    """Parquet in ``path``, one sorted file per bucket of ``key``, known to the
    catalog: joins and aggregates on the key read it without a shuffle, and
    tables of one number of buckets (default: the session's shuffle
    partitions) join bucket by bucket. The key should be close to unique; a
    store that is read by time keeps the layout of :func:`write_partitioned`."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(_bucketed_name(path)))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(_bucketed_name(path))


# ------------------------------------------------------------------ lookups
def lookup_table(spark: SparkSession, mapping: dict, key: str, value: str, value_type: str) -> DataFrame:
    """A fixed-size dimension table (a handful of rows, safe to broadcast)."""
    return spark.createDataFrame(list(mapping.items()), f"`{key}` string, `{value}` {value_type}")


def join_service_tier(df: DataFrame) -> DataFrame:
    tiers = lookup_table(df.sparkSession, S.SERVICE_TIER, "Service_Type", "service_tier", "string")
    return (df.join(F.broadcast(tiers), "Service_Type", "left")
            .withColumn("service_tier", F.coalesce(F.col("service_tier"), F.lit("standard"))))


def join_service_price(df: DataFrame) -> DataFrame:
    prices = lookup_table(df.sparkSession, S.SERVICE_PRICE, "Service_Type", "price", "int")
    return (df.join(F.broadcast(prices), "Service_Type", "left")
            .withColumn("price", F.coalesce(F.col("price"), F.lit(S.DEFAULT_PRICE))))


def join_global_prior(df: DataFrame, target: str = "No_Show") -> DataFrame:
    """Attach a one-row aggregate (the global rate) to every row."""
    prior = df.agg(F.avg(target).alias("global_rate"))
    return df.crossJoin(F.broadcast(prior))


# ------------------------------------------------------------------ joins on the stores
def latest_scores(scores: DataFrame) -> DataFrame:
    """Latest row per booking (max scored_at, then the larger model_version):
    an aggregate with map-side combine, not a per-key sort."""
    cols = [c for c in scores.columns if c != "booking_id"]
    return (scores.groupBy("booking_id")
            .agg(F.max_by(F.struct(*cols), F.struct("scored_at", "model_version")).alias("s"))
            .select("booking_id", "s.*"))


def log_per_booking(log: DataFrame) -> DataFrame:
    """Pre-aggregate the log to one row per booking before joining."""
    return log.groupBy("booking_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_touches"),
        F.count_if(F.col("outcome") == "confirmed").cast("bigint").alias("n_confirmed"),
        F.count_if(F.col("outcome") == "bounced").cast("bigint").alias("n_bounced"),
        F.max("sent_at").alias("last_sent_at"))


def booking_score_log(bookings: DataFrame, scores: DataFrame, log: DataFrame) -> DataFrame:
    """bookings LEFT JOIN latest score LEFT JOIN per-booking log summary.
    All three sides are keyed by booking id: stored in buckets of it they join
    without a shuffle, else both joins reuse one hash partitioning of the key."""
    b = bookings if "booking_id" in bookings.columns else bookings.withColumnRenamed("Booking_ID", "booking_id")
    return (b.join(latest_scores(scores), "booking_id", "left")
            .join(log_per_booking(log), "booking_id", "left")
            .withColumns({"n_touches": F.coalesce("n_touches", F.lit(0)),
                          "n_confirmed": F.coalesce("n_confirmed", F.lit(0)),
                          "n_bounced": F.coalesce("n_bounced", F.lit(0))}))


def anti_no_intervention(actions: DataFrame, log: DataFrame) -> DataFrame:
    """Bookings queued for a touch with no log row at all."""
    # a filter on a generated column, as above: else the action tree is inlined
    # into the predicate and worked out again for it
    queued = actions.withColumn("_queued", F.explode_outer(F.array(F.col("action_type") != "NO_ACTION"))).where("_queued").drop("_queued")
    return queued.join(log.select(F.col("booking_id").alias("Booking_ID")), "Booking_ID", "left_anti")


def semi_confirmed_recent(bookings: DataFrame, log: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Bookings with a confirmed log row, appointment in the ``days`` before ``as_of``."""
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    recent = bookings.where((F.to_date("Appointment_Time") >= start)
                            & (F.to_date("Appointment_Time") < F.lit(as_of).cast("date")))
    confirmed = log.where(F.col("outcome") == "confirmed").select(F.col("booking_id").alias("Booking_ID"))
    return recent.join(confirmed, "Booking_ID", "left_semi")


def append_outcomes(corpus: DataFrame, recent: DataFrame, key: str = "Booking_ID") -> DataFrame:
    """Union by name and keep one row per key (rows of a key are identical
    in both inputs, so which copy survives does not matter)."""
    return corpus.unionByName(recent).dropDuplicates([key])


# ------------------------------------------------------------------ windows
def customer_score_history(scores: DataFrame, bookings: DataFrame, **how) -> DataFrame:
    """Scores by (customer, scored_at) with the change from the customer's
    previous score. Skew-safe lag: a hot customer is split into time
    buckets instead of one task."""
    b = bookings if "booking_id" in bookings.columns else bookings.withColumnRenamed("Booking_ID", "booking_id")
    s = scores.join(b.select("booking_id", F.col("Customer_ID").alias("customer_id")), "booking_id")
    out = previous_values(s, "customer_id", "scored_at", "booking_id", ["no_show_probability"], **how)
    return out.withColumn("change", F.col("no_show_probability") - F.col("prev_no_show_probability"))


def weekly_counts(df: DataFrame, threshold: float, score: str = "no_show_probability") -> DataFrame:
    """Per appointment week (Monday start): rows, no-shows, tp, fp, fn."""
    pred = F.col(score) >= F.lit(threshold)
    pos = F.col("No_Show") == 1
    wk = F.date_trunc("week", F.col("Appointment_Time").cast("timestamp")).cast("date")
    return df.groupBy(wk.alias("week")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.count_if(pos).cast("bigint").alias("no_shows"),
        F.count_if(pred & pos).cast("bigint").alias("tp"), F.count_if(pred & ~pos).cast("bigint").alias("fp"),
        F.count_if(~pred & pos).cast("bigint").alias("fn"))


def _week_no(week: Column) -> Column:
    return (F.datediff(week, F.lit("1970-01-05").cast("date")) / 7).cast("int")


def rolling_4wk(weekly: DataFrame, weeks: int = 4) -> DataFrame:
    """Ratios of the summed counts over the current and 3 previous calendar
    weeks. The weekly table has one row per week (a few hundred rows per
    decade), so the unpartitioned range window is bounded."""
    w = Window.orderBy(_week_no(F.col("week"))).rangeBetween(-(weeks - 1), 0)
    s = weekly.withColumns({f"r_{c}": F.sum(c).over(w) for c in ("n", "no_shows", "tp", "fp", "fn")})
    return s.select("week", F.col("r_n").alias("rolling_n"),
                    F.when(F.col("r_tp") + F.col("r_fp") > 0, F.col("r_tp") / (F.col("r_tp") + F.col("r_fp")))
                    .alias("rolling_precision"),
                    F.when(F.col("r_tp") + F.col("r_fn") > 0, F.col("r_tp") / (F.col("r_tp") + F.col("r_fn")))
                    .alias("rolling_recall"),
                    (F.col("r_no_shows") / F.col("r_n")).alias("rolling_no_show_rate"))


def three_weeks_out(weekly: DataFrame, baseline_pct: float = S.BASELINE_NO_SHOW_PCT, band_pp: float = 4.0,
                    run: int = 3) -> DataFrame:
    """Weekly rate outside baseline +- band for ``run`` consecutive weeks."""
    rate = F.col("no_shows") * 100.0 / F.col("n")
    d = weekly.select("week", rate.alias("rate"),
                      (F.abs(rate - F.lit(baseline_pct)) > band_pp).cast("int").alias("out_flag"))
    w = Window.orderBy(_week_no(F.col("week"))).rangeBetween(-(run - 1), 0)
    return d.withColumn("alert", ((F.count(F.lit(1)).over(w) == run) & (F.min("out_flag").over(w) == 1)).cast("int"))
