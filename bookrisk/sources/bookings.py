"""Sources: booking tables derived from the driver tables, and file readers.

The driver tables hold no bookings, so ``bookings()`` derives them from
``orders JOIN customer`` with md5-based uniform draws (identical in Spark
and DuckDB). Past_* counters are running counts over each customer's
earlier bookings, built with the skew-safe :func:`prior_sums`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookrisk.functions.hashing import uniform
from bookrisk.operators.prefix import GRAIN_DAYS, prior_sums
from bookrisk.sources import schema as S

# Fixed values of the fixture recipe
OUTCOME_BASE = {"Cash": 0.39, "Card": 0.15, "UPI": 0.20, "Wallet": 0.22}
MAX_LEAD_MINUTES = 18720
CANCEL_SHARE = 0.10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), idx + 1)


def bookings(spark: SparkSession, sf_dir: str, grain_days: int = GRAIN_DAYS) -> DataFrame:
    """The 14-column booking table (schema ``S.BOOKING``) for one scale."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.bround(uniform(F.col("c_custkey"), "risk"), 2).alias("_risk"))  # once a customer, not once a booking
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    # customer is a dimension: let the planner choose (broadcast under the
    # autoBroadcastJoinThreshold, sort-merge above it).
    b = orders.join(customer, orders.o_custkey == customer.c_custkey)
    appt = (F.col("o_orderdate").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), (8 + F.floor(13 * uniform(ok, "hour"))).cast("int"),
                                 (30 * F.floor(2 * uniform(ok, "half"))).cast("int")))
    lead_min = F.floor(MAX_LEAD_MINUTES * F.pow(uniform(ok, "lead"), 2)).cast("int")
    b = b.select(
        ok.alias("Booking_ID"), ck.alias("Customer_ID"),
        _pick(S.SERVICES, F.floor(7 * uniform(ok, "svc")).cast("int")).alias("Service_Type"),
        _pick(S.BRANCHES, F.pmod(F.col("c_nationkey"), F.lit(7))).alias("Branch"),
        appt.alias("Appointment_Time"), lead_min.alias("_lead_min"),
        _pick(S.PAYMENTS, F.floor(4 * uniform(ok, "pay")).cast("int")).alias("Payment_Method"),
        F.col("_risk").alias("Customer_Latent_Risk"),
        uniform(ok, "out").alias("_u_out"), uniform(ok, "canc").alias("_u_canc"),
    )
    base = F.coalesce(*[F.when(F.col("Payment_Method") == k, F.lit(v)) for k, v in OUTCOME_BASE.items()])
    b = b.withColumns({
        "Booking_Time": F.col("Appointment_Time") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("_lead_min")),
        "Outcome": F.when(F.col("_u_out") < base * (0.5 + F.col("Customer_Latent_Risk")), "No-Show").otherwise("Show"),
        "Day_of_Week": F.date_format("Appointment_Time", "EEEE"),
    })
    b = b.withColumn("Booking_Lead_Time_Days",
                     F.datediff(F.to_date("Appointment_Time"), F.to_date("Booking_Time")).cast("int"))
    b = prior_sums(b, "Customer_ID", "Appointment_Time", "Booking_ID", {
        "Past_Visit_Count": F.lit(1),
        "Past_Cancellation_Count": ((F.col("Outcome") == "Show") & (F.col("_u_canc") < CANCEL_SHARE)).cast("int"),
        "Past_No_Show_Count": (F.col("Outcome") == "No-Show").cast("int"),
    }, grain_days=grain_days)
    return b.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.BOOKING.fields])


def dirty_bookings(b: DataFrame) -> DataFrame:
    """Bookings with injected nulls, unparsable times (as text) and duplicate rows."""
    ok = F.col("Booking_ID")
    b = b.withColumns({
        "Service_Type": F.when(uniform(ok, "n1") < 0.02, F.lit(None).cast("string")).otherwise(F.col("Service_Type")),
        "Past_Visit_Count": F.when(uniform(ok, "n2") < 0.02, F.lit(None).cast("int")).otherwise(F.col("Past_Visit_Count")),
        "Booking_Time": F.when(uniform(ok, "n3") < 0.01, F.lit("bad"))
                         .otherwise(F.date_format("Booking_Time", "yyyy-MM-dd HH:mm:ss")),
        "Appointment_Time": F.date_format("Appointment_Time", "yyyy-MM-dd HH:mm:ss"),
    })
    dups = b.where(uniform(ok, "dup") < 0.01)
    return b.unionByName(dups)


def read_bookings_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; times stay text until :func:`parse_ts_coerce`. Fails if missing."""
    return spark.read.schema(S.BOOKING_RAW).option("header", True).option("mode", "PERMISSIVE").csv(path)


def scoring_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring-request log from ``events``: latency ms, failed flag, null feature flag."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"), F.col("ts"), F.col("user_id"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "error").cast("int").alias("failed"),
        (uniform(F.col("event_id"), "nul") < 0.01).cast("int").alias("null_feature"),
    )
