"""Shared inputs for the registered queries (Spark side and SQL side)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookrisk.functions.columns import lookup, ts_text
from bookrisk.functions.hashing import uniform_sql as h
from bookrisk.operators.clean import parse_ts_coerce
from bookrisk.operators.rules import evaluate
from bookrisk.operators.score import score_frozen
from bookrisk.session import ensure_checkpoint_dir
from bookrisk.sources import schema as S
from bookrisk.sources.bookings import bookings, dirty_bookings


_STORED: dict[tuple, str] = {}


def _stamp(spark: SparkSession, sf: str) -> tuple:
    """Identity of the driver inputs: files, bytes and last change, asked of
    the file system that Spark reads them from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for t in ("orders", "customer"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf}/{t}.parquet")
        files = path.getFileSystem(conf).listStatus(path)
        out.append((len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)))
    return tuple(out)


def stored(spark: SparkSession, sf: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a derived table of one scale, written by ``write(path)`` once
    per session in the reliable checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf, _stamp(spark, sf), name)
    path = _STORED.get(key)
    if path is None:
        path = scratch_path(spark, name)
        write(path)
        _STORED[key] = path
    return path


def bk(spark: SparkSession, sf: str) -> DataFrame:
    """The booking table of one scale, derived by Spark from the driver
    tables and stored as Parquet; queries read it like any stored booking
    source (the derivation, with its history window, is not repeated per query)."""
    path = stored(spark, sf, "bookings", lambda p: bookings(spark, sf).write.mode("overwrite").parquet(p))
    return spark.read.schema(S.BOOKING).parquet(path)


def sc(spark: SparkSession, sf: str) -> DataFrame:
    return score_frozen(bk(spark, sf))


def ac(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate(sc(spark, sf))


def report_columns(df: DataFrame) -> DataFrame:
    """Dashboard helper columns on scored bookings."""
    price = lookup(S.SERVICE_PRICE, F.col("Service_Type"), S.DEFAULT_PRICE).cast("double")
    return df.withColumns({
        "No_Show": F.coalesce(F.col("Outcome") == "No-Show", F.lit(False)).cast("int"),
        "Is_New_Customer": (F.col("Past_Visit_Count") == 0).cast("int"),
        "Revenue": price,
        "Revenue_At_Risk": price * F.col("no_show_probability"),
        "Appt_Hour": F.hour("Appointment_Time"),
        "Appt_Date": F.to_date("Appointment_Time"),
    })


def rp(spark: SparkSession, sf: str) -> DataFrame:
    return report_columns(sc(spark, sf))


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    return dirty_bookings(bk(spark, sf))


def parsed_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return parse_ts_coerce(dirty(spark, sf))


def texts(df: DataFrame) -> DataFrame:
    """Timestamps as 'yyyy-MM-dd HH:mm:ss' text (engine-neutral output)."""
    return df.withColumns({f.name: ts_text(F.col(f.name)) for f in df.schema.fields
                           if f.dataType.typeName() in ("timestamp", "timestamp_ntz")})


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's reliable checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


# ---------------------------------------------------------------- SQL side
def TS(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


DIRTY = f"""
dirty_b AS (
  SELECT Booking_ID, Customer_ID,
    CASE WHEN {h('Booking_ID', 'n1')} < 0.02 THEN NULL ELSE Service_Type END AS Service_Type, Branch,
    CASE WHEN {h('Booking_ID', 'n3')} < 0.01 THEN 'bad' ELSE {TS('Booking_Time')} END AS Booking_Time,
    {TS('Appointment_Time')} AS Appointment_Time, Booking_Lead_Time_Days,
    CASE WHEN {h('Booking_ID', 'n2')} < 0.02 THEN NULL ELSE Past_Visit_Count END AS Past_Visit_Count,
    Past_Cancellation_Count, Past_No_Show_Count, Payment_Method, Day_of_Week, Customer_Latent_Risk, Outcome
  FROM bk
), dirty AS (
  SELECT * FROM dirty_b UNION ALL SELECT * FROM dirty_b WHERE {h('Booking_ID', 'dup')} < 0.01
), pdirty AS (
  SELECT * REPLACE (try_cast(Booking_Time AS TIMESTAMP) AS Booking_Time,
                    try_cast(Appointment_Time AS TIMESTAMP) AS Appointment_Time)
  FROM dirty
)"""

BOOKING_COLS = [f.name for f in S.BOOKING.fields]


def sel_text(cols: list[str], alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(TS(p + c) + f" AS {c}" if c in S.DATETIME_COLUMNS else p + c for c in cols)
