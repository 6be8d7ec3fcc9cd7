"""Structured Streaming: the batch operators applied to a file stream.

Scoring and acting are stateless column expressions, so the streaming plan
is the batch plan over ``readStream``; state appears only for
de-duplication (bounded by the watermark) and windowed aggregates.
Sinks are Parquet files in append mode with a checkpoint under the
session's reliable checkpoint directory, so a restarted query resumes
from its last committed batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bookrisk.operators.rules import evaluate
from bookrisk.operators.score import score_frozen
from bookrisk.operators.sketches import latency_sketch, quantiles
from bookrisk.operators.stores import risk_score_rows

DEDUP_WATERMARK = "30 days"
OPS_WATERMARK = "2 minutes"
DRIFT_WATERMARK = "14 days"


def read_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """File source with a fixed schema (no inference on a stream)."""
    return spark.readStream.schema(schema).parquet(path)


def dedup(stream: DataFrame, key: str = "Booking_ID", ts: str = "Booking_Time",
          watermark: str = DEDUP_WATERMARK) -> DataFrame:
    """One row per key under replays; state is kept only within the watermark.
    (Event time must be a TIMESTAMP: wall-clock NTZ times are read as UTC.)"""
    return (stream.withColumn("_event_ts", F.col(ts).cast("timestamp")).withWatermark("_event_ts", watermark)
            .dropDuplicatesWithinWatermark([key]).drop("_event_ts"))


def score_to_store(stream: DataFrame, model_version: str) -> DataFrame:
    """``risk_scores`` rows of the arriving bookings, by the functions of the batch path."""
    return risk_score_rows(evaluate(score_frozen(stream)), model_version)


def tumbling_ops(log: DataFrame, window: str = "1 minute", watermark: str | None = OPS_WATERMARK) -> DataFrame:
    """Failure / null-feature rates, latency mean, P50 and P99 per tumbling
    window; ``latency`` is the sketch they come from, which is the window's state."""
    rows = log if watermark is None else log.withWatermark("ts", watermark)
    g = rows.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg("failed").alias("failure_rate"),
        F.avg("null_feature").alias("null_feature_rate"), F.avg("latency_ms").alias("mean_latency_ms"),
        latency_sketch("latency_ms").alias("latency"))
    return g.select(F.col("w.start").alias("window_start"), "n", "failure_rate", "null_feature_rate", "mean_latency_ms",
                    *quantiles("latency"), "latency")


def sliding_rate(bookings: DataFrame, length: str = "28 days", slide: str = "7 days",
                 watermark: str | None = DRIFT_WATERMARK, dedup_key: str | None = None) -> DataFrame:
    """No-show rate over a 4-week window sliding weekly (by appointment time);
    with a watermark, rows later than it are dropped from the stream, and
    ``dedup_key`` drops replays under the same watermark (one event time
    per query)."""
    b = bookings.withColumn("_ts", F.col("Appointment_Time").cast("timestamp"))
    if watermark:
        b = b.withWatermark("_ts", watermark)
        if dedup_key:
            b = b.dropDuplicatesWithinWatermark([dedup_key])
    return (b.groupBy(F.window("_ts", length, slide).alias("w"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.count_if(F.col("Outcome") == "No-Show").cast("bigint").alias("no_shows"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n", "no_shows",
                    (F.col("no_shows") / F.col("n")).alias("no_show_rate")))


def run_available_now(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process everything available, append to Parquet, stop. A later run with
    the same ``checkpoint`` goes on with the files that arrived since."""
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def write_feed(df: DataFrame, path: str, ts: str, before: Column | None = None) -> None:
    """Append the rows (those that meet ``before``) as feed files, dealt out
    by ranges of event time."""
    rows = df if before is None else df.where(before)
    rows.repartitionByRange(ts).sortWithinPartitions(ts).write.mode("append").parquet(path)


def closing_row(df: DataFrame, ts: str, days: int) -> DataFrame:
    """One row, null but for an event time ``days`` after the last one: it
    carries the watermark past every window with data, so that they are all
    emitted. Its own window stays open. No row for an empty input."""
    last = df.agg(F.max(ts).alias("_last")).where("_last is not null")
    return last.select(*[(F.col("_last") + F.make_dt_interval(F.lit(days)) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name)
                         for f in df.schema.fields])
