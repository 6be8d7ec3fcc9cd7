"""Cleaning: time parsing, missing-value strategies, validation, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookrisk.operators.prefix import RANGE_WIDTH, forward_back_fill
from bookrisk.sources import schema as S

STRATEGIES = ("drop", "forward_fill", "mean", "mode")


def parse_ts_coerce(df: DataFrame, cols: list[str] = S.DATETIME_COLUMNS) -> DataFrame:
    """Text -> TIMESTAMP_NTZ; unparsable values become null (never raises)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS TIMESTAMP_NTZ)") for c in cols if c in df.columns})


def parse_ts_strict(df: DataFrame, cols: list[str] = S.DATETIME_COLUMNS) -> DataFrame:
    """Text -> TIMESTAMP_NTZ; a bad value fails the job (ANSI cast)."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols if c in df.columns})


def missing_drop(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def missing_ffill(df: DataFrame, order_col: str = "Booking_ID", width: int = RANGE_WIDTH) -> DataFrame:
    """Forward fill then back fill in ``order_col`` order (skew-safe form)."""
    cols = [c for c in df.columns if c != order_col]
    return forward_back_fill(df, order_col, cols, width)


def mode_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the most frequent non-null value per column (ties -> smallest)."""
    cols = [c for c in cols if c in df.columns]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                                         for c in cols])).alias("kv")).select("kv.*").where(F.col("v").isNotNull())
    counts = long.groupBy("k", "v").count()  # bounded by the number of levels
    best = counts.groupBy("k").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("v"))
    return best.groupBy().pivot("k", cols).agg(F.first("v"))


def missing_mean(df: DataFrame) -> DataFrame:
    """Numeric nulls -> column mean (column becomes double), categorical
    nulls -> mode. Times and Customer_Latent_Risk are left as they are."""
    num = [c for c in S.NUMERIC_COLUMNS if c in df.columns]
    cat = [c for c in S.CATEGORICAL_COLUMNS if c in df.columns]
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in num])
    modes = mode_values(df, cat).select(*[F.col(c).alias(f"_d_{c}") for c in cat])
    out = df.crossJoin(F.broadcast(means)).crossJoin(F.broadcast(modes))  # one-row tables
    out = out.withColumns({**{c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in num},
                           **{c: F.coalesce(F.col(c), F.col(f"_d_{c}")) for c in cat}})
    return out.select(*df.columns)


def missing_mode(df: DataFrame) -> DataFrame:
    """Categorical nulls -> most frequent value (ties -> smallest)."""
    cat = [c for c in S.CATEGORICAL_COLUMNS if c in df.columns]
    modes = mode_values(df, cat).select(*[F.col(c).alias(f"_d_{c}") for c in cat])
    out = df.crossJoin(F.broadcast(modes)).withColumns({c: F.coalesce(F.col(c), F.col(f"_d_{c}")) for c in cat})
    return out.select(*df.columns)


def handle_missing(df: DataFrame, strategy: str = "drop") -> DataFrame:
    if strategy == "drop":
        return missing_drop(df)
    if strategy == "forward_fill":
        return missing_ffill(df)
    if strategy == "mean":
        return missing_mean(df)
    if strategy == "mode":
        return missing_mode(df)
    raise ValueError(f"unknown missing-value strategy {strategy!r}; expected one of {STRATEGIES}")


def clean(df: DataFrame, strategy: str = "drop") -> DataFrame:
    """Parse times (bad -> null) then apply the missing-value strategy."""
    return df.transform(parse_ts_coerce).transform(handle_missing, strategy)


_GROUPS = [("datetime_columns", S.DATETIME_COLUMNS, (T.TimestampType, T.TimestampNTZType)),
           ("numeric_columns", S.NUMERIC_COLUMNS, (T.NumericType,)),
           ("categorical_columns", S.CATEGORICAL_COLUMNS, (T.StringType,)),
           ("id_columns", S.ID_COLUMNS, (T.NumericType,))]


def validate_types(df: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Per column: type ok flag (from the schema) and, when the raw text
    table is given, the number of values that failed to cast."""
    spark = df.sparkSession
    rows = []
    for group, cols, types in _GROUPS:
        for c in cols:
            if c in df.columns:
                rows.append((group, c, int(isinstance(df.schema[c].dataType, types))))
    flags = spark.createDataFrame(rows, "grp string, column_name string, type_ok int")
    if raw is None:
        return flags.withColumn("cast_failures", F.lit(0).cast("bigint"))
    fails = []
    for _, cols, _types in _GROUPS:
        for c in cols:
            if c in raw.columns and c in df.columns:
                to = df.schema[c].dataType if c not in S.DATETIME_COLUMNS else T.TimestampNTZType()
                bad = F.col(c).try_cast(to).isNull() & F.col(c).isNotNull()
                fails.append(F.struct(F.lit(c).alias("column_name"), F.count_if(bad).alias("cast_failures")))
    agg = raw.agg(F.array(*fails).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return (flags.join(F.broadcast(agg), "column_name", "left")
            .select("grp", "column_name", "type_ok",
                    F.coalesce(F.col("cast_failures"), F.lit(0)).cast("bigint").alias("cast_failures")))


def data_summary(df: DataFrame) -> DataFrame:
    """Long table (metric, value): rows, columns, duplicates, nulls per column.
    One pass for the null counts; duplicates via a grouped count."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    n_null = nulls.select(F.explode(F.array(*[F.struct(F.lit(f"null:{c}").alias("metric"),
                                                       F.col(c).cast("bigint").alias("value")) for c in df.columns]))
                          .alias("x")).select("x.*")
    dup = df.groupBy(*df.columns).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("dups"), F.sum("count").alias("n"))
    top = dup.select(F.explode(F.array(
        F.struct(F.lit("rows").alias("metric"), F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("value")),
        F.struct(F.lit("columns").alias("metric"), F.lit(len(df.columns)).cast("bigint").alias("value")),
        F.struct(F.lit("duplicates").alias("metric"), F.col("dups").alias("value")))).alias("x")).select("x.*")
    return top.unionByName(n_null)


def duplicates_count(df: DataFrame) -> DataFrame:
    """Exact duplicate rows beyond the first (pre-aggregated per row value)."""
    return (df.groupBy(*df.columns).count()
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicates")))


def lead_time_audit(df: DataFrame, sample: int = 10) -> DataFrame:
    """Rows where the supplied lead differs from the computed floor lead:
    the total count and the first ``sample`` rows by Booking_ID."""
    from bookrisk.functions.columns import elapsed_days_floor
    d = df.select("Booking_ID", F.col("Booking_Lead_Time_Days").alias("supplied"),
                  elapsed_days_floor("Booking_Time", "Appointment_Time").alias("computed"))
    bad = d.where(~F.col("supplied").eqNullSafe(F.col("computed")))
    n = bad.agg(F.count(F.lit(1)).alias("n_mismatch"))
    return bad.orderBy("Booking_ID").limit(sample).crossJoin(F.broadcast(n))
