"""JSON booking payloads: the single-record request format of the API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.operators.clean import parse_ts_coerce
from bookrisk.sources import schema as S


def to_payload(bookings: DataFrame) -> DataFrame:
    """One JSON object per booking (times as 'yyyy-MM-dd HH:mm:ss')."""
    cols = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in S.DATETIME_COLUMNS else F.col(c)
            for c in bookings.columns]
    return bookings.select(F.to_json(F.struct(*cols)).alias("value"))


def parse_payload(payloads: DataFrame, col: str = "value") -> DataFrame:
    """JSON text -> typed booking row; absent fields are null, unparsable
    times become null (the lead falls back to the computed one)."""
    parsed = payloads.select(F.from_json(F.col(col), S.BOOKING_RAW).alias("b")).select("b.*")
    return parse_ts_coerce(parsed)
