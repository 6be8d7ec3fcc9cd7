"""A Parquet store that takes micro-batches exactly once and holds one row per key.

``upsert`` runs in ``foreachBatch``. Rows belong to the part of their month
(``grain``; a store that takes much every day may use days). A batch reads the present version of the parts it touches, puts its rows in (of
one key the newer ``ts`` stays, then the row that came later), writes these parts
as a new version and then adds one entry to the ledger: which version of which
part is now in force. Readers follow the ledger only. So a batch that stopped
between the two is not seen and is written again when the stream resumes; a
batch that the ledger names is not applied a second time; and rows that come
again, however late, find their part and change nothing. Only touched parts are
rewritten; no watermark and no state is needed.

One writer at a time. The key includes the time of the row, so a booking
scored again later keeps both scores. Rows without a time form a part of their
own. An empty batch is entered without parts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("booking_id", "model_version", "scored_at")
GRAIN = "yyyy-MM"
LEDGER = "seq long, stream string, batch long, part string, version string"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The committed entries: one row per batch and part (part null: none)."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _commit(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def _present(spark: SparkSession, path: str, parts: Sequence[str] | None = None) -> dict[str, str]:
    """Part -> folder of its version in force. One entry per part of the store."""
    entries = _ledger(spark, path).where("part is not null")
    if parts is not None:
        entries = entries.where(F.col("part").isin(list(parts)))
    found = entries.groupBy("part").agg(F.max_by("version", "seq").alias("version")).collect()
    return {r["part"]: f"{path}/data/{r['version']}/part={r['part']}" for r in found}


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows in force."""
    folders = list(_present(spark, path).values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(batch: DataFrame, batch_id: int, path: str, key: Sequence[str] = KEY, ts: str = "scored_at", stream: str = "stream",
           grain: str = GRAIN) -> bool:
    """Apply one micro-batch; False if it was applied before."""
    spark = batch.sparkSession
    if not _ledger(spark, path).where((F.col("stream") == stream) & (F.col("batch") == batch_id)).isEmpty():
        return False
    part = F.coalesce(F.date_format(ts, grain), F.lit("none")).alias("part")
    parts = [r["part"] for r in batch.select(part).distinct().collect()]  # months of one batch
    seq = (_ledger(spark, path).agg(F.max("seq")).first()[0] or 0) + 1
    version = f"{stream}-{batch_id}"
    if parts:
        rows = batch.select(F.lit(1).alias("_new"), *batch.columns)
        old = list(_present(spark, path, parts).values())
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("_new", F.lit(0)))
        value = [c for c in batch.columns if c not in key]
        newest = rows.groupBy(*key).agg(F.max(F.struct("_new", *value)).alias("_row"))
        out = newest.select(*[F.col(c) if c in key else F.col(f"_row.{c}") for c in batch.columns])
        # a part is dealt out by ranges of the key, so that a large one is written by many tasks
        out.withColumn("part", part).repartitionByRange("part", *key).write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/{version}")
    _commit(spark, path, [(seq, stream, batch_id, p, version) for p in parts or [None]])
    return True


def run_available_now(stream: DataFrame, path: str, checkpoint: str, apply: Callable[[DataFrame], DataFrame] = lambda b: b,
                      grain: str = GRAIN) -> None:
    """Put everything available into the store, then stop. ``apply`` turns the
    rows of a batch into rows of the store."""
    def each(batch: DataFrame, batch_id: int) -> None:
        upsert(apply(batch), batch_id, path, grain=grain)
    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
