"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookrisk.session import ensure_checkpoint_dir

#: Words are separated by these characters and nothing else.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared
    folder: the table is computed once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_slices(values: pa.Array, rows: int = 256) -> Iterator[list[str | None]]:
    """The values of an Arrow string array as Python lists of ``rows``."""
    for i in range(0, len(values), rows):
        yield values.slice(i, rows).to_pylist()


def id_crc(col: str | Column) -> Column:
    """crc32 of an id written as decimal text; null ids count as 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0))


def uniform(*cols: str | Column, salt: str = "") -> Column:
    """A fixed draw in (0, 1) from the given columns: 52 bits of XXH64."""
    h = F.xxhash64(F.lit(salt), *cols)
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once per row, also when ``of``
    uses it inside a higher-order function."""
    return F.element_at(F.transform(F.array(value), of), 1)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
