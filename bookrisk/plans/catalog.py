"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where SQL can state it, the DuckDB oracle text. Keys follow SURVEY §2."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    oracle: str  # "S" exact SQL oracle, "R" rows only


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(fn, sql, "S" if sql else "R")
        return fn
    return deco
