"""Corpus preparation as stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with
the columns of ``docs``; the last one adds what the mix takes of a document.
A driver writes each result as Parquet and reads it as the next one's input;
``run`` chains them in one session through checkpoints.

Defined results: rows with null text or null ids pass through the stages that
cannot judge them (quality scores null text like empty text; language ID
rejects it); the near-dedup stage judges rows, so that different texts of one
id stay unless they are copies themselves, and repeated rows leave one; rows
without an id are copies of one another only; empty tables give empty results; extra columns, also with names that
operators use, are kept with their values (what the mix adds gets an underline
more where its name is taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookrisk.llm import decontam, langid, mixing, quality, simhash
from bookrisk.llm.common import durable, id_crc, table

#: Keep a document from this quality score on.
QUALITY = 0.5
#: Reject a language guess below this score (a guess among four starts at 0.25).
LANGUAGE = 0.3


def whole(docs: DataFrame) -> Column:
    """All columns of a document in one struct, apart from what a stage adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    judged = docs.select(whole(docs), quality.scored(docs, model).alias("judged"))
    return judged.where(F.col("judged.score") >= QUALITY).select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language cannot be told."""
    model = langid.train(docs.where(id_crc("doc_id") % 4 != 2), key=F.col("doc_id"))
    guess = langid.predictor(spark, model)(F.col("text").cast("string"))
    judged = docs.select(whole(docs), guess.alias("judged"))
    return judged.where((F.col("judged.lang") != langid.UNKNOWN) & (F.col("judged.score") >= LANGUAGE)).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id, then text hash, of each group, and
    of its rows without an id the one with the smallest text hash."""
    values = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(whole(docs), "doc_id", "text", F.xxhash64(*[x for v in values for x in (v, v.isNull())]).alias("key"))
    groups = simhash.near_duplicates(rows, shingle=3, radius=3, id_col="key")
    each = groups.groupBy(F.col("doc_id").alias("key"), "component_id").agg(F.count(F.lit(1)).alias("n"))
    order = rows.select("key", "doc_id", F.xxhash64("text").alias("t")).dropDuplicates(["key"])
    first = each.join(order, "key").groupBy("component_id", F.col("doc_id").isNull().alias("no_id")).agg(
        F.min(F.struct("doc_id", "t", "key", "n")).alias("f"))
    kept = durable(first.select("f.key", "f.n"))
    once = rows.join(kept.where("n = 1").select("key"), "key", "left_semi").select("row.*")
    again = rows.join(kept.where("n > 1").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return once.unionByName(again.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the copies and words it takes."""
    rows = mixing.mixed(mixing.sized(docs)).where("mix.taken > 0")
    return rows.select("row.*", *[F.col(f"mix.{c}").alias(free(f"mix_{c}", docs.columns)) for c in ("size", "source_size", "target", "copies", "taken")])


def free(name: str, taken: list[str]) -> str:
    """``name``, with underlines added while a column has it already."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
]

#: Trained models and 64-bit hashes have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
