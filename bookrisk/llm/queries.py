"""Registered queries of the operators: ``QUERIES`` by name, ``ORACLE`` with
the DuckDB text where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from bookrisk.llm import conversations, decontam, html, langid, licenses, mixing, pieces, quality, simhash, sketch, toxicity, warc, whitening
from bookrisk.llm.common import durable, id_crc, shared_folder, table


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item against every whole document, one edit in 16 characters."""
    return decontam.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 4 is not 2 and predicts all."""
    docs = table(spark, sf, "documents")
    held_out = id_crc("doc_id") % 4 == 2
    model = langid.train(docs.where(~held_out), key=F.col("doc_id"))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Co-trained on the labelled documents; scores every document."""
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf, "labels")))


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Writes an archive record for every page and reads the archives back."""
    folder = shared_folder(spark, "warc")
    warc.write(table(spark, sf, "pages"), folder)
    return warc.read(spark, folder).where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, b32.digest AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = origin THEN NULL ELSE origin END AS refers_to
FROM (SELECT *, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS origin FROM pages) p,
LATERAL (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT
  >> (35 - 5 * (i % 8))) & 31)::INT, 1), '' ORDER BY i) AS digest FROM (SELECT unnest(range(32)) AS i)) b32
"""


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Learns from the labels of rows whose crc32(doc_id) mod 3 is not 1 and scores all."""
    docs = table(spark, sf, "documents")
    held_out = id_crc("doc_id") % 3 == 1
    model = toxicity.train(docs, table(spark, sf, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Sources weigh 3, 1, 2 by turns and share 150 % of all words, each at most twice its size."""
    rows = durable(mixing.sized(table(spark, sf, "documents"), keep=["doc_id", "source"]))
    return mixing.mixed(rows).select("row.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "row.source", "mix.copies")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM documents
), s AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
      WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), levels AS (  -- every number of stopped sources; the right one is the first whose level stops no other
  SELECT *, row_number() OVER (o) AS r,
    ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s WINDOW o AS (ORDER BY lim / w, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(lim, coalesce((SELECT arg_min(level, r) FROM levels WHERE lim >= level * w), 1e300) * w) AS target
  FROM levels
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), q AS (
  SELECT d.*, source_size, target, floor(rate)::BIGINT AS whole, target - floor(rate)::BIGINT * source_size AS rest,
    CASE WHEN rate - floor(rate) > 0 THEN u / (1 - u) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS rnk
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id NULLS FIRST, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM q
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies
FROM (SELECT *, whole + CASE WHEN rnk IS NOT NULL AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS copies FROM c)
"""


def op7_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages; subtrees on three or more and a quarter of a host's different pages are template."""
    return html.main_text(table(spark, sf, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Three-word shingles, links at 3 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, radius=3)


def op9_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text against its edited text and the next document."""
    return sketch.compare_edits(table(spark, sf, "documents"))


def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All template notices in every whole document."""
    return licenses.scan(table(spark, sf, "documents"))


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged conversations, their faults and their cheapest repair."""
    whole = table(spark, sf, "conversations")
    return conversations.repair(whole, conversations.damaged(whole))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """The 32 leading components of all vectors."""
    done = whitening.whiten(table(spark, sf, "embeddings"), components=32)
    return done.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text encoded with a public 32k model and decoded again."""
    import public_tokenizers

    done = pieces.round_trip(table(spark, sf, "documents"), pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_quality, op4_warc, op5_toxicity, op6_mixing, op7_main_text, op8_simhash_near_dedup, op9_fingerprints,
                                   op10_license_scan, op11_conversation_repair, op12_whitening, op13_sentencepiece)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE: dict[str, str] = {"op4_warc": OP4_SQL, "op6_mixing": OP6_SQL}
