"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's 64-bit SimHash takes each bit by majority over the XXH64 hashes
of its word shingles. Two fingerprints link when they differ in at most
``radius`` bits. The tables are built so that no such pair is missed: every
bit position gets a vector of F2^(radius+1), and the mask of a table, one for
each non-zero v, has the positions whose vector has odd inner product with v.
The differing positions of a pair span at most ``radius`` dimensions, so some
v is orthogonal to all of them: the pair agrees on that table's mask and
meets in one of its buckets.

Buckets hold distinct fingerprints only. A bucket of up to ``bucket_rows``
is compared in one array and gives a spanning forest of its links, never all
pairs. A larger bucket is linked exactly through balls instead: two
fingerprints within 3 bits have a point within 1 bit of one and 2 of the
other, so every fingerprint is sent to the points of its ball and joined to
one fingerprint that lies nearer; the rows grow in proportion to the bucket.

Defined results: null or empty text (or white space only) has fingerprint
zero and links like any other; a text with fewer words than a shingle is one
shingle; repeated rows get equal rows; a null doc_id stays null and its
component takes the smallest non-null id reachable (null if there is none);
an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.llm.common import durable, text_slices

BITS = 64
BUCKET_ROWS = 4096
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, 42) for g in grams), dtype="<u8")
    cells = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.uint16)
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits((2 * counts > len(h)).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long with the same bits."""
    def run(batches):
        for b in batches:
            fp = [fingerprint_of(t, shingle) for part in text_slices(b.column(1)) for t in part]
            yield pa.record_batch([b.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))],
                                  names=["doc_id", "fp"])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = 3, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks of the tables."""
    size = (1 << (radius + 1)) - 1
    vector = [1 + i % size for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Links that connect what lies within ``radius`` bits: (n, 2) values."""
    label, out = np.arange(len(fps)), []
    for i in range(len(fps) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= radius)
        joined = near[label[near] != label[i]]
        if len(joined):
            roots, first = np.unique(label[joined], return_index=True)
            out += [(fps[i], fps[j]) for j in joined[first]]
            label[np.isin(label, roots)] = label[i]
    return np.array(out, dtype=np.uint64).reshape(-1, 2)


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """buckets: (fps array<long>) -> links (a, b)."""
    def run(batches):
        for batch in batches:
            col = batch.column(0)
            values, offsets = col.values.to_numpy().view(np.uint64), col.offsets.to_numpy()
            found = [_forest(values[s:e], radius) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            links = np.concatenate([np.empty((0, 2), np.uint64), *found]).view(np.int64)
            yield pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])
    return buckets.mapInArrow(run, "a long, b long")


def _ball_links(rows: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """Exact links of crowded buckets, rows (v, k, fp), in linear size: each
    fingerprint goes to all points of its ball over the bits that its table
    leaves free; at a point, all within the larger ball link to the smallest
    one within the smaller ball."""
    small, large = radius // 2, radius - radius // 2

    def points(batches):
        flips, depth = [], []
        for mask in masks:
            free = [1 << i for i in range(BITS) if not mask >> i & 1]
            sets = [c for n in range(large + 1) for c in combinations(free, n)]
            flips.append(np.array([sum(c) for c in sets], dtype=np.uint64))
            depth.append(np.array([len(c) for c in sets], dtype=np.int8))
        for batch in batches:
            for v, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(), strict=True):
                z = (flips[v] ^ fp.view(np.uint64)).view(np.int64)
                yield pa.record_batch([pa.array(z), pa.array(depth[v]), pa.array(np.full(len(z), fp))],
                                      names=["z", "d", "fp"])

    at = rows.select("v", "fp").mapInArrow(points, "z long, d byte, fp long")
    centre = at.where(F.col("d") <= small).groupBy("z").agg(F.min("fp").alias("c"))
    return at.join(centre, "z").where(F.col("fp") != F.col("c")).select(F.col("fp").alias("a"), F.col("c").alias("b"))


def links(distinct: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within
    ``radius`` bits, directly or through one another."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(v).cast("byte").alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
                       for v, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(tables).alias("t")).select("t.v", "t.k", "fp")
    met = durable(rows.groupBy("v", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                  .where("n > 1"))
    pairs = met.where(F.col("n") == 2).select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    more = rows.join(met.where("n > 2").select("v", "k", "n"), ["v", "k"])
    grouped = (more.where(F.col("n") <= bucket_rows).groupBy("v", "k").agg(F.collect_list("fp").alias("fps")).select("fps"))
    crowded = more.where(F.col("n") > bucket_rows)
    return (pairs.unionByName(_bucket_links(grouped, radius))
            .unionByName(_ball_links(crowded, radius, masks)).distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component. Alternates
    large-star and small-star steps until the edges no longer change; each
    round is checkpointed, and the joins are between two shuffled inputs, so
    that a hub's rows can be split."""
    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = durable(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .where("u != v").distinct())
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(low, "u")
        e = durable(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                    .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, bucket_rows: int = BUCKET_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row."""
    fps = durable(fingerprints(docs, shingle, id_col, text_col))
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = connected(links(nodes.select("fp"), radius, bucket_rows))
    member = (linked.unionByName(linked.select(F.col("root").alias("node"), "root")).distinct()
              .join(nodes.withColumnRenamed("fp", "node"), "node"))
    smallest = durable(member.groupBy("root").agg(F.min("first_id").alias("component_id")))
    of = member.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    ids = durable(nodes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return fps.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
