"""Threshold-scaled sketches of documents (DataFrame functions only).

The sketch of a text is every XXH64 hash of its five-word shingles that lies
below a fixed fraction of the hash range; a text of fewer than ``SHORT`` words
also keeps, below the same fraction, the hashes of its five-character
shingles, since a few words leave too few hashes. Sketches of parts merge by
union, and two sketches of any lengths compare directly: the shared hashes
over the smaller sketch estimate how much of the smaller document the larger
one holds. Character hashes count where both sketches have them.

``next_in_order`` brings every row together with the text of the next lower
id by one shuffle: rows go to blocks of about ``BLOCK`` rows that are next to
each other in the order, a window looks ahead inside a block, and the last row
of a block joins the first row of the next block in use. Borders of blocks are
approximate quantiles of the ids (one aggregate, at most ``BORDERS`` numbers),
so gaps between ids do not matter; an id that fills more than a block, and the
rows without an id, are cut by the hash of the text. The order of the blocks
comes from block numbers alone, in two levels. Only copies of one id and text
stay together.

Defined results: null text counts as empty; a text of fewer than five words
(characters) is one shingle, an empty one has an empty sketch; two empty
sketches are alike (1.0) if the texts are equal and unlike (0.0) otherwise, an
empty and a non-empty one unlike; rows with equal ids follow one another by
the hash of the text, null ids come last; a single row is its own next;
repeated rows get rows of their own; an empty table gives an empty result;
other input columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookrisk.llm.common import let

SHINGLE = 5
SHORT = 64
SCALE = 4
BLOCK = 256
BORDERS = 16_384
#: Block numbers: twice the number of the border, then 16 bits of the text's hash.
_CUT = 16
_LOWEST = -(1 << 63)


def sketch(text: Column, scale: int = SCALE, shingle: int = SHINGLE) -> Column:
    """Struct of the sorted distinct word and character hashes below 1/scale
    of the range."""
    most = F.lit(_LOWEST + (1 << 64) // scale)

    def kept(parts: Column) -> Column:
        starts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.greatest(F.size(parts) - (shingle - 1), F.lit(1)))) \
                  .otherwise(F.array().cast("array<int>"))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(parts, i, shingle)))
        return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < most)))

    def both(lower: Column) -> Column:
        none = F.array().cast("array<bigint>")
        letters = F.split(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "), "")
        return let(F.regexp_extract_all(lower, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda words: F.struct(
            kept(words).alias("words"),
            F.when((F.size(words) > 0) & (F.size(words) < SHORT), let(letters, kept)).otherwise(none).alias("chars")))
    return let(F.lower(F.coalesce(text, F.lit(""))), both)


def merged(a: Column, b: Column) -> Column:
    """Sketch of two texts taken as one collection of shingles."""
    return F.struct(*[F.array_sort(F.array_union(a[c], b[c])).alias(c) for c in ("words", "chars")])


def written(s: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash, in order; a colon goes
    before the character hashes, if there are any."""
    def digits(c):
        return F.array_join(F.transform(s[c], lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")
    return F.concat(digits("words"), F.when(F.size(s["chars"]) > 0, F.concat(F.lit(":"), digits("chars"))).otherwise(""))


def containment(a: Column, b: Column, same: Column) -> Column:
    """Share of the smaller sketch that the other holds; ``same`` decides two empty ones."""
    chars = (F.size(a["chars"]) > 0) & (F.size(b["chars"]) > 0)

    def of(count):
        return count("words") + F.when(chars, count("chars")).otherwise(0)
    least = F.least(of(lambda c: F.size(a[c])), of(lambda c: F.size(b[c])))
    shared = of(lambda c: F.size(F.array_intersect(a[c], b[c])))
    return F.when(least > 0, shared / least).when(same, F.lit(1.0)).otherwise(F.lit(0.0))


def _blocks(docs: DataFrame, doc_id: Column, text_hash: Column) -> Column:
    """The block of a row: rises with (id, hash of the text), null ids lowest."""
    n = docs.agg(F.count(doc_id)).first()[0]
    count = min(BORDERS, n // BLOCK)
    found = docs.agg(F.percentile_approx(doc_id, [i / (count + 1) for i in range(1, count + 1)], F.lit(10 * (count + 1)))).first()[0] if count else []
    borders = sorted(set(found))
    heavy = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    width = max(1, math.isqrt(len(borders)))
    groups = [borders[i:i + width] for i in range(0, len(borders), width)]

    def values(x, kind):  # one literal, folded before the query runs
        return F.from_json(F.lit(json.dumps(x)), kind)

    def below(a: Column) -> Column:
        return F.size(F.filter(a, lambda b: b < doc_id))
    if groups:
        group = below(values([g[0] for g in groups], "array<bigint>"))
        number = F.when(group == 0, 0).otherwise((group - 1) * width + below(F.element_at(values(groups, "array<array<bigint>>"), group)))
    else:
        number = F.lit(0)
    cut = F.shiftright(text_hash, 64 - _CUT) + (1 << (_CUT - 1))
    full = F.array_contains(values(heavy, "array<bigint>"), doc_id) if heavy else F.lit(False)
    place = F.when(doc_id.isNull(), F.lit(1)).otherwise(2 * (number + 1) + full.cast("int")).cast("long")
    return F.shiftleft(place, _CUT) + F.when(doc_id.isNull() | full, cut).otherwise(F.lit(0))


def next_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, sk, next_text, next_sk) with the next row by descending id."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    block = _blocks(named, F.col("doc_id"), F.xxhash64("text"))
    base = named.select("*", block.alias("block")).repartition("block")
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())
    rows = base.withColumn("sk", sketch(F.col("text")))
    ahead = rows.select("*", F.lead("text").over(order).alias("n_text"), F.lead("sk").over(order).alias("n_sk"))

    first = base.groupBy("block").agg(F.max_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("h_text"))
    used = named.select(block.alias("block")).distinct().withColumn("top", F.shiftright("block", _CUT))
    tops = used.groupBy("top").agg(F.max("block").alias("head"))
    lower_top = F.lead("head").over(Window.orderBy(F.col("top").desc()))  # a row per border at most
    tops = tops.select("top", F.coalesce(lower_top, F.max("head").over(Window.partitionBy(F.lit(0)))).alias("below"))
    inside = F.lead("block").over(Window.partitionBy("top").orderBy(F.col("block").desc()))
    follows = (used.withColumn("inside", inside).join(tops, "top")
               .select(F.col("block").alias("of"), F.coalesce("inside", "below").alias("block")))
    heads = follows.join(first, "block").select("of", "h_text", sketch(F.col("h_text")).alias("h_sk"))
    last = F.col("n_text").isNull()
    both = ahead.join(heads, (F.col("block") == F.col("of")) & last, "left")
    return both.select("doc_id", "text", "sk", F.coalesce("n_text", "h_text").alias("next_text"),
                       F.coalesce("n_sk", "h_sk").alias("next_sk"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every text and of its edited text (the last third replaced
    by the beginning of the next document), and how alike they are."""
    d = next_in_order(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    d = d.withColumn("e_sk", sketch(F.col("edited")))
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), written(F.col("sk")).alias("fingerprint"),
        written(F.col("e_sk")).alias("edited_fingerprint"),
        containment(F.col("sk"), F.col("e_sk"), F.col("text") == F.col("edited")).alias("near_edited"),
        containment(F.col("sk"), F.col("next_sk"), F.col("text") == F.col("next_text")).alias("near_next"))
