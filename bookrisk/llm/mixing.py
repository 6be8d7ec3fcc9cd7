"""Mixing sources to target weights by Pareto order sampling.

The size of a document is its number of words. Sources, in code-point order
and null last, get weights by turns and share ``share`` of all words by
weight; a target stops at ``most`` times its source's size and the excess is
reshared by weight among the others (water-filling: with the sources ordered
by limit over weight, the stopped ones come first, so running sums give the
common level). A document's expected number of copies is its source's target
over its size. The whole part is certain; the fraction f is drawn by Pareto
order sampling: documents are ranked by the odds of a fixed random number
over the odds of f, and taken from the smallest on until the source's
remaining words are reached (the last one only if that comes nearer). With
``weight`` the expected copies follow the document's weight, so that whole
copies and fractions differ within a source; no document expects more than
``most``, and what heavy ones cannot take is reshared by weight.

No source passes through one task: ranks are cut into 4,096 ranges, the words
of each (source, range) are summed before the shuffle, running sums over that
small table say which ranges are taken, and only documents of one range are
ordered against each other.

Defined results: null or empty text has size 0 and takes 0; a source without
words has target 0; a null source is a source of its own; ties in rank go to
the smaller id (null first), then the smaller size; repeated rows are drawn
one by one; a null id draws by its text; an empty table gives an empty
result; other columns are kept or ignored, as the function says.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookrisk.llm.common import durable

RANGES = 4096
#: A table of up to so many sources (some 10 MB) goes whole to every task; above it the join is shuffled.
BROADCAST_SOURCES = 100_000
WEIGHTS = (3, 1, 2)
SIZE, DRAW, SOURCE, ID, HEAVY = "_mix_size", "_mix_draw", "_mix_source", "_mix_id", "_mix_weight"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weight: str | None = None, salt: str = "mix", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or ``keep`` of them) in a struct ``row``, whatever
    their names, beside size, draw, source, id and weight."""
    text = F.col(text_col).cast("string")
    key = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), text, F.lit("")))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long")).alias(SIZE),
        ((F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)).alias(DRAW),
        F.col(source_col).cast("string").alias(SOURCE), F.col(id_col).alias(ID),
        (F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1e-9))).alias(HEAVY))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size, ...) -> with target. One row per source; the windows
    run over this table of sources only, never over documents."""
    by_name = Window.orderBy(F.col(SOURCE).asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumns({"limit": F.col("source_size") * float(most), "row": turn})
    earlier = Window.orderBy(F.col("limit") / F.col("w"), "row").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)))
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))))
    # a source is stopped while its limit is below its share of the level left by the ones before it
    s = s.withColumn("open", F.min(F.when(F.col("limit") >= F.col("level") * F.col("w"), F.struct(F.col("limit") / F.col("w"), "row", "level"))).over(every))
    return (s.withColumn("target", F.when(F.col("open").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("open.level") * F.col("w"))))
            .drop("w", "limit", "row", "level", "open"))


def _sent(plan: DataFrame) -> DataFrame:
    """A written table of sources, to every task while it is small."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def _factors(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """``plan`` with the factor by which weights become expected copies, at
    most ``most`` for a document: what the heavy ones cannot take is reshared
    by weight among the others, until no other reaches ``most``. The capped
    documents only grow in number, so this ends."""
    plan = durable(plan.withColumn("factor", F.lit(0.0)))
    while True:
        d = rows.join(_sent(plan), F.col(SOURCE).eqNullSafe(F.col("p_source")))
        full = F.col(HEAVY) * F.col("factor") >= most
        sums = d.groupBy(F.col(SOURCE).alias("s_source")).agg(F.sum(F.when(full, F.col(SIZE)).otherwise(0)).alias("full"),
                                                             F.sum(F.when(full, 0.0).otherwise(F.col(HEAVY) * F.col(SIZE))).alias("open"))
        j = plan.join(sums, F.col("p_source").eqNullSafe(F.col("s_source")), "left")
        factor = F.when(F.col("open") > 0, F.greatest((F.col("target") - most * F.col("full")) / F.col("open"), F.col("factor"))).otherwise(F.col("factor"))
        after = durable(j.select(*[c for c in plan.columns if c != "factor"], factor.alias("factor"), (factor > F.col("factor") * (1 + 1e-12)).alias("more")))
        plan = after.drop("more")
        if after.where("more").isEmpty():
            return plan


def mixed(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, weighted: bool = False) -> DataFrame:
    """rows: what ``sized`` returns. (row, mix): every row with a struct of
    size, source_size, target, copies and taken. With ``weighted`` the expected
    copies of a document follow its weight, else only its source."""
    plan = targets(rows.groupBy(SOURCE).agg(F.sum(SIZE).alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.select(F.col(SOURCE).alias("p_source"), "source_size", "target", rate.alias("rate"))
    plan = _factors(rows, plan, most) if weighted else durable(plan)
    expected = F.least(F.lit(float(most)), F.col(HEAVY) * F.col("factor")) if weighted else F.col("rate")
    d = rows.join(_sent(plan), F.col(SOURCE).eqNullSafe(F.col("p_source")), "left")
    d = d.withColumns({"whole": F.floor(expected), "part": expected - F.floor(expected)})
    if weighted:
        certain = d.groupBy(F.col(SOURCE).alias("c_source")).agg(F.sum(F.col("whole") * F.col(SIZE)).alias("certain"))
        d = d.join(_sent(durable(certain)), F.col(SOURCE).eqNullSafe(F.col("c_source")), "left").withColumn("rest", F.col("target") - F.col("certain"))
    else:
        d = d.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    odds = F.when(F.col("part") > 0, F.col(DRAW) / (1 - F.col(DRAW)) / (F.col("part") / (1 - F.col("part"))))
    d = d.withColumn("rank", odds)
    # any rising function of the rank gives ranges; with equal parts this is the draw itself, which is even
    even = F.col("rank") * (F.lit(1.0) if weighted else F.col("part") / (1 - F.col("part")))
    # documents of a source without a drawn part have no rank; they spread over the ranges all the same
    d = d.withColumn("range", F.floor(F.when(F.col("rank").isNull(), F.col(DRAW)).otherwise(even / (1 + even)) * RANGES).cast("int"))
    # only what may be drawn takes words of the rest
    ranges = d.groupBy(F.col(SOURCE).alias("r_source"), F.col("range").alias("r_range")).agg(
        F.sum(F.when(F.col("rank").isNotNull(), F.col(SIZE)).otherwise(0)).alias("words"))
    before = Window.partitionBy("r_source").orderBy("r_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    d = d.join(ranges, F.col(SOURCE).eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")), "left")
    order = Window.partitionBy(SOURCE, "range").orderBy("rank", F.col(ID).asc_nulls_first(), SIZE).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), F.col(SIZE)).otherwise(0)).over(order), F.lit(0))
    d = d.withColumn("ahead", ahead)
    drawn = (F.col("rank").isNotNull() & (F.col("ahead") + F.col(SIZE) / 2 <= F.col("rest"))).cast("long")
    copies = F.coalesce(F.col("whole"), F.lit(0)) + drawn
    return d.select("row", F.struct(F.col(SIZE).alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col(SIZE)).alias("taken")).alias("mix"))


def mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, weighted: bool = False) -> DataFrame:
    """``mixed`` with the columns of the rows side by side and the struct in
    ``_mix``, which takes the place of a column of that name."""
    out = mixed(rows, weights, share, most, weighted)
    return out.select(*[F.col(f"row.`{c}`") for c in out.schema["row"].dataType.names if c != "_mix"], F.col("mix").alias("_mix"))
