"""Population stability from stored counts: no second reading of the rows.

:func:`summarise` reads the rows once and counts them per day, feature and
cell of a fixed grid; a cell keeps its least and largest value. The grid does
not depend on the data (cells are ``grid`` wide in proportion to the value,
with cells of their own for 0 and for each sign), so the tables of two days or
two inputs are merged by adding counts (:func:`merge`), and any reference and
current period is binned from them (:func:`psi_between`).

The bins are those of ``drift.psi``: equal widths between the least and the
largest reference value, which the cells know exactly. A cell whose least and
largest value share a bin is counted as the rows would be; one that holds an
edge is counted where its middle lies, and its rows may belong to either side.
``psi_low`` and ``psi_high`` are the least and largest index over all such
choices bin by bin, so the index of the rows always lies between them, and all
three agree where no cell holds an edge.

Null and non-finite values are left out; rows without a day are in no period;
a side without values in the range has no index ('not enough data'). Values
below ``grid`` times themselves apart share a cell; a feature has at most
about 1,500 / ``grid`` cells a day, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookrisk.operators.drift import PSI_CLIP, psi_status

GRID = 0.002
_FAR = 10 ** 9  # above every cell number, so that signs and 0 stay apart


def cell(x: Column, grid: float = GRID) -> Column:
    """Number of the cell of a finite value."""
    place = F.floor(F.log(F.abs(x)) / F.log(F.lit(1.0 + grid))) + _FAR
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * place).cast("long")


def merge(summaries: DataFrame, *by: str) -> DataFrame:
    """Counts added up per feature, cell and the columns ``by``."""
    return summaries.groupBy(*by, "feature", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def summarise(df: DataFrame, features: list[str], ts: str = "Appointment_Time", grid: float = GRID) -> DataFrame:
    """(day, feature, cell, n, lo, hi): one scan, counts combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("x")) for f in features])
    long = df.select(F.to_date(F.col(ts)).alias("day"), F.explode(pairs).alias("kv")).select("day", "kv.*")
    long = long.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    return merge(long.select("day", "feature", cell(F.col("x"), grid).alias("cell"), F.lit(1).alias("n"),
                             F.col("x").alias("lo"), F.col("x").alias("hi")), "day")


def _shares(cells: DataFrame, rng: DataFrame, by: list[str], bins: int, name: str) -> DataFrame:
    """Share of every bin that has one, with its least and largest possible value."""
    step = (F.col("r_hi") - F.col("r_lo")) / float(bins)

    def bin_of(x: Column) -> Column:
        return sum(((F.lit(float(i)) * step + F.col("r_lo") <= x).cast("int") for i in range(1, bins)), F.lit(0))

    def inside(x: Column) -> Column:
        return (x >= F.col("r_lo")) & (x <= F.col("r_hi"))
    middle = F.col("lo") + (F.col("hi") - F.col("lo")) / 2
    d = cells.join(F.broadcast(rng), "feature").where((F.col("hi") >= F.col("r_lo")) & (F.col("lo") <= F.col("r_hi")))  # a row per feature
    d = d.select(*by, "feature", "n", (inside(F.col("lo")) & inside(F.col("hi"))).alias("whole"), F.when(inside(middle), bin_of(middle)).alias("guess"),
                 bin_of(F.col("lo")).alias("first"), bin_of(F.col("hi")).alias("last"))
    d = d.withColumn("bin", F.explode(F.sequence("first", "last")))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))
    once, only = F.col("bin") == F.col("first"), F.col("whole") & (F.col("first") == F.col("last"))
    g = d.groupBy(*by, "feature", "bin").agg(
        total(F.col("guess") == F.col("bin")).alias("n"), total(only).alias("n_low"), F.sum("n").alias("n_high"),
        total(once & F.col("whole")).alias("t_low"), total(once).alias("t_high"))
    t = g.groupBy(*by, "feature").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "t_low", "t_high")])
    return g.join(t, [*by, "feature"]).select(
        *by, "feature", "bin", (F.col("n") / F.nullif("all_n", F.lit(0))).alias(name), (F.col("n_low") / F.col("all_t_high")).alias(f"{name}_low"),
        F.least(F.lit(1.0), F.coalesce(F.col("n_high") / F.nullif("all_t_low", F.lit(0)), F.lit(1.0))).alias(f"{name}_high"))


def psi_between(summaries: DataFrame, reference: Column, current: Column, label: str = "period", bins: int = 10) -> DataFrame:
    """(label, feature, psi, psi_low, psi_high, status) of every current period
    against the reference. ``reference`` marks the days of the reference;
    ``current`` names the period of a day (null: in none)."""
    s = summaries.select("*", reference.alias("_reference"), current.alias(label))
    ref = merge(s.where("_reference"))
    rng = ref.groupBy("feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rng = rng.select("feature", *[F.when(F.col("lo") == F.col("hi"), F.col(c) + d).otherwise(F.col(c)).alias(f"r_{c}")
                                  for c, d in (("lo", -0.5), ("hi", 0.5))])
    cur = merge(s.where(F.col(label).isNotNull()), label)
    e, a = _shares(ref, rng, [], bins, "e"), _shares(cur, rng, [label], bins, "a")
    frame = cur.select(label, "feature").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    j = frame.join(e, ["feature", "bin"], "left").join(a, [label, "feature", "bin"], "left")

    def side(c: str) -> Column:
        return F.greatest(F.lit(PSI_CLIP), F.coalesce(F.col(c), F.lit(0.0)))

    def term(x: str, y: str) -> Column:
        return (side(y) - side(x)) * F.log(side(y) / side(x))
    low = (F.when(side("a_low") > side("e_high"), term("e_high", "a_low"))
           .when(side("a_high") < side("e_low"), term("e_low", "a_high")).otherwise(0.0))
    out = j.groupBy(label, "feature").agg(
        F.sum(term("e", "a")).alias("psi"), F.sum(low).alias("psi_low"), F.sum(F.greatest(term("e_low", "a_high"), term("e_high", "a_low"))).alias("psi_high"),
        (F.max("e").isNull() | F.max("a").isNull()).alias("none"))
    out = out.select(label, "feature", *[F.when(~F.col("none"), F.col(c)).alias(c) for c in ("psi", "psi_low", "psi_high")])
    return out.withColumn("status", psi_status(F.col("psi")))
