"""Exact stratified splits.

Every class gives each part its share to within half a row: rows of a class
are ordered by a fixed draw from their key, and the first ``share`` of them
form the first part, the next the second. No class is ordered as a whole.
The draws are counted in ``CELLS`` cells per class (one grouped count), the
quotas are placed in the running totals of that small table, and only rows
of a cell that a quota cuts are ordered, to find the row at the cut. The
split itself is then a comparison with the cuts of the class: map-only. The
cuts, a row per class, are sent to the tasks: a shuffle by the class would put
each class into one task.

Rows without a label form a class of their own. Keys should be unique: rows
of one key, null keys among them, stand at one place of the order and fall
into one part together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookrisk.functions.hashing import uniform

CELLS = 4096


def quota(n: Column, share: float) -> Column:
    """Rows of a share, half a row rounded up."""
    return F.floor(n * F.lit(float(share)) + 0.5)


def cuts(df: DataFrame, shares: list[float], key: str, label: Column, salt: str) -> DataFrame:
    """(label, cut_0, cut_1, ...): the place (draw, key) of the last row within
    each running share; null where the quota is zero. One row per class."""
    u = F.coalesce(uniform(F.col(key), salt), F.lit(0.0))
    rows = df.select(label.alias("_label"), F.struct(u.alias("u"), F.col(key).alias("k")).alias("_place"),
                     F.floor(u * CELLS).cast("int").alias("_cell"))
    cells = rows.groupBy("_label", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy("_label").orderBy("_cell")
    upto = F.sum("_n").over(ordered)
    total = F.sum("_n").over(Window.partitionBy("_label"))
    running = cells.select("_label", "_cell", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), total.alias("_total"))
    quotas = F.array(*[F.struct(F.lit(i).alias("i"), quota(F.col("_total"), s).alias("q")) for i, s in enumerate(shares)])
    placed = running.withColumn("_c", F.explode(quotas))
    cut = placed.where("_c.q > _before and _c.q <= _upto").select(
        F.col("_label").alias("_l"), F.col("_cell").alias("_at"), F.col("_c.i").alias("_i"), (F.col("_c.q") - F.col("_before")).alias("_rank"))
    inside = rows.join(F.broadcast(cut), F.col("_label").eqNullSafe(F.col("_l")) & (F.col("_cell") == F.col("_at")))
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_label", "_i").orderBy("_place")))
    return ranked.where("_r = _rank").groupBy("_label").agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_place"))).alias(f"_cut_{i}") for i in range(len(shares))])


def stratified(df: DataFrame, parts: dict[str, float], rest: str = "train", key: str = "Booking_ID",
               label: Column | str = "No_Show", salt: str = "split") -> DataFrame:
    """``df`` with a column ``split``: the parts in order, then ``rest``."""
    label = F.col(label) if isinstance(label, str) else label
    running = [sum(list(parts.values())[:i + 1]) for i in range(len(parts))]
    table = cuts(df, running, key, label, salt)
    place = F.struct(F.coalesce(uniform(F.col(key), salt), F.lit(0.0)).alias("u"), F.col(key).alias("k"))
    split = F.coalesce(*[F.when(place <= F.col(f"_cut_{i}"), F.lit(name)) for i, name in enumerate(parts)], F.lit(rest))
    joined = df.withColumn("_of", label).join(F.broadcast(table), F.col("_of").eqNullSafe(F.col("_label")), "left")
    return joined.withColumn("split", split).drop("_of", *table.columns)


def stratified_sql(source: str, label: str, parts: dict[str, float], rest: str, draw: str, key: str = "Booking_ID") -> str:
    """DuckDB twin: every class ranked as a whole."""
    running = [sum(list(parts.values())[:i + 1]) for i in range(len(parts))]
    cases = " ".join(f"WHEN _r <= floor(_n * CAST({s} AS DOUBLE) + 0.5) THEN '{name}'" for name, s in zip(parts, running, strict=True))
    return (f"(SELECT * EXCLUDE (_r, _n), CASE {cases} ELSE '{rest}' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY {label} "
            f"ORDER BY {draw}, {key}) AS _r, count(*) OVER (PARTITION BY {label}) AS _n FROM {source}))")
