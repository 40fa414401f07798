"""Exact order statistics of many groups at once, by narrowing value ranges.

The first pass takes each group's count, least and greatest value. A wanted
rank then lies in a cell, a range of values of one group with a known number of
rows below it. While a cell holds more than ``CELL`` rows, a pass cuts it into
``BINS`` ranges, counts its rows in each (map-side combined, least and greatest
value kept), and the range that holds the rank becomes the new cell. Small cells
are read by one last pass that counts their distinct values. The number of
passes grows with the logarithm of the rows; of the rows themselves nothing is
sorted, written or joined through a shuffle: cells are a small table, one row a
group, that is broadcast (``GROUPS`` rows at most, else joined as it comes).

Nulls of the value are left out. A null group is a group like any other, NaN is
above all numbers, and -0.0 is 0.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equigroup.session import gathered, materialize

BINS, CELL, GROUPS = 1024, 10_000, 100_000


def _bin():
    """Bin of ``_v`` in the cell ``c``: monotone in the value, and the cell's
    ends have bins of their own, so that every pass narrows (halves keep the
    differences finite; an infinite end leaves its neighbours in one bin)."""
    half = F.col("c.lo") / 2
    share = (F.col("_v") / 2 - half) / (F.col("c.hi") / 2 - half)
    inner = F.least(F.lit(BINS - 2), F.greatest(F.lit(1), F.floor(F.nanvl(share, F.lit(0.0)) * BINS)))
    return F.when(F.col("_v") <= F.col("c.lo"), 0).when(F.col("_v") >= F.col("c.hi"), BINS - 1).otherwise(inner).cast("int")


def _in_cells(rows: DataFrame, cells: DataFrame, groups: int) -> DataFrame:
    """(_g, _v, c): the rows inside a cell, each with its cell. Cells of a group
    are disjoint or the same."""
    per_group = cells.groupBy("_g").agg(F.collect_set(F.struct("lo", "hi")).alias("_cells"))
    small = F.broadcast(per_group) if groups <= GROUPS else per_group
    return (rows.join(small, "_g")
            .select("_g", "_v", F.explode(F.filter("_cells", lambda c: F.col("_v").between(c["lo"], c["hi"]))).alias("c")))


def _holding_rank(cells: DataFrame, parts: DataFrame, order: str) -> DataFrame:
    """The part of each cell that holds its rank; ``below`` counts the rows under the part."""
    w = Window.partitionBy("_g", "lo", "hi").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.withColumn("_under", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return (cells.select("_g", "lo", "hi", "rank", "below").join(counted, ["_g", "lo", "hi"])
            .withColumn("below", F.col("below") + F.col("_under"))
            .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n"))))


def order_statistics(rows: DataFrame, wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """(_g, rank, value) for the 0-based ranks in ``wanted`` (_g, rank) of rows
    (_g, _v); ``stats`` is (_g, n, lo, hi) by group."""
    groups = stats.count()
    cells = materialize(gathered(wanted.distinct().join(stats, "_g").withColumn("below", F.lit(0).cast("long"))
                                 .select("_g", "rank", "below", "n", "lo", "hi")))
    while True:
        wide = cells.where((F.col("n") > CELL) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        parts = (_in_cells(rows, wide, groups).groupBy("_g", F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"), _bin().alias("bin"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most")))
        narrowed = (_holding_rank(wide, parts, "bin")
                    .select("_g", "rank", "below", "n", F.col("least").alias("lo"), F.col("most").alias("hi")))
        rest = cells.where((F.col("n") <= CELL) | (F.col("lo") >= F.col("hi")))
        cells = materialize(gathered(rest.unionByName(narrowed)))
    single = cells.where(F.col("lo") >= F.col("hi")).select("_g", "rank", F.col("lo").alias("value"))
    small = cells.where(F.col("lo") < F.col("hi"))
    values = (_in_cells(rows, small, groups).groupBy("_g", F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"), F.col("_v").alias("v"))
              .agg(F.count(F.lit(1)).alias("n")))
    return single.unionByName(_holding_rank(small, values, "v").select("_g", "rank", F.col("v").alias("value")))


def percentiles(df: DataFrame, group_cols: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact linear-interpolation percentiles per group: (group..., q, value).
    A group without any value gives no row."""
    g = list(group_cols)
    rows = df.select(F.struct(F.lit(0).alias("_"), *g).alias("_g"), (F.col(value).cast("double") + F.lit(0.0)).alias("_v")) \
        .where(F.col("_v").isNotNull())
    stats = materialize(gathered(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))))
    h = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("n") - 1)).alias("h")) for q in qs]))
    want = stats.select("_g", h.alias("w")).select("_g", "w.q", "w.h", F.floor("w.h").alias("r_lo"), F.ceil("w.h").alias("r_hi"))
    ranks = want.select("_g", F.col("r_lo").alias("rank")).unionByName(want.select("_g", F.col("r_hi").alias("rank")))
    found = materialize(gathered(order_statistics(rows, ranks, stats)))
    lo = found.select("_g", F.col("rank").alias("r_lo"), F.col("value").alias("v_lo"))
    hi = found.select("_g", F.col("rank").alias("r_hi"), F.col("value").alias("v_hi"))
    between = F.when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo")).otherwise(
        F.col("v_lo") + (F.col("h") - F.col("r_lo")) * (F.col("v_hi") - F.col("v_lo")))
    return (want.join(lo, ["_g", "r_lo"]).join(hi, ["_g", "r_hi"])
            .select(*[F.col("_g").getField(c).alias(c) for c in g], "q", between.alias("value")))
