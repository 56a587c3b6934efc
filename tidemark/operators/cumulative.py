"""Running sums over a whole table without one task that sorts it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the key that are summed apart; the running sum over ranges has so many rows at most.
RANGES = 256
#: Accuracy of the quantiles that cut them.
ACCURACY = 4 * RANGES


def ranged(df: DataFrame, key: str, by: Sequence[str] = (), name: str = "_range") -> DataFrame:
    """Add the number (0 to ``RANGES`` - 1) of the quantile range of ``key`` within ``by`` that a row falls in.

    Edges are approximate quantiles, so the ranges hold alike many rows whatever
    the spread of the key; a key that many rows share is in one range. They are
    found by halving, in eight comparisons. A table of one row is broadcast
    where there is no group; with groups the planner chooses by size.
    """
    by = list(by)
    cuts = df.groupBy(*by).agg(F.percentile_approx(key, [k / RANGES for k in range(1, RANGES)], ACCURACY).alias("_edges"))
    out = df.join(cuts, by) if by else df.crossJoin(F.broadcast(cuts))
    out, step = out.withColumn(name, F.lit(0)), RANGES // 2
    while step:
        above = F.get("_edges", F.col(name) + (step - 1)) < F.col(key)
        out, step = out.withColumn(name, F.col(name) + F.when(above, step).otherwise(0)), step // 2
    return out.drop("_edges")


def cumulative(df: DataFrame, key: str, sums: Sequence[str], descending: bool = False, by: Sequence[str] = (), prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<s>``: the sum of ``s`` over all rows of the group up to this key, inclusive.

    Keys should be distinct within ``by`` (aggregate ties first). Sums per
    quantile range of the key are run up in a window of at most ``RANGES`` rows,
    and each range is run up by itself. No task holds more than a range.
    """
    by = list(by)
    placed = ranged(df, key, by)
    order: Column = F.col("_range").desc() if descending else F.col("_range").asc()
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_n_{s}") for s in sums])
    offsets = per.select(*by, "_range", *[F.coalesce(F.sum(f"_n_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inner = Window.partitionBy(*by, "_range").orderBy(F.col(key).desc() if descending else F.col(key).asc()).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(offsets, [*by, "_range"])
    out = out.withColumns({f"{prefix}{s}": F.col(f"_o_{s}") + F.sum(s).over(inner) for s in sums})
    return out.drop("_range", *[f"_o_{s}" for s in sums])


def position(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Add each row's place (from 1) in the order of the columns ``order``, the first of them a number.

    Rows are ranked within quantile ranges of the first column, after the counts
    of the ranges before; null comes first. Ties in all columns take any order.
    """
    by = list(by)
    placed = ranged(df, order[0], by).withColumn("_range", F.when(F.col(order[0]).isNull(), -1).otherwise(F.col("_range")))
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    per = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per.select(*by, "_range", F.coalesce(F.sum("_n").over(window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return placed.join(offsets, [*by, "_range"]).withColumn(name, F.col("_o") + within).drop("_range", "_o")
