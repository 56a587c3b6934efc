"""Mergeable summaries: frequency, distinct, quantile and sampling sketches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import mix32
from tidemark.operators.cumulative import cumulative

PRIME = (1 << 31) - 1


def count_min_size(epsilon: float, delta: float) -> tuple[int, int]:
    """Width and depth for an overestimate of epsilon * n with probability 1 - delta."""
    return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))


def _row_hash(key: Column, row: int, width: int) -> Column:
    """A universal hash any SQL engine repeats: ((a x + b) mod p) mod w."""
    a, b = 48271 + 7919 * row, 69621 + 104729 * row
    return F.pmod(F.pmod(F.pmod(key, F.lit(PRIME)) * a + b, F.lit(PRIME)), F.lit(width)).cast("int")


def count_min(df: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    """The counters of a Count-Min sketch: row, cell, n. Sketches add cell by cell."""
    cells = F.array(*[F.struct(F.lit(r).alias("row"), _row_hash(F.col(key), r, width).alias("cell")) for r in range(depth)])
    return df.select(F.inline(cells)).groupBy("row", "cell").agg(F.count(F.lit(1)).alias("n"))


def count_min_query(sketch: DataFrame, keys: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    """Estimates for keys: the smallest of their cells. The sketch has width * depth rows and is broadcast."""
    cells = F.array(*[F.struct(F.lit(r).alias("row"), _row_hash(F.col(key), r, width).alias("cell")) for r in range(depth)])
    at = keys.select(key, F.inline(cells))
    return at.join(F.broadcast(sketch), ["row", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def registers(df: DataFrame, key: str, precision: int) -> DataFrame:
    """HyperLogLog registers: register, rank (largest leading-zero rank). Sketches merge by maximum."""
    h = F.xxhash64(key)
    rest = F.shiftrightunsigned(h, precision)
    rank = F.when(rest == 0, 64 - precision + 1).otherwise(64 - precision - F.floor(F.log2(rest.cast("double"))).cast("int"))
    return df.groupBy(F.pmod(h, F.lit(1 << precision)).cast("int").alias("register")).agg(F.max(rank).alias("rank"))


def cardinality(regs: DataFrame, precision: int) -> DataFrame:
    """The HyperLogLog estimate, with linear counting for small sets."""
    m = 1 << precision
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = regs.agg(F.count(F.lit(1)).alias("used"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"))
    raw = alpha * m * m / (F.col("s") + (m - F.col("used")))
    small = m * F.log(m / F.greatest(m - F.col("used"), F.lit(1)).cast("double"))
    return sums.select(F.when((raw <= 2.5 * m) & (F.col("used") < m), small).otherwise(raw).alias("estimate"))


def heavy_hitters(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys with more than a share of all rows, exactly (partial counts before the shuffle)."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))).where(F.col("n") > share * F.col("_all")).drop("_all")


def approx_heavy_hitters(df: DataFrame, key: str, k: int, tracked: int = 1000) -> DataFrame:
    """The k most frequent keys by a bounded summary."""
    return df.agg(F.expr(f"approx_top_k({key}, {k}, {tracked})").alias("t")).select(F.inline("t"))


def reservoir(df: DataFrame, key: str, size: int, seed: int = 7) -> DataFrame:
    """A uniform sample of fixed size that repeats exactly: the rows whose key hashes smallest."""
    return df.orderBy(mix32(F.col(key) + seed), key).limit(size)


def histogram_quantile(df: DataFrame, value: str, low: float, high: float, bins: int, level: float) -> DataFrame:
    """A quantile from fixed equal bins, interpolated inside the bin."""
    width = (high - low) / bins
    place = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    h = df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ran = h.withColumns({"cum": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    target = level * F.col("all")
    at = ran.where(F.col("cum") >= target).agg(F.min(F.struct("bin", "n", "cum", "all")).alias("b"))
    b = F.col("b")
    return at.select((low + width * (b["bin"] + (level * b["all"] - (b["cum"] - b["n"])) / b["n"])).alias("quantile"))


def exact_quantile(df: DataFrame, value: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """The order statistic at ceil(level * n), by a running count of distinct values."""
    ties = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))
    total = ties.groupBy(*by).agg(F.sum("m").alias("n"))
    ran = cumulative(ties, value, ["m"], by=by)
    both = ran.join(F.broadcast(total), list(by)) if by else ran.crossJoin(F.broadcast(total))
    return both.groupBy(*by).agg(F.min(F.when(F.col("cum_m") >= F.ceil(level * F.col("n")), F.col(value))).alias("quantile"))


def kll_quantile(df: DataFrame, value: str, level: float) -> DataFrame:
    """A quantile from a mergeable KLL sketch (approximate)."""
    return df.agg(F.expr(f"kll_sketch_get_quantile_double(kll_sketch_agg_double({value}), {level}D)").alias("quantile"))
