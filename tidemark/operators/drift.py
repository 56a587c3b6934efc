"""Drift and change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import mix32
from tidemark.operators.cumulative import cumulative, position


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form: feature, value; nulls and non-finite values are left out."""
    long = df.unpivot(list(keep), [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def quantile_edges(reference: DataFrame, bins: int) -> DataFrame:
    """feature, edges: distinct interior quantiles of the reference (linear interpolation), rising."""
    levels = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    return reference.groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile("value", levels))).alias("edges"))


def bin_shares(long: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """feature, bin, share, n: half-open bins [edge, next). Edges are one row a feature and are broadcast."""
    place = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    counted = long.join(F.broadcast(edges), "feature").groupBy("feature", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feature")))


def psi(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index per feature over the reference's quantile bins, with its class.

    Both sides are read in long form; edges and shares are one small row per
    feature and bin.
    """
    ref, cur = unpivot(reference, columns), unpivot(current, columns)
    edges = quantile_edges(ref, bins)
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    both = grid.join(bin_shares(ref, edges, bins).select("feature", "bin", F.col("share").alias("r")), ["feature", "bin"], "left")
    both = both.join(bin_shares(cur, edges, bins).select("feature", "bin", F.col("share").alias("c")), ["feature", "bin"], "left")
    r, c = (F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(eps)) for x in "rc")
    out = both.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
    return out.withColumn("drift", F.when(F.col("psi") >= 0.25, "major").when(F.col("psi") >= 0.1, "moderate").otherwise("none"))


def ks(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature, by running both distributions over distinct values."""
    long = unpivot(reference, columns).withColumn("a", F.lit(1)).unionByName(unpivot(current, columns).withColumn("a", F.lit(0)))
    ties = long.groupBy("feature", "value").agg(F.sum("a").cast("long").alias("ra"), F.sum(1 - F.col("a")).cast("long").alias("cb"))
    ran = cumulative(ties, "value", ["ra", "cb"], by=["feature"])
    total = ties.groupBy("feature").agg(F.sum("ra").alias("n"), F.sum("cb").alias("m")).where("n > 0 and m > 0")
    gap = F.abs(F.col("cum_ra") / F.col("n") - F.col("cum_cb") / F.col("m"))
    return ran.join(F.broadcast(total), "feature").groupBy("feature").agg(F.max(gap).alias("ks"), F.max("n").alias("n"), F.max("m").alias("m"))


def page_hinkley(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, delta: float, lam: float) -> DataFrame:
    """First step per stream where the cumulative deviation exceeds its running minimum by more than ``lam``; null if none."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ran = df.withColumn("_x", value).withColumns({"_n": F.row_number().over(Window.partitionBy(*by).orderBy(*order)), "_d": F.col("_x") - F.avg("_x").over(w) - delta})
    ran = ran.withColumn("_m", F.sum("_d").over(w)).withColumn("_low", F.least(F.lit(0.0), F.min("_m").over(w)))
    return ran.groupBy(*by).agg(F.min(F.when(F.col("_m") - F.col("_low") > lam, F.col("_n"))).alias("alarm"))


def ddm(df: DataFrame, by: Sequence[str], order: Sequence[str], error: Column, min_samples: int = 30, warn: float = 2.0, drift: float = 3.0) -> DataFrame:
    """Drift detection on an error stream: first drift, and first warning before it.

    Level p + s against the best (smallest) level so far, armed once there are
    ``min_samples`` rows and p > 0; the first row that attains the minimum counts.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ran = df.withColumn("_e", error.cast("double")).withColumns({"_n": n, "_p": F.avg("_e").over(w)})
    ran = ran.withColumn("_s", F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col("_n")))
    armed = (F.col("_n") >= min_samples) & (F.col("_p") > 0)
    level = F.when(armed, F.struct((F.col("_p") + F.col("_s")).alias("l"), F.col("_n").alias("n"), F.col("_p").alias("p"), F.col("_s").alias("s")))
    ran = ran.withColumn("_b", F.min(level).over(w))
    over = lambda k: armed & (F.col("_p") + F.col("_s") > F.col("_b.p") + k * F.col("_b.s"))
    out = ran.groupBy(*by).agg(F.min(F.when(over(drift), F.col("_n"))).alias("drift"), F.min(F.when(over(warn), F.col("_n"))).alias("warning"))
    return out.withColumn("warning", F.when(F.col("drift").isNull() | (F.col("warning") < F.col("drift")), F.col("warning")))


def batch_volumes(df: DataFrame, batch: str, alert: Column) -> DataFrame:
    return df.groupBy(batch).agg(F.count_if(alert).alias("volume"), F.count(F.lit(1)).alias("n"))


def control_summary(volumes: DataFrame, order: str, setpoint: float, tolerance: float, tail: int) -> DataFrame:
    """Overshoot, settling batch, steady-state error and oscillation of an alert volume (one row per batch)."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    back = Window.partitionBy(F.lit(0)).orderBy(F.desc(order))
    out = F.abs(F.col("volume") - setpoint) > tolerance * setpoint
    ran = volumes.withColumns({"_i": F.row_number().over(w) - 1, "_j": F.row_number().over(back), "_step": F.abs(F.col("volume") - F.lag("volume").over(w)), "_out": out})
    last = F.max(F.when(F.col("_out"), F.col("_i")))
    return ran.agg(
        F.greatest(F.lit(0.0), (F.max("volume") - setpoint) / setpoint).alias("overshoot"), (F.coalesce(last, F.lit(-1)) + 1).alias("settled_at"),
        F.coalesce((F.avg(F.when(F.col("_j") <= tail, F.col("volume"))) - setpoint) / setpoint, F.lit(0.0)).alias("steady_error"), F.avg("_step").alias("oscillation"),
    )


def linear_time_mmd(x: DataFrame, y: DataFrame, key: str, value: str, gamma: float) -> DataFrame:
    """Linear-time MMD: pairs of rows by hash order, mean of k(x1,x2) + k(y1,y2) - k(x1,y2) - k(x2,y1)."""

    def pairs(df: DataFrame, name: str) -> DataFrame:
        keyed = df.select(mix32(F.col(key)).alias("_h"), F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
        at = position(keyed, ["_h", "_k"], name="_i").withColumn("_i", F.col("_i") - 1)
        return at.groupBy(F.floor(F.col("_i") / 2).alias("pair")).agg(F.max(F.when(F.col("_i") % 2 == 0, F.col("_v"))).alias(f"{name}1"), F.max(F.when(F.col("_i") % 2 == 1, F.col("_v"))).alias(f"{name}2")).where(F.col(f"{name}2").isNotNull())

    k = lambda a, b: F.exp(-gamma * F.pow(F.col(a) - F.col(b), 2))
    h = k("x1", "x2") + k("y1", "y2") - k("x1", "y2") - k("x2", "y1")
    return pairs(x, "x").join(pairs(y, "y"), "pair").select(h.alias("h")).agg(F.avg("h").alias("mmd2"), (F.avg("h") / (F.stddev_samp("h") / F.sqrt(F.count("h")))).alias("z"), F.count("h").alias("pairs"))


def covariate_weights(df: DataFrame, weight: str, group: str) -> DataFrame:
    """Mean weight and Kish effective sample size per group."""
    return df.groupBy(group).agg(F.avg(weight).alias("mean_weight"), (F.pow(F.sum(weight), 2) / F.sum(F.pow(weight, 2))).alias("ess"))
