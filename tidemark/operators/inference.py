"""Conformal and multiple-testing decisions, survival, sampling, policy evaluation and sequential tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import mixture_boundary, safe_rate
from tidemark.operators.cumulative import cumulative, position


def conformal_quantile(df: DataFrame, score: str, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """The order statistic at zero-based index ceil(level * (n - 1)), level = min(1, ceil((n+1)(1-alpha)) / n).

    That is one above the textbook rank for small n, and kept so. Distinct scores
    are run up, so the quantile needs no global sort of rows.
    """
    by = list(by)
    ties = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("m"))
    total = ties.groupBy(*by).agg(F.sum("m").alias("n"))
    ran = cumulative(ties, score, ["m"], by=by)
    both = ran.join(F.broadcast(total), by) if by else ran.crossJoin(F.broadcast(total))
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"))
    # the guard keeps an index that is whole but for rounding
    index = F.ceil(level * (F.col("n") - 1) - 1e-9)
    return both.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("cum_m") > index, F.col(score))), F.lit(float("inf"))).alias("tau"), F.max("n").alias("n"))


def conformal_pvalues(null: DataFrame, test: DataFrame, key: str, score: str) -> DataFrame:
    """p = (1 + number of null scores at or above the row's) / (n + 1), by one run over distinct scores."""
    a = null.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("m"))
    scores = a.unionByName(test.select(F.col(score).alias("_s")).distinct().withColumn("m", F.lit(0).cast("long"))).groupBy("_s").agg(F.sum("m").alias("m"))
    ran = cumulative(scores, "_s", ["m"], descending=True)
    n = null.agg(F.count(score).alias("n"))
    return test.join(ran, F.col(score) == F.col("_s")).crossJoin(F.broadcast(n)).select(key, score, ((F.col("cum_m") + 1) / (F.col("n") + 1)).alias("p"))


def benjamini_hochberg(df: DataFrame, p: str, q: float) -> DataFrame:
    """Adds selected: p at or below the largest p_(k) <= k q / m."""
    ties = df.groupBy(p).agg(F.count(F.lit(1)).alias("m"))
    ran = cumulative(ties, p, ["m"])
    total = df.agg(F.count(p).alias("_n"))
    cut = ran.crossJoin(F.broadcast(total)).agg(F.max(F.when(F.col(p) <= F.col("cum_m") * q / F.col("_n"), F.col(p))).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("selected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def false_discovery(df: DataFrame, selected: str, y: str) -> DataFrame:
    """Realised false discovery proportion and power."""
    s, a = F.col(selected), F.col(y) == 1
    c = df.agg(F.count_if(s).alias("n"), F.count_if(s & ~a).alias("f"), F.count_if(s & a).alias("t"), F.count_if(a).alias("p"))
    return c.select((F.col("f") / F.greatest(F.col("n"), F.lit(1))).alias("fdp"), safe_rate(F.col("t"), F.col("p")).alias("power"), F.col("n").alias("selected"))


def conformal_shares(df: DataFrame, p: str, y: str, tau_benign: float, tau_attack: float) -> DataFrame:
    """Coverage and shares of one-class, both-class and empty prediction sets."""
    b, a = F.col(p) <= tau_benign, 1 - F.col(p) <= tau_attack
    mean = lambda c: F.avg(c.cast("double"))
    return df.agg(mean(F.when(F.col(y) == 1, a).otherwise(b)).alias("coverage"), mean(a & ~b).alias("alert"), mean(b & ~a).alias("clear"), mean(a & b).alias("both"), mean(~a & ~b).alias("empty"))


# --- survival -----------------------------------------------------------------------------------


def life_table(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct time: events, censored, at risk."""
    by = list(by)
    per = df.groupBy(*by, F.col(time).alias("time")).agg(F.sum(event).cast("long").alias("d"), F.sum(1 - F.col(event)).cast("long").alias("c"), F.count(F.lit(1)).alias("m"))
    ran = cumulative(per, "time", ["m"], descending=True, by=by)
    return ran.select(*by, "time", "d", "c", F.col("cum_m").alias("at_risk"))


def kaplan_meier(table: DataFrame, z: float = 1.96, by: Sequence[str] = ()) -> DataFrame:
    """Product-limit survival at event times, with Greenwood log-log bounds; 0 once all at risk have died.

    Times are distinct and few next to rows, so one window per group runs over
    the life table.
    """
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.max(F.when(F.col("d") == F.col("at_risk"), 1).otherwise(0)).over(w) == 1
    rate = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)
    var = F.when(F.col("d") < F.col("at_risk"), F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d")))).otherwise(0.0)
    s = F.when(gone, 0.0).otherwise(F.exp(F.sum(rate).over(w)))
    out = table.withColumn("survival", s).withColumn("_v", F.sum(var).over(w)).where("d > 0")
    inner = (F.col("survival") > 0) & (F.col("survival") < 1)
    theta = z * F.sqrt("_v") / F.log("survival")
    low, high = F.pow(F.col("survival"), F.exp(-theta)), F.pow(F.col("survival"), F.exp(theta))
    return out.withColumns({"low": F.when(inner, low).otherwise(F.col("survival")), "high": F.when(inner, high).otherwise(F.col("survival"))}).drop("_v")


def median_survival(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).cast("double"), F.lit(float("inf"))).alias("median"))


def restricted_mean(curve: DataFrame, horizon: float, by: Sequence[str] = ()) -> DataFrame:
    """Area under the survival steps up to the horizon."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("time")
    t = F.least(F.col("time").cast("double"), F.lit(float(horizon)))
    end = F.least(F.coalesce(F.lead("time").over(w).cast("double"), F.lit(float(horizon))), F.lit(float(horizon)))
    first = F.row_number().over(w) == 1
    area = F.col("survival") * (end - t) + F.when(first, t).otherwise(0.0)
    return curve.withColumn("_a", area).groupBy(*by).agg(F.sum("_a").alias("rmst"))


def logrank(df: DataFrame, time: str, event: str, group: str, a: str) -> DataFrame:
    """Two-group log-rank test: observed, expected and chi squared of group ``a`` against the rest, p by erfc."""
    per = df.groupBy(F.col(time).alias("time")).agg(
        F.sum(event).cast("long").alias("d"), F.count(F.lit(1)).alias("m"), F.sum(F.when(F.col(group) == a, F.col(event)).otherwise(0)).cast("long").alias("da"), F.count_if(F.col(group) == a).alias("ma")
    )
    ran = cumulative(per, "time", ["m", "ma"], descending=True)
    n, na, d = F.col("cum_m"), F.col("cum_ma"), F.col("d")
    var = F.when(n > 1, d * (na / n) * (1 - na / n) * (n - d) / (n - 1)).otherwise(0.0)
    sums = ran.where("d > 0").agg(F.sum(F.when(n > 1, F.col("da")).otherwise(0)).alias("observed"), F.sum(F.when(n > 1, d * na / n).otherwise(0.0)).alias("expected"), F.sum(var).alias("v"))
    chi = F.when(F.col("v") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("v")).otherwise(0.0)
    return sums.select("observed", "expected", chi.alias("chi2"))


# --- sampling and estimation --------------------------------------------------------------------


def horvitz_thompson(df: DataFrame, value: Column, probability: Column, eps: float = 1e-9) -> DataFrame:
    """Total from a Poisson sample: sum y / pi, variance sum y^2 (1 - pi) / pi^2, and the naive expansion."""
    pi = F.least(F.lit(1.0), F.greatest(F.lit(eps), probability))
    return df.agg(F.sum(value / pi).alias("total"), F.sum(F.pow(value, 2) * (1 - pi) / F.pow(pi, 2)).alias("variance"), (F.sum(value) / F.avg(pi)).alias("naive"))


def stratified_probabilities(df: DataFrame, stratum: str, budget: float, value: str | None = None) -> DataFrame:
    """Inclusion probability per stratum: proportional, or Neyman (n * sd) when a value is given; at most 1."""
    per = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop(value) if value else F.lit(1.0)).alias("sd"))
    whole = Window.partitionBy(F.lit(0))
    mass = F.col("n") * F.col("sd")
    share = F.when(F.sum(mass).over(whole) > 0, mass / F.sum(mass).over(whole)).otherwise(F.col("n") / F.sum("n").over(whole))
    return per.withColumn("probability", F.least(F.lit(1.0), budget * share / F.col("n")))


def greedy_topk(df: DataFrame, score: str, k: int) -> DataFrame:
    """Rows at or above the k-th largest score; ties are all in."""
    ties = df.groupBy(score).agg(F.count(F.lit(1)).alias("m"))
    ran = cumulative(ties, score, ["m"], descending=True)
    cut = ran.agg(F.min(F.when(F.col("cum_m") - F.col("m") < k, F.col(score))).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).where(F.col(score) >= F.col("_cut")).drop("_cut")


def ppi_mean(labelled: DataFrame, unlabelled: DataFrame, y: str, f: str, alpha: float = 0.05) -> DataFrame:
    """Prediction-powered mean and interval, with the classical and naive ones."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    a = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(f) - F.col(y)).alias("bias"), F.var_samp(F.col(f) - F.col(y)).alias("v"), F.avg(y).alias("mean_y"), F.var_samp(y).alias("v_y"))
    b = unlabelled.agg(F.count(F.lit(1)).alias("m"), F.avg(f).alias("mean_f"), F.var_samp(f).alias("v_f"))
    half = z * F.sqrt(F.col("v_f") / F.col("m") + F.col("v") / F.col("n"))
    point = F.col("mean_f") - F.col("bias")
    empty = F.col("n") == 0
    inf = float("inf")
    return a.crossJoin(b).select(
        F.when(empty, float("nan")).otherwise(point).alias("ppi"), F.when(empty, -inf).otherwise(point - half).alias("ppi_low"), F.when(empty, inf).otherwise(point + half).alias("ppi_high"),
        F.col("mean_y").alias("classical"), (z * F.sqrt(F.col("v_y") / F.col("n"))).alias("classical_half"), F.col("mean_f").alias("naive"), F.when(F.col("v") > 0, F.col("v_y") / F.col("v")).otherwise(inf).alias("gain"),
    )


def importance_weights(action: Column, logged: Column, target: Column) -> Column:
    """Target over logged propensity of the taken action; 0 for an impossible target, +inf for an impossible log."""
    num = F.when(action == 1, target).otherwise(1 - target)
    den = F.when(action == 1, logged).otherwise(1 - logged)
    return F.when(num == 0, 0.0).when(den == 0, float("inf")).otherwise(num / den)


def policy_values(df: DataFrame, action: str, reward: str, weight: str, target: str, reward_hat: str) -> DataFrame:
    """IPS, self-normalised IPS, direct and doubly robust values, and effective sample size."""
    w = F.when(F.col(weight) < float("inf"), F.col(weight)).otherwise(0.0)
    a, r, p, rh = (F.col(c) for c in (action, reward, target, reward_hat))
    return df.agg(
        F.avg(w * r).alias("ips"), safe_rate(F.sum(w * r), F.sum(w)).alias("snips"), F.avg(p * rh).alias("dm"), F.avg(p * rh + w * a * (r - rh)).alias("dr"), safe_rate(F.pow(F.sum(w), 2), F.sum(w * w)).alias("ess")
    )


def support_violation(df: DataFrame, logged: str, target: str) -> DataFrame:
    """Of rows the target may act on, the share that the log never could."""
    return df.agg(F.coalesce(F.avg(F.when(F.col(target) > 0, (F.col(logged) <= 0).cast("double"))), F.lit(0.0)).alias("violation"))


def risk_coverage(df: DataFrame, uncertainty: str, error: str, key: str, coverages: Sequence[float]) -> DataFrame:
    """Error rate of the k = max(round(c n), 1) least uncertain rows, by uncertainty then key."""
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    ran = position(df.select(uncertainty, key, F.col(error).cast("double").alias("_e")), [uncertainty, key], name="_k").crossJoin(F.broadcast(size))
    rows = {float(c): F.greatest(F.rint(F.lit(float(c)) * F.col("_n")), F.lit(1.0)).cast("long") for c in coverages}
    sums = ran.agg(*[F.sum(F.when(F.col("_k") <= k, F.col("_e"))).alias(f"e{i}") for i, k in enumerate(rows.values())], F.max("_n").alias("_n"))
    found = F.array(*[F.struct(F.lit(c).alias("coverage"), k.alias("rows"), (F.col(f"e{i}") / k).alias("risk")) for i, (c, k) in enumerate(rows.items())])
    return sums.where("_n > 0").select(F.inline(found))


def crc_threshold(risks: DataFrame, n: int, alpha: float, bound: float = 1.0) -> DataFrame:
    """Largest threshold whose corrected risk (n r + B) / (n + 1) is within alpha; else the first of the grid."""
    ok = (n * F.col("risk") + bound) / (n + 1) <= alpha
    return risks.agg(F.coalesce(F.max(F.when(ok, F.col("threshold"))), F.min("threshold")).alias("threshold"))


def np_admissible_count(n: int, alpha: float, delta: float) -> int | None:
    """Largest m with P(Bin(n, alpha) <= m) <= delta, in log space; None if there is none."""
    total, best = 0.0, None
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * math.log(alpha) + (n - m) * math.log1p(-alpha))
        if total > delta:
            break
        best = m
    return best


def threshold_from_count(df: DataFrame, score: str, m: int | None) -> DataFrame:
    """The (m + 1)-th largest score: a strict comparison lets m rows through. Without an admissible m (null), infinite."""
    if m is None:
        return df.agg(F.lit(float("inf")).alias("threshold"))
    ties = df.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("m"))
    ran = cumulative(ties, "score", ["m"], descending=True)
    return ran.agg(F.max(F.when(F.col("cum_m") > m, F.col("score"))).alias("threshold"))


def mean_excess(df: DataFrame, score: str, thresholds: DataFrame) -> DataFrame:
    """Mean of score - u over scores above each u (column threshold); rows are counted per distinct score first."""
    ties = df.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    over = ties.crossJoin(F.broadcast(thresholds)).where(F.col("_s") > F.col("threshold"))
    return over.groupBy("threshold").agg((F.sum((F.col("_s") - F.col("threshold")) * F.col("_n")) / F.sum("_n")).alias("mean_excess"), F.sum("_n").alias("n"))


# --- sequential tests, by stream ----------------------------------------------------------------


def confidence_sequence(df: DataFrame, by: Sequence[str], order: Sequence[str], diff: str, rho: float, alpha: float, sigma: float) -> DataFrame:
    """Running mean of differences with an anytime-valid mixture boundary; adds n, mean, low, high."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.row_number().over(w).cast("double")
    mean = F.avg(diff).over(w.rowsBetween(Window.unboundedPreceding, 0))
    half = sigma * mixture_boundary(n, rho, alpha) / n
    return df.withColumns({"n": n.cast("long"), "mean": mean, "low": mean - half, "high": mean + half})


def first_conclusive(sequence: DataFrame, by: Sequence[str]) -> DataFrame:
    """First step whose interval leaves out 0; 0 if none."""
    return sequence.groupBy(*by).agg(F.coalesce(F.min(F.when((F.col("low") > 0) | (F.col("high") < 0), F.col("n"))), F.lit(0)).alias("first"))


def sprt(df: DataFrame, by: Sequence[str], order: Sequence[str], increment: Column, upper: float, lower: float) -> DataFrame:
    """First crossing of Wald's boundaries per stream: decision (attack, benign, open) and its step."""
    w = Window.partitionBy(*by).orderBy(*order)
    ran = df.withColumns({"_n": F.row_number().over(w), "_s": F.sum(increment).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    crossed = (F.col("_s") >= upper) | (F.col("_s") <= lower)
    first = F.min(F.when(crossed, F.struct(F.col("_n").alias("n"), F.col("_s").alias("s"))))
    out = ran.groupBy(*by).agg(first.alias("f"), F.count(F.lit(1)).alias("steps"))
    decision = F.when(F.col("f").isNull(), "open").when(F.col("f.s") >= upper, "attack").otherwise("benign")
    return out.select(*by, decision.alias("decision"), F.coalesce(F.col("f.n").cast("long"), F.col("steps")).alias("steps"))


def rolling_rate(df: DataFrame, by: Sequence[str], order: Sequence[str], event: str, window: int) -> DataFrame:
    """Trailing mean over at most ``window`` rows; adds rate."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window - 1), 0)
    return df.withColumn("rate", F.avg(F.col(event).cast("double")).over(w))


#: Long window, short window (rows), burn rate: the usual multi-window alert policies (fixed values, hours).
BURN_POLICIES = ((1.0, 1 / 12, 14.4), (6.0, 0.5, 6.0), (24.0, 2.0, 3.0), (72.0, 6.0, 1.0))


def first_firing(df: DataFrame, by: Sequence[str], order: Sequence[str], bad: str, budget: float, long: int, short: int, burn: float) -> DataFrame:
    """First row, after a full long window, where long and short bad rates reach burn * budget; null if none."""
    base = Window.partitionBy(*by).orderBy(*order)
    rate = lambda n: F.avg(F.col(bad).cast("double")).over(base.rowsBetween(-(n - 1), 0))
    n = F.row_number().over(base)
    fires = (n >= long) & (rate(long) >= burn * budget) & (rate(short) >= burn * budget)
    return df.withColumn("_n", F.when(fires, n)).groupBy(*by).agg(F.min("_n").alias("first_firing"))


def power_martingale(df: DataFrame, by: Sequence[str], order: Sequence[str], p: str, epsilons: Sequence[float]) -> DataFrame:
    """Log of the mean over epsilon of prod eps * p^(eps - 1); adds log_m."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    logs = [F.sum(F.log(F.lit(float(e))) + (e - 1) * F.log(F.greatest(F.col(p), F.lit(1e-12)))).over(w) for e in epsilons]
    top = F.greatest(*logs)
    return df.withColumn("log_m", top + F.log(sum((F.exp(x - top) for x in logs), F.lit(0.0)) / len(logs)))
