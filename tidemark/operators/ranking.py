"""Threshold, ranking and calibration metrics from a score and a 0/1 label."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import bayes_precision, cost_per_flow, mix32, safe_rate
from tidemark.operators.cumulative import cumulative


def roc_frame(df: DataFrame, score: str = "score", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: counts, running counts from the top, totals, TPR, FPR, precision."""
    by = list(by)
    ties = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    totals = ties.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    ran = cumulative(ties, "score", ["pos", "neg"], descending=True, by=by).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    joined = ran.join(F.broadcast(totals), by) if by else ran.crossJoin(F.broadcast(totals))
    return joined.withColumns({"tpr": safe_rate(F.col("tp"), F.col("n_pos")), "fpr": safe_rate(F.col("fp"), F.col("n_neg")), "precision": safe_rate(F.col("tp"), F.col("tp") + F.col("fp"))})


def threshold_at_fpr(roc: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """The lowest score whose FPR is within ``target``; +inf if none is, with TPR and FPR there."""
    ok = F.col("fpr") <= target
    return roc.groupBy(*by).agg(
        F.coalesce(F.min(F.when(ok, F.col("score"))), F.lit(float("inf"))).alias("threshold"),
        F.coalesce(F.max(F.when(ok, F.col("tpr"))), F.lit(0.0)).alias("tpr"),
        F.coalesce(F.max(F.when(ok, F.col("fpr"))), F.lit(0.0)).alias("fpr"),
    )


def average_precision(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step sum of precision over recall gains; 0 without positives."""
    return roc.groupBy(*by).agg(F.coalesce(F.sum(safe_rate(F.col("pos"), F.col("n_pos")) * F.col("precision")), F.lit(0.0)).alias("average_precision"))


def roc_auc(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mid-rank AUC; null when a class is absent."""
    won = F.col("pos") * ((F.col("n_neg") - F.col("fp")) + F.col("neg") / 2.0)
    return roc.groupBy(*by).agg((F.sum(won) / F.when(F.max("n_pos") * F.max("n_neg") > 0, F.max("n_pos") * F.max("n_neg"))).alias("roc_auc"))


def membership_advantage(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest TPR - FPR over all thresholds, at least 0."""
    return roc.groupBy(*by).agg(F.greatest(F.lit(0.0), F.max(F.col("tpr") - F.col("fpr"))).alias("advantage"))


def rates_at_threshold(df: DataFrame, threshold: Column | float, score: str = "score", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, TN, TPR, FPR and precision with score >= threshold; 0/0 is 0."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn")
    )
    return counts.withColumns({"tpr": safe_rate(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": safe_rate(F.col("fp"), F.col("fp") + F.col("tn")), "precision": safe_rate(F.col("tp"), F.col("tp") + F.col("fp"))})


def rates_above(df: DataFrame, threshold: float, score: str = "score", label: str = "y") -> DataFrame:
    """TPR and FPR with a strict comparison."""
    over = (F.col(score) > threshold).cast("double")
    return df.agg(F.avg(F.when(F.col(label) == 1, over)).alias("tpr"), F.avg(F.when(F.col(label) == 0, over)).alias("fpr"))


def confusion(df: DataFrame, true: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """Counts per true label, one column per predicted label."""
    return df.groupBy(F.col(true).alias("true_label")).pivot(pred, list(labels)).count().na.fill(0)


def class_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each label; a label without predictions or rows has 0."""
    actual = df.groupBy(F.col(true).alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(true) == F.col(pred)).alias("hit"))
    said = df.groupBy(F.col(pred).alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    both = actual.join(said, "label", "full").na.fill(0, ["support", "hit", "predicted"])
    out = both.withColumns({"precision": safe_rate(F.col("hit"), F.col("predicted")), "recall": safe_rate(F.col("hit"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", safe_rate(2 * p * r, p + r)).drop("hit", "predicted")


def macro_report(report: DataFrame) -> DataFrame:
    """Macro and support-weighted F1 of :func:`class_report`."""
    return report.agg(F.avg("f1").alias("macro_f1"), safe_rate(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def class_detection(df: DataFrame, threshold: float, benign: str, label: str = "label", score: str = "score") -> DataFrame:
    """Recall at a threshold of each class but the benign one."""
    return df.where(F.col(label) != benign).groupBy(label).agg(F.count(F.lit(1)).alias("support"), F.avg((F.col(score) >= threshold).cast("double")).alias("detection"))


def campaign_outcomes(df: DataFrame, threshold: float, benign: str, day: str, order: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Per day and attack class: flows, alerts, place of the first alert in stream order (null if silent)."""
    place = F.row_number().over(Window.partitionBy(day, label).orderBy(*order))
    alert = F.col(score) >= threshold
    held = df.where(F.col(label) != benign).withColumn("_place", place)
    return held.groupBy(day, label).agg(F.count(F.lit(1)).alias("flows"), F.count_if(alert).alias("alerts"), F.min(F.when(alert, F.col("_place"))).alias("first_alert"))


def service_slices(df: DataFrame, threshold: float, service: str, min_support: int, score: str = "score", label: str = "y") -> DataFrame:
    """Per service: counts, TPR and FPR (NaN where that side is empty), share of all false alerts."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    per = df.groupBy(service).agg(F.count_if(~y).alias("benign"), F.count_if(y).alias("attacks"), F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"))
    total = F.sum("fp").over(Window.partitionBy(F.lit(0)))
    out = per.withColumn("false_alert_share", safe_rate(F.col("fp"), total))
    nan = F.lit(float("nan"))
    out = out.withColumns({"tpr": F.coalesce(safe_rate(F.col("tp"), F.col("attacks"), None), nan), "fpr": F.coalesce(safe_rate(F.col("fp"), F.col("benign"), None), nan)})
    return out.where(F.col("benign") + F.col("attacks") >= min_support)


def reliability(df: DataFrame, bins: int, prob: str = "score", label: str = "y") -> DataFrame:
    """Equal-width bins of the clipped probability: mean confidence, observed rate, count."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(prob)))
    place = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(F.avg(p).alias("confidence"), F.avg(F.col(label).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


def calibration_summary(df: DataFrame, bins: int, prob: str = "score", label: str = "y") -> DataFrame:
    """Expected and maximum calibration error, Brier score."""
    gap = F.abs(F.col("confidence") - F.col("observed"))
    errors = reliability(df, bins, prob, label).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    return errors.crossJoin(F.broadcast(df.agg(F.avg(F.pow(F.col(prob) - F.col(label), 2)).alias("brier"))))


def cost_curve(df: DataFrame, thresholds: DataFrame, prior: float, alert: float, miss: float, score: str = "score", label: str = "y") -> DataFrame:
    """Expected cost per flow at each row of ``thresholds`` (threshold), reweighted to a base rate.

    Rows are first counted per distinct score, so only tie groups meet the grid.
    """
    ties = df.groupBy(F.col(score).alias("_s")).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_q"))
    over = lambda c: F.sum(F.when(F.col("_s") >= F.col("threshold"), F.col(c)).otherwise(0))
    sums = ties.crossJoin(F.broadcast(thresholds)).groupBy("threshold").agg(over("_p").alias("tp"), over("_q").alias("fp"), F.sum("_p").alias("p"), F.sum("_q").alias("q"))
    rates = sums.withColumns({"tpr": safe_rate(F.col("tp"), F.col("p")), "fpr": safe_rate(F.col("fp"), F.col("q"))})
    return rates.withColumn("cost", cost_per_flow(F.col("tpr"), F.col("fpr"), F.lit(prior), alert, miss)).select("threshold", "tpr", "fpr", "cost")


def quantile_grid(df: DataFrame, points: int, score: str = "score") -> DataFrame:
    """Distinct thresholds at equally spaced quantiles (linear interpolation)."""
    levels = F.array(*[F.lit(k / (points - 1)) for k in range(points)])
    return df.agg(F.percentile(score, levels).alias("q")).select(F.explode(F.array_distinct("q")).alias("threshold"))


def cost_optimal(curve: DataFrame) -> DataFrame:
    """The cheapest threshold; the lowest of ties."""
    return curve.agg(F.min(F.struct("cost", "threshold")).alias("m")).select(F.col("m.threshold").alias("threshold"), F.col("m.cost").alias("cost"))


def prior_sweep(tpr: float, fpr: float, priors: DataFrame, per_day: int) -> DataFrame:
    """Alert composition at each base rate (prior)."""
    t, f, p = F.lit(tpr), F.lit(fpr), F.col("prior")
    return priors.withColumns({"precision": bayes_precision(t, f, p), "alerts": per_day * (t * p + f * (1 - p)), "true_alerts": per_day * t * p, "missed": per_day * (1 - t) * p})


def alert_queue(roc: DataFrame, budgets: DataFrame, base_rate: float, per_day: int) -> DataFrame:
    """Per daily budget: the lowest threshold whose alerts fit, with recall, precision and lift."""
    daily = per_day * (F.col("tpr") * base_rate + F.col("fpr") * (1 - base_rate))
    fits = roc.withColumn("daily", daily).crossJoin(F.broadcast(budgets)).where(F.col("daily") <= F.col("budget"))
    best = fits.groupBy("budget").agg(F.max_by(F.struct("score", "tpr", "fpr", "daily"), F.col("fp") + F.col("tp")).alias("b"))
    tpr, fpr = F.col("b.tpr"), F.col("b.fpr")
    precision = bayes_precision(tpr, fpr, F.lit(base_rate))
    return best.select("budget", F.col("b.score").alias("threshold"), tpr.alias("recall"), precision.alias("precision"), (precision / base_rate).alias("lift"), F.col("b.daily").alias("alerts"))


def h_measure(roc: DataFrame, a: float = 2.0, b: float = 2.0, grid: int = 200) -> DataFrame:
    """Hand's H: expected minimum loss under a Beta(a, b) density of costs, against the trivial classifier.

    Trapezoid on a cost grid; 0 when a class is absent.
    """
    density = F.pow("c", a - 1) * F.pow(1 - F.col("c"), b - 1)
    points = roc.select("tpr", "fpr", "n_pos", "n_neg")
    corner = points.limit(1).select(F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"), "n_pos", "n_neg")
    costs = roc.sparkSession.range(grid + 1).select((F.col("id") / grid).alias("c"), F.when(F.col("id").isin(0, grid), 0.5).otherwise(1.0).alias("w"))
    pi1 = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    loss = F.col("c") * (1 - pi1) * F.col("fpr") + (1 - F.col("c")) * pi1 * (1 - F.col("tpr"))
    per = points.unionByName(corner).crossJoin(F.broadcast(costs)).groupBy("c", "w").agg(F.min(loss).alias("loss"), F.max(pi1).alias("pi1"), F.max("n_pos").alias("p"), F.max("n_neg").alias("n"))
    trivial = F.least(F.col("c") * (1 - F.col("pi1")), (1 - F.col("c")) * F.col("pi1"))
    sums = per.agg(F.sum(F.col("loss") * density * F.col("w")).alias("m"), F.sum(trivial * density * F.col("w")).alias("t"), F.max(F.col("p") * F.col("n")).alias("both"))
    return sums.select(F.when((F.col("both") > 0) & (F.col("t") > 0), 1 - F.col("m") / F.col("t")).otherwise(0.0).alias("h"))


def tie_average_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mid-ranks (1-based, ties averaged) of each distinct value: value, rank, n."""
    ties = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ran = cumulative(ties, value, ["n"], by=by)
    return ran.withColumn("rank", F.col("cum_n") - (F.col("n") - 1) / 2.0).drop("cum_n")


def topk_stats(df: DataFrame, k: int, order: Sequence[Column], label: str = "y") -> DataFrame:
    """Precision and recall of the ``k`` first rows of an order."""
    top = df.orderBy(*order).limit(k)
    hits = top.agg(F.sum(label).alias("hits"), F.count(F.lit(1)).alias("taken"))
    return hits.crossJoin(F.broadcast(df.agg(F.sum(label).alias("pos")))).select(safe_rate(F.col("hits"), F.col("taken")).alias("precision"), safe_rate(F.col("hits"), F.col("pos")).alias("recall"))


def bootstrap_ci(df: DataFrame, key: str, replicates: int, alpha: float, seed: int, value: str = "value") -> DataFrame:
    """Percentile interval of a mean: Poisson(1) weights from a hash both engines share.

    The weight of a row in replicate b is a function of (key, b, seed) only, so
    replicates run as one aggregation and repeat exactly. A linear congruence of
    the key stands for the uniform draw.
    """
    u = F.pmod(mix32(F.col(key)) + F.col("b") * 40503 * seed + (F.col(key) % 1009) * F.col("b") * 7919, F.lit(1 << 32)) / float(1 << 32)
    steps = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(6)]
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    drawn = df.select(key, F.col(value).alias("v")).crossJoin(F.broadcast(df.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "b")))
    means = drawn.withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col("v")) / F.when(F.sum("w") > 0, F.sum("w"))).alias("m"))
    return means.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"), F.count("m").alias("replicates"))


def audit_labels(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Rows whose score is at least as extreme as the opposite class's mean."""
    means = df.agg(F.avg(F.when(F.col(label) == 1, F.col(score))).alias("_m1"), F.avg(F.when(F.col(label) == 0, F.col(score))).alias("_m0"))
    flagged = F.when(F.col(label) == 1, F.col(score) <= F.col("_m0")).otherwise(F.col(score) >= F.col("_m1"))
    return df.crossJoin(F.broadcast(means)).withColumn("flagged", flagged).drop("_m1", "_m0")


def hierarchy_scores(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall and F1 over ancestor sets (arrays)."""
    sums = df.agg(F.sum(F.size(F.array_intersect(true, pred))).alias("both"), F.sum(F.size(pred)).alias("said"), F.sum(F.size(true)).alias("was"))
    p, r = safe_rate(F.col("both"), F.col("said")), safe_rate(F.col("both"), F.col("was"))
    return sums.select(p.alias("precision"), r.alias("recall"), safe_rate(2 * p * r, p + r).alias("f1"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Share of rows per value."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def playbook_cost(profile: DataFrame, prices: Mapping[str, float], column: str) -> DataFrame:
    """Expected price of the outcomes of :func:`shares`."""
    pairs = [F.lit(x) for k, v in prices.items() for x in (k, float(v))]
    return profile.agg(F.sum(F.col("share") * F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(0.0))).alias("cost"))
