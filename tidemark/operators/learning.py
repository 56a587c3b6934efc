"""Operators around learned models: aggregation, weak labels, stability, games, attribution, fronts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import clamp, safe_rate
from tidemark.operators.cumulative import ranged

# --- model updates: rows of (site, pos, value) --------------------------------------------------


def explode_updates(df: DataFrame, site: str, vector: str) -> DataFrame:
    return df.select(F.col(site).alias("site"), F.posexplode(vector).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def federated_average(updates: DataFrame, sizes: DataFrame) -> DataFrame:
    """Size-weighted mean per coordinate; ``sizes``: site, n."""
    return updates.join(sizes, "site").groupBy("pos").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))


def coordinate_median(updates: DataFrame) -> DataFrame:
    return updates.groupBy("pos").agg(F.percentile("value", 0.5).alias("value"))


def trimmed_mean(updates: DataFrame, trim: int) -> DataFrame:
    """Mean per coordinate without the ``trim`` lowest and highest (at most (n - 1) // 2 each)."""
    w = Window.partitionBy("pos")
    k = F.least(F.lit(trim), F.floor((F.col("_n") - 1) / 2))
    ranked = updates.withColumns({"_r": F.row_number().over(w.orderBy("value", "site")), "_n": F.count(F.lit(1)).over(w)})
    return ranked.where((F.col("_r") > k) & (F.col("_r") <= F.col("_n") - k)).groupBy("pos").agg(F.avg("value").alias("value"))


def krum(updates: DataFrame, byzantine: int) -> DataFrame:
    """Score of each site: sum of its n - f - 2 smallest squared distances; the smallest wins.

    Sites are the parties of one round, so their pairs are few.
    """
    a, b = updates.select(F.col("site").alias("a"), "pos", F.col("value").alias("x")), updates.select(F.col("site").alias("b"), "pos", F.col("value").alias("y"))
    far = a.join(b, "pos").where("a <> b").groupBy("a", "b").agg(F.sum(F.pow(F.col("x") - F.col("y"), 2)).alias("d"))
    w = Window.partitionBy("a")
    near = far.withColumns({"_r": F.row_number().over(w.orderBy("d", "b")), "_n": F.count(F.lit(1)).over(w) + 1})
    kept = near.where(F.col("_r") <= F.greatest(F.lit(1), F.col("_n") - byzantine - 2)).groupBy("a").agg(F.sum("d").alias("score"))
    return kept.select(F.col("a").alias("site"), "score", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", "a")) == 1).alias("chosen"))


def clip_norm(vector: Column, limit: float) -> Column:
    """Scale a vector to the norm ball when it lies outside."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") * F.least(F.lit(1.0), limit / F.when(norm > 0, norm)))


# --- groups -------------------------------------------------------------------------------------


def group_losses(df: DataFrame, group: str, loss: Column) -> DataFrame:
    """Mean loss per group and whether it is the worst."""
    per = df.groupBy(group).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("worst", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("loss"), group)) == 1)


def exponentiated_gradient(losses: DataFrame, weight: str, step: float) -> DataFrame:
    """Multiplicative group weights, normalised."""
    w = F.col(weight) * F.exp(step * F.col("loss"))
    return losses.withColumn("new_weight", w / F.sum(w).over(Window.partitionBy(F.lit(0))))


def feature_stability(aucs: DataFrame, feature: str = "feature", strength: str = "strength") -> DataFrame:
    """Over environments: mean size, sign agreement, relative dispersion of AUC - 0.5."""
    s = F.col(strength)
    per = aucs.groupBy(feature).agg(F.avg(F.abs(s)).alias("magnitude"), F.abs(F.avg(F.signum(s))).alias("agreement"), safe_rate(F.stddev_pop(s), F.abs(F.avg(s)), float("inf")).alias("dispersion"), F.count(F.lit(1)).alias("environments"))
    return per


def seed_summary(runs: DataFrame, metric: str, value: str) -> DataFrame:
    return runs.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.max(value) - F.min(value)).alias("range"), F.count(F.lit(1)).alias("runs"))


# --- near-optimal models: an array of 0/1 decisions per row -------------------------------------


def multiplicity(df: DataFrame, champion: str, decisions: str) -> DataFrame:
    """Ambiguity (rows that any model flips) and discrepancy (the most that one model flips)."""
    flips = df.select(F.transform(decisions, lambda d: (d != F.col(champion)).cast("double")).alias("f"))
    per = flips.select(F.array_max("f").alias("any"), F.posexplode("f").alias("model", "x")).groupBy("model").agg(F.avg("x").alias("share"))
    return flips.agg(F.avg(F.array_max("f")).alias("ambiguity")).crossJoin(F.broadcast(per.agg(F.max("share").alias("discrepancy"))))


def vote_route(votes: Column, low: float, high: float) -> Column:
    return F.when(votes > high, "alert").when(votes >= low, "review").otherwise("clear")


# --- weak labels --------------------------------------------------------------------------------


def vote_patterns(df: DataFrame, votes: Sequence[str]) -> DataFrame:
    """Counts of vote patterns: all that an EM over the label model needs."""
    return df.groupBy(*votes).agg(F.count(F.lit(1)).alias("n"))


def naive_posterior(votes: dict[str, tuple[float, float]], prior: float) -> Column:
    """Posterior of the positive class from 0/1 rule columns with (recall, false-positive rate) each, in log space."""
    z = F.lit(math.log(prior / (1 - prior)))
    for name, (t, f) in votes.items():
        z = z + F.when(F.col(name), math.log(t / f)).otherwise(math.log((1 - t) / (1 - f)))
    return 1 / (1 + F.exp(-z))


def fit_label_model(patterns: DataFrame, votes: Sequence[str], prior: float, rounds: int = 20) -> dict[str, tuple[float, float]]:
    """(recall, false-positive rate) of each rule by EM over the patterns.

    Only pattern counts reach the driver: 2**rules rows at most, whatever the
    table's size.
    """
    rows = [(tuple(bool(r[v]) for v in votes), r["n"]) for r in patterns.collect()]
    rates = {v: (0.7, 0.2) for v in votes}
    bound = lambda x: min(0.999, max(0.001, x))
    for _ in range(rounds):
        mass = {v: [0.0, 0.0] for v in votes}
        total = [1e-9, 1e-9]
        for pattern, n in rows:
            z = math.log(prior / (1 - prior)) + sum(math.log(rates[v][0] / rates[v][1]) if hit else math.log((1 - rates[v][0]) / (1 - rates[v][1])) for v, hit in zip(votes, pattern, strict=True))
            p = 1 / (1 + math.exp(-z))
            total[0] += n * p
            total[1] += n * (1 - p)
            for v, hit in zip(votes, pattern, strict=True):
                if hit:
                    mass[v][0] += n * p
                    mass[v][1] += n * (1 - p)
        rates = {v: (bound(mass[v][0] / total[0]), bound(mass[v][1] / total[1])) for v in votes}
    return rates


def pseudo_labels(df: DataFrame, score: str, key: str, attack: float, benign: float, most: int) -> DataFrame:
    """Confident rows on both sides, at most ``most`` each, the surest first: adds pseudo."""
    side = F.when(F.col(score) >= attack, 1).when(F.col(score) <= benign, 0)
    held = df.withColumn("pseudo", side).where(F.col("pseudo").isNotNull())
    sure = F.when(F.col("pseudo") == 1, -F.col(score)).otherwise(F.col(score))
    return held.withColumn("_r", F.row_number().over(Window.partitionBy("pseudo").orderBy(sure, key))).where(F.col("_r") <= most).drop("_r")


def pu_correct(score: Column, c: float) -> Column:
    """Positive-unlabelled correction of a score."""
    return F.least(score / c, F.lit(1.0))


def pu_weight(score: Column, c: float, clip: float = 1e-6) -> Column:
    """Weight of an unlabelled row as a positive."""
    g = clamp(score, clip, 1 - clip)
    return clamp((1 - c) / c * g / (1 - g), 0, 1)


# --- games and fronts ---------------------------------------------------------------------------


def attacker_utility(detection: Column, fraction: Column, exponent: float) -> Column:
    return (1 - detection) * F.pow(1 - fraction, exponent)


def stackelberg(payoff: DataFrame, exponent: float) -> DataFrame:
    """The defence whose detection is highest once the attacker has replied best; payoff: defence, fraction, detection."""
    u = payoff.withColumn("utility", attacker_utility(F.col("detection"), F.col("fraction"), exponent))
    reply = u.withColumn("_r", F.row_number().over(Window.partitionBy("defence").orderBy(F.desc("utility"), "fraction"))).where("_r = 1").drop("_r")
    return reply.withColumn("chosen", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("detection"), "defence")) == 1)


def pareto_front(df: DataFrame, low: str, high: str) -> DataFrame:
    """Rows that no other beats: smaller ``low``, larger ``high``.

    Candidates are first cut to the best ``high`` of each ``low`` value; a
    running maximum over those finds the front without comparing pairs.
    """
    best = df.groupBy(low).agg(F.max(high).alias("_best"))
    w = Window.partitionBy(F.lit(0)).orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    edge = best.withColumn("_before", F.max("_best").over(w)).where(F.col("_before").isNull() | (F.col("_best") > F.col("_before")))
    return df.join(edge.select(low, "_best"), low).where(F.col(high) == F.col("_best")).drop("_best")


def crowding(front: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Crowding distance: the summed, scaled gap to the neighbours in each objective; infinite at the ends.

    ``key`` names a row. Neighbours are found within quantile ranges of the
    objective; those across a border come from the ranges' ends.
    """
    out = front
    for i, c in enumerate(columns):
        placed = ranged(front.select(key, F.col(c).alias("_v")), "_v")
        ends = placed.groupBy("_range").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        whole = Window.partitionBy(F.lit(0))
        beside = ends.select("_range", F.lag("_hi").over(whole.orderBy("_range")).alias("_last"), F.lead("_lo").over(whole.orderBy("_range")).alias("_next"), (F.max("_hi").over(whole) - F.min("_lo").over(whole)).alias("_span"))
        within = Window.partitionBy("_range").orderBy("_v", key)
        last, after = (F.coalesce(f("_v").over(within), F.col(end)) for f, end in ((F.lag, "_last"), (F.lead, "_next")))
        wide = placed.join(F.broadcast(beside), "_range").select(key, "_span", last.alias("_a"), after.alias("_b"))
        gap = F.when(F.col("_a").isNull() | F.col("_b").isNull(), float("inf")).otherwise(safe_rate(F.col("_b") - F.col("_a"), F.col("_span")))
        out = out.join(wide.select(key, gap.alias(f"_c{i}")), key)
    crowded = sum((F.col(f"_c{i}") for i in range(len(columns))), F.lit(0.0))
    return out.select(*front.columns, crowded.alias("crowding"))


def cluster_purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Per cluster: size, most frequent class (first by name of ties) and its share."""
    counted = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(cluster).agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("t")).select(cluster, "size", F.col("t.l").alias("dominant"), (-F.col("t.m") / F.col("size")).alias("purity"))


def affine_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line y = a + b x."""
    return df.agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"))


def linear_attribution(df: DataFrame, key: str, weights: dict[str, float], centre: dict[str, float], k: int) -> DataFrame:
    """The k largest signed contributions w (x - centre) of each row."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (w * (F.col(c) - centre[c])).alias("contribution")) for c, w in weights.items()])
    long = df.select(key, F.inline(parts))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "feature"))
    return long.withColumn("rank", rank).where(F.col("rank") <= k)


def mutual_information(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mutual information (nats) of pairs of discrete columns."""
    out = None
    for a, b in pairs:
        joint = df.groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))
        whole, by_x, by_y = Window.partitionBy(F.lit(0)), Window.partitionBy("x"), Window.partitionBy("y")
        j = joint.withColumns({"p": F.col("n") / F.sum("n").over(whole), "px": F.sum("n").over(by_x) / F.sum("n").over(whole), "py": F.sum("n").over(by_y) / F.sum("n").over(whole)})
        one = j.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "mi")
        out = one if out is None else out.unionByName(one)
    return out
