"""Choosing rows, policies and operating points; serving checks; attacks and their measures."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import inverse_signed_log, mix32
from tidemark.operators import ranking as rk
from tidemark.operators.cumulative import cumulative, position

Model = Callable[[Mapping[str, Column]], Column]


def hash_draw(key: str, salt: int = 0) -> Column:
    """A number in [0, 1) from a whole-number key."""
    return mix32(F.col(key) + F.lit(salt * 7919)) / float(1 << 32)


# --- choosing rows ------------------------------------------------------------------------------


def first_by(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of an order; ``k`` is the feature, so the plan keeps ``k`` rows a task."""
    return df.orderBy(*order).limit(k)


def select_uncertain(df: DataFrame, probability: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows whose probability is nearest to a half, ties by key."""
    return first_by(df, [F.abs(F.col(probability) - 0.5), F.col(key)], k)


def select_random(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows by the hash of their key."""
    return first_by(df, [hash_draw(key, seed), F.col(key)], k)


def resample_to_prevalence(df: DataFrame, y: str, key: str, rate: float, seed: int = 0) -> DataFrame:
    """Thin the class in surplus until positives are a share ``rate`` of the rows; rows are chosen by hash.

    Positives are thinned if there are more than the negatives call for (one
    stays at least), else the negatives are.
    """
    rate = min(1 - 1e-9, max(1e-9, rate))
    n = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    wanted = round(neg * rate / (1 - rate))
    keep = {1: max(wanted, 1), 0: neg} if wanted <= pos else {1: pos, 0: min(round(pos * (1 - rate) / rate), neg)}
    placed = position(df.withColumn("_h", hash_draw(key, seed)), ["_h", key], by=[y], name="_p")
    allowed = F.when(F.col(y) == 1, keep[1]).otherwise(keep[0])
    return placed.where(F.col("_p") <= allowed).select(*df.columns)


def order_stream(df: DataFrame, day: str, days: Sequence[str], row: str) -> DataFrame:
    """Adds stream_pos: the place by day (in the order given; unknown days last), then by row."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, days)), F.col(day)), F.lit(0)).cast("int")
    ranked = df.withColumn("_day", F.when(rank == 0, len(days)).otherwise(rank - 1))
    return position(ranked, ["_day", row], name="stream_pos").drop("_day")


def day_tasks(df: DataFrame, day: str, days: Sequence[str], row: str, y: str, most: int, share: float) -> DataFrame:
    """Adds task and part ('train' or 'held'): one task for each day with positives, its first rows for training.

    At most ``most`` rows of a day count, in row order. Days without positives
    train the next task that has them, and are left out behind the last.
    """
    placed = position(df.where(F.col(day).isin(*days)), [row], by=[day], name="_p").where(F.col("_p") <= most)
    per = {r[day]: (r["n"], r["a"]) for r in placed.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.max(y).alias("a")).collect()}
    plan, waiting = [], []
    for d in days:
        n, attacked = per.get(d, (0, 0))
        if not n:
            continue
        waiting.append((d, n if not attacked else int(n * share)))
        if attacked:
            plan += [(w, d, cut) for w, cut in waiting]
            waiting = []
    task = F.create_map(*[F.lit(x) for w, d, _ in plan for x in (w, d)]) if plan else F.lit(None).cast("map<string,string>")
    cut = F.create_map(*[F.lit(x) for w, _, c in plan for x in (w, c)]) if plan else F.lit(None).cast("map<string,int>")
    out = placed.withColumns({"task": F.try_element_at(task, F.col(day)), "part": F.when(F.col("_p") <= F.try_element_at(cut, F.col(day)), "train").otherwise("held")})
    return out.where("task is not null").drop("_p")


def quantile_literals(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Half-open ranges (feature, low, high] between observed quantiles, the outer ones open; ranges that hold no row or all are left out.

    The edge at share q is the value at place floor(q (n - 1)) of the sorted column.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))).where("v is not null")
    ties = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("m"))
    ran = cumulative(ties, "v", ["m"], by=["feature"])
    size = ties.groupBy("feature").agg(F.sum("m").alias("n"))
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: F.floor(k / float(bins) * (F.col("n") - 1)))
    edges = ran.join(size, "feature").where(F.exists(shares, lambda p: (p >= F.col("cum_m") - F.col("m")) & (p < F.col("cum_m"))))
    edges = edges.groupBy("feature").agg(F.sort_array(F.collect_list("v")).alias("e")).where(F.size("e") >= 3)  # bins + 1 values at most
    last = F.size("e") - 2
    pair = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(F.when(k == 0, float("-inf")).otherwise(F.get("e", k)).alias("low"), F.when(k == last, float("inf")).otherwise(F.get("e", k + 1)).alias("high")),
    )
    return edges.select("feature", F.inline(pair))


def literal(feature: str, low: float, high: float) -> Column:
    """Whether a row lies in a range of :func:`quantile_literals`."""
    return (F.col(feature) > low) & (F.col(feature) <= high)


# --- operating points ---------------------------------------------------------------------------


def stage1_threshold(df: DataFrame, cheap: str, alerted: str, keep: float) -> DataFrame:
    """The cut of a cheap score that forwards a share ``keep`` of the full model's alerts; minus infinity without alerts."""
    at = 1 - min(1.0, max(0.0, keep))
    return df.agg(F.coalesce(F.percentile(F.when(F.col(alerted), F.col(cheap)), at), F.lit(float("-inf"))).alias("threshold"))


def detection_retention(df: DataFrame, cheap: str, full: str, y: str, threshold: float, keeps: Sequence[float]) -> DataFrame:
    """Of the positives that the full model detects, the share among the top ``keep`` of the cheap score: keep, retained, detected."""
    hit = ((F.col(full) >= threshold) & (F.col(y) == 1)).cast("long")
    ties = df.groupBy(F.col(cheap).alias("s")).agg(F.count(F.lit(1)).alias("m"), F.sum(hit).alias("hits"))
    total = ties.agg(F.sum("m").alias("n"), F.sum("hits").alias("found"))
    ran = cumulative(ties, "s", ["m"]).crossJoin(F.broadcast(total)).withColumn("below", (F.col("cum_m") - F.col("m")) / F.col("n"))
    sums = ran.groupBy("found").agg(*[F.sum(F.when(F.col("below") >= 1 - k, F.col("hits"))).alias(f"k{i}") for i, k in enumerate(keeps)])
    rows = [F.struct(F.lit(float(k)).alias("keep"), F.when(F.col("found") > 0, F.coalesce(f"k{i}", F.lit(0)) / F.col("found")).alias("retained"), F.col("found").alias("detected")) for i, k in enumerate(keeps)]
    return sums.select(F.inline(F.array(*rows)))


def realised_rates(reference: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, rate): the share of reference rows at or above each threshold, in one pass."""
    rates = reference.agg(*[F.avg((F.col(score) >= t).cast("double")).alias(f"r{i}") for i, t in enumerate(thresholds)])
    return rates.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"r{i}").alias("rate")) for i, t in enumerate(thresholds)])))


def compliance_share(df: DataFrame, fpr: str, budget: float, factor: float) -> DataFrame:
    """Share of false-positive rates within a factor of the budget, on either side."""
    return df.agg(F.avg(F.col(fpr).between(budget / factor, budget * factor).cast("double")).alias("share"))


def label_budget_trials(df: DataFrame, key: str, y: str, score: str, k: int, budget: float, trials: int) -> DataFrame:
    """(trial, threshold, fpr, tpr): thresholds from ``k`` rows drawn by hash, rates over all rows.

    A trial first keeps a hash range expected to hold twice its rows, so no
    more than that is ranked. The threshold is the smallest score whose
    false-positive rate in the sample is within the budget, infinite if none is.
    """
    n = df.count()
    roomy = min(1.0, (2.0 * k + 50) / max(n, 1))
    draws = F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: F.struct(t.alias("trial"), (mix32(F.col(key) + t * 7919) / float(1 << 32)).alias("u")))
    sample = df.select(key, y, score, F.inline(F.filter(draws, lambda d: d["u"] < roomy)))
    sample = position(sample, ["u", key], by=["trial"], name="_p").where(F.col("_p") <= k)
    ties = sample.groupBy("trial", F.col(score).alias("s")).agg(F.sum(F.lit(1) - F.col(y)).alias("neg"))
    ran = cumulative(ties, "s", ["neg"], descending=True, by=["trial"])
    total = ties.groupBy("trial").agg(F.sum("neg").alias("n_neg"))
    cuts = ran.join(total, "trial").groupBy("trial").agg(F.coalesce(F.min(F.when(F.col("cum_neg") <= budget * F.col("n_neg"), F.col("s"))), F.lit(float("inf"))).alias("threshold"))
    points = df.groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - F.col(y)).alias("neg"))
    above = lambda c: F.sum(F.when(F.col("s") >= F.col("threshold"), F.col(c)).otherwise(0)) / F.sum(c)
    return points.crossJoin(F.broadcast(cuts)).groupBy("trial", "threshold").agg(above("neg").alias("fpr"), above("pos").alias("tpr"))


def wait_sensitivity(df: DataFrame, duration: str, timeout: float, shares: Sequence[float]) -> DataFrame:
    """(share, median_wait): the median wait when a share of flows only ends by timeout."""
    at = [0.5 / (1 - s) if s < 0.5 else (s - 0.5) / s for s in shares]
    cuts = df.agg(F.percentile(duration, at).alias("q"))
    return cuts.select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), (F.get("q", F.lit(i)) + (0.0 if s < 0.5 else timeout)).alias("median_wait")) for i, s in enumerate(shares)])))


def flip_recovery(df: DataFrame, value: str, flipped: str, key: str) -> DataFrame:
    """How well the lowest values find planted flips: n_flips, hits among as many lowest rows, their share, ROC AUC of -value."""
    flag = F.col(flipped).cast("int")
    n = df.agg(F.sum(flag).alias("n_flips"))
    placed = position(df.select(value, key, flag.alias("_f")), [value, key], name="_p").crossJoin(F.broadcast(n))
    found = placed.agg(F.max("n_flips").alias("n_flips"), F.sum(F.when(F.col("_p") <= F.col("n_flips"), F.col("_f")).otherwise(0)).alias("hits"))
    auc = rk.roc_auc(rk.roc_frame(df.select((-F.col(value)).alias("score"), flag.alias("y"))))
    out = found.crossJoin(F.broadcast(auc.toDF("auc")))
    return out.withColumn("precision", F.when(F.col("n_flips") > 0, F.col("hits") / F.col("n_flips")).otherwise(0.0))


# --- policies -----------------------------------------------------------------------------------


def bandit_context(score: Column, anomaly: Column) -> Column:
    """What a policy sees of a flow: 1, the score, the anomaly, the score squared."""
    return F.array(F.lit(1.0), score, anomaly, score * score)


def threshold_policy(score: Column, threshold: float) -> Column:
    return score >= threshold


def random_policy(key: str, rate: float, seed: int = 0) -> Column:
    """Acts on a share ``rate`` of rows, by hash."""
    return hash_draw(key, seed) < rate


def analyst_skill(kind: str, confidence: Column, novelty: Column, base: float, spread: float) -> Column:
    """Chance that an analyst is right: the same everywhere, better with confidence, or better with novelty."""
    lean = {"uniform": F.lit(0.0), "correlated": confidence - 0.5, "complementary": novelty - 0.5}
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(base) + spread * lean[kind]))


def analyst_verdict(skill: Column, y: Column, key: str, seed: int = 0) -> Column:
    """The truth with chance ``skill``, else the opposite."""
    return F.when(hash_draw(key, seed) < skill, y).otherwise(1 - y)


def advantage_bins(rows: int, least: int) -> int:
    """Bins per axis of a grid whose cells hold about ``least`` rows; two at least."""
    return max(2, math.isqrt(max(rows, 1) // max(least, 1)))


# --- checks of models and deployments -----------------------------------------------------------


def positive_score(probabilities: str, classes: Sequence[str], positive: str) -> Column:
    """The positive class's entry of a probability array."""
    return F.get(F.col(probabilities), F.lit(list(classes).index(positive)))


def shadow_disagreement(df: DataFrame, champion: str, shadow: str, champion_threshold: float, shadow_threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Flows that both models scored, the mean gap of their scores, and on how many their verdicts differ, each at its own threshold."""
    differ = (F.col(champion) >= champion_threshold) != (F.col(shadow) >= shadow_threshold)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("scored"), F.avg(F.abs(F.col(champion) - F.col(shadow))).alias("mean_gap"), F.count_if(differ).alias("disagreements"))


def checks(measured: DataFrame, floors: Mapping[str, float] | None = None, ceilings: Mapping[str, float] | None = None) -> DataFrame:
    """Rows (name, rule, required, measured, ok) for one row of metrics; a metric that is missing or null fails."""
    rules = [(c, "least", v) for c, v in (floors or {}).items()] + [(c, "most", v) for c, v in (ceilings or {}).items()]
    rows = []
    for c, rule, v in rules:
        value = F.col(c).cast("double") if c in measured.columns else F.lit(None).cast("double")
        ok = F.coalesce(value >= v if rule == "least" else value <= v, F.lit(False))
        rows.append(F.struct(F.lit(c).alias("name"), F.lit(rule).alias("rule"), F.lit(float(v)).alias("required"), value.alias("measured"), ok.alias("ok")))
    return measured.select(F.inline(F.array(*rows)))


def coverage_ratio(df: DataFrame, grade: str, by: Sequence[str] = ()) -> DataFrame:
    """Controls met plus half of those met in part, over those that apply."""
    worth = F.when(F.col(grade) == "met", 1.0).when(F.col(grade) == "partial", 0.5).when(F.col(grade) != "not_applicable", 0.0)
    return df.groupBy(*by).agg(F.coalesce(F.avg(worth), F.lit(0.0)).alias("ratio"), F.count(worth).alias("applicable"))


def session_code(day: Column, label: Column) -> Column:
    """A stable number for a day and class: the first eight hex digits of their SHA-1, modulo 100,000."""
    return (F.conv(F.substring(F.sha1(F.concat_ws("|", day, label)), 1, 8), 16, 10).cast("long") % 100_000).cast("double")


def quick_metrics(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Average precision and ROC AUC in one row."""
    roc = rk.roc_frame(df.select(F.col(score).alias("score"), F.col(y).alias("y")))
    return rk.average_precision(roc).toDF("average_precision").crossJoin(F.broadcast(rk.roc_auc(roc).toDF("roc_auc")))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from the counts of their pairs of labels; 1 where neither could differ."""
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias(name)) for c, name in ((a, "ra"), (b, "rb")))
    both = cells.agg(F.sum(pairs("n")).alias("rab"), F.sum("n").alias("n")).crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))
    chance, best = F.col("ra") * F.col("rb") / pairs("n"), (F.col("ra") + F.col("rb")) / 2
    return both.select(F.when(best != chance, (F.col("rab") - chance) / (best - chance)).otherwise(1.0).alias("ari"))


def random_baseline_ari(df: DataFrame, label: str, key: str, k: int, trials: int) -> DataFrame:
    """Mean adjusted Rand index of ``trials`` random assignments to ``k`` clusters."""
    found = None
    for t in range(trials):
        one = adjusted_rand(df.withColumn("_c", F.floor(hash_draw(key, t + 1) * k)), label, "_c")
        found = one if found is None else found.unionByName(one)
    return found.agg(F.avg("ari").alias("ari"))


def nearest_centroid(centroids: DataFrame, classes: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """For each centroid the class whose centroid is nearest (ties by name): key, nearest, distance.

    Both sides have a row per cluster or class.
    """
    other = classes.select(F.col(label).alias("nearest"), F.col(vector).alias("_v"))
    square = F.aggregate(F.zip_with(vector, "_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    best = centroids.crossJoin(F.broadcast(other)).groupBy(key).agg(F.min(F.struct(square.alias("d"), "nearest")).alias("m"))
    return best.select(key, F.col("m.nearest").alias("nearest"), F.sqrt("m.d").alias("distance"))


def grade_counts(df: DataFrame, grade: str, by: Sequence[str] = ()) -> DataFrame:
    """Entries per grade."""
    return df.groupBy(*by, grade).agg(F.count(F.lit(1)).alias("entries"))


def complexity(features: Sequence[str]) -> Column:
    """The length of a row's feature vector: a stand-in for how unusual it is."""
    return F.sqrt(sum((F.col(f).cast("double") * F.col(f).cast("double") for f in features), F.lit(0.0)))


# --- attributions -------------------------------------------------------------------------------


def shapley_values(df: DataFrame, features: Sequence[str], baseline: Mapping[str, float], model: Model) -> DataFrame:
    """Adds shap_<feature>: exact Shapley values of a column model against a baseline; they add up to model(x) - model(baseline).

    The model is a Catalyst expression evaluated on all subsets, so this is for
    few features (2**n model terms a row).
    """
    n = len(features)
    mixed: dict[tuple, Column] = {}
    for r in range(n + 1):
        for subset in combinations(range(n), r):
            mixed[subset] = model({f: F.col(f).cast("double") if i in subset else F.lit(float(baseline[f])) for i, f in enumerate(features)})
    names = {s: f"_m{k}" for k, s in enumerate(mixed)}
    wide = df.withColumns({names[s]: c for s, c in mixed.items()})
    out = {}
    for i, f in enumerate(features):
        total = F.lit(0.0)
        for s in mixed:
            if i not in s:
                weight = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                total = total + weight * (F.col(names[tuple(sorted((*s, i)))]) - F.col(names[s]))
        out[f"shap_{f}"] = total
    return wide.withColumns(out).drop(*names.values())


def top_attributions(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """Adds top: the ``k`` features of largest absolute shap_<feature>, as (feature, value), ties by name."""
    parts = F.array(*[F.struct((-F.abs(F.col(f"shap_{f}"))).alias("o"), F.lit(f).alias("feature"), F.col(f"shap_{f}").alias("value")) for f in features])
    return df.withColumn("top", F.transform(F.slice(F.array_sort(parts), 1, k), lambda p: F.struct(p["feature"].alias("feature"), p["value"].alias("value"))))


# --- kernels between samples --------------------------------------------------------------------


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, by hash of the key: the documented bound of the quadratic statistics below."""
    return first_by(df, [hash_draw(key, seed), F.col(key)], most)


def median_bandwidth(x: DataFrame, y: DataFrame, columns: Sequence[str], key: str, most: int = 500) -> DataFrame:
    """gamma = 1 over the median squared distance of ``most`` sampled rows of both sides together; a half where that is 0."""
    both = x.select(F.lit(0).alias("_s"), key, *columns).unionByName(y.select(F.lit(1).alias("_s"), key, *columns))
    few = both.withColumn("_u", mix32(F.col(key) * 2 + F.col("_s"))).orderBy("_u", "_s", key).limit(most)
    few = few.select((F.col("_u") * 2 + F.col("_s")).alias("_i"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_v"))
    other = F.broadcast(few.select(F.col("_i").alias("_j"), F.col("_v").alias("_w")))
    d2 = F.aggregate(F.zip_with("_v", "_w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    median = few.join(other, F.col("_i") < F.col("_j")).agg(F.percentile(d2, 0.5).alias("m"))
    return median.select(F.when(F.col("m") > 1e-12, 1 / F.col("m")).otherwise(0.5).alias("gamma"))


def _kernel(x: np.ndarray, gamma: float) -> np.ndarray:
    square = (x * x).sum(axis=1)
    return np.exp(-gamma * np.maximum(0.0, square[:, None] + square[None, :] - 2 * x @ x.T))


def split_mmd2(kernel: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Unbiased MMD^2 of many splits of one pooled sample: ``first`` has a row a split, true for the first side."""
    inside = kernel - np.diag(np.diag(kernel))
    f = first.astype(float)
    n, m = f.sum(axis=1), (1 - f).sum(axis=1)
    sum_ff, sum_f = ((f @ inside) * f).sum(axis=1), f @ inside.sum(axis=1)
    sum_fg = sum_f - sum_ff
    sum_gg = inside.sum() - sum_f - sum_fg
    return sum_ff / np.maximum(n * (n - 1), 1e-12) + sum_gg / np.maximum(m * (m - 1), 1e-12) - 2 * sum_fg / np.maximum(n * m, 1e-12)


def mmd_permutation_test(x: DataFrame, y: DataFrame, columns: Sequence[str], key: str, permutations: int = 200, most: int = 500, gamma: float | None = None, seed: int = 0) -> tuple[float, float, float]:
    """(statistic, p-value, gamma) of the two-sample test with a permutation null, on at most ``most`` rows a side.

    The p-value counts the observed split, so it is never 0.
    """
    sides = [np.array(bounded_sample(df, key, most, seed).select(*[F.col(c).cast("double") for c in columns]).collect(), dtype=float).reshape(-1, len(columns)) for df in (x, y)]
    pooled, first = np.vstack(sides), np.arange(sum(map(len, sides))) < len(sides[0])
    if gamma is None:
        square = (pooled * pooled).sum(axis=1)
        d2 = np.maximum(0.0, square[:, None] + square[None, :] - 2 * pooled @ pooled.T)[np.triu_indices(len(pooled), 1)]
        middle = float(np.median(d2)) if len(d2) else 0.0
        gamma = 1 / middle if middle > 1e-12 else 0.5
    rng = np.random.default_rng(seed)
    found = split_mmd2(_kernel(pooled, gamma), np.vstack([first, *(rng.permutation(first) for _ in range(permutations))]))
    return float(found[0]), float((1 + (found[1:] >= found[0]).sum()) / (1 + permutations)), gamma


def per_feature_mmd(x: DataFrame, y: DataFrame, columns: Sequence[str], key: str, most: int = 400, seed: int = 0) -> dict[str, float]:
    """The unbiased MMD^2 of each column by itself, on at most ``most`` rows a side."""
    return {c: mmd_permutation_test(x, y, [c], key, 0, most, seed=seed)[0] for c in columns}


def dependence_strength(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and largest absolute correlation between different columns; undefined ones count as 0. One pass."""
    pairs = [F.abs(F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))).alias(f"r{i}") for i, (a, b) in enumerate(combinations(columns, 2))]
    if not pairs:
        return df.agg(F.lit(0.0).alias("mean"), F.lit(0.0).alias("largest"))
    names = [F.col(f"r{i}") for i in range(len(pairs))]
    return df.agg(*pairs).select((sum(names[1:], names[0]) / len(pairs)).alias("mean"), F.array_max(F.array(*names)).alias("largest"))


def marginal_shift(df: DataFrame, columns: Sequence[str], sigmas: float) -> DataFrame:
    """Columns moved by ``sigmas`` of their standard deviations (1 for a constant column)."""
    sd = df.agg(*[F.when(F.stddev_pop(c) > 1e-12, F.stddev_pop(c)).otherwise(1.0).alias(f"_s{i}") for i, c in enumerate(columns)])
    return df.crossJoin(F.broadcast(sd)).withColumns({c: F.col(c) + sigmas * F.col(f"_s{i}") for i, c in enumerate(columns)}).select(*df.columns)


def corrupt(df: DataFrame, columns: Sequence[str], key: str, rate: float, seed: int = 0) -> DataFrame:
    """Replaces a share ``rate`` of the cells by the same column's value in another row; adds <column>_corrupted.

    Rows are numbered by key, and a cell's donor is the row whose number its
    hash names.
    """
    n = df.count()
    placed = position(df, [key], name="_p")
    out = placed
    for i, c in enumerate(columns):
        donor = placed.select(F.col("_p").alias("_d"), F.col(c).alias("_v"))
        at = F.floor(hash_draw(key, seed + 2 * i + 1) * n) + 1
        chosen = F.when(hash_draw(key, seed + 2 * i) < rate, at)
        out = out.withColumn("_at", chosen).join(donor, F.col("_at") == F.col("_d"), "left")
        out = out.withColumns({c: F.when(F.col("_at").isNull(), F.col(c)).otherwise(F.col("_v")), f"{c}_corrupted": F.col("_at").isNotNull()}).drop("_at", "_d", "_v")
    return out.drop("_p")


# --- continual and invariant learning -----------------------------------------------------------


def backward_transfer(scores: DataFrame, learned: str, task: str, score: str) -> DataFrame:
    """Mean change of each earlier task's score from when it was learned to the end: (learned, task) rows of numbers; 0 for one task."""
    last = scores.agg(F.max(learned).alias("_last"))
    wide = scores.crossJoin(F.broadcast(last)).where(F.col(task) < F.col("_last"))
    per = wide.groupBy(task).agg((F.max(F.when(F.col(learned) == F.col("_last"), F.col(score))) - F.max(F.when(F.col(learned) == F.col(task), F.col(score)))).alias("d"))
    return per.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("backward"))


def forward_transfer(scores: DataFrame, learned: str, task: str, score: str, baseline: str) -> DataFrame:
    """Mean score above the baseline on each later task just before it is learned; 0 for one task."""
    return scores.where(F.col(learned) == F.col(task) - 1).agg(F.coalesce(F.avg(F.col(score) - F.col(baseline)), F.lit(0.0)).alias("forward"))


def informative_environments(df: DataFrame, environment: str, y: str) -> DataFrame:
    """Environments that hold both classes."""
    return df.groupBy(environment).agg(F.min(y).alias("lo"), F.max(y).alias("hi")).where("lo <> hi").select(environment)


def screen_breakdown(stability: DataFrame, agree: str, strength: str, dispersion: str, least: float, most: float) -> DataFrame:
    """How many features pass the screen, or the first reason why not."""
    reason = F.when(~F.col(agree), "flipped sign").when(F.col(strength) < least, "too weak").when(F.col(dispersion) > most, "unstable magnitude").otherwise("passed")
    return stability.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("features"))


# --- attacks and their measures -----------------------------------------------------------------


def pad_features(df: DataFrame, columns: Sequence[str], factor: float) -> DataFrame:
    """Volume columns inflated by a factor."""
    return df.withColumns({c: F.col(c) * factor for c in columns})


def attack_success_rate(df: DataFrame, triggered: str, threshold: float, detained: str | None = None) -> DataFrame:
    """Of the attacks that are caught without the trigger, the share below the threshold with it; null without any."""
    rows = df.where(F.col(detained)) if detained else df
    return rows.agg(F.avg((F.col(triggered) < threshold).cast("double")).alias("success"))


def confidence_features(probabilities: str, classes: Sequence[str], label: str, k: int) -> dict[str, Column]:
    """What a membership attack sees: the ``k`` largest probabilities, that of the true class, correctness, entropy."""
    p = F.col(probabilities)
    down = F.sort_array(p, asc=False)
    names = F.array(*map(F.lit, classes))
    place = F.array_position(names, F.col(label)).cast("int")
    entropy = -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.log(F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-12))))
    return {
        **{f"top{i + 1}": F.coalesce(F.get(down, F.lit(i)), F.lit(0.0)) for i in range(k)},
        "true_probability": F.coalesce(F.get(p, place - 1), F.lit(0.0)),
        "correct": F.coalesce(F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int")) == F.col(label), F.lit(False)).cast("double"),
        "entropy": entropy,
    }


def membership_summary(df: DataFrame, member: str, score: str, fpr: float) -> DataFrame:
    """ROC AUC, largest gap of the rates, and TPR within a false-positive budget, of a membership attack."""
    roc = rk.roc_frame(df.select(F.col(score).alias("score"), F.col(member).cast("int").alias("y")))
    within = roc.agg(F.coalesce(F.max(F.when(F.col("fpr") <= fpr, F.col("tpr"))), F.lit(0.0)).alias("tpr_at_budget"))
    gap = roc.agg(F.greatest(F.lit(0.0), F.max(F.col("tpr") - F.col("fpr"))).alias("advantage"))
    return rk.roc_auc(roc).toDF("auc").crossJoin(F.broadcast(gap)).crossJoin(F.broadcast(within))


def flood(df: DataFrame, row: str, score: str, y: str, batch: int, start: int, batches: int, decoys: int, quantile: float, seed: int = 0) -> DataFrame:
    """Adds decoys to some batches of a stream: batch, score, y, decoy, protected.

    Decoys are copies of scores at or above a quantile, drawn by hash, ``decoys``
    for each of ``batches`` batches from ``start``; the positives of those
    batches are what they cover for.
    """
    spark = df.sparkSession
    placed = position(df, [row], name="_p").select(F.floor((F.col("_p") - 1) / batch).alias("batch"), F.col(score).alias("score"), F.col(y).cast("int").alias("y"))
    inside = F.col("batch").between(start, start + batches - 1)
    own = placed.withColumns({"decoy": F.lit(False), "protected": inside & (F.col("y") == 1)})
    cut = df.agg(F.percentile(score, quantile).alias("_cut"))
    loud = position(df.crossJoin(F.broadcast(cut)).where(F.col(score) >= F.col("_cut")).select(row, F.col(score).alias("score")), [row], name="_i")
    n = loud.agg(F.count(F.lit(1)).alias("_n"))
    flooded = placed.where(inside).select("batch").distinct()
    slots = flooded.crossJoin(F.broadcast(spark.range(decoys).toDF("_s"))).crossJoin(F.broadcast(n)).where("_n > 0")
    drawn = slots.withColumn("_i", F.pmod(mix32(F.col("batch") * decoys + F.col("_s") + seed), F.col("_n")) + 1)
    fake = drawn.join(loud, "_i").select("batch", "score", F.lit(1).alias("y"), F.lit(True).alias("decoy"), F.lit(False).alias("protected"))
    return own.unionByName(fake)


def search_evasion(df: DataFrame, features: Sequence[str], controllable: Sequence[str], model: Model, key: str, radius: float, tries: int, seed: int = 0) -> DataFrame:
    """Adds evaded: the lowest score found by ``tries`` random moves of the controllable columns within a ball of ``radius``.

    Moves come from hashes of the key, so each row's search is the same again
    after a lost executor. Every try is a column expression.
    """
    best = model({f: F.col(f).cast("double") for f in features})
    for t in range(tries):
        raw = {c: hash_draw(key, seed + 97 * t + 13 * i + 1) * 2 - 1 for i, c in enumerate(controllable)}
        norm = F.sqrt(sum((v * v for v in raw.values()), F.lit(1e-12)))
        reach = hash_draw(key, seed + 97 * t) * radius
        best = F.least(best, model({f: F.col(f).cast("double") + (raw[f] / norm * reach if f in raw else F.lit(0.0)) for f in features}))
    return df.withColumn("evaded", best)


def inflate(df: DataFrame, features: Sequence[str], inflatable: Sequence[str], model: Model, factors: Sequence[float], rounds: int = 1) -> DataFrame:
    """Adds evaded: the lowest score that inflating one column after the other reaches; each takes the factor that lowers it most.

    A row's columns are tried in the order given, ``rounds`` times over, with
    what was chosen before kept. Factors are 1 or more, and 1 is always tried.
    """
    out = df.withColumn("_x", F.array(*[F.col(f).cast("double") for f in features]))
    at = lambda v: {f: F.get(v, F.lit(i)) for i, f in enumerate(features)}
    for c in list(inflatable) * rounds:
        k = features.index(c)
        moved = [F.array(*[v * m if i == k else v for i, v in enumerate(at(F.col("_x")).values())]) for m in sorted({1.0, *map(float, factors)})]
        # structs compare by their first field, so the least score wins and the smallest factor on ties
        best = F.array_min(F.array(*[F.struct(model(at(x)).alias("s"), F.lit(j).alias("j"), x.alias("x")) for j, x in enumerate(moved)]))
        out = out.withColumn("_x", best["x"])
    return out.withColumn("evaded", model(at(F.col("_x")))).drop("_x")


def watermark_keys(df_session, features: int, k: int, scale: float, seed: int) -> DataFrame:
    """``k`` trigger rows far from the data (key, features, owner_label): normal draws of the given scale, labels by fair coins."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(scale=scale, size=features)], int(rng.integers(2))) for i in range(k)]
    return df_session.createDataFrame(rows, "key long, features array<double>, owner_label int")


def watermark_accuracy(df: DataFrame, prediction: str, owner: str) -> DataFrame:
    """Share of keys that a model answers with the owner's label."""
    return df.agg(F.avg((F.col(prediction).cast("int") == F.col(owner)).cast("double")).alias("accuracy"))


# --- released bins ------------------------------------------------------------------------------


def sample_within_bins(level: Column, edges: Sequence[float], key: str, seed: int = 0) -> Column:
    """A value drawn evenly inside a released bin (1, 2, ...) of signed-log edges, back on the raw scale; level 0 is missing."""
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    low = F.greatest(F.lit(0), F.least(level.cast("int") - 1, F.lit(len(edges) - 2)))
    a, b = F.get(cuts, low), F.get(cuts, low + 1)
    return F.when(level > 0, inverse_signed_log(a + hash_draw(key, seed) * (b - a)))
