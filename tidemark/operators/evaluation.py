"""Open-set, deferral, slice, stability, robustness and refresh operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import binary_entropy, mix32, safe_rate
from tidemark.operators import ranking as rk
from tidemark.operators.cumulative import cumulative, position


# --- positions in a reference distribution ------------------------------------------------------


def ecdf(values: DataFrame, reference: DataFrame, value: str, ref_value: str, out: str = "ecdf") -> DataFrame:
    """Adds the share of reference values at or below each row's value; 0 for an empty reference.

    One run over the distinct values of both sides; rows join it by equality.
    """
    ref = reference.groupBy(F.col(ref_value).alias("_v")).agg(F.count(F.lit(1)).alias("m"))
    both = ref.unionByName(values.select(F.col(value).alias("_v")).distinct().withColumn("m", F.lit(0).cast("long"))).where("_v is not null").groupBy("_v").agg(F.sum("m").alias("m"))
    ran = cumulative(both, "_v", ["m"]).select("_v", "cum_m")
    n = reference.agg(F.count(ref_value).alias("_n"))
    return values.join(ran, F.col(value) == F.col("_v"), "left").crossJoin(F.broadcast(n)).withColumn(out, F.when(F.col("_n") > 0, F.coalesce("cum_m", F.lit(0)) / F.col("_n")).otherwise(0.0)).drop("_v", "cum_m", "_n")


def rank_average(df: DataFrame, columns: Sequence[str], out: str = "rank_average") -> DataFrame:
    """Mean over score columns of the mid-rank of each, scaled to (0, 1]."""
    total = df.agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        df = df.join(rk.tie_average_rank(df, c).select(c, F.col("rank").alias(f"_r{i}")), c)
    df = df.crossJoin(F.broadcast(total))
    mean = sum((F.col(f"_r{i}") / F.col(f"_n{i}") for i in range(len(columns))), F.lit(0.0)) / len(columns)
    return df.withColumn(out, mean).drop(*[f"_{k}{i}" for i in range(len(columns)) for k in "rn"])


def rank_residual(df: DataFrame, score: str, proxy: str) -> DataFrame:
    """Adds residual: mid-rank of the score minus its least-squares fit on the mid-rank of a proxy."""
    a = rk.tie_average_rank(df, score).select(score, F.col("rank").alias("_y"))
    b = rk.tie_average_rank(df, proxy).select(proxy, F.col("rank").alias("_x"))
    both = df.join(a, score).join(b, proxy)
    line = both.agg(F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"))
    return both.crossJoin(F.broadcast(line)).withColumn("residual", F.col("_y") - F.coalesce(F.col("_a") + F.col("_b") * F.col("_x"), F.col("_y"))).drop("_x", "_y", "_a", "_b")


def detection_at_fpr(known: DataFrame, unknown: DataFrame, novelty: str, fpr: float) -> DataFrame:
    """Threshold at the (1 - fpr) quantile of known novelty (+inf if empty) and the share of unknown rows at or above it."""
    cut = known.agg(F.coalesce(F.percentile(novelty, 1 - fpr), F.lit(float("inf"))).alias("threshold"))
    return unknown.crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.avg((F.col(novelty) >= F.col("threshold")).cast("double")).alias("detection"))


def oscr(df: DataFrame, novelty: str, known: str, correct: str) -> DataFrame:
    """Open-set curve: at each distinct novelty (and beyond all) the shares strictly below it.

    fpr: unknown rows accepted; ccr: known rows accepted and classified right.
    """
    k = F.col(known).cast("int")
    ties = df.groupBy(F.col(novelty).alias("threshold")).agg(F.sum(1 - k).alias("u"), F.sum(k * F.col(correct).cast("int")).alias("c"), F.sum(k).alias("k"))
    total = ties.agg(F.sum("u").alias("_u"), F.sum("k").alias("_k"), F.sum("c").alias("_c"))
    ran = cumulative(ties, "threshold", ["u", "c"])
    below = ran.select("threshold", (F.col("cum_u") - F.col("u")).alias("u"), (F.col("cum_c") - F.col("c")).alias("c"))
    end = total.select(F.lit(float("inf")).alias("threshold"), F.col("_u").alias("u"), F.col("_c").alias("c"))
    return below.unionByName(end).crossJoin(F.broadcast(total)).select("threshold", safe_rate(F.col("u"), F.col("_u")).alias("fpr"), safe_rate(F.col("c"), F.col("_k")).alias("ccr"))


def trapezoid(curve: DataFrame, x: str, y: str) -> DataFrame:
    """Area under a curve of distinct points, by x then y."""
    w = Window.partitionBy(F.lit(0)).orderBy(x, y)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.select(part.alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("area"))


def partial_auc(df: DataFrame, alpha: float, grid: int, score: str = "score", label: str = "y") -> DataFrame:
    """Area under TPR for FPR up to ``alpha`` on a grid of negative quantiles, with McClish's rescaling."""
    xs = [alpha * k / (grid - 1) for k in range(grid)]
    cuts = df.where(F.col(label) == 0).agg(F.percentile(score, F.array(*[F.lit(1 - x) for x in xs])).alias("q")).select(F.posexplode("q").alias("k", "cut"))
    tpr = df.where(F.col(label) == 1).crossJoin(F.broadcast(cuts)).groupBy("k").agg(F.avg((F.col(score) >= F.col("cut")).cast("double")).alias("tpr"))
    area = tpr.agg(F.sum(F.col("tpr") * F.when(F.col("k").isin(0, grid - 1), 0.5).otherwise(1.0)).alias("s"))
    raw = F.col("s") * alpha / (grid - 1)
    low = alpha * alpha / 2
    return area.select(raw.alias("partial_auc"), (0.5 * (1 + (raw - low) / (alpha - low))).alias("standardised"))


# --- uncertainty and deferral -------------------------------------------------------------------


def decompose(df: DataFrame, members: str) -> DataFrame:
    """Total, aleatoric and epistemic uncertainty of an array of member probabilities."""
    n = F.size(members)
    mean = F.aggregate(members, F.lit(0.0), lambda a, x: a + x) / n
    aleatoric = F.aggregate(F.transform(members, lambda x: binary_entropy(x)), F.lit(0.0), lambda a, x: a + x) / n
    out = df.withColumns({"total": binary_entropy(mean), "aleatoric": aleatoric})
    return out.withColumn("epistemic", F.greatest(F.col("total") - F.col("aleatoric"), F.lit(0.0)))


def defer_top(df: DataFrame, value: str, key: str, budget: int) -> DataFrame:
    """Adds deferred: the ``budget`` rows with the largest value, ties by key."""
    chosen = df.orderBy(F.desc(value), key).limit(budget).select(F.col(key).alias("_k"))
    return df.join(chosen.withColumn("deferred", F.lit(True)), F.col(key) == F.col("_k"), "left").withColumn("deferred", F.coalesce("deferred", F.lit(False))).drop("_k")


def deferral_advantage(score: Column, flagged: Column, skill: Column, false_alarm: float, miss: float, review: float) -> Column:
    """Expected gain of asking an analyst."""
    model = F.when(flagged, false_alarm * (1 - score)).otherwise(miss * score)
    return model - (1 - skill) * (miss * score + false_alarm * (1 - score)) - review


def system_cost(df: DataFrame, y: str, model: str, human: str, deferred: str, false_alarm: float, miss: float, review: float) -> DataFrame:
    """Cost per row of a team in which deferred rows get the analyst's verdict."""
    said = F.when(F.col(deferred), F.col(human)).otherwise(F.col(model))
    cost = F.when((said == 1) & (F.col(y) == 0), false_alarm).when((said == 0) & (F.col(y) == 1), miss).otherwise(0.0) + F.when(F.col(deferred), review).otherwise(0.0)
    return df.agg(F.avg(cost).alias("cost"), F.avg(F.col(deferred).cast("double")).alias("deferred"))


# --- slices and bins ----------------------------------------------------------------------------


def slice_scores(df: DataFrame, slices: Mapping[str, Column], loss: str) -> DataFrame:
    """Per slice: size, mean loss inside and outside, and Welch's t of the difference (null under two rows a side).

    All slices are scored in one scan.
    """
    parts = []
    for name, inside in slices.items():
        x, o = F.when(inside, F.col(loss)), F.when(~inside, F.col(loss))
        parts.append(F.struct(F.lit(name).alias("slice"), F.count(x).alias("n"), F.avg(x).alias("inside"), F.avg(o).alias("outside"), F.var_samp(x).alias("v"), F.var_samp(o).alias("w"), F.count(o).alias("m")).alias(f"_{len(parts)}"))
    row = df.agg(*parts).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(parts))])))
    se = F.sqrt(F.col("v") / F.col("n") + F.col("w") / F.col("m"))
    return row.select("slice", "n", "inside", "outside", F.when((F.col("n") > 1) & (F.col("m") > 1) & (se > 0), (F.col("inside") - F.col("outside")) / se).alias("t"))


def bin_rates(df: DataFrame, value: str, hit: str, edges: Sequence[float]) -> DataFrame:
    """Rate per bin between edges (left-closed; the last closed on both sides); rows outside are left out."""
    k = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return df.where(F.col(value).between(edges[0], edges[-1])).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("rate"))


def composition_counterfactual(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target's overall rate had its bins the source's rates (bins: bin, n, rate)."""
    both = target.join(source.select("bin", F.col("rate").alias("source_rate")), "bin")
    return both.agg((F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("observed"), (F.sum(F.col("n") * F.col("source_rate")) / F.sum("n")).alias("counterfactual"))


def tumbling_coverage(df: DataFrame, by: Sequence[str], order: Sequence[str], covered: str, keep: Column, width: int) -> DataFrame:
    """Coverage of chosen rows in consecutive windows of ``width`` rows; a last partial window, and windows without such rows, are left out."""
    place = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / width
    held = df.withColumn("_w", F.floor(place)).withColumn("_k", keep)
    per = held.groupBy(*by, F.col("_w").alias("window")).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.when(F.col("_k"), F.col(covered).cast("double"))).alias("coverage"))
    return per.where((F.col("_n") == width) & F.col("coverage").isNotNull()).drop("_n")


# --- thresholds over time -----------------------------------------------------------------------


def trailing_thresholds(df: DataFrame, batch: str, window: int, target: float, fallback: float, score: str = "score", label: str = "y") -> DataFrame:
    """Batch i's threshold at an FPR budget, from batches i - window to i - 1; the fallback where they lack a class.

    Tie groups per batch are replicated to the batches that look back at them
    (``window`` times at most), then run up per target batch.
    """
    ties = df.groupBy(F.col(batch).alias("_b"), F.col(score).alias("score")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    ahead = ties.withColumn("_b", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + window))).groupBy("_b", "score").agg(F.sum("pos").cast("long").alias("pos"), F.sum("neg").cast("long").alias("neg"))
    down = Window.partitionBy("_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_b")
    ran = ahead.withColumns({"_fp": F.sum("neg").over(down), "_n": F.sum("neg").over(whole), "_p": F.sum("pos").over(whole)})
    cut = ran.where("_n > 0 and _p > 0").groupBy("_b").agg(F.coalesce(F.min(F.when(F.col("_fp") / F.col("_n") <= target, F.col("score"))), F.lit(float("inf"))).alias("_t"))
    batches = df.select(F.col(batch)).distinct()
    return batches.join(F.broadcast(cut), F.col(batch) == F.col("_b"), "left").select(batch, F.coalesce("_t", F.lit(float(fallback))).alias("threshold"))


def best_expert(losses: DataFrame, segment: str, expert: str, loss: str) -> DataFrame:
    """The expert with the lowest total loss per segment, ties by name."""
    total = losses.groupBy(segment, expert).agg(F.sum(loss).alias("total"))
    return total.groupBy(segment).agg(F.min(F.struct("total", expert)).alias("b")).select(segment, F.col(f"b.{expert}").alias("best"), F.col("b.total").alias("total"))


def best_threshold_reward(df: DataFrame, reward: str, score: str = "score", idle: bool = True) -> DataFrame:
    """The prefix of descending scores, cut at tie-group ends, with the largest total reward; of equal ones the shortest.

    With ``idle``, nothing is acted on where no prefix pays: an infinite
    threshold and no reward. Without it the best prefix is returned at a loss
    too, and an empty table has none.
    """
    ties = df.groupBy(F.col(score).alias("score")).agg(F.sum(reward).alias("g"))
    ran = cumulative(ties, "score", ["g"], descending=True)
    best = ran.agg(F.max(F.struct("cum_g", F.col("score"))).alias("b"))
    if not idle:
        return best.where("b is not null").select(F.col("b.score").alias("threshold"), F.col("b.cum_g").alias("reward"))
    pays = F.col("b.cum_g") > 0
    return best.select(F.when(pays, F.col("b.score")).otherwise(float("inf")).alias("threshold"), F.when(pays, F.col("b.cum_g")).otherwise(0.0).alias("reward"))


def online_pvalues(df: DataFrame, by: Sequence[str], order: Sequence[str], score: str, theta: Column) -> DataFrame:
    """Adds p: the smoothed rank of each score among those before it and itself.

    Equi-join on the stream, then a comparison with earlier rows only: quadratic
    in a stream's length, so streams should be sliced first.
    """
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    a = df.withColumns({"_n": n, "_t": theta})
    b = a.select(*by, F.col("_n").alias("_m"), F.col(score).alias("_s"))
    joined = a.join(b, list(by)).where("_m <= _n")
    per = joined.groupBy(*by, "_n").agg(F.count_if(F.col("_s") > F.col(score)).alias("_gt"), F.count_if(F.col("_s") == F.col(score)).alias("_eq"))
    return a.join(per, [*by, "_n"]).withColumn("p", (F.col("_gt") + F.col("_t") * F.col("_eq")) / F.col("_n")).drop("_n", "_t", "_gt", "_eq")


# --- comparisons of models ----------------------------------------------------------------------


def paired_difference(df: DataFrame, key: str, a: str, b: str, replicates: int, alpha: float, seed: int) -> DataFrame:
    """Bootstrap of mean(b) - mean(a) on shared Poisson weights: interval, and the share of differences at or below 0."""
    diff = df.select(key, (F.col(b) - F.col(a)).alias("value"))
    u = F.pmod(mix32(F.col(key)) + F.col("b") * 40503 * seed + (F.col(key) % 1009) * F.col("b") * 7919, F.lit(1 << 32)) / float(1 << 32)
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    w = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    drawn = diff.crossJoin(F.broadcast(df.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "b"))).withColumn("w", w)
    means = drawn.groupBy("b").agg((F.sum(F.col("w") * F.col("value")) / F.when(F.sum("w") > 0, F.sum("w"))).alias("m"))
    return means.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"), F.coalesce(F.avg((F.col("m") <= 0).cast("double")), F.lit(1.0)).alias("p"))


def fidelity(df: DataFrame, teacher: str, student: str, t_cut: float, s_cut: float) -> DataFrame:
    """Spearman correlation of two scores (0 if one is constant) and the agreement of their decisions."""
    a = rk.tie_average_rank(df, teacher).select(teacher, F.col("rank").alias("_x"))
    b = rk.tie_average_rank(df, student).select(student, F.col("rank").alias("_y"))
    both = df.join(a, teacher).join(b, student)
    agree = ((F.col(teacher) >= t_cut) == (F.col(student) >= s_cut)).cast("double")
    return both.agg(F.when((F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0), F.corr("_x", "_y")).otherwise(0.0).alias("spearman"), F.avg(agree).alias("agreement"))


def importance_stability(df: DataFrame, run: str, feature: str, importance: str, k: int) -> DataFrame:
    """Per feature over refits: mean importance, mean and spread of its rank, share of runs in the top ``k``."""
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(importance), feature))
    return df.withColumn("_r", rank).groupBy(feature).agg(F.avg(importance).alias("mean"), F.avg("_r").alias("mean_rank"), F.stddev_pop("_r").alias("rank_sd"), F.avg((F.col("_r") <= k).cast("double")).alias("top_share"))


def partial_dependence(df: DataFrame, feature: str, grid: DataFrame, model: Column) -> DataFrame:
    """Mean model output with a feature set to each grid value (column ``value``); the model is an expression."""
    forced = df.drop(feature).crossJoin(F.broadcast(grid.withColumnRenamed("value", feature)))
    return forced.groupBy(feature).agg(F.avg(model).alias("mean"))


# --- perturbations ------------------------------------------------------------------------------


def mimicry(df: DataFrame, centre: Mapping[str, float], share: float) -> DataFrame:
    """Move controllable columns a share of the way to the benign centre."""
    return df.withColumns({c: F.col(c) + share * (F.lit(float(v)) - F.col(c)) for c, v in centre.items()})


def rescale_clock(df: DataFrame, times: Sequence[str], rates: Sequence[str], factor: float) -> DataFrame:
    return df.withColumns({**{c: F.col(c) * factor for c in times}, **{c: F.col(c) / factor for c in rates}})


def apply_fault(df: DataFrame, columns: Sequence[str], mode: str, key: str) -> DataFrame:
    """'missing' (null), 'stuck' (0) or 'shuffled' (one permutation of the whole block, by hash order; ``key`` is a number)."""
    if mode == "missing":
        return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})
    if mode == "stuck":
        return df.withColumns({c: F.lit(0).cast(df.schema[c].dataType) for c in columns})
    if mode != "shuffled":
        raise ValueError(f"unknown fault {mode}")
    there = position(df.select(mix32(F.col(key)).alias("_h"), F.col(key).alias("_k"), *columns), ["_h", "_k"], name="_i")
    here = position(df.drop(*columns), [key], name="_i")
    return here.join(there.drop("_h", "_k"), "_i").select(*df.columns)


def flip_rate(df: DataFrame, before: str, after: str, threshold: float) -> DataFrame:
    """Share of verdicts that change, and the largest change of a score."""
    flips = ((F.col(before) >= threshold) != (F.col(after) >= threshold)).cast("double")
    return df.agg(F.avg(flips).alias("flip_rate"), F.max(F.abs(F.col(after) - F.col(before))).alias("max_delta"))


def decision_latency(df: DataFrame, duration: str, teardown: Column, tier: str, timeout: int, horizon: int) -> DataFrame:
    """Microseconds until a verdict can be given: at the handshake, in flight, or when the flow is complete."""
    full = F.col(duration) + F.when(teardown, 0).otherwise(timeout)
    value = {"handshake": F.lit(0).cast("double"), "in_flight": F.least(F.col(duration), F.lit(float(horizon))), "complete": full}[tier]
    return df.withColumn("latency_us", value)


def detected_within(df: DataFrame, detected: str, latency: str, horizons: DataFrame) -> DataFrame:
    """Share of all rows detected within each horizon (column ``seconds``)."""
    hit = F.col(detected) & (F.col(latency) <= F.col("seconds") * 1e6)
    return df.crossJoin(F.broadcast(horizons)).groupBy("seconds").agg(F.avg(hit.cast("double")).alias("share"))


def canary(stored: DataFrame, now: DataFrame, key: str, score: str, tolerance: float) -> DataFrame:
    """Whether rescored rows agree with their stored scores; a missing row fails."""
    both = stored.select(key, F.col(score).alias("_was")).join(now.select(key, F.col(score).alias("_is")), key, "left")
    gap = F.max(F.coalesce(F.abs(F.col("_is") - F.col("_was")), F.lit(float("inf"))))
    return both.agg(gap.alias("max_delta"), F.coalesce(gap <= tolerance, F.lit(True)).alias("ok"))


def mmd2(x: DataFrame, y: DataFrame, key: str, value: str, gamma: float, most: int = 500) -> DataFrame:
    """Unbiased squared MMD with an RBF kernel on ``most`` rows a side, picked by hash; the sample is the feature."""

    def some(df: DataFrame, side: int) -> DataFrame:
        return df.orderBy(mix32(F.col(key)), key).limit(most).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.lit(side).alias("s"))

    z = some(x, 1).unionByName(some(y, 0))
    pairs = z.crossJoin(F.broadcast(z.select(F.col("k").alias("k2"), F.col("v").alias("v2"), F.col("s").alias("s2")))).where("s <> s2 or k <> k2")
    k = F.exp(-gamma * F.pow(F.col("v") - F.col("v2"), 2))
    part = lambda a, b: F.avg(F.when((F.col("s") == a) & (F.col("s2") == b), k))
    return pairs.agg((part(1, 1) + part(0, 0) - 2 * part(1, 0)).alias("mmd2"))
