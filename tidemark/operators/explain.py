"""Attribution, anchors, recourse, interactions, and robustness probes of models that are expressions.

A model is a function from a mapping of column name to Column to a Column, so
that each probe is one projection or one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import mix32, safe_rate
from tidemark.operators.models import PcaResidual

Model = Callable[[Mapping[str, Column]], Column]


def _inputs(features: Sequence[str], **set_to: Column) -> dict[str, Column]:
    return {c: set_to.get(c, F.col(c).cast("double")) for c in features}


def occlusion(df: DataFrame, key: str, features: Sequence[str], centre: Mapping[str, float], model: Model) -> DataFrame:
    """key, feature, contribution: the score a row loses when a feature is set to the benign centre. All features in one scan."""
    base = model(_inputs(features))
    parts = [F.struct(F.lit(c).alias("feature"), (base - model(_inputs(features, **{c: F.lit(float(centre[c]))}))).alias("contribution")) for c in features]
    return df.select(key, F.inline(F.array(*parts)))


def deletion_test(df: DataFrame, key: str, features: Sequence[str], centre: Mapping[str, float], model: Model, k: int) -> DataFrame:
    """Mean score drop when each row's k strongest features are reset, and when k features drawn by hash are."""
    long = occlusion(df, key, features, centre, model)
    place = F.create_map(*[F.lit(x) for i, c in enumerate(features) for x in (c, i)])
    w = Window.partitionBy(key)
    ranked = long.withColumns({"_top": F.row_number().over(w.orderBy(F.desc("contribution"), "feature")), "_any": F.row_number().over(w.orderBy(mix32(F.col(key) * 31 + place[F.col("feature")]), "feature"))})
    sets = ranked.groupBy(key).agg(F.collect_set(F.when(F.col("_top") <= k, F.col("feature"))).alias("_t"), F.collect_set(F.when(F.col("_any") <= k, F.col("feature"))).alias("_r"))
    reset = lambda chosen: model({c: F.when(F.array_contains(chosen, c), float(centre[c])).otherwise(F.col(c).cast("double")) for c in features})
    base = model(_inputs(features))
    return df.join(sets, key).agg(F.avg(base - reset("_t")).alias("top_drop"), F.avg(base - reset("_r")).alias("random_drop"))


def recourse(df: DataFrame, features: Sequence[str], movable: Sequence[str], centre: Mapping[str, float], model: Model, threshold: float, steps: int) -> DataFrame:
    """Greedy counterfactual per row: adds moved (features set to the centre, in order), final_score, escaped.

    Each step sets the unused movable feature that lowers the score most and
    stops below the threshold or when none helps; steps unroll into expressions.
    """
    work = df.withColumns({f"_r_{c}": F.col(c).cast("double") for c in features}).withColumn("moved", F.array().cast("array<string>"))
    now = lambda **to: model({c: to.get(c, F.col(f"_r_{c}")) for c in features})
    for _ in range(steps):
        work = work.withColumn("_now", now())
        trials = F.array(*[F.struct(F.when(F.array_contains("moved", c), float("inf")).otherwise(now(**{c: F.lit(float(centre[c]))})).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(movable)])
        work = work.withColumn("_best", F.array_min(trials))
        go = (F.col("_now") >= threshold) & (F.col("_best.s") < F.col("_now"))
        work = work.withColumn("_go", go)
        work = work.withColumns({f"_r_{c}": F.when(F.col("_go") & (F.col("_best.c") == c), float(centre[c])).otherwise(F.col(f"_r_{c}")) for c in movable})
        work = work.withColumn("moved", F.when(F.col("_go"), F.array_append("moved", F.col("_best.c"))).otherwise(F.col("moved")))
    out = work.withColumn("final_score", now())
    return out.withColumn("escaped", F.col("final_score") < threshold).drop("_now", "_best", "_go", *[f"_r_{c}" for c in features])


def anchor(background: DataFrame, bins: Mapping[str, int], target: str, wanted: int, tau: float, most: int, least_rows: int, z: float = 1.645) -> dict:
    """Grow a rule of bin equalities whose precision lower bound reaches ``tau``: features, precision, coverage.

    Each step is one aggregation over all unused features; ties go to the first.
    """

    def bound(hits: int, n: int) -> float:
        if not n:
            return 0.0
        p, z2 = hits / n, z * z
        return (p + z2 / (2 * n) - z * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)

    hit = F.col(target) == wanted
    first = background.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("h")).first()
    total, n, h, chosen = first["n"], first["n"], first["h"], []
    while len(chosen) < most and bound(h, n) < tau:
        rule = [F.col(c) == bins[c] for c in chosen]
        rest = [c for c in bins if c not in chosen]
        held = background
        for r in rule:
            held = held.where(r)
        if not rest:
            break
        row = held.agg(*[F.count_if(F.col(c) == bins[c]) for c in rest], *[F.count_if((F.col(c) == bins[c]) & hit) for c in rest]).first()
        options = [(row[len(rest) + i] / row[i], -i) for i in range(len(rest)) if row[i] >= max(1, least_rows)]
        if not options:
            break
        i = -max(options)[1]
        chosen.append(rest[i])
        n, h = row[i], row[len(rest) + i]
    return {"features": chosen, "precision": h / n if n else 0.0, "coverage": n / total if total else 0.0, "lower": bound(h, n)}


def _dependence(df: DataFrame, points: DataFrame, at: Mapping[str, str], features: Sequence[str], model: Model, name: str) -> DataFrame:
    """Mean of the model over ``df`` with the features of ``at`` set to each distinct value of the points' columns.

    Rows of ``df`` that are equal in the other features are computed once.
    """
    rest = df.groupBy(*[F.col(c) for c in features if c not in at]).agg(F.count(F.lit(1)).alias("_n"))
    wanted = points.select(*at.values()).distinct()
    out = wanted.crossJoin(rest).withColumn("_m", model(_inputs(features, **{c: F.col(v) for c, v in at.items()})))
    return out.groupBy(*at.values()).agg((F.sum(F.col("_m") * F.col("_n")) / F.sum(F.when(F.col("_m").isNotNull(), F.col("_n")))).alias(name))


def h_statistic(df: DataFrame, sample: DataFrame, a: str, b: str, features: Sequence[str], model: Model) -> DataFrame:
    """Friedman's interaction of two features: the share of their joint dependence that the sum of single ones misses.

    ``sample`` holds the points (columns a, b), ``df`` itself for the whole
    table; the mean is over ``df``. The work is distinct points times distinct
    rows of the features that they don't set.
    """
    points = sample.select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    pd = points
    for at, name in (({a: "_a", b: "_b"}, "jk"), ({a: "_a"}, "j"), ({b: "_b"}, "k")):
        found = _dependence(df, points, at, features, model, name).withColumnsRenamed({v: f"{v}_" for v in at.values()})
        same = [F.col(v).eqNullSafe(F.col(f"{v}_")) for v in at.values()]
        pd = pd.join(found, same, "left").drop(*[f"{v}_" for v in at.values()])
    mean = pd.agg(F.avg("jk").alias("m"), F.avg("j").alias("mj"), F.avg("k").alias("mk"))
    c = pd.crossJoin(F.broadcast(mean)).select((F.col("jk") - F.col("m")).alias("x"), (F.col("j") - F.col("mj")).alias("y"), (F.col("k") - F.col("mk")).alias("z"))
    num, den = F.sum(F.pow(F.col("x") - F.col("y") - F.col("z"), 2)), F.sum(F.pow("x", 2))
    return c.agg(F.when(den > 1e-12, F.sqrt(F.least(num / den, F.lit(1.0)))).otherwise(0.0).alias("h"))


def effort_curve(df: DataFrame, features: Sequence[str], centre: Mapping[str, float], efforts: Sequence[float], model: Model, threshold: float) -> DataFrame:
    """Detection of attack rows that move their controllable features (those in ``centre``) a share of the way to benign."""
    moved = {e: model({c: F.col(c).cast("double") + (e * (float(centre[c]) - F.col(c).cast("double")) if c in centre else F.lit(0.0)) for c in features}) for e in efforts}
    parts = F.array(*[F.struct(F.lit(float(e)).alias("effort"), (m >= threshold).cast("double").alias("hit")) for e, m in moved.items()])
    return df.select(F.inline(parts)).groupBy("effort").agg(F.avg("hit").alias("detection"))


def monotone_violations(df: DataFrame, features: Sequence[str], rising: Sequence[str], factors: Sequence[float], model: Model) -> DataFrame:
    """Share of rows whose score falls when any of the ``rising`` features is inflated."""
    base = model(_inputs(features))
    falls = [model(_inputs(features, **{c: F.col(c).cast("double") * f})) < base - 1e-12 for c in rising for f in factors]
    return df.agg(F.avg(F.greatest(*[x.cast("int") for x in falls], F.lit(0)).cast("double")).alias("violations"))


def metamorphic(df: DataFrame, relations: Mapping[str, Callable[[DataFrame], DataFrame]], key: str, score: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Per relation (a change that should not matter): flip rate and largest change of the score. ``score`` adds column score."""
    base = score(df).select(key, F.col("score").alias("_was"))
    out = None
    for name, change in relations.items():
        both = score(change(df)).select(key, "score").join(base, key)
        one = both.agg(F.avg(((F.col("score") >= threshold) != (F.col("_was") >= threshold)).cast("double")).alias("flip_rate"), F.max(F.abs(F.col("score") - F.col("_was"))).alias("max_delta")).select(F.lit(name).alias("relation"), "flip_rate", "max_delta")
        out = one if out is None else out.unionByName(one)
    return out


def stamp_trigger(df: DataFrame, trigger: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in trigger.items()})


def poison(df: DataFrame, key: str, y: str, trigger: Mapping[str, float], rate: float) -> DataFrame:
    """Append floor(n * rate) attack rows, by hash rank, stamped with the trigger and labelled benign; adds poisoned."""
    attacks = df.where(F.col(y) == 1)
    rank = F.row_number().over(Window.partitionBy(y).orderBy(mix32(F.col(key)), key))
    n = F.count(F.lit(1)).over(Window.partitionBy(y))
    chosen = attacks.withColumns({"_r": rank, "_n": n}).where(F.col("_r") <= F.floor(F.col("_n") * rate)).drop("_r", "_n")
    return df.withColumn("poisoned", F.lit(False)).unionByName(stamp_trigger(chosen, trigger).withColumn(y, F.lit(0).cast(df.schema[y].dataType)).withColumn("poisoned", F.lit(True)))


def spectral_scores(df: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    """Adds the squared projection on the leading direction of the centred columns.

    The direction is the first principal component, from one distributed
    covariance of the columns.
    """
    fitted = PcaResidual.fit(df, features, 1)
    part = sum((float(t) * (F.col(c).cast("double") - float(m)) for t, c, m in zip(fitted.basis[:, 0], features, fitted.mean, strict=True)), F.lit(0.0))
    return df.withColumn(out, F.pow(part, 2))


def answered(score: Column, mode: str, digits: int = 2, threshold: float = 0.5) -> Column:
    """What a defended endpoint tells: 'raw', 'rounded' or 'label'."""
    return {"raw": score, "rounded": F.round(score, digits), "label": (score >= threshold).cast("double")}[mode]


def priority_probabilities(df: DataFrame, weight: str, budget: float, floor: float, rounds: int = 20) -> DataFrame:
    """Inclusion probabilities proportional to a weight, floored, capped at 1; what the cap frees is dealt again.

    Every round is one aggregation; a row's probability is an expression of the
    final scale.
    """
    w = F.greatest(F.col(weight).cast("double"), F.lit(1e-12))
    n = df.count()
    target, scale = max(0.0, min(1.0, budget)) * n, 0.0
    capped = -1
    for _ in range(rounds):
        full = w * scale >= 1 if scale else F.lit(False)
        row = df.agg(F.count_if(full).alias("k"), F.sum(F.when(~full, w).otherwise(0.0)).alias("s")).first()
        if row["k"] == capped or not row["s"] or target <= row["k"]:
            break
        capped, scale = row["k"], (target - row["k"]) / row["s"]
    return df.withColumn("probability", F.least(F.lit(1.0), F.greatest(F.lit(float(floor)), w * scale)))


def cascade(df: DataFrame, tiers: Sequence[tuple[str, float, float]], gate: Callable[[Column, float], Column]) -> DataFrame:
    """Escalate through price tiers (score column, threshold, price): adds decision, cost, tier.

    A row moves on while its verdict is in doubt by ``gate``; it pays the price
    of the tier where it stops.
    """
    decision, cost, level = None, None, None
    for i, (score, cut, price) in reversed(list(enumerate(tiers))):
        here = F.col(score) >= cut
        if decision is None:
            decision, cost, level = here, F.lit(float(price)), F.lit(i)
        else:
            doubt = gate(F.col(score), cut)
            decision, cost, level = F.when(doubt, decision).otherwise(here), F.when(doubt, cost).otherwise(float(price)), F.when(doubt, level).otherwise(i)
    return df.withColumns({"decision": decision, "cost": cost, "tier": level})


def retrain_schedule(psi: DataFrame, batch: str, threshold: float, cooldown: int) -> DataFrame:
    """Batches at which a drift trigger retrains: PSI at the threshold and the last retraining at least ``cooldown`` back.

    One row per batch; the state is the last retraining, so rows fold in order.
    """
    rows = psi.agg(F.array_sort(F.collect_list(F.struct(F.col(batch).cast("long").alias("b"), F.col("psi").alias("p")))).alias("rows"))
    start = F.array().cast("array<bigint>")
    fold = F.aggregate("rows", start, lambda fired, r: F.when((r["p"] >= threshold) & ((F.size(fired) == 0) | (r["b"] - F.coalesce(F.try_element_at(fired, F.lit(-1)), F.lit(-(1 << 40))) >= cooldown)), F.array_append(fired, r["b"])).otherwise(fired))
    return rows.select(F.explode(fold).alias(batch))


def fidelity_share(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(safe_rate(F.count_if(F.col(a) == F.col(b)), F.count(F.lit(1))).alias("agreement"))


def beam_slices(df: DataFrame, literals: Mapping[str, Column], loss: str, depth: int, beam: int, least_rows: int) -> DataFrame:
    """The worst slices by Welch's t among conjunctions of literals, level by level; one scan scores a level."""
    from tidemark.operators.evaluation import slice_scores

    seen, front = None, [((), F.lit(True))]
    for _ in range(depth):
        level = {}
        for names, cond in front:
            for name, literal in literals.items():
                if name not in names and (key := tuple(sorted((*names, name)))) not in level:
                    level[key] = cond & literal
        if not level:
            break
        scored = slice_scores(df, {" & ".join(k): c for k, c in level.items()}, loss).where(F.col("n") >= least_rows)
        best = scored.orderBy(F.desc_nulls_last("t"), "slice").limit(beam).collect()
        names_of = {" & ".join(k): k for k in level}
        front = [(names_of[r["slice"]], level[names_of[r["slice"]]]) for r in best if r["t"] is not None]
        rows = [tuple(r) for r in best]
        seen = rows if seen is None else seen + rows
    return df.sparkSession.createDataFrame(seen or [], "slice string, n long, inside double, outside double, t double").orderBy(F.desc_nulls_last("t"), "slice")


def influence(train: DataFrame, test: DataFrame, key: str, features: Sequence[str], weights: Sequence[float], l2: float = 1e-3, label: str = "y") -> DataFrame:
    """key, influence (predicted change of the mean test loss if the row were left out) and self_influence, for a logistic model.

    The Hessian is one aggregation of (k + 1)(k + 2) / 2 sums; scores are expressions.
    """
    cols = [*[F.col(c).cast("double") for c in features], F.lit(1.0)]
    k = len(cols)
    p = 1 / (1 + F.exp(-sum((float(w) * c for w, c in zip(weights, cols, strict=True)), F.lit(0.0))))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = train.agg(F.count(F.lit(1)), *[F.sum(p * (1 - p) * cols[i] * cols[j]) for i, j in pairs]).first()
    n, h = max(1, row[0]), np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        h[i, j] = h[j, i] = v / n
    inverse = np.linalg.inv(h + l2 * np.eye(k))
    gap = p - F.col(label)
    g_test = np.array(test.agg(*[F.avg(gap * c) for c in cols]).first())
    pull = inverse @ g_test
    own = sum((float(inverse[i, j]) * cols[i] * cols[j] for i in range(k) for j in range(k)), F.lit(0.0)) * gap * gap
    return train.select(key, (gap * sum((float(v) * c for v, c in zip(pull, cols, strict=True)), F.lit(0.0)) / n).alias("influence"), own.alias("self_influence"))


def merge_cascade(df: DataFrame, first: str, second: str, forwarded: Column) -> DataFrame:
    """One ranking of a two-stage cascade: forwarded rows keep the second score, the others fill a unit band below the lowest of those, by the first."""
    ends = df.agg(F.min(F.when(forwarded, F.col(second))).alias("_floor"), F.min(F.when(~forwarded, F.col(first))).alias("_lo"), F.max(F.when(~forwarded, F.col(first))).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    place = F.when(span > 0, (F.col(first) - F.col("_lo")) / span).otherwise(0.0)
    below = F.coalesce("_floor", F.lit(0.0)) - 1 - 1e-9 + place * (1 - 1e-9)
    return df.crossJoin(F.broadcast(ends)).withColumn("merged", F.when(forwarded, F.col(second)).otherwise(below)).drop("_floor", "_lo", "_hi")


def independent_difference(a: DataFrame, b: DataFrame, key: str, value: str, replicates: int, alpha: float, seed: int) -> DataFrame:
    """Bootstrap of mean(b) - mean(a) of two samples, each with its own Poisson weights: interval and share at or below 0."""
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)

    def means(df: DataFrame, salt: int, name: str) -> DataFrame:
        u = F.pmod(mix32(F.col(key)) + F.col("r") * 40503 * (seed + salt) + (F.col(key) % 1009) * F.col("r") * 7919, F.lit(1 << 32)) / float(1 << 32)
        w = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
        drawn = df.select(key, F.col(value).alias("_v")).crossJoin(F.broadcast(df.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "r"))).withColumn("_w", w)
        return drawn.groupBy("r").agg((F.sum(F.col("_w") * F.col("_v")) / F.when(F.sum("_w") > 0, F.sum("_w"))).alias(name))

    both = means(a, 0, "a").join(means(b, 101, "b"), "r").withColumn("d", F.col("b") - F.col("a"))
    return both.agg(F.percentile("d", alpha / 2).alias("low"), F.percentile("d", 1 - alpha / 2).alias("high"), F.coalesce(F.avg((F.col("d") <= 0).cast("double")), F.lit(1.0)).alias("p"))
