"""Compositions of models with the other operators: families, curves, weights, surrogates, deployments."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import mix32
from tidemark.operators import context as cx
from tidemark.operators import drift as dr
from tidemark.operators import explain as xp
from tidemark.operators import flows as fl
from tidemark.operators import models as md
from tidemark.operators import ranking as rk
from tidemark.operators.cleaning import subsample

Score = Callable[[DataFrame], DataFrame]


def score_capture(packets: DataFrame, score: Score, timeout_us: int = 120_000_000) -> DataFrame:
    """Packets to flows to scores; a flow's addresses, ports and times stay in its row, so nothing is matched up afterwards."""
    return score(fl.flow_features(fl.assign_flows(packets, timeout_us)))


def evaluate_family(kind: str, train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], label: str = "y", fprs: Sequence[float] = (0.001, 0.01), **params: object) -> DataFrame:
    """One row for a family of models: average precision and ROC AUC on test, and TPR and FPR there at thresholds chosen on validation."""
    names = {f"fpr_{f:g}": f for f in fprs}
    bundle = md.train_bundle(train, val, features, kind, label, names, **params)
    scored = bundle.score(test).select(F.col("attack_probability").alias("score"), F.col(label).alias("y"))
    roc = rk.roc_frame(scored)
    out = rk.average_precision(roc).toDF("average_precision").crossJoin(F.broadcast(rk.roc_auc(roc).toDF("roc_auc")))
    rate = lambda cut, y: F.avg(F.when(F.col("y") == y, (F.col("score") >= cut).cast("double")))
    points = scored.agg(*[rate(bundle.thresholds[n], y).alias(f"{side}_at_{n}") for n in names for side, y in (("tpr", 1), ("fpr", 0))])
    return out.crossJoin(F.broadcast(points)).select(F.lit(kind).alias("family"), "*")


def learning_curve(train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], key: str, label: str, fractions: Sequence[float], kind: str = "logistic", **params: object) -> DataFrame:
    """(fraction, rows, average_precision): the same family on growing, nested parts of the training rows."""
    out = None
    for f in fractions:
        part = subsample(train, label, key, f) if f < 1 else train
        row = evaluate_family(kind, part, val, test, features, label, (0.01,), **params)
        one = row.select(F.lit(float(f)).alias("fraction"), F.lit(part.count()).alias("rows"), "average_precision")
        out = one if out is None else out.unionByName(one)
    return out


def domain_ratio(train: DataFrame, test: DataFrame, features: Sequence[str], key: str, folds: int = 3, clip: float = 20.0, kind: str = "logistic", **params: object) -> tuple[DataFrame, float]:
    """Training rows with weight p / (1 - p) * n_train / n_test, cut to [0, clip], and the AUC of the scores behind it.

    p is the chance of being a test row by models that never saw the row.
    """
    both = train.withColumn("y", F.lit(0)).select("y", key, *features).unionByName(test.withColumn("y", F.lit(1)).select("y", key, *features))
    scored = md.out_of_fold(both, key, features, folds, kind, "y", **params)
    n = {r["y"]: r["count"] for r in both.groupBy("y").count().collect()}
    auc = rk.roc_auc(rk.roc_frame(scored.select(F.col("attack_probability").alias("score"), "y"))).first()[0]
    p = F.col("attack_probability")
    odds = F.when(p < 1, p / (1 - p) * (n.get(0, 0) / max(1, n.get(1, 0)))).otherwise(clip)
    weights = scored.where("y = 0").select(key, F.greatest(F.lit(0.0), F.least(F.lit(clip), odds)).alias("weight"))
    return train.join(weights, key), auc


def reward_model(log: DataFrame, features: Sequence[str], reviewed: str, attack: str, gain: float, cost: float, **params: object) -> Callable[[DataFrame], DataFrame]:
    """The expected reward of a review, learned from reviewed rows only; adds reward."""
    seen = md.balance_weights(log.where(F.col(reviewed)).withColumns({c: F.col(c).cast("double") for c in features}), attack).withColumn("weight", F.lit(1.0))
    model = Pipeline(stages=[md.feature_pipeline(features), md.classifier("logistic", attack, weightCol="weight", **params)]).fit(seen)

    def apply(df: DataFrame) -> DataFrame:
        p = md.Bundle(model, md.Calibrator("none"), {}, list(features)).score(df)
        return p.withColumn("reward", F.col("attack_probability") * gain - (1 - F.col("attack_probability")) * cost).drop("attack_probability")

    return apply


def surrogate(queries: DataFrame, features: Sequence[str], answer: str, kind: str = "forest", **params: object) -> Score:
    """A model of a victim's answers (0 or 1), fitted on queried rows; adds attack_probability."""
    rows = queries.withColumns({c: F.col(c).cast("double") for c in features}).withColumn("weight", F.lit(1.0))
    model = Pipeline(stages=[md.feature_pipeline(features), md.classifier(kind, answer, weightCol="weight", **params)]).fit(rows)
    return md.Bundle(model, md.Calibrator("none"), {}, list(features)).score


def pca_encoder(pool: DataFrame, features: Sequence[str], k: int) -> Score:
    """Adds code: the leading ``k`` principal components, fitted on the pool."""
    fitted = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_v"), PCA(k=k, inputCol="_v", outputCol="_p")]).fit(pool)
    return lambda df: fitted.transform(df).withColumn("code", md.vector_to_array("_p")).drop("_v", "_p")


def adversarial_rows(df: DataFrame, y: str, centre: Mapping[str, float], shares: Sequence[float]) -> DataFrame:
    """Copies of the positives whose controllable columns have moved a share of the way to the benign centre, added to all rows."""
    out = df
    for s in shares:
        out = out.unionByName(df.where(F.col(y) == 1).withColumns({c: F.col(c) + s * (F.lit(float(v)) - F.col(c)) for c, v in centre.items()}))
    return out


def interaction_matrix(df: DataFrame, sample: DataFrame, features: Sequence[str], model: Callable[[Mapping[str, Column]], Column]) -> DataFrame:
    """(a, b, h): the interaction of every pair of features."""
    out = None
    for a, b in combinations(features, 2):
        one = xp.h_statistic(df, sample, a, b, features, model).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "h")
        out = one if out is None else out.unionByName(one)
    return out


def importance_matrix(df: DataFrame, features: Sequence[str], key: str, refits: int, label: str = "y", **params: object) -> DataFrame:
    """(refit, feature, importance): impurity importances of forests on resampled rows; a row weighs by a Poisson draw from its key."""
    rows = []
    for b in range(refits):
        u = mix32(F.col(key) * 31 + 7919 * (b + 1)) / float(1 << 32)
        weight = sum((F.when(u >= cut, 1.0).otherwise(0.0) for cut in (0.3678794, 0.7357589, 0.9196986, 0.9810118, 0.9963402)), F.lit(0.0))
        part = df.withColumns({c: F.col(c).cast("double") for c in features}).withColumn("weight", weight).where("weight > 0")
        fitted = Pipeline(stages=[md.feature_pipeline(features, scaler="none"), md.classifier("forest", label, weightCol="weight", **params)]).fit(part)
        rows += [(b, f, float(v)) for f, v in zip(features, fitted.stages[-1].featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "refit int, feature string, importance double")


def models_per_parent(train: DataFrame, test: DataFrame, features: Sequence[str], paths: Mapping[str, Sequence[str]], label: str, **params: object) -> DataFrame:
    """Adds predicted: the leaf that a chain of models reaches, one model for each branching node of a taxonomy.

    ``paths`` maps each label to its path below the root. A node with one child
    takes it; a row's branch is the child with the largest probability.
    """
    nodes: dict[tuple, list[str]] = {}
    for path in paths.values():
        for k in range(len(path)):
            children = nodes.setdefault(tuple(path[:k]), [])
            if path[k] not in children:
                children.append(path[k])
    leaf = {tuple(p): name for name, p in paths.items()}
    at = F.create_map(*[F.lit(x) for name, p in paths.items() for x in (name, "/".join(p))])
    placed = train.withColumns({"_path": at[F.col(label)], **{c: F.col(c).cast("double") for c in features}})
    out = test.withColumn("_at", F.lit(""))
    for node in sorted(nodes, key=len):
        prefix, children = "/".join(node), nodes[node]
        here = F.col("_at") == prefix
        below = lambda c, p=prefix: f"{p}/{c}" if p else c
        if len(children) == 1:
            out = out.withColumn("_at", F.when(here, below(children[0])).otherwise(F.col("_at")))
            continue
        best = None
        for c in children:
            inside = placed.where(F.lit(not prefix) | F.col("_path").startswith(prefix + "/") | (F.col("_path") == prefix))
            rows = inside.withColumns({"_y": (F.col("_path").startswith(below(c) + "/") | (F.col("_path") == below(c))).cast("double"), "weight": F.lit(1.0)})
            model = Pipeline(stages=[md.feature_pipeline(features), md.classifier("logistic", "_y", weightCol="weight", **params)]).fit(rows)
            out = md.Bundle(model, md.Calibrator("none"), {}, list(features)).score(out).withColumnRenamed("attack_probability", f"_p{len(node)}_{children.index(c)}")
            entry = F.struct(F.col(f"_p{len(node)}_{children.index(c)}").alias("p"), F.lit(below(c)).alias("to"))
            best = entry if best is None else F.greatest(best, entry)
        out = out.withColumn("_at", F.when(here, best["to"]).otherwise(F.col("_at"))).drop(*[f"_p{len(node)}_{i}" for i in range(len(children))])
    names = F.create_map(*[F.lit(x) for p, name in leaf.items() for x in ("/".join(p), name)])
    return out.withColumn("predicted", F.try_element_at(names, F.col("_at"))).drop("_at")


def build_deployment(train: DataFrame, val: DataFrame, features: Sequence[str], key: str, label_class: str, path: str, kind: str = "logistic", budgets: Mapping[str, float] | None = None, per_class: int = 20, canaries: int = 50, **params: object) -> md.Bundle:
    """Fit, calibrate and store what serving needs below ``path``: the bundle, the drift reference, exemplars, and canary rows with their scores."""
    bundle = md.train_bundle(train, val, features, kind, "y", dict(budgets or {"default": 0.01}), **params)
    bundle.save(f"{path}/bundle")
    dr.quantile_edges(dr.unpivot(train, features), 10).write.mode("overwrite").parquet(f"{path}/reference")
    cx.exemplars(train.select(key, label_class, *features), label_class, key, per_class).write.mode("overwrite").parquet(f"{path}/exemplars")
    few = val.select(key, *features).orderBy(mix32(F.col(key)), key).limit(canaries)
    bundle.score(few).write.mode("overwrite").parquet(f"{path}/canaries")
    return bundle
