"""Feature pipelines, classifiers, calibrators, detectors and their stored form."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import clamp, mix32
from tidemark.operators import ranking as rk


def feature_pipeline(numeric: Sequence[str], categorical: str | None = None, scaler: str = "standard", categories: int = 32) -> Pipeline:
    """Median impute and scale, optionally one-hot a port; only these columns reach ``features``. Fit on train only."""
    held = [f"{c}__in" for c in numeric]
    stages: list = [Imputer(strategy="median", inputCols=list(numeric), outputCols=held), VectorAssembler(inputCols=held, outputCol="raw", handleInvalid="keep")]
    last = "raw"
    if scaler != "none":
        stages.append(StandardScaler(inputCol="raw", outputCol="scaled", withMean=True) if scaler == "standard" else RobustScaler(inputCol="raw", outputCol="scaled", withCentering=True))
        last = "scaled"
    if categorical:
        stages += [StringIndexer(inputCol=categorical, outputCol="cat_index", handleInvalid="keep"), OneHotEncoder(inputCol="cat_index", outputCol="cat", handleInvalid="keep")]
        stages.append(VectorAssembler(inputCols=[last, "cat"], outputCol="features"))
    else:
        stages.append(VectorAssembler(inputCols=[last], outputCol="features"))
    return Pipeline(stages=stages)


def classifier(kind: str, label: str = "y", **params: object) -> object:
    """'logistic', 'forest' or 'boosted'; rows weigh by column ``weight`` where asked for."""
    kinds = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier}
    return kinds[kind](labelCol=label, featuresCol="features", seed=7, **params) if kind != "logistic" else LogisticRegression(labelCol=label, featuresCol="features", **params)


def balance_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Adds weight: n / (classes * n_class), so that classes weigh alike."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    both = n.crossJoin(F.broadcast(n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))))
    return df.join(F.broadcast(both), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def attack_probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


class Calibrator:
    """Isotonic or Platt map from score to probability; identity when a class is missing."""

    def __init__(self, method: str = "isotonic") -> None:
        self.method, self.x, self.y = method, [], []
        self.a = self.b = None

    def fit(self, df: DataFrame, score: str = "score", label: str = "y") -> Calibrator:
        if df.select(label).distinct().count() < 2:
            return self
        if self.method == "isotonic":
            model = IsotonicRegression(labelCol=label, featuresCol=score).fit(df.select(F.col(score).cast("double"), F.col(label).cast("double")))
            self.x, self.y = model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()
        else:
            rows = VectorAssembler(inputCols=[score], outputCol="features").transform(df.select(score, F.col(label).cast("double").alias(label)))
            model = LogisticRegression(labelCol=label).fit(rows)
            self.a, self.b = float(model.coefficients[0]), float(model.intercept)
        return self

    def apply(self, score: Column) -> Column:
        """Clipped to [0, 1]; outside the fitted range the end values hold."""
        if self.a is not None:
            return clamp(1 / (1 + F.exp(-(self.a * score + self.b))), 0, 1)
        if not self.x:
            return clamp(score, 0, 1)
        xs, ys = (F.array(*[F.lit(float(v)) for v in vs]) for vs in (self.x, self.y))
        k = F.size(F.filter(xs, lambda e: e <= score))
        x0, x1, y0, y1 = (F.try_element_at(a, i) for a, i in ((xs, k), (xs, k + 1), (ys, k), (ys, k + 1)))
        inner = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (score - x0) / (x1 - x0))
        return clamp(F.when(k == 0, ys[0]).when(k >= len(self.x), ys[len(self.y) - 1]).otherwise(inner), 0, 1)


# --- detectors: fitted on benign rows, larger scores are stranger -------------------------------


@dataclass
class Mahalanobis:
    """Distance under a shrunk covariance."""

    mean: np.ndarray
    inverse: np.ndarray

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], shrink: float = 0.1) -> Mahalanobis:
        """Mean and covariance are one aggregation of k * (k + 3) / 2 sums."""
        k = len(features)
        cols = [F.col(c).cast("double") for c in features]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c) for c in cols], *[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).first()
        cov = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[1 + k :], strict=True):
            cov[i, j] = cov[j, i] = v
        cov = (1 - shrink) * cov + shrink * np.eye(k) * max(np.trace(cov) / k, 1e-12)
        return Mahalanobis(np.array(row[1 : 1 + k]), np.linalg.inv(cov))

    def score(self, features: Sequence[str]) -> Column:
        gap = [F.col(c).cast("double") - float(m) for c, m in zip(features, self.mean, strict=True)]
        square = sum((float(self.inverse[i, j]) * gap[i] * gap[j] for i in range(len(gap)) for j in range(len(gap))), F.lit(0.0))
        return F.sqrt(F.greatest(square, F.lit(0.0)))


@dataclass
class PcaResidual:
    """Distance from the leading principal subspace."""

    mean: np.ndarray
    basis: np.ndarray

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], k: int) -> PcaResidual:
        rows = VectorAssembler(inputCols=list(features), outputCol="v").transform(df)
        mean = rows.select(Summarizer.mean(F.col("v"))).first()[0].toArray()
        return PcaResidual(mean, PCA(k=k, inputCol="v", outputCol="p").fit(rows).pc.toArray())

    def score(self, features: Sequence[str]) -> Column:
        gap = F.array(*[F.col(c).cast("double") - float(m) for c, m in zip(features, self.mean, strict=True)])
        axes, rows = (F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in m]) for m in (self.basis.T, self.basis))

        def total(parts: Column) -> Column:
            return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

        def dot(a: Column, b: Column) -> Column:
            return total(F.zip_with(a, b, lambda x, y: x * y))

        # arrays of one element, so that the row's gaps and parts are worked out once and not for each feature
        def length(g: Column) -> Column:
            parts = F.array(F.transform(axes, lambda axis: dot(g, axis)))
            return F.transform(parts, lambda p: F.sqrt(total(F.zip_with(g, rows, lambda x, r: F.pow(x - dot(r, p), 2)))))[0]

        return F.transform(F.array(gap), length)[0]


@dataclass
class IsolationForest:
    """Random isolation trees over a bounded, seeded sample (Liu, Ting and Zhou)."""

    trees: list
    size: int

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], key: str, trees: int = 100, size: int = 256, seed: int = 7) -> IsolationForest:
        """``trees * size`` rows at most reach the driver, picked by a hash of the key."""
        need = trees * size
        rows = df.orderBy(mix32(F.col(key) + seed), key).limit(need).select(*[F.col(c).cast("double") for c in features]).collect()
        data, rng = np.array(rows, dtype=float), np.random.default_rng(seed)
        size = min(size, len(data))
        deepest = math.ceil(math.log2(max(size, 2)))

        def grow(x: np.ndarray, depth: int) -> tuple:
            spread = x.max(axis=0) > x.min(axis=0) if len(x) else np.zeros(data.shape[1], bool)
            if depth >= deepest or len(x) <= 1 or not spread.any():
                return (depth + _average_path(len(x)),)
            f = int(rng.choice(np.flatnonzero(spread)))
            cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            left = x[:, f] < cut
            return f, cut, grow(x[left], depth + 1), grow(x[~left], depth + 1)

        return IsolationForest([grow(data[rng.choice(len(data), size, replace=False)], 0) for _ in range(trees if len(data) else 0)], size)

    def transform(self, df: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
        """Adds the anomaly score in (0, 1]; trees travel with the tasks, rows in Arrow batches."""
        trees, normal = self.trees, max(_average_path(self.size), 1e-9)
        names = df.columns

        def depth(tree: tuple, x: np.ndarray) -> np.ndarray:
            if len(tree) == 1:
                return np.full(len(x), tree[0])
            f, cut, left, right = tree
            under, found = x[:, f] < cut, np.empty(len(x))
            found[under], found[~under] = depth(left, x[under]), depth(right, x[~under])
            return found

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.stack([np.nan_to_num(np.array(b.column(len(names) + i).to_pylist(), dtype=float)) for i in range(len(features))], axis=1) if b.num_rows else np.empty((0, len(features)))
                mean = np.mean([depth(t, x) for t in trees], axis=0) if trees else np.full(len(x), normal)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(2.0 ** (-mean / normal))], names=[*names, out])

        schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) + f", {out} double"
        return df.select("*", *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)]).mapInArrow(score, schema)


def _average_path(n: int) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def detector_threshold(benign: DataFrame, fpr: float, score: str = "score") -> float:
    """The (1 - fpr) quantile of benign scores."""
    return float(benign.agg(F.percentile(score, 1 - fpr)).first()[0])


# --- the deployable bundle ----------------------------------------------------------------------


def with_thresholds(df: DataFrame, service: str, by_service: DataFrame, default: float) -> DataFrame:
    """Adds threshold: the row's service's (a table service, threshold with a row a service), else the default."""
    dim = F.broadcast(by_service.select(F.col("service").alias(service), F.col("threshold").alias("_t")))
    return df.join(dim, service, "left").withColumn("threshold", F.coalesce("_t", F.lit(default))).drop("_t")


@dataclass
class Bundle:
    """Features, model, calibration and thresholds of one deployment."""

    model: PipelineModel
    calibrator: Calibrator
    thresholds: dict[str, float]
    features: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds attack_probability; missing feature columns are null and get imputed."""
        have = set(df.columns)
        frame = df.withColumns({c: F.lit(None).cast("double") for c in self.features if c not in have})
        raw = self.model.transform(frame.withColumns({c: F.col(c).cast("double") for c in self.features}))
        return raw.select(*df.columns, self.calibrator.apply(attack_probability()).alias("attack_probability"))

    def predict(self, df: DataFrame, profile: str, service: str | None = None, by_service: DataFrame | None = None) -> DataFrame:
        """The serving contract: probability, threshold of the profile (or the row's service), decision, class, action."""
        out = self.score(df)
        if service and by_service is not None:
            out = with_thresholds(out, service, by_service, self.thresholds[profile])
        else:
            out = out.withColumn("threshold", F.lit(self.thresholds[profile]))
        attack = F.col("attack_probability") >= F.col("threshold")
        return out.withColumns({"is_attack": attack, "predicted_class": F.when(attack, "attack").otherwise("benign"), "recommended_action": F.when(attack, "alert").otherwise("allow")})

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        side = {"method": self.calibrator.method, "x": self.calibrator.x, "y": self.calibrator.y, "a": self.calibrator.a, "b": self.calibrator.b, "thresholds": self.thresholds, "features": self.features}
        spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/side")

    @staticmethod
    def load(path: str) -> Bundle:
        side = json.loads(SparkSession.getActiveSession().read.text(f"{path}/side").first()[0])
        cal = Calibrator(side["method"])
        cal.x, cal.y, cal.a, cal.b = side["x"], side["y"], side["a"], side["b"]
        return Bundle(PipelineModel.load(f"{path}/model"), cal, side["thresholds"], side["features"])


def train_bundle(train: DataFrame, val: DataFrame, features: Sequence[str], kind: str = "boosted", label: str = "y", budgets: dict[str, float] | None = None, **params: object) -> Bundle:
    """Fit on train, calibrate and choose thresholds at FPR budgets on validation."""
    prepared = balance_weights(train.withColumns({c: F.col(c).cast("double") for c in features}), label)
    model = Pipeline(stages=[feature_pipeline(features), classifier(kind, label, weightCol="weight", **params)]).fit(prepared)
    bundle = Bundle(model, Calibrator("none"), {}, list(features))
    scored = bundle.score(val).withColumnRenamed("attack_probability", "score")
    bundle.calibrator = Calibrator("platt").fit(scored, "score", label)
    final = bundle.score(val).withColumnRenamed("attack_probability", "score")
    roc = rk.roc_frame(final, "score", label)
    bundle.thresholds = {name: rk.threshold_at_fpr(roc, fpr).first()["threshold"] for name, fpr in (budgets or {"default": 0.01}).items()}
    return bundle


def promote(metrics: DataFrame, least_gain: float = 0.0, most_loss: float = 0.01) -> DataFrame:
    """Whether a challenger goes live: its main metric gains and no guarded one loses more than allowed; rows (metric, delta, guarded)."""
    return metrics.agg((F.min(F.when(~F.col("guarded"), F.col("delta"))) >= least_gain).alias("gains"), (F.coalesce(F.min(F.when(F.col("guarded"), F.col("delta"))), F.lit(0.0)) >= -most_loss).alias("holds")).select((F.col("gains") & F.col("holds")).alias("promote"))


def tune(train: DataFrame, val: DataFrame, features: Sequence[str], candidates: Sequence[dict], label: str = "y") -> tuple[dict, list[float]]:
    """The candidate ({'kind': ..., parameters}) with the best average precision on validation; ties go to the first."""
    prepared = balance_weights(train.withColumns({c: F.col(c).cast("double") for c in features}), label).cache()
    scores = []
    for c in candidates:
        params = {k: v for k, v in c.items() if k != "kind"}
        model = Pipeline(stages=[feature_pipeline(features), classifier(c["kind"], label, weightCol="weight", **params)]).fit(prepared)
        scored = Bundle(model, Calibrator("none"), {}, list(features)).score(val).withColumnRenamed("attack_probability", "score")
        scores.append(rk.average_precision(rk.roc_frame(scored, "score", label)).first()[0])
    prepared.unpersist()
    return candidates[max(range(len(scores)), key=lambda i: (scores[i], -i))], scores


def out_of_fold(df: DataFrame, key: str, features: Sequence[str], folds: int = 3, kind: str = "logistic", label: str = "y", **params: object) -> DataFrame:
    """Scores from models that never saw the row: folds by a hash of the key; adds attack_probability."""
    held = df.withColumn("_fold", F.pmod(mix32(F.col(key)), F.lit(folds)))
    out = None
    for i in range(folds):
        part = balance_weights(held.where(F.col("_fold") != i).withColumns({c: F.col(c).cast("double") for c in features}), label)
        model = Pipeline(stages=[feature_pipeline(features), classifier(kind, label, weightCol="weight", **params)]).fit(part)
        scored = Bundle(model, Calibrator("none"), {}, list(features)).score(held.where(F.col("_fold") == i).drop("_fold"))
        out = scored if out is None else out.unionByName(scored)
    return out


def leave_one_class_out(df: DataFrame, label_class: str, benign: str, features: Sequence[str], fpr: float, part: str = "part") -> list[tuple[str, float]]:
    """Detection of each attack class by a benign-only detector at an FPR budget: (class, share), classes by name."""
    good = df.where((F.col(label_class) == benign) & (F.col(part) != "test"))
    model = Mahalanobis.fit(good, features)
    cut = detector_threshold(good.select(model.score(features).alias("score")), fpr)
    rows = df.where(F.col(label_class) != benign).groupBy(label_class).agg(F.avg((model.score(features) >= cut).cast("double")).alias("d")).orderBy(label_class).collect()
    return [(r[label_class], r["d"]) for r in rows]
