"""Mergeable summaries of streams (t-digest, Misra-Gries) and an autoencoder without a deep-learning library."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import mix32


class TDigest:
    """Centroids whose sizes shrink towards the tails (Dunning's k1 scale): quantiles with small relative error there."""

    def __init__(self, delta: float = 100.0, means: Sequence[float] = (), weights: Sequence[float] = ()) -> None:
        self.delta = delta
        self.means, self.weights = np.asarray(means, dtype=float), np.asarray(weights, dtype=float)

    def add(self, values: np.ndarray, weights: np.ndarray | None = None) -> TDigest:
        """Merge values, or another digest's centroids."""
        values = np.asarray(values, dtype=float)
        weights = np.ones(len(values)) if weights is None else np.asarray(weights, dtype=float)
        means, sizes = np.concatenate([self.means, values]), np.concatenate([self.weights, weights])
        if not len(means):
            return self
        order = np.argsort(means, kind="stable")
        means, sizes = means[order], sizes[order]
        ends = np.cumsum(sizes) / sizes.sum()
        scale = self.delta / (2 * math.pi) * np.arcsin(np.clip(2 * ends - 1, -1, 1))
        # a centroid takes values while the scale moves on by one step at most
        cuts, at = [0], -self.delta / 4
        while cuts[-1] < len(means):
            end = max(cuts[-1] + 1, int(np.searchsorted(scale, at + 1, side="right")))
            cuts.append(min(end, len(means)))
            at = scale[cuts[-1] - 1]
        first = np.array(cuts[:-1])
        self.weights = np.add.reduceat(sizes, first)
        self.means = np.add.reduceat(means * sizes, first) / self.weights
        return self

    def quantile(self, q: float) -> float:
        """Between the centres of neighbouring centroids; null without values."""
        if not len(self.means):
            return math.nan
        centres = (np.cumsum(self.weights) - self.weights / 2) / self.weights.sum()
        return float(np.interp(q, centres, self.means))


def tdigest_quantiles(df: DataFrame, value: str, shares: Sequence[float], delta: float = 100.0) -> DataFrame:
    """(share, quantile): each task digests its rows, and the digests (some hundred centroids a task) merge in a tree.

    Null and non-finite values are left out.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = TDigest(delta)
        for batch in batches:
            mean, weight = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
            good = np.isfinite(mean)
            held.add(mean[good], weight[good])
        yield pa.RecordBatch.from_arrays([pa.array(held.means), pa.array(held.weights)], names=["mean", "weight"])

    schema = "mean double, weight double"
    parts = df.select(F.col(value).cast("double").alias("mean"), F.lit(1.0).alias("weight")).where("mean is not null").mapInArrow(digest, schema)
    for width in (64, 8, 1):
        parts = parts.coalesce(width).mapInArrow(digest, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = TDigest(delta)
        for batch in batches:
            held.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(list(map(float, shares))), pa.array([held.quantile(q) for q in shares])], names=["share", "quantile"])

    return parts.mapInArrow(read, "share double, quantile double")


class MisraGries:
    """``k`` counters: every key of more than n / (k + 1) rows is among them, and no count is over the true one."""

    def __init__(self, k: int) -> None:
        self.k, self.counts = k, {}

    def add(self, counts: dict) -> MisraGries:
        """Merge counts of keys, or another summary's counters."""
        for key, n in counts.items():
            self.counts[key] = self.counts.get(key, 0) + n
        if len(self.counts) > self.k:
            cut = sorted(self.counts.values(), reverse=True)[self.k]
            self.counts = {key: n - cut for key, n in self.counts.items() if n > cut}
        return self


def misra_gries(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, count): the counters of all tasks' summaries merged; at most ``k`` rows. Null keys are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = MisraGries(k)
        for batch in batches:
            found = pa.TableGroupBy(pa.Table.from_batches([batch]), "key").aggregate([("count", "sum")])
            held.add(dict(zip(found.column("key").to_pylist(), found.column("count_sum").to_pylist(), strict=True)))
        keys = sorted(held.counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([held.counts[x] for x in keys], pa.int64())], names=["key", "count"])

    schema = "key string, count long"
    parts = df.select(F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("count")).where("key is not null").mapInArrow(count, schema)
    for width in (64, 8, 1):
        parts = parts.coalesce(width).mapInArrow(count, schema)
    return parts


@dataclass
class Autoencoder:
    """A network with one hidden layer that repeats its standardised input; rows it repeats badly are unusual.

    Fitted by Adam on at most ``sample`` benign rows, chosen by hash; every row
    is scored by a column expression.
    """

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray

    @staticmethod
    def fit(benign: DataFrame, columns: Sequence[str], key: str, hidden: int = 4, sample: int = 5000, epochs: int = 200, rate: float = 0.01, seed: int = 0) -> Autoencoder:
        few = benign.select(key, *[F.col(c).cast("double") for c in columns]).na.drop().orderBy(mix32(F.col(key)), key).limit(sample).drop(key).collect()
        x = np.array([tuple(r) for r in few], dtype=float).reshape(-1, len(columns))
        mean, scale = (x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)) if len(x) else (np.zeros(len(columns)), np.ones(len(columns)))
        x = (x - mean) / scale
        rng, d = np.random.default_rng(seed), len(columns)
        params = [rng.normal(scale=d**-0.5, size=(d, hidden)), np.zeros(hidden), rng.normal(scale=hidden**-0.5, size=(hidden, d)), np.zeros(d)]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs if len(x) else 0):
            order = rng.permutation(len(x))
            for part in np.array_split(order, max(1, len(x) // 256)):
                batch = x[part]
                a = np.tanh(batch @ params[0] + params[1])
                gap = 2 * (a @ params[2] + params[3] - batch) / batch.size
                back = gap @ params[2].T * (1 - a * a)
                step += 1
                for k, g in enumerate((batch.T @ back, back.sum(axis=0), a.T @ gap, gap.sum(axis=0))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return Autoencoder(list(columns), mean, scale, *params)

    def score(self) -> Column:
        """Mean squared error of the repetition, on the standardised scale."""
        x = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)]
        line = lambda parts, w, b: sum((p * float(v) for p, v in zip(parts, w, strict=True)), F.lit(float(b)))
        # one array after the other, so that no layer is worked out once for each unit of the next
        inputs = F.array(*x)
        units = lambda v, w, b: F.array(*[line([F.get(v, F.lit(i)) for i in range(len(w))], w[:, j], b[j]) for j in range(w.shape[1])])
        error = lambda v: F.transform(
            F.array(F.transform(units(v, self.inner, self.inner_bias), F.tanh)),
            lambda a: F.aggregate(F.zip_with(units(a, self.outer, self.outer_bias), v, lambda y, z: (y - z) * (y - z)), F.lit(0.0), lambda s, e: s + e) / float(len(self.columns)),
        )
        return F.transform(F.array(inputs), lambda v: error(v)[0])[0]
