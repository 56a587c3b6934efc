"""Closed forms and seeded draws of study designs: nothing here sees rows."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from itertools import pairwise

import numpy as np

from tidemark.functions import closed_forms as cf

# --- rates and intervals ------------------------------------------------------------------------


def normal_tail(z: float) -> float:
    """P(Z > z) of a standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def interval_coverage(interval: Callable[[int, int], tuple[float, float]], rate: float, n: int) -> float:
    """Chance that an interval made from k of n successes holds the rate: a sum over all k, not a simulation."""
    held = 0.0
    for k in range(n + 1):
        low, high = interval(k, n)
        if low <= rate <= high:
            held += math.exp(cf._log_choose(n, k) + (k * math.log(rate) if k else 0.0) + ((n - k) * math.log1p(-rate) if n > k else 0.0))
    return min(1.0, held)


def prior_mean_coverage(interval: Callable[[int, int], tuple[float, float]], alpha: float, beta: float, n: int, points: int = 200) -> float:
    """Coverage averaged over rates of a beta prior, at its mid-quantiles."""
    rates = [cf.beta_quantile((i + 0.5) / points, alpha, beta) for i in range(points)]
    return sum(interval_coverage(interval, r, n) for r in rates) / points


def violation_chance(n: int, alpha: float, m: int) -> float:
    """Chance that the threshold after m exceedances among n calibration rows has a false-positive rate above alpha.

    The rate of the (m + 1)-th largest of n uniform scores is beta(m + 1, n - m).
    """
    return 1 - cf.beta_cdf(alpha, m + 1, n - m)


def certification_floor(fpr: float, confidence: float) -> int:
    """Benign rows without which no threshold can be certified for a false-positive rate."""
    return cf.min_calibration_size(fpr, 1 - confidence)


def prior_from_weights(weights: Sequence[float], source: Sequence[float]) -> list[float]:
    """Target class shares from importance weights; the source's where nothing is left."""
    mass = [max(0.0, w) * p for w, p in zip(weights, source, strict=True)]
    return [m / sum(mass) for m in mass] if sum(mass) > 0 else list(source)


def sequence_error(trials: int, rows: int, alpha: float, rho: float, sigma: float = 1.0, seed: int = 0) -> float:
    """Share of null streams whose normal-mixture confidence sequence ever leaves out the true mean 0."""
    draws = np.random.default_rng(seed).normal(scale=sigma, size=(trials, rows))
    t = np.arange(1, rows + 1)
    radius = sigma * np.sqrt((t + rho) * np.log((t + rho) / (rho * alpha**2))) / t
    return float((np.abs(draws.cumsum(axis=1) / t) > radius).any(axis=1).mean())


# --- latency and search -------------------------------------------------------------------------


def mean_latency(rate: float, fixed: float, marginal: float) -> float:
    """Half a service and a whole one, at the batch size that keeps up; infinite past capacity."""
    batch = cf.equilibrium_batch(rate, fixed, marginal)
    return 1.5 * (fixed + marginal * batch) if math.isfinite(batch) else math.inf


def blended_latency(first: float, second: float, deferred: float) -> float:
    return first + deferred * second


def search_seconds(rate: float, bits: int) -> float:
    """Time to try every value of so many bits."""
    return math.ldexp(1.0, bits) / rate


def cycle_length(states: Sequence[tuple]) -> int:
    """Steps since the last state was there before; all of them if it never was, 1 for a fixed point."""
    back = next((k for k, s in enumerate(reversed(states[:-1]), 1) if s == states[-1]), None) if states else 0
    return len(states) if back is None else back


def top_negatives(k: int, n: int) -> int:
    """``k`` within 1 and the number of negatives."""
    return sorted((1, k, max(n, 1)))[1]


# --- released histograms ------------------------------------------------------------------------


def public_edges(bins: int, low: float, high: float) -> list[float]:
    """Equal-width edges on the signed-log scale over a declared domain."""
    a, b = (math.copysign(math.log1p(abs(v)), v) for v in (low, high))
    return [a + (b - a) * k / bins for k in range(bins + 1)]


def levels(edges: Sequence[float]) -> int:
    """Bins, and one level for missing values."""
    return sum(1 for _ in pairwise(edges)) + 1


# --- updates of sites ---------------------------------------------------------------------------


def sign_flip(update: Sequence[float], scale: float = 1.0) -> list[float]:
    return [-scale * v for v in update]


def gaussian_update(n: int, sigma: float, seed: int = 0) -> list[float]:
    return np.random.default_rng(seed).normal(scale=sigma, size=n).tolist()


def aggregate_updates(name: str, updates: Sequence[Sequence[float]], sizes: Sequence[int], byzantine: int = 0, trim: float = 0.2) -> list[float]:
    """One update from one row a site: size-weighted 'mean', coordinate 'median', 'trimmed' mean, or 'krum'."""
    x = np.asarray(updates, dtype=float)
    if name == "mean":
        return np.average(x, axis=0, weights=sizes).tolist()
    if name == "median":
        return np.median(x, axis=0).tolist()
    if name == "trimmed":
        cut = min(int(len(x) * trim), (len(x) - 1) // 2)
        return np.sort(x, axis=0)[cut : len(x) - cut].mean(axis=0).tolist()
    if name == "krum":
        gaps = np.sort(((x[:, None] - x[None, :]) ** 2).sum(axis=2), axis=1)[:, 1 : max(2, len(x) - byzantine - 1)]
        return x[int(gaps.sum(axis=1).argmin())].tolist()
    raise ValueError(f"unknown rule {name}")


def encode_update(weights: Sequence[float], rows: int, scale: float) -> list[int]:
    """A site's share of a weighted mean in fixed point: its weights times its rows, then its rows."""
    return [round(v * scale) for v in (*(w * rows for w in weights), float(rows))]


def decode_update(total: Sequence[int], scale: float) -> list[float]:
    """The weighted mean from the sum of all shares."""
    *sums, rows = (v / scale for v in total)
    return [s / rows if abs(rows) > 1e-9 else s for s in sums]


def dh_keypair(rng: random.Random, generator: int = 3) -> tuple[int, int]:
    """(private, public) in the multiplicative group of the Mersenne prime that shares live in."""
    private = rng.randrange(2, cf.SHARE_PRIME - 2)
    return private, pow(generator, private, cf.SHARE_PRIME)


def pair_masks(keys: Mapping[str, tuple[int, int]], turn: int, n: int, ring: int = (1 << 61) - 1) -> dict[str, list[int]]:
    """Each site's mask of one round: what it shares with each later site added, with each earlier one subtracted.

    Both ends of a pair draw the same numbers from the secret that their keys
    agree on, so the masks of all sites add up to nothing.
    """
    names = sorted(keys)

    def shared(a: str, b: str) -> np.ndarray:
        secret = pow(keys[b][1], keys[a][0], cf.SHARE_PRIME)
        draw = random.Random(f"{secret}:{turn}")
        return np.array([draw.randrange(ring) for _ in range(n)], dtype=object)

    return {a: [int(v) % ring for v in sum((shared(a, b) if a < b else -shared(a, b) for b in names if b != a), np.zeros(n, dtype=object))] for a in names}


# --- seeded specifications ----------------------------------------------------------------------


def draw_specs(space: Mapping[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    """``n`` different settings from a space of choices (all of them if there are fewer), in a seeded order."""
    total = math.prod(len(v) for v in space.values())
    picks = random.Random(seed).sample(range(total), min(n, total))
    out = []
    for at in picks:
        spec = {}
        for name, choices in space.items():
            at, k = divmod(at, len(choices))
            spec[name] = choices[k]
        out.append(spec)
    return out


def believed_label_model(accuracies: Sequence[float], coverage: Sequence[float], positive: float) -> list[dict[int, tuple[float, float]]]:
    """For each labelling rule, P(vote | class 0) and P(vote | class 1) of votes 1, 0 and -1 (abstains), from believed accuracies alone."""
    if not 0 < positive < 1:
        raise ValueError("the share of positives must lie strictly between 0 and 1")
    return [{1: (c * (1 - a), c * a), 0: (c * a, c * (1 - a)), -1: (1 - c, 1 - c)} for a, c in zip(accuracies, coverage, strict=True)]
