"""Scalar Columns: labels, numbers, network addresses, rates and closed forms."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dash code points that labels carry in place of a plain hyphen (fixed values).
DASHES = "–—‑\u0096"

#: Well-known ports and their coarse service (fixed values).
SERVICES = {
    20: "ftp", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http", 110: "pop3", 123: "ntp", 143: "imap",
    161: "snmp", 389: "ldap", 443: "https", 445: "smb", 465: "smtp", 993: "imap", 995: "pop3", 3306: "mysql", 3389: "rdp", 8080: "http",
}
OTHER_SERVICE = "other/ephemeral"


def normalize_label(c: Column) -> Column:
    """Dashes become '-', white space collapses, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"[{DASHES}]", "-"), r"\s+", " "))


def consolidate(c: Column, mapping: Mapping[str, str]) -> Column:
    """Map known values, keep the rest."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c) if pairs else c


def coerce_number(c: Column) -> Column:
    """Lenient cast to double; infinities and NaN become null."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def sentinel_to_null(c: Column, sentinel: float = -1.0) -> Column:
    return F.when(c != sentinel, c)


def safe_rate(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den as double; ``empty`` where the denominator is 0 or null."""
    out = F.when((den.isNotNull()) & (den != 0), num.cast("double") / den.cast("double"))
    return F.coalesce(out, F.lit(empty).cast("double")) if empty is not None else out


def service_of(port: Column) -> Column:
    """Coarse service of a port; unknown or garbled ports are ephemeral."""
    pairs = [F.lit(x) for kv in SERVICES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[port.try_cast("int")], F.lit(OTHER_SERVICE))


def is_internal(host: Column) -> Column:
    """Private IPv4 space; anything that is no dotted quad is false."""
    quad = host.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    part = F.split(host, r"\.")
    a, b = part[0].try_cast("int"), part[1].try_cast("int")
    inside = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    return F.coalesce(quad & inside, F.lit(False))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def inverse_signed_log(c: Column) -> Column:
    return F.signum(c) * F.expm1(F.abs(c))


def bucket_of(c: Column, edges: Sequence[float]) -> Column:
    """1 + number of interior edges at or below the value; 0 for null or non-finite values."""
    level = sum((F.when(c >= F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(1))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0).otherwise(level)


def round_significant(c: Column, digits: int) -> Column:
    """Half-even rounding to significant digits; zero, null and non-finite values stay."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1.0) - F.floor(F.log10(F.abs(c))))
    return F.when((c == 0) | F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.rint(c * scale) / scale)


def severity(p: Column) -> Column:
    """0 to 100: clamp to [0, 1], scale, round half-even."""
    return F.rint(100 * clamp(p, 0, 1)).cast("int")


def clamp(c: Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null, which ``least`` and ``greatest`` would skip."""
    return F.when(c.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c)))


def binary_entropy(p: Column, eps: float = 1e-12) -> Column:
    q = clamp(p, eps, 1 - eps)
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def log_loss(p: Column, y: Column, clip: float | None = None, eps: float = 1e-12) -> Column:
    q = clamp(p, eps, 1 - eps)
    loss = -(y * F.log(q) + (1 - y) * F.log(1 - q))
    return F.least(loss, F.lit(float(clip))) if clip is not None else loss


def brier(p: Column, y: Column) -> Column:
    return F.pow(p - y, 2)


def msp_novelty(proba: Column) -> Column:
    return 1 - F.array_max(proba)


def entropy_novelty(proba: Column) -> Column:
    return F.aggregate(proba, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def margin_novelty(proba: Column) -> Column:
    top = F.sort_array(proba, False)
    return 1 - (top[0] - top[1])


def wilson(successes: Column, n: Column, z: float = 1.96, empty: tuple[float, float] | None = None) -> tuple[Column, Column]:
    """Wilson interval; at n = 0 ``empty``, or NaN."""
    p, z2 = successes / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    lo, hi = empty or (float("nan"), float("nan"))
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(lo), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(hi)


def bayes_precision(tpr: Column, fpr: Column, prior: Column) -> Column:
    return safe_rate(tpr * prior, tpr * prior + fpr * (1 - prior))


def required_fpr(tpr: Column, prior: Column, precision: Column) -> Column:
    return tpr * prior * (1 - precision) / (precision * (1 - prior))


def break_even_prior(tpr: Column, fpr: Column) -> Column:
    return safe_rate(fpr, tpr + fpr)


def cost_per_flow(tpr: Column, fpr: Column, prior: Column, alert: float, miss: float) -> Column:
    """Alerts cost ``alert`` each, missed attacks ``miss``."""
    return alert * (tpr * prior + fpr * (1 - prior)) + miss * (1 - tpr) * prior


def mixture_boundary(v: Column, rho: float, alpha: float) -> Column:
    return F.sqrt((v + rho) * F.log((v + rho) / (rho * alpha * alpha)))


def wald_boundaries(alpha: float, beta: float) -> tuple[float, float]:
    return math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))


def llr(alerted: Column, p1: float, p0: float) -> Column:
    return F.when(alerted, math.log(p1 / p0)).otherwise(math.log((1 - p1) / (1 - p0)))


def hoeffding_bound(value_range: Column, delta: float, n: Column) -> Column:
    return F.sqrt(value_range * value_range * math.log(1 / delta) / (2 * n))


def quantize(c: Column, scale: float, modulus: int) -> Column:
    """Fixed point in a ring: round half-even, wrap."""
    return F.pmod(F.rint(c * scale).cast("long"), F.lit(modulus))


def dequantize(c: Column, scale: float, modulus: int) -> Column:
    return F.when(c > modulus // 2, c - modulus).otherwise(c) / scale


def emit_delay_us(duration: Column, teardown: Column, timeout_us: int) -> Column:
    return duration + F.when(teardown, 0).otherwise(timeout_us)


def conformal_set(p: Column, tau_benign: Column | float, tau_attack: Column | float) -> tuple[Column, Column, Column]:
    """Members of the prediction set and the action it implies."""
    benign, attack = p <= tau_benign, 1 - p <= tau_attack
    action = F.when(attack & ~benign, "auto_alert").when(benign & ~attack, "auto_clear").otherwise("review")
    return benign, attack, action


def mix32(key: Column) -> Column:
    """A multiplicative hash of a whole number to [0, 2**32), by arithmetic that any SQL engine repeats without overflow."""
    return F.pmod(F.pmod(key, F.lit(1 << 31)) * 2654435761, F.lit(1 << 32))
