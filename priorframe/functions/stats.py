"""Distributions without SciPy: vectorised over NumPy arrays, for use in Arrow-batched functions."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def normal_two_sided(t) -> np.ndarray:
    """P(|Z| >= |t|)."""
    return np.asarray(_erfc(np.abs(np.asarray(t, float)) / math.sqrt(2)), float)


def log_binom(n: int, k: np.ndarray, p: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(k > 0, k * np.log(p), 0.0)
        b = np.where(n - k > 0, (n - k) * np.log1p(-p), 0.0)
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + a + b


def binom_test(k: int, n: int, p: float) -> float:
    """Exact two-sided test: the mass of all outcomes that are no likelier than k."""
    if n == 0:
        return 1.0
    mass = np.exp(log_binom(n, np.arange(n + 1, dtype=float), p))
    return float(min(1.0, mass[mass <= mass[int(k)] * (1 + 1e-7)].sum()))


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def student_two_sided(t: float, df: float) -> float:
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else float("nan")
    return betainc(df / 2, 0.5, df / (df + t * t))


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval, by bisection of the beta distribution."""
    if n == 0:
        return 0.0, 1.0
    tail = (1 - level) / 2

    def quantile(a: float, b: float, q: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if betainc(a, b, mid) < q else (lo, mid)
        return (lo + hi) / 2

    return (quantile(k, n - k + 1, tail) if k else 0.0), (quantile(k + 1, n - k, 1 - tail) if k < n else 1.0)
