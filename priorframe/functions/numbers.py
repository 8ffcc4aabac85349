"""Numeric expressions: safe casts, clips, odds and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bookmaker's margin on a win market, and the stake-free payout of a -110 bet.
VIG = 0.045
JUICE = 100 / 110


def number(c: Column) -> Column:
    """A double, null where the text isn't one (NaN too)."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def flag(c: Column) -> Column:
    """0 or 1; unknown is 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Like a clip of arrays: null stays null, although greatest and least would skip it."""
    x = c
    if lower is not None:
        x = F.greatest(x, F.lit(lower))
    if upper is not None:
        x = F.least(x, F.lit(upper))
    return F.when(c.isNotNull(), x)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def elo_expected(diff: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -diff / 400))


def decimal_odds(p: Column) -> Column:
    """What a market at probability p pays for a stake of one, the stake included."""
    return (1 / clip(p, 1e-6, 1.0)) / (1 + VIG)


def shrink(value: Column, n: Column, prior: Column, strength: float) -> Column:
    w = n / (n + F.lit(float(strength)))
    return w * value + (1 - w) * prior


def cut(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval (edge, next edge] that holds the value; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((c > lo) & (c <= hi), F.lit(label)).otherwise(out)
    return out


def prob_bin(p: Column, bins: int = 10) -> Column:
    """Which of the equal bins [k/bins, (k+1)/bins) holds p, by the edges as doubles; 1.0 is in the last."""
    edges = [k * (1.0 / bins) for k in range(1, bins)]
    return F.when(p.isNotNull(), sum(((p >= F.lit(e)).cast("int") for e in edges), F.lit(0)))
