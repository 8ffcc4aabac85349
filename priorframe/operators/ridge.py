"""Opponent-adjusted ratings: a weighted ridge for each boundary, over what was played before it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ROWS = 50
METRICS = ("epa_play", "success_rate")


def weighted_ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients of y on x, all penalised but the intercept (which centring by weighted means removes)."""
    w_sum = w.sum()
    xc, yc = x - (w @ x) / w_sum, y - (w @ y) / w_sum
    return np.linalg.solve(xc.T @ (xc * w[:, None]) + alpha * np.eye(x.shape[1]), xc.T @ (yc * w))


def solve(team: np.ndarray, opponent: np.ndarray, home: np.ndarray, n: np.ndarray, w: np.ndarray, wy: np.ndarray, alpha: float) -> pd.DataFrame:
    """team, off, def, net of one boundary from its cells, rows of one team, opponent and home: their number, weight and weighted sum.

    Rows of a cell are alike but for y, so a cell counts as one row of its mean. Empty if fewer than LEAST_ROWS usable rows.
    """
    if n.sum() < LEAST_ROWS:
        return pd.DataFrame(columns=["team", "off", "def", "net"])
    ok = n > 0
    team, opponent, home, w, wy = (a[ok] for a in (team, opponent, home, w, wy))
    names = np.unique(np.concatenate([team, opponent]))
    k = len(names)
    x = np.zeros((len(w), 2 * k + 1))
    x[np.arange(len(w)), np.searchsorted(names, team)] = 1
    x[np.arange(len(w)), k + np.searchsorted(names, opponent)] = 1
    x[:, -1] = home
    b = weighted_ridge(x, np.divide(wy, w, out=np.zeros(len(w)), where=w > 0), w, alpha)
    return pd.DataFrame({"team": names, "off": b[:k], "def": b[k : 2 * k], "net": b[:k] - b[k : 2 * k]})


def faded(start: str, end: str, halflife_days: float) -> Column:
    """The weight at `end` of what weighs one at `start`."""
    gap = f"(`{end}` - `{start}`)"
    days = f"(extract(day from {gap}) + (extract(hour from {gap}) * 3600 + extract(minute from {gap}) * 60 + double(extract(second from {gap}))) / 86400)"
    return F.expr(f"power(0.5D, {days} / {float(halflife_days)!r}D)")


def adjusted(rows: DataFrame, boundaries: DataFrame, metrics: tuple[str, ...] = METRICS, alpha: float = 12.0, halflife_days: float = 400.0, min_games: int = 64) -> DataFrame:
    """season, week, team and <metric>_off, _def, _net for each boundary.

    rows: team, opponent, is_home, kickoff and the metrics (one row a team and game); boundaries: season, week, asof, as
    many as there are weeks. A boundary with fewer than min_games earlier rows has no ratings. Rows are summed by team,
    opponent, home and the first boundary after them, weighted as of it; only these sums meet all later boundaries, where
    they fade further. So no row is repeated, and a task holds the cells of one boundary, however many rows they have.
    """
    slim = rows.select("team", "opponent", F.col("is_home").cast("double").alias("home"), "kickoff", *(F.col(f"off_{m}").cast("double").alias(m) for m in metrics))
    asked = boundaries.filter("asof is not null")
    bounds = asked.select(F.array_sort(F.collect_set("asof"))).scalar()
    slim = slim.withColumn("_bounds", bounds).withColumn("_next", F.get(F.filter("_bounds", lambda t: t > F.col("kickoff")), F.lit(0))).drop("_bounds")
    slim = slim.filter("_next is not null").withColumn("_w", faded("kickoff", "_next", halflife_days))
    sums, names = [F.count(F.lit(1)).alias("games")], ["games"]
    for i, m in enumerate(metrics):
        usable = F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf"))
        sums += [F.count(F.when(usable, 1)).alias(f"n{i}"), *(F.coalesce(F.sum(F.when(usable, v)), F.lit(0.0)).alias(f"{k}{i}") for k, v in (("w", F.col("_w")), ("y", F.col("_w") * F.col(m))))]
        names += [f"n{i}", f"w{i}", f"y{i}"]
    cells = slim.groupBy("team", "opponent", "home", "_next").agg(*sums)
    earlier = cells.join(asked.select("season", "week", "asof"), F.col("_next") <= F.col("asof")).withColumn("_f", faded("_next", "asof", halflife_days))
    totals = [(F.sum(F.col(c) * F.col("_f")) if c[0] in "wy" else F.sum(c)).alias(c) for c in names]
    earlier = earlier.groupBy("season", "week", "team", "opponent", "home").agg(*totals)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        columns = ["season", "week", "team", *(f"{m}_{s}" for m in metrics for s in ("off", "def", "net"))]
        if g["games"].sum() < min_games:
            return pd.DataFrame(columns=columns)
        out = None
        for i, m in enumerate(metrics):
            r = solve(g["team"].to_numpy(), g["opponent"].to_numpy(), g["home"].to_numpy(float), *(g[f"{k}{i}"].to_numpy() for k in "nwy"), alpha)
            r = r.rename(columns={s: f"{m}_{s}" for s in ("off", "def", "net")})
            out = r if out is None else out.merge(r, on="team", how="outer")
        out.insert(0, "week", g["week"].iloc[0])
        out.insert(0, "season", g["season"].iloc[0])
        return out[columns]

    kinds = dict(earlier.dtypes)
    values = ", ".join(f"{m}_{s} double" for m in metrics for s in ("off", "def", "net"))
    return earlier.groupBy("season", "week").applyInPandas(run, f"season {kinds['season']}, week {kinds['week']}, team {kinds['team']}, {values}")
