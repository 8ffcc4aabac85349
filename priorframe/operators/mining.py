"""Pattern mining with control of false discoveries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorframe.functions import stats
from priorframe.functions.numbers import JUICE, cut, decimal_odds, finite
from priorframe.operators.relational import cells
from priorframe.operators.temporal import History

# The bins of game state and their names.
SCORE_EDGES = [-99, -14.5, -7.5, -3.5, 0.5, 3.5, 7.5, 14.5, 99]
SCORE_NAMES = ["down 15+", "down 8-14", "down 4-7", "down 1-3", "up 1-3", "up 4-7", "up 8-14", "up 15+"]
DISTANCE_EDGES, DISTANCE_NAMES = [-1, 2.5, 6.5, 10.5, 99], ["short 1-2", "med 3-6", "long 7-10", "v.long 11+"]
FIELD_EDGES, FIELD_NAMES = [-1, 20, 50, 80, 101], ["redzone", "opp half", "own half", "backed up"]
TIME_EDGES, TIME_NAMES = [-1, 120, 300, 900, 9999], ["<2min", "2-5min", "5-15min", "15min+"]
DIMS = ("quarter", "score_state", "down_", "distance", "field_pos", "time_left", "formation", "tempo")


def outcomes(plays: DataFrame, games: DataFrame) -> DataFrame:
    """plays with posteam_wins, drive_ends_score and next_play_explosive."""
    d = plays.join(games.select("game_id", "result"), "game_id", "left")
    winner = F.when(F.col("result") > 0, F.col("home_team")).otherwise(F.col("away_team"))
    d = d.withColumn("posteam_wins", F.when(F.col("result") != 0, F.coalesce(F.col("posteam") == winner, F.lit(False)).cast("double")))
    d = d.withColumn("drive_ends_score", F.coalesce(F.col("fixed_drive_result").isin("Touchdown", "Field goal"), F.lit(False)).cast("double"))
    d = d.withColumn("next_yards", History(("game_id",), ("play_id",)).lead("yards_gained"))
    return d.withColumn("next_play_explosive", (F.col("next_yards") >= 15).cast("double"))


def game_state(plays: DataFrame) -> DataFrame:
    """plays with eight discrete columns of the situation."""
    quarter = F.when(F.col("qtr").isin(1, 2, 3, 4), F.concat(F.lit("Q"), F.col("qtr").cast("int").cast("string"))).otherwise("OT")
    down = F.element_at(F.create_map(*(F.lit(x) for k, v in ((1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th")) for x in (k, v))), F.col("down").cast("int"))
    return plays.select(
        "*", quarter.alias("quarter"), cut(F.col("score_differential"), SCORE_EDGES, SCORE_NAMES).alias("score_state"), F.when(F.col("down").isin(1, 2, 3, 4), down).alias("down_"),
        cut(F.col("ydstogo"), DISTANCE_EDGES, DISTANCE_NAMES).alias("distance"), cut(F.col("yardline_100"), FIELD_EDGES, FIELD_NAMES).alias("field_pos"),
        cut(F.col("half_seconds_remaining"), TIME_EDGES, TIME_NAMES).alias("time_left"),
        F.when(F.col("shotgun") == 1, "shotgun").otherwise("under center").alias("formation"), F.when(F.col("no_huddle") == 1, "no huddle").otherwise("huddle").alias("tempo"),
    )


def with_p_binomial(cells_: DataFrame, k: str = "k", n: str = "n", p: str = "base") -> DataFrame:
    """cells with the exact two-sided binomial p of k in n against p."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[stats.binom_test(int(x), int(m), float(q)) for x, m, q in zip(b[k], b[n], b[p])])

    return cells_.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells_.schema) + ", p double")


#: Ranges of p that bh ranks apart: 32 for each halving, down to 2**-64.
_PARTS = 64 * 32


def bh(df: DataFrame, p: str, ties: list[str], q: float = 0.05, step_up: bool = False, many: bool = False) -> DataFrame:
    """df with its rank by p and whether it survives: pointwise p <= rank / m * q, or by the step-up rule.

    Hypotheses are as many as the cells of a grid, so one task sorts them. Where they are as many as rows, `many` ranks
    them within ranges of p laid end to end: what is sorted in one place is the table of at most 2,049 ranges.
    """
    if not many:
        m = F.count(F.lit(1)).over(Window.partitionBy())
        out = df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(p), *ties))).withColumn("_ok", F.col(p) <= F.col("rank") / m * q)
        last = F.max(F.when(F.col("_ok"), F.col("rank"))).over(Window.partitionBy())
    else:
        part = F.when(F.col(p) > 0, F.greatest(F.lit(1), F.lit(_PARTS) + F.floor(F.log2(p) * 32))).otherwise(F.lit(0)).cast("int")
        parts = df.select(part.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        ladder = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_m"))
        inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(p), *ties))
        out = df.withColumn("_part", part).withColumn("_in", inside).join(F.broadcast(ladder), "_part")
        out = out.withColumn("rank", F.col("_in") + F.col("_before")).withColumn("_ok", F.col(p) <= F.col("rank") / F.col("_m") * q)
        last = out.agg(F.max(F.when(F.col("_ok"), F.col("rank")))).scalar() if step_up else None
        out = out.drop("_part", "_in", "_before", "_m")
    if step_up:
        return out.withColumn("survives", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("_ok")
    return out.withColumnRenamed("_ok", "survives")


def mine(d: DataFrame, outcome: str, dims: list[str], min_n: int = 300, depth: int = 3) -> DataFrame:
    """Every cell of up to `depth` dims with n >= min_n: rate, base, lift, exact p, and whether it survives."""
    known = d.filter(F.col(outcome).isNotNull())
    base = known.agg(F.avg(outcome).alias("base"))
    c = cells(known, dims, depth, [F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("k"), F.avg(outcome).alias("rate")])
    c = c.filter(F.col("n") >= min_n).join(F.broadcast(base)).withColumn("lift", F.col("rate") - F.col("base"))
    tested = with_p_binomial(c)
    return bh(tested, "p", ["mask", *dims]).orderBy(F.abs("lift").desc(), "mask", *dims)


def confirm(patterns: DataFrame, holdout: DataFrame, outcome: str, dims: list[str], min_n: int = 100, depth: int = 3) -> DataFrame:
    """patterns with n, rate and lift in the holdout, and whether they replicate: same sign, at least half the lift."""
    known = holdout.filter(F.col(outcome).isNotNull())
    base = known.agg(F.avg(outcome).alias("hold_base"))
    c = cells(known, dims, depth, [F.count(F.lit(1)).alias("hold_n"), F.avg(outcome).alias("hold_rate")]).filter(F.col("hold_n") >= min_n)
    c = c.join(F.broadcast(base)).withColumn("hold_lift", F.col("hold_rate") - F.col("hold_base"))
    return _joined(patterns, c, dims).withColumn("replicated", _same_way(F.col("lift"), F.col("hold_lift"), 0.5))


def _joined(a: DataFrame, b: DataFrame, dims: list[str]) -> DataFrame:
    on = a["mask"] == b["mask"]
    for x in dims:
        on = on & a[x].eqNullSafe(b[x])
    return a.join(b, on, "left").select(*(a[c] for c in a.columns), *(b[c] for c in b.columns if c not in a.columns))


def _same_way(found: Column, again: Column, part: float) -> Column:
    return F.coalesce((F.signum(found) == F.signum(again)) & (F.abs(again) >= part * F.abs(found)), F.lit(False))


def residuals(d: DataFrame, outcome: str, controls: list[str], c: float = 1.0) -> DataFrame:
    """d with resid: the outcome less what an L2-penalised logistic model of the one-hot controls expects."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = d.filter(F.col(outcome).isNotNull()).select("*", *(F.coalesce(F.col(x).cast("string"), F.lit("nan")).alias(f"_c_{x}") for x in controls))
    n = known.count()
    stages = [
        StringIndexer(inputCols=[f"_c_{x}" for x in controls], outputCols=[f"_i_{x}" for x in controls], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"_i_{x}" for x in controls], outputCols=[f"_o_{x}" for x in controls], dropLast=False),
        VectorAssembler(inputCols=[f"_o_{x}" for x in controls], outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol=outcome, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y", regParam=1.0 / (c * max(1, n)), standardization=False, maxIter=200, tol=1e-8),
    ]
    fitted = Pipeline(stages=stages).fit(known).transform(known)
    return fitted.select(*d.columns, (F.col(outcome) - vector_to_array("_p")[1]).alias("resid"))


def residual_cells(disc: DataFrame, hold: DataFrame, dims: list[str], min_n: int = 400, hold_n: int = 100, depth: int = 2) -> DataFrame:
    """Cells whose mean residual differs from zero in `disc`, with their mean in `hold`. Both have a column resid."""
    text = [F.coalesce(F.col(x).cast("string"), F.lit("nan")).alias(x) for x in dims]
    found = cells(disc.select("resid", *text), dims, depth, [F.count(F.lit(1)).alias("n"), F.avg("resid").alias("excess"), F.stddev_samp("resid").alias("sd")])
    found = found.filter(F.col("n") >= min_n).withColumn("t", F.col("excess") / (F.col("sd") / F.sqrt("n")))
    again = cells(hold.select("resid", *text), dims, depth, [F.count(F.lit(1)).alias("hold_n"), F.avg("resid").alias("hold_excess")]).filter(F.col("hold_n") >= hold_n)

    @F.pandas_udf("double")
    def two_sided(t: pd.Series) -> pd.Series:
        return pd.Series(stats.normal_two_sided(t.to_numpy(float)))

    got = _joined(found, again, dims).withColumn("p", two_sided(F.coalesce("t", F.lit(0.0))))
    got = bh(got, "p", ["mask", *dims])
    return got.withColumn("replicated", _same_way(F.col("excess"), F.col("hold_excess"), 0.4)).orderBy(F.abs("excess").desc(), "mask", *dims)


def residual_mine(disc: DataFrame, hold: DataFrame, outcome: str, dims: list[str], controls: list[str], **limits) -> DataFrame:
    return residual_cells(residuals(disc, outcome, controls), residuals(hold, outcome, controls), dims, **limits)


def noteworthy(found: DataFrame, least: float = 0.015, top: int = 10) -> DataFrame:
    """Of what residual_mine found the `top` cells with the largest excess, of those that survive, replicate and exceed `least`."""
    return found.filter(F.col("survives") & F.col("replicated") & (F.abs("excess") >= least)).orderBy(F.abs("excess").desc(), *(c for c in ("mask",) if c in found.columns), *(c for c in found.columns if c in DIMS)).limit(top)


# The grid of betting strategies.
CONTEXTS = {
    "all games": "true", "wk1-6": "week <= 6", "wk7-13": "week > 6 and week <= 13", "wk14+": "week >= 14", "line<=3": "abs(vegas_spread) <= 3",
    "line 3-7": "abs(vegas_spread) > 3 and abs(vegas_spread) <= 7", "line>7": "abs(vegas_spread) > 7", "total<=44": "vegas_total <= 44", "total>=48": "vegas_total >= 48",
}
WIN_SIDES = {"ML any": "true", "ML dogs": "(p_home > 0.5) <> (market > 0.5)", "ML favs": "(p_home > 0.5) = (market > 0.5)"}
SPREAD_SIDES = {"ATS any": "true", "ATS home": "pred_spread > vegas_spread", "ATS away": "pred_spread <= vegas_spread", "ATS dogs": "(pred_spread > vegas_spread) <> (vegas_spread > 0)"}
TOTAL_SIDES = {"OU any": "true", "OU over": "pred_total > vegas_total", "OU under": "pred_total <= vegas_total"}


def strategies(predictions: DataFrame, market: str = "vegas", min_bets: int = 60, split: float | None = None) -> DataFrame:
    """n, hit rate, return, t and both halves' returns of every model x context x side x threshold with enough bets.

    predictions: model, game_id, season, week, p_home, pred_spread, pred_total, home_win, spread_actual, total_actual,
    vegas_spread, vegas_total. Predictions of the same contexts, bets and outcomes are one cell: cells, not predictions,
    are expanded to their strategies.
    """
    mk = predictions.filter(F.col("model") == market).select("game_id", F.col("p_home").alias("market"))
    d = predictions.filter(F.col("model") != "home_team").join(mk, "game_id", "left")
    half = split if split is not None else predictions.agg(F.median("season")).collect()[0][0]
    home = F.col("p_home") > 0.5
    at = F.when(home, F.col("market")).otherwise(1 - F.col("market"))
    juice = F.lit(JUICE + 1)
    kinds = [
        (WIN_SIDES, F.col("home_win").isin(0.0, 1.0), F.abs(F.col("p_home") - F.col("market")), (0.0, 0.05, 0.10), home == (F.col("home_win") == 1), decimal_odds(at), "{:.2f}"),
        (SPREAD_SIDES, finite(F.col("pred_spread")) & finite(F.col("spread_actual")) & finite(F.col("vegas_spread")) & (F.col("spread_actual") != F.col("vegas_spread")),
         F.abs(F.col("pred_spread") - F.col("vegas_spread")), (0.0, 1.0, 3.0), (F.col("pred_spread") > F.col("vegas_spread")) == (F.col("spread_actual") > F.col("vegas_spread")), juice, "{:.0f}pt"),
        (TOTAL_SIDES, finite(F.col("pred_total")) & finite(F.col("total_actual")) & finite(F.col("vegas_total")) & (F.col("total_actual") != F.col("vegas_total")),
         F.abs(F.col("pred_total") - F.col("vegas_total")), (0.0, 1.5, 3.0), (F.col("pred_total") > F.col("vegas_total")) == (F.col("total_actual") > F.col("vegas_total")), juice, "{:.1f}pt"),
    ]
    bit = lambda on, j: F.when(on, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long"))
    bets, on_, won_, profits = [], F.lit(0).cast("long"), F.lit(0).cast("long"), []
    for k, (sides, valid, edge, levels, won, odds, label) in enumerate(kinds):
        profits.append(F.when(valid, F.when(won, odds - 1).otherwise(F.lit(-1.0))))
        won_ = won_.bitwiseOR(bit(valid & won, k))
        for side, mask in sides.items():
            for level in levels:
                on_ = on_.bitwiseOR(bit(valid & F.expr(mask) & (edge >= level), len(bets)))
                bets.append((f"{side} | edge>={label.format(level)}", k))
    in_ = F.lit(0).cast("long")
    for j, m in enumerate(CONTEXTS.values()):
        in_ = in_.bitwiseOR(bit(F.expr(m), j))
    d = d.select("model", (F.col("season") <= half).alias("_early"), in_.alias("_in"), on_.alias("_on"), won_.alias("_won"), *(p.alias(f"_p{k}") for k, p in enumerate(profits)))
    sums = [f(c).alias(f"{name}{k}") for k in range(len(kinds)) for c in (F.col(f"_p{k}"),) for name, f in (("_s", F.sum), ("_q", lambda x: F.sum(x * x)), ("_lo", F.min), ("_hi", F.max))]
    d = d.groupBy("model", "_early", "_in", "_on", "_won").agg(F.count(F.lit(1)).alias("_n"), *sums)
    has = lambda c, j: F.col(c).bitwiseAND(F.lit(1 << j).cast("long")) != 0
    contexts = F.array(*(F.when(has("_in", j), F.lit(c)) for j, c in enumerate(CONTEXTS)))
    told = F.array(*(F.when(has("_on", j), F.struct(F.lit(b).alias("bet"), F.when(has("_won", k), F.col("_n")).otherwise(0).alias("hits"), *(F.col(f"_{c}{k}").alias(c) for c in ("s", "q", "lo", "hi")))) for j, (b, k) in enumerate(bets)))
    d = d.select("model", "_early", "_n", F.filter(contexts, lambda x: x.isNotNull()).alias("_contexts"), F.filter(told, lambda x: x.isNotNull()).alias("_bets"))
    d = d.select("model", "_early", "_n", F.explode("_contexts").alias("context"), "_bets").select("model", "_early", "_n", "context", F.explode("_bets").alias("b")).select("model", "_early", "_n", "context", "b.*")
    n, early = F.sum("_n"), F.col("_early")
    mean = lambda on: F.sum(F.when(on, F.col("s"))) / F.sum(F.when(on, F.col("_n")))
    square = F.greatest(F.sum("q") - F.sum("s") * F.sum("s") / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
    g = d.groupBy("model", "context", "bet").agg(
        n.alias("n"), (F.sum("hits") / n).alias("hit_rate"), (F.sum("s") / n).alias("roi"), F.when((n > 1) & (F.min("lo") == F.max("hi")), 0.0).otherwise(F.sqrt(square)).alias("sd"),
        mean(early).alias("roi_early"), mean(~early).alias("roi_late"),
    ).filter(F.col("n") >= min_bets)
    return g.withColumn("t", F.when(F.col("sd") > 0, F.col("roi") / (F.col("sd") / F.sqrt("n"))))


def strategy_scan(predictions: DataFrame, q: float = 0.05, **options) -> DataFrame:
    """strategies with Student's p and which survive the correction and pay in both halves."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([stats.student_two_sided(x, m - 1) if np.isfinite(x) and m > 1 else 1.0 for x, m in zip(t.to_numpy(float), n)])

    s = strategies(predictions, **options).withColumn("p", p_value("t", "n"))
    return bh(s, "p", ["model", "context", "bet"], q).withColumn("survivor", F.col("survives") & (F.col("roi") > 0) & (F.col("roi_early") > 0) & (F.col("roi_late") > 0))


def with_interval(df: DataFrame, k: str, n: str, level: float = 0.95) -> DataFrame:
    """df with the exact binomial interval (ci_low, ci_high) of k in n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [stats.clopper_pearson(int(x), int(m), level) for x, m in zip(b[k], b[n])]
            yield b.assign(ci_low=[e[0] for e in ends], ci_high=[e[1] for e in ends])

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", ci_low double, ci_high double")
