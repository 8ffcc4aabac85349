"""Scores of predictions, as aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorframe.functions.numbers import JUICE, clip, finite, prob_bin


@dataclass(frozen=True)
class Target:
    """What is predicted: the outcome's column, the prediction's, and the market's line if there is one."""

    name: str
    column: str
    kind: str
    prediction: str
    market: str | None = None
    label: str = ""


# The targets, in report order.
TARGETS = (
    Target("win", "home_win", "binary", "p_home", "vegas_spread", "Moneyline / win probability"),
    Target("spread", "spread_actual", "regression", "pred_spread", "vegas_spread", "Point spread (home margin)"),
    Target("total", "total_actual", "regression", "pred_total", "vegas_total", "Total points"),
    Target("h1_win", "h1_home_win", "binary", "p_home_h1", None, "Leading at halftime"),
    Target("h1_spread", "h1_spread_actual", "regression", "pred_h1_spread", None, "Halftime margin"),
    Target("h1_total", "h1_total_actual", "regression", "pred_h1_total", None, "Halftime total points"),
)


def resolve(names: list[str] | None = None) -> list[Target]:
    """The targets of these names, all without names; KeyError for one that doesn't exist."""
    by = {t.name: t for t in TARGETS}
    if unknown := [n for n in names or () if n not in by]:
        raise KeyError(f"unknown targets {unknown}; there are {sorted(by)}")
    return [by[n] for n in names] if names else list(TARGETS)


def prediction_columns(targets: list[Target]) -> list[str]:
    return [t.prediction for t in targets]


def usable(train: DataFrame, target: Target) -> DataFrame:
    """Rows with a label; a binary target leaves out ties."""
    y = F.col(target.column)
    return train.filter(y.isin(0.0, 1.0) if target.kind == "binary" else finite(y))


def both(y: str, p: str) -> Column:
    return finite(F.col(y)) & finite(F.col(p))


def _avg(ok: Column, value: Column) -> Column:
    return F.avg(F.when(ok, value))


def accuracy(y: str, p: str, ok: Column | None = None) -> Column:
    return _avg(both(y, p) if ok is None else ok, ((F.col(p) > 0.5) == (F.col(y) > 0.5)).cast("double"))


def log_loss(y: str, p: str, ok: Column | None = None, eps: float = 1e-12) -> Column:
    q = clip(F.col(p), eps, 1 - eps)
    return _avg(both(y, p) if ok is None else ok, -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def brier(y: str, p: str, ok: Column | None = None) -> Column:
    return _avg(both(y, p) if ok is None else ok, F.pow(F.col(p) - F.col(y), 2))


def mae(y: str, p: str) -> Column:
    return _avg(both(y, p), F.abs(F.col(p) - F.col(y)))


def rmse(y: str, p: str) -> Column:
    return F.sqrt(_avg(both(y, p), F.pow(F.col(p) - F.col(y), 2)))


def r2(y: str, p: str) -> Column:
    """1 - SSE / SST over the pairs that are known."""
    ok = both(y, p)
    n, s, ss = F.count(F.when(ok, F.lit(1))), F.sum(F.when(ok, F.col(y))), F.sum(F.when(ok, F.col(y) * F.col(y)))
    sst = ss - s * s / n
    return 1 - F.sum(F.when(ok, F.pow(F.col(y) - F.col(p), 2))) / F.when(sst > 0, sst)


def record(y: str, p: str, line: str, prefix: str = "ats") -> list[Column]:
    """Wins, losses, pushes, percentage and units against a line: over it iff the prediction is; a result on the line is a push.

    The same counts score totals (prefix ou).
    """
    ok = both(y, p) & finite(F.col(line))
    push = ok & (F.col(y) == F.col(line))
    right = (F.col(p) > F.col(line)) == (F.col(y) > F.col(line))
    total = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    wins, losses = total(ok & ~push & right), total(ok & ~push & ~right)
    return [
        wins.alias(f"{prefix}_wins"), losses.alias(f"{prefix}_losses"), total(push).alias(f"{prefix}_pushes"),
        (wins / F.when(wins + losses > 0, wins + losses)).alias(f"{prefix}_pct"), (wins * JUICE - losses).alias(f"{prefix}_units"),
    ]


def calibration(df: DataFrame, y: str, p: str, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Per bin that has rows: n, mean_pred, actual and gap."""
    by = by or []
    d = df.filter(both(y, p)).withColumn("bin", prob_bin(F.col(p), bins))
    g = d.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("actual"))
    return g.withColumn("bin_low", F.col("bin") / bins).withColumn("bin_high", (F.col("bin") + 1) / bins).withColumn("gap", F.col("actual") - F.col("mean_pred"))


def ece(df: DataFrame, y: str, p: str, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    c = calibration(df, y, p, by, bins)
    return c.groupBy(*(by or [])).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def evaluate(predictions: DataFrame, target: Target, by: list[str]) -> DataFrame:
    """One row a group with the metrics of the target's kind; null metrics where the prediction's column is missing."""
    d = predictions
    for c in (target.prediction, target.column, *([target.market] if target.market else [])):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("double"))
    y, p = target.column, target.prediction
    n = F.count(F.when(both(y, p), F.lit(1))).alias("n_games")
    if target.kind == "binary":
        decided = both(y, p) & F.col(y).isin(0.0, 1.0)
        d = d.withColumn("_bin", F.when(decided, prob_bin(F.col(p))))
        inner = d.groupBy(*by, "_bin").agg(
            n, F.count(F.when(decided, F.lit(1))).alias("_n"), F.sum(F.when(decided, F.col(p))).alias("_p"), F.sum(F.when(decided, F.col(y))).alias("_y"),
            F.sum(F.when(decided, ((F.col(p) > 0.5) == (F.col(y) > 0.5)).cast("double"))).alias("_right"),
            F.sum(F.when(decided, -(F.col(y) * F.log(clip(F.col(p), 1e-12, 1 - 1e-12)) + (1 - F.col(y)) * F.log(1 - clip(F.col(p), 1e-12, 1 - 1e-12))))).alias("_loss"),
            F.sum(F.when(decided, F.pow(F.col(p) - F.col(y), 2))).alias("_brier"),
        )
        all_n = F.sum("_n")
        some = F.when(all_n > 0, all_n)
        return inner.groupBy(*by).agg(
            F.sum("n_games").alias("n_games"), all_n.alias("n_scored"), (F.sum("_right") / some).alias("accuracy"), (F.sum("_loss") / some).alias("log_loss"),
            (F.sum("_brier") / some).alias("brier"), (F.sum(F.abs(F.col("_y") - F.col("_p"))) / some).alias("ece"),
        ).withColumn("target", F.lit(target.name))
    more = [mae(y, p).alias("mae"), rmse(y, p).alias("rmse")]
    if target.market:
        more += record(y, p, target.market, "ats" if target.name == "spread" else "ou")
    return d.groupBy(*by).agg(n, *more).withColumn("target", F.lit(target.name))


def summarize(predictions: DataFrame, targets: list[Target] | None = None, by: list[str] | None = None) -> DataFrame:
    """target x model (x further keys): all metrics, null where a target has none of them."""
    out = None
    for t in targets or list(TARGETS):
        if t.prediction in predictions.columns:
            part = evaluate(predictions, t, by or ["model"])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no prediction column of any target")
    return out


def ordered(summary: DataFrame, models: list[str]) -> DataFrame:
    """A summary with target_order and model_order, sorted by them: targets as listed, models as in the slate, others last by name."""
    place = lambda c, names: F.coalesce(F.expr("nullif(array_position({}, {}), 0)".format("array(" + ", ".join(f"'{n}'" for n in names) + ")", c)), F.lit(len(names) + 1)).cast("int")
    out = summary.withColumn("target_order", place("target", [t.name for t in TARGETS])).withColumn("model_order", place("model", models))
    return out.orderBy("target_order", "model_order", "model")


# The columns of the comparison table and how each is written.
SHOWN = {"accuracy": "%.4f", "log_loss": "%.4f", "brier": "%.4f", "ece": "%.4f", "mae": "%.3f", "rmse": "%.3f", "ats_pct": "%.4f", "ats_units": "%+.1f", "ou_pct": "%.4f"}


def format_table(summary: DataFrame, models: list[str], breakeven: float = 0.5238) -> str:
    """The comparison table to read: a block for each target, a dash for what is unknown, and the break-even rate below.

    A summary has one row a target and model, so it is gathered as it is.
    """
    have = [c for c in ("n_games", *SHOWN) if c in summary.columns]
    rows = ordered(summary, models).select("target", "model", *have).collect()
    if not rows:
        return "(no results)"
    blocks = []
    for t in TARGETS:
        own = [r for r in rows if r["target"] == t.name]
        if not own:
            continue
        columns = ["model", *(c for c in have if any(r[c] is not None for r in own))]
        told = [columns] + [[str(r[c]) if c not in SHOWN else "-" if r[c] is None else SHOWN[c] % r[c] for c in columns] for r in own]
        width = [max(len(x[i]) for x in told) for i in range(len(columns))]
        lines = ["  ".join(x.rjust(w) for x, w in zip(row, width)) for row in told]
        blocks.append(f"--- {t.name}: {t.label}{'' if t.market else '   [no market benchmark exists]'} ---\n" + "\n".join(lines))
    return "\n\n".join(blocks) + f"\n\nATS break-even at standard -110 juice: {breakeven:.4f}"


def by_season(predictions: DataFrame, targets: list[Target] | None = None) -> DataFrame:
    return summarize(predictions, targets, ["model", "season"])


def within(df: DataFrame, y: str, p: str, limits: list[float], by: list[str] | None = None) -> DataFrame:
    """The share of predictions within each distance of the outcome."""
    ok = both(y, p)
    hits = [_avg(ok, (F.abs(F.col(p) - F.col(y)) <= k).cast("double")).alias(f"within_{k:g}") for k in limits]
    return df.groupBy(*(by or [])).agg(F.count(F.when(ok, F.lit(1))).alias("n"), *hits)


def bands(df: DataFrame, y: str, p: str) -> DataFrame:
    """Hit rates by confidence."""
    from priorframe.functions.text import confidence

    d = df.filter(both(y, p) & F.col(y).isin(0.0, 1.0)).withColumn("band", confidence(F.col(p)))
    return d.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col(p) > 0.5) == (F.col(y) > 0.5)).cast("double")).alias("hit_rate"))


def recent(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How right recent weeks were: winners, missed points of the total, of each team's score, and confident picks.

    predictions: p_home, pred_spread, pred_total, home_score, away_score; scores are predicted as half of total plus or
    minus margin, to whole points. Games without a result don't count.
    """
    margin, total = F.col("home_score") - F.col("away_score"), F.col("home_score") + F.col("away_score")
    right = ((F.col("p_home") > 0.5) == (margin > 0)).cast("double")
    miss = F.abs(total - F.col("pred_total"))
    whole = lambda c: F.bround(c / 2, 0)
    home = F.abs(F.col("home_score") - whole(F.col("pred_total") + F.col("pred_spread")))
    away = F.abs(F.col("away_score") - whole(F.col("pred_total") - F.col("pred_spread")))
    sure = F.greatest("p_home", 1 - F.col("p_home")) >= 0.70
    done = predictions.filter(margin.isNotNull())
    return done.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).cast("long").alias("hits"), F.avg(right).alias("hit_rate"), F.avg(miss).alias("total_miss"),
        F.avg((miss <= 7).cast("double")).alias("within_7"), F.avg((miss <= 14).cast("double")).alias("within_14"), F.avg((home + away) / 2).alias("team_miss"),
        F.count(F.when(sure, F.lit(1))).alias("sure_n"), F.sum(F.when(sure, right)).cast("long").alias("sure_hits"),
    )


def weekly_record(predictions: DataFrame, target: Target = TARGETS[0]) -> DataFrame:
    return evaluate(predictions, target, ["model", "season", "week"])


def shuffled(df: DataFrame, columns: list[str], key: str, seed: int) -> DataFrame:
    """df with the values of these columns dealt anew among its rows, all by one permutation.

    Rows are numbered twice, by key and by a seeded hash of it, within 1024 hash ranges laid end to end, so that no
    global sort is needed; ranges of both orders are joined by their numbers.
    """
    from pyspark.sql import Window

    def numbered(order: Column, name: str) -> DataFrame:
        d = df.select("*", order.alias("_o")).withColumn("_part", F.shiftrightunsigned("_o", 54))
        sizes = d.groupBy("_part").count()
        starts = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))  # 1024 rows
        n = F.row_number().over(Window.partitionBy("_part").orderBy("_o", key))
        return d.withColumn("_n", n).join(F.broadcast(starts), "_part").withColumn(name, F.col("_n") + F.col("_start")).drop("_o", "_part", "_n", "_start")

    a = numbered(F.xxhash64(F.col(key), F.lit(seed)), "_i")
    b = numbered(F.xxhash64(F.col(key), F.lit(seed + 1)), "_i").select("_i", *(F.col(c).alias(f"_new_{c}") for c in columns))
    got = a.join(b, "_i")
    return got.select(*(F.col(f"_new_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))
