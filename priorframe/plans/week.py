"""The coming week: its games, their predictions, and how they read."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe import predlog
from priorframe.functions.text import confidence, percent
from priorframe.metrics import TARGETS
from priorframe.models.base import Model


def upcoming(df: DataFrame, now: datetime | str) -> DataFrame:
    """The unplayed games of the first week that has one after now, those after now only; LookupError if there is none."""
    t = F.lit(str(now)).cast("timestamp_ntz")
    later = df.filter(~F.col("played") & (F.col("kickoff") > t))
    first = later.orderBy("kickoff", "season", "week").select("season", "week").limit(1).collect()
    if not first:
        raise LookupError("no game after " + str(now))
    return later.filter((F.col("season") == first[0][0]) & (F.col("week") == first[0][1]))


def train(df: DataFrame, asof, models: Callable[[], list[Model]], least: int = 1, regular_only: bool = False) -> list[Model]:
    """All models on what was played before asof, each fitted in a task of its own; only the fitted models come to the driver."""
    rows = df.filter(F.col("played") & (F.col("kickoff") < F.lit(str(asof)).cast("timestamp_ntz")))
    if regular_only:
        rows = rows.filter(F.col("game_type") == "REG")
    n = rows.limit(max(1, least)).count()
    if n < max(1, least):
        raise RuntimeError(f"{n} training rows")
    names = [m.name for m in models()]
    each = rows.withColumn("_model", F.explode(F.array(*map(F.lit, names))))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        name = g["_model"].iloc[0]
        fitted = next(m for m in models() if m.name == name).fit(g.drop(columns="_model").sort_values(["kickoff", "game_id"], ignore_index=True))
        return pd.DataFrame({"name": [name], "model": [pickle.dumps(fitted)]})

    got = {r[0]: pickle.loads(r[1]) for r in each.groupBy("_model").applyInPandas(fit, "name string, model binary").collect()}  # noqa: S301
    return [got[n] for n in names]


def predict_week(spark: SparkSession, df: DataFrame, season: int, week: int, models: Callable[[], list[Model]], log_path: str | None = None, vintage: str = "unknown", regular_only: bool = False) -> DataFrame:
    """Predictions for one week by all models, as of its first kickoff; appended to the log if one is given."""
    slate = df.filter((F.col("season") == season) & (F.col("week") == week))
    games = slate.toPandas()  # one week's games
    if games.empty:
        raise LookupError(f"no games in {season} week {week}")
    fitted = train(df, games["kickoff"].min(), models, regular_only=regular_only)
    keep = [c for c in ("game_id", "season", "week", "kickoff", "home_team", "away_team", "vegas_spread", "vegas_total") if c in games]
    parts = [games[keep].assign(model=m.name, **m.predict(games)) for m in fitted]
    out = pd.concat(parts, ignore_index=True)
    out["kickoff"] = out["kickoff"].astype(str)
    for t in TARGETS:
        if t.prediction in out:
            out[t.prediction] = out[t.prediction].astype(float)
    got = spark.createDataFrame(out)
    if log_path:
        predlog.append(spark, got, log_path, vintage)
    return got


def told(predictions: DataFrame) -> DataFrame:
    """Scores, winner, confidence and half-time leader in words."""
    total, margin = F.col("pred_total"), F.col("pred_spread")
    home = F.col("p_home") > 0.5
    lead = F.col("p_home_h1") if "p_home_h1" in predictions.columns else F.lit(None).cast("double")
    return predictions.select(
        "model", "game_id", "home_team", "away_team", F.round((total + margin) / 2).cast("int").alias("home_points"), F.round((total - margin) / 2).cast("int").alias("away_points"),
        F.when(home, F.col("home_team")).otherwise(F.col("away_team")).alias("winner"), percent(F.greatest("p_home", 1 - F.col("p_home"))).alias("chance"),
        confidence(F.col("p_home")).alias("confidence"), F.when(lead > 0.5, F.col("home_team")).when(lead.isNotNull(), F.col("away_team")).alias("half_leader"),
    )
