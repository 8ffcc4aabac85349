"""Commands: fetch, build-features, backtest, train, predict-week, score, audit, and the reports on a backtest."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import functions as F

from priorframe import metrics, predlog
from priorframe.config import Config
from priorframe.functions.calendar import eastern_now
from priorframe.models.linear import Linear
from priorframe.models.registry import DEFAULT_GROUPS, save, slate
from priorframe.operators import mining
from priorframe.operators.relational import null_rates
from priorframe.plans import audits, features, walkforward, week
from priorframe.session import session
from priorframe.sources import cache, tables

GAMES = "games.csv"


def _table(spark, cfg: Config, asof: str | None = None, force: bool = False):
    raw = cfg.get("paths.raw_cache")
    games = tables.read_games(spark, f"{raw}/{GAMES}")
    plays = tables.read_plays(spark, raw, cfg.event_seasons)
    starters = tables.read_starters(spark, [f"{raw}/stats_player_{s}.parquet" for s in cfg.event_seasons])
    if asof:
        return features.build(spark, games, plays, starters, cfg, asof)
    return features.cached_features(spark, games, plays, starters, cfg, cache.Manifest(f"{raw}/manifest.json").vintage, force)


def _models(df, cfg: Config, targets=None):
    columns = df.columns
    return lambda: slate(cfg, lambda groups: features.select_features(columns, groups), targets)


def _regular_only(cfg: Config) -> bool:
    return not cfg.get("data.include_postseason_in_training")


def _backtested(spark, cfg: Config):
    return spark.read.parquet(f"{cfg.get('paths.artifacts')}/backtest.parquet").filter("error is null")


def fetch(spark, cfg: Config, a) -> None:
    files = [cache.Source("games", cfg.get("sources.games_url"), GAMES)]
    files += [cache.Source(f"pbp_{s}", cfg.get("sources.pbp_url_template").format(season=s), f"pbp_{s}.parquet", optional=True) for s in cfg.event_seasons]
    m = cache.fetch(cfg.get("paths.raw_cache"), files, a.force)
    print(len(m.entries), "files, vintage", m.vintage)


def build_features(spark, cfg: Config, a) -> None:
    df = _table(spark, cfg, a.asof, a.force)
    print(df.count(), "games,", len(df.columns), "columns")


def backtest(spark, cfg: Config, a) -> None:
    df = _table(spark, cfg)
    b = cfg.get("backtest")
    out = cfg.get("paths.artifacts")
    p = walkforward.run(df, _models(df, cfg, a.targets), b["first_test_season"], b["first_test_week"], b["min_train_games"], _regular_only(cfg), a.models, errors=True)
    p.write.mode("overwrite").parquet(f"{out}/backtest.parquet")
    failed = walkforward.failures(spark.read.parquet(f"{out}/backtest.parquet")).collect()  # at most one row a model
    for r in failed:
        print(f"{r['model']} failed on {r['folds']} folds: {r['error']}")
    p = walkforward.scored_or_raise(_backtested(spark, cfg))
    targets, names = metrics.resolve(a.targets), [m.name for m in _models(df, cfg, a.targets)()]
    summary = metrics.summarize(p, targets).filter("n_games > 0")
    metrics.ordered(summary, names).coalesce(1).write.mode("overwrite").csv(f"{out}/backtest_summary", header=True)
    seasons = metrics.by_season(p, targets).filter("n_games > 0").orderBy("target", "model", "season")
    seasons.coalesce(1).write.mode("overwrite").csv(f"{out}/backtest_by_season", header=True)
    metrics.calibration(p, "home_win", "p_home", ["model"]).coalesce(1).write.mode("overwrite").csv(f"{out}/calibration", header=True)
    print(metrics.format_table(summary, names, cfg.get("evaluation.ats_breakeven")))
    if a.by_season:
        seasons.filter("target = 'win'").groupBy("season").pivot("model").agg(F.round(F.first("accuracy"), 4)).orderBy("season").show(100, truncate=False)


def train(spark, cfg: Config, a) -> None:
    df = _table(spark, cfg)
    fitted = week.train(df, a.asof or "9999-12-31 00:00:00", _models(df, cfg), regular_only=_regular_only(cfg))
    out = cfg.get("paths.artifacts")
    os.makedirs(out, exist_ok=True)
    save(fitted, f"{out}/production_models.pkl")
    print(f"trained {len(fitted)} models:", ", ".join(m.name for m in fitted))


def predict_week(spark, cfg: Config, a) -> None:
    df = _table(spark, cfg)
    if a.season is None or a.week is None:
        r = week.upcoming(df, eastern_now()).select("season", "week").first()
        a.season, a.week = r[0], r[1]
    log = None if a.no_log else cfg.get("paths.prediction_log")
    vintage = cache.Manifest(f"{cfg.get('paths.raw_cache')}/manifest.json").vintage
    p = week.predict_week(spark, df, a.season, a.week, _models(df, cfg), log, vintage, _regular_only(cfg))
    shown = week.told(p)
    (shown.filter(F.col("model") == a.model) if a.model else shown).show(500, truncate=False)


def score(spark, cfg: Config, a) -> None:
    log = predlog.read(spark, cfg.get("paths.prediction_log"))
    bad = predlog.verify(log).filter("status = 'tampered'")
    if n := bad.count():
        print(f"WARNING: {n} logged rows fail their content hash")
        bad.select("model", "game_id").show(100)
    got = predlog.score(log, _table(spark, cfg).filter("played"))
    predlog.update_performance(spark, cfg.get("paths.performance_log"), got)
    got.orderBy("season", "week", "target", "model").show(200, truncate=False)


def audit(spark, cfg: Config, a) -> None:
    df = _table(spark, cfg)
    print("data vintage      :", cache.Manifest(f"{cfg.get('paths.raw_cache')}/manifest.json").vintage)
    columns = sorted({c for g in features.feature_groups(df.columns).values() for c in g})
    seen = df.agg(F.count(F.lit(1)), F.count(F.when(F.col("played"), 1)), F.min(F.when(F.col("played"), F.col("season"))), F.max(F.when(F.col("played"), F.col("season")))).first()
    print(f"feature table     : {seen[0]} games, {len(columns)} features")
    print(f"completed games   : {seen[1]}  ({seen[2]}-{seen[3]})")
    nulls = null_rates(df.filter("played"), columns).collect()  # one row a feature
    print(f"features >5% null : {len(nulls)}")
    for r in nulls[:10]:
        print(f"    {r['feature']:40s} {r['null_rate']:.3f}")
    path = cfg.get("paths.prediction_log")
    if predlog.exists(spark, path):
        states = {r[0]: r[1] for r in predlog.verify(predlog.read(spark, path)).groupBy("status").count().collect()}
        bad = states.get("tampered", 0) + states.get("unverifiable", 0)
        print("prediction log    :", f"{states.get('tampered', 0)} TAMPERED and {states.get('unverifiable', 0)} unverifiable rows" if bad else "OK")
    else:
        print("prediction log    : none yet")


def strategy_scan(spark, cfg: Config, a) -> None:
    out = cfg.get("paths.artifacts")
    found = mining.strategy_scan(_backtested(spark, cfg))
    found.orderBy(F.desc("roi")).coalesce(1).write.mode("overwrite").csv(f"{out}/strategy_scan", header=True)
    found = spark.read.csv(f"{out}/strategy_scan", header=True, inferSchema=True)
    n, raw, kept = found.agg(F.count(F.lit(1)), F.count(F.when(F.col("p") < 0.05, 1)), F.count(F.when(F.col("survives"), 1))).first()
    print(f"{n} strategies, {raw} with p < 0.05 where chance alone gives {n * 0.05:.0f}, {kept} after correction")
    found.orderBy(F.desc("roi")).select("model", "context", "bet", "n", "hit_rate", "roi", "p", "survives").show(15, truncate=False)


def mine_patterns(spark, cfg: Config, a) -> None:
    raw = cfg.get("paths.raw_cache")
    plays = mining.outcomes(tables.read_mining_plays(spark, raw, cfg.seasons), tables.read_games(spark, f"{raw}/{GAMES}")).filter(F.col("play_type").isin("pass", "run"))
    state = mining.game_state(plays)
    for outcome in ("posteam_wins", "drive_ends_score", "next_play_explosive"):
        got = mining.residual_mine(state.filter(F.col("season") < a.split), state.filter(F.col("season") >= a.split), outcome, list(mining.DIMS), ["score_state", "time_left", "field_pos", "down_", "distance"], min_n=a.min_n)
        print(f"beyond the obvious: {outcome}")
        mining.noteworthy(got).select(*mining.DIMS, "n", "excess", "hold_excess").show(10, truncate=False)


def scorecard(spark, cfg: Config, a) -> None:
    p = _backtested(spark, cfg).filter((F.col("model") == a.model) & (F.col("season") >= a.since))
    for y, q, label in (("home_win", "p_home", "who wins"), ("h1_home_win", "p_home_h1", "who leads at half-time")):
        b = metrics.bands(p, y, q).withColumn("k", F.round(F.col("hit_rate") * F.col("n")).cast("long"))
        print(label)
        mining.with_interval(b, "k", "n").orderBy(F.desc("hit_rate")).show(truncate=False)
    for y, q, label in (("total_actual", "pred_total", "total points"), ("spread_actual", "pred_spread", "margin")):
        print(label)
        metrics.within(p, y, q, [3, 7, 10, 14]).show(truncate=False)


def score_recent(spark, cfg: Config, a) -> None:
    df = _table(spark, cfg)
    lin = {"c": cfg.get("models.logistic.C"), "alpha": cfg.get("models.ridge.alpha")}
    lean = features.select_features(df.columns, ["lean"])
    p = walkforward.run(df, lambda: [Linear(lean, "lean", coherent=True, **lin)], a.season, 1, 1, _regular_only(cfg))
    done = p.filter(F.col("season") == a.season).join(df.select("game_id", "home_score", "away_score"), "game_id")
    metrics.recent(done, ["week"]).orderBy("week").show(50, truncate=False)
    metrics.recent(done).show(truncate=False)


def overfit_audit(spark, cfg: Config, a) -> None:
    df = _table(spark, cfg)
    audits.overfit(df, lambda: [m for m in _models(df, cfg)() if m.name in ("linear", "lightgbm", "neural")], a.split, cfg.seed).show(truncate=False)
    lin = {"c": cfg.get("models.logistic.C"), "alpha": cfg.get("models.ridge.alpha")}
    sets = {"tiny": features.select_features(df.columns, ["lean"]), "full": features.select_features(df.columns, DEFAULT_GROUPS)}
    audits.tiny_vs_full(df, sets, lambda name, columns: Linear(columns, name, **lin), a.split).show(truncate=False)
    if predlog.exists(spark, f"{cfg.get('paths.artifacts')}/backtest.parquet"):
        audits.drift(_backtested(spark, cfg), a.split).orderBy("model", "era").show(100, truncate=False)


COMMANDS = {
    "fetch": fetch, "build-features": build_features, "backtest": backtest, "train": train, "predict-week": predict_week, "score": score, "audit": audit,
    "strategy-scan": strategy_scan, "mine-patterns": mine_patterns, "scorecard": scorecard, "score-recent": score_recent, "overfit-audit": overfit_audit,
}


def names(text: str) -> list[str]:
    """Comma-separated names."""
    return [n.strip() for n in text.split(",") if n.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="priorframe")
    p.add_argument("-c", "--config")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    one = {name: sub.add_parser(name) for name in COMMANDS}
    for name in ("fetch", "build-features"):
        one[name].add_argument("--force", action="store_true")
    for name in ("build-features", "train"):
        one[name].add_argument("--asof")
    one["backtest"].add_argument("--models", type=names)
    one["backtest"].add_argument("--targets", type=names)
    one["backtest"].add_argument("--by-season", action="store_true")
    one["predict-week"].add_argument("--season", type=int)
    one["predict-week"].add_argument("--week", type=int)
    one["predict-week"].add_argument("--model")
    one["predict-week"].add_argument("--no-log", action="store_true")
    one["mine-patterns"].add_argument("--split", type=int, default=2023)
    one["mine-patterns"].add_argument("--min-n", type=int, default=400)
    one["scorecard"].add_argument("--model", default="neural")
    one["scorecard"].add_argument("--since", type=int, default=2025)
    one["score-recent"].add_argument("--season", type=int, default=2026)
    one["overfit-audit"].add_argument("--split", type=int, default=2025)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    COMMANDS[a.command](session(), Config.load(a.config), a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
