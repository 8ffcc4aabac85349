"""The modelling table: one row a game, everything in it known before kickoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.config import Config
from priorframe.functions.calendar import kickoff
from priorframe.operators import context as C
from priorframe.operators import players, ratings, ridge
from priorframe.operators.relational import differences, game_box, matchup, pivot_sides, semi_by, sums
from priorframe.operators.temporal import with_games_in_season, with_running_ewma
from priorframe.sources import cache

# The rolling metrics and the columns of each namespace.
METRICS = (
    "off_epa_play", "off_success_rate", "off_pass_epa", "off_rush_epa", "off_early_epa", "off_explosive_rate", "off_proe", "off_sack_rate", "off_turnover_rate",
    "def_epa_play", "def_success_rate", "def_pass_epa", "def_rush_epa", "def_early_epa", "def_explosive_rate", "net_epa", "off_plays", "def_plays",
)
GAME_CONTEXT = ("div_game", "conference_game", "neutral_site", "is_indoor", "is_retractable_open", "is_turf", "primetime", "is_thursday", "is_monday", "temp", "wind", "wind_gt15", "temp_freezing")
SIDE_CONTEXT = ("rest_days", "short_week", "long_rest", "off_bye", "travel_miles", "tz_delta", "tz_abs", "travel_load_3g", "west_team_early_east_kick")
R8 = ("off_epa_play_r8", "def_epa_play_r8", "net_epa_r8", "off_success_rate_r8")
ADJUSTED = ("adj_off_epa_play_off", "adj_off_epa_play_def", "adj_off_epa_play_net", "adj_off_success_rate_net")
STARTER = ("qb_epa_ewma", "qb_starts", "qb_is_new", "qb_is_rookie_ish", "qb_epa_delta")
SUMMED = (
    "off_epa_play_ewma", "def_epa_play_ewma", "off_success_rate_ewma", "off_explosive_rate_ewma", "off_pass_epa_ewma", "off_proe_ewma",
    "off_plays_ewma", "def_plays_ewma", "points_for_ewma", "points_against_ewma", "points_for_r8", "points_against_r8",
)
MATCHUPS = (("off_epa_play_ewma", "def_epa_play_ewma", "epa"), ("off_pass_epa_ewma", "def_pass_epa_ewma", "pass_epa"), ("off_rush_epa_ewma", "def_rush_epa_ewma", "rush_epa"), ("off_success_rate_ewma", "def_success_rate_ewma", "success"))
LEAN = ("elo_diff", "d_adj_off_epa_play_net", "d_net_epa_ewma", "d_rest_days", "s_expected_total", "d_margin_r5")
ELO = ("elo_diff", "elo_prob_home", "elo_spread_home")


def rolling(tg: DataFrame, box: DataFrame, halflife: float = 6.0, windows: tuple[int, ...] = (8,), reset_by_season: bool = False) -> DataFrame:
    """tg with, for every metric, the prior EWMA and rolling means, counts, points for and against, and recent margin.

    All windows share a team's order; the EWMAs of all metrics are made in one linear pass.
    """
    t = tg.join(box, ["game_id", "team"], "left")
    h = C.TEAM
    have = [m for m in METRICS if m in t.columns]
    made = [h.mean(m, w).alias(f"{m}_r{w}") for m in have for w in windows]
    made += [h.count().alias("games_played"), h.mean("team_score", 8).alias("points_for_r8"), h.mean("opp_score", 8).alias("points_against_r8"), h.mean("margin", 5).alias("margin_r5")]
    faded = [*have, "team_score", "opp_score"]
    t = with_running_ewma(t.select("*", *made), h, faded, halflife, [*(f"{m}_ewma" for m in have), "points_for_ewma", "points_against_ewma"])
    return with_games_in_season(t, h, "season", "games_this_season", reset_by_season)


def before(games: DataFrame, plays: DataFrame, asof: str) -> tuple[DataFrame, DataFrame]:
    """Only games that kicked off before asof, and their plays."""
    early = games.filter(kickoff(F.col("gameday"), F.col("gametime")) < F.lit(asof).cast("timestamp_ntz"))
    return early, semi_by(plays, early, ["game_id"])


def boundaries(tg: DataFrame) -> DataFrame:
    return tg.groupBy("season", "week").agg(F.min("kickoff").alias("asof"))


def build(spark: SparkSession, games: DataFrame, plays: DataFrame, starters: DataFrame | None, cfg: Config, asof: str | None = None) -> DataFrame:
    """games, plays and starters to the modelling table, as one plan; the caller's sink is its only action."""
    warm, first, last = cfg.get("data.pbp_warmup_seasons"), cfg.get("data.start_season"), cfg.get("data.end_season")
    games = games.filter(F.col("season").between(first - warm, last))
    if asof:
        games, plays = before(games, plays, asof)
    tg = C.context(spark, C.team_games(spark, games), cfg.get("features.weather.mode"))
    windows = tuple(w for w in cfg.get("features.rolling_windows") if w == 8) or (8,)
    team = rolling(tg, game_box(plays), cfg.get("features.ewma_halflife"), windows)
    adj = cfg.get("features.opponent_adjust")
    if adj["enabled"]:
        history = team.select("team", "opponent", "is_home", "kickoff", *(f"off_{m}" for m in ridge.METRICS))
        solved = ridge.adjusted(history, boundaries(tg), ridge.METRICS, adj["ridge_alpha"], adj["recency_halflife_days"], adj["min_games_required"])
        team = team.join(solved.withColumnsRenamed({f"{m}_{s}": f"adj_off_{m}_{s}" for m in ridge.METRICS for s in ("off", "def", "net")}), ["season", "week", "team"], "left")
    else:
        team = team.select("*", *(F.lit(None).cast("double").alias(c) for c in ADJUSTED))
    if starters is not None:
        team = players.starter_features(starters, team)
    else:
        team = team.select("*", *(F.lit(None).cast("double").alias(c) for c in STARTER))

    wide = paired(pivot_sides(team, "game_id", "is_home", list(dict.fromkeys([*DIFFERENCED, *SUMMED, *GAME_CONTEXT]))))
    timed = games.withColumn("kickoff", kickoff(F.col("gameday"), F.col("gametime")))
    e = cfg.get("features.elo")
    rated = ratings.elo(timed, k=e["k"], home_field=e["home_field"], season_regression=e["season_regression"], initial=e["initial_rating"], margin_of_victory=e["mov_multiplier"])
    out = timed.join(wide, "game_id", "left").join(rated.select("game_id", *ELO), "game_id", "left")
    out = out.withColumn("played", F.col("home_score").isNotNull()).withColumn("spread_actual", F.col("home_score") - F.col("away_score"))
    out = out.withColumn("total_actual", F.col("home_score") + F.col("away_score")).withColumn("home_win", C.outcome(F.col("home_score"), F.col("away_score")))
    out = C.attach_half_targets(out, C.half_scores(plays))
    out = out.withColumn("ctx_week", F.col("week")).withColumn("vegas_spread", F.col("spread_line")).withColumn("vegas_total", F.col("total_line"))
    keep = [c for c in META + TARGETS + ("vegas_spread", "vegas_total") if c in out.columns]
    made = [c for c in out.columns if c.startswith(("ctx_", "d_", "s_", "mu_", "elo_"))]
    return out.filter(F.col("season") >= first).select(*keep, *made)


FORM = (*(f"{m}_ewma" for m in METRICS), *R8, "games_this_season", "margin_r5")
DIFFERENCED = (*SIDE_CONTEXT, *FORM, *ADJUSTED, *STARTER)


def paired(wide: DataFrame) -> DataFrame:
    """home_ and away_ columns to differences, sums, expected points and plays, matchups and the context of the game.

    What a side is expected to score is the mean of what it scores and what the other allows, and likewise its plays.
    """
    mean = lambda mine, theirs: (F.col(mine) + F.col(theirs)) / 2
    up, down = mean("home_points_for_ewma", "away_points_against_ewma"), mean("away_points_for_ewma", "home_points_against_ewma")
    plays = mean("home_off_plays_ewma", "away_def_plays_ewma") + mean("away_off_plays_ewma", "home_def_plays_ewma")
    have = lambda names: [c for c in names if f"home_{c}" in wide.columns]
    return sums(differences(wide, have(DIFFERENCED)), have(SUMMED)).select(
        "*", (up + down).alias("s_expected_total"), (up - down).alias("d_expected_margin"), plays.alias("s_expected_plays"),
        *(x for m in MATCHUPS for x in matchup(*m)), *(F.col(f"home_{c}").alias(f"ctx_{c}") for c in have(GAME_CONTEXT)),
    )


META = ("game_id", "season", "week", "game_type", "kickoff", "gameday", "home_team", "away_team", "home_qb_id", "away_qb_id", "played")
TARGETS = ("home_score", "away_score", "spread_actual", "total_actual", "home_win", "h1_home_score", "h1_away_score", "h1_spread_actual", "h1_total_actual", "h1_home_win")


def feature_groups(columns: list[str]) -> dict[str, list[str]]:
    """Group to columns, by prefix and list; d_off_bye is in both context and form, as its prefix says."""
    has = set(columns)
    pick = lambda names: [c for c in names if c in has]
    starts = lambda *prefixes: [c for c in columns if c.startswith(prefixes)]
    return {
        "context": starts("ctx_", "d_rest", "d_short", "d_long", "d_off_bye", "d_travel", "d_tz", "d_west"),
        "form": [c for c in columns if c.startswith(("d_off_", "d_def_", "d_net_")) or c in ("d_margin_r5", "d_games_this_season")],
        "adjusted": starts("d_adj_"), "matchup": starts("mu_"), "elo": starts("elo_"), "totals": starts("s_"), "vegas": starts("vegas_"),
        "lean": pick(LEAN), "qb": pick(f"d_{c}" for c in STARTER), "lean_qb": pick((*LEAN, "d_qb_epa_ewma", "d_qb_is_new")),
    }


def select_features(columns: list[str], groups: list[str]) -> list[str]:
    """The columns of these groups, in order, each once; KeyError for an unknown group."""
    by = feature_groups(columns)
    if unknown := [g for g in groups if g not in by]:
        raise KeyError(f"unknown feature groups {unknown}; there are {sorted(by)}")
    return list(dict.fromkeys(c for g in groups for c in by[g]))


def cached_features(spark: SparkSession, games: DataFrame, plays: DataFrame, starters: DataFrame | None, cfg: Config, vintage: str, force: bool = False) -> DataFrame:
    """build, kept by the data's vintage and the settings that shape it."""
    settings = {k: cfg.get(k) for k in ("data", "features")}
    return cache.cached(spark, cfg.get("paths.feature_cache"), "features", vintage, settings, lambda: build(spark, games, plays, starters, cfg), force)
