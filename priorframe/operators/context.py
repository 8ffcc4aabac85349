"""Team-game rows and what is known about a game before it starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.functions import dimensions, geo
from priorframe.functions.calendar import hour, kickoff
from priorframe.functions.numbers import flag, number
from priorframe.operators.lookup import era_lookup, venue_cascade
from priorframe.operators.relational import modal, unpivot_sides
from priorframe.operators.temporal import History, prior_mean

INDOOR = ("dome", "closed")
TEAM = History(("team",), ("kickoff", "game_id"))
# Indoor climate, and what stands in where no earlier season is known.
INDOOR_TEMP, INDOOR_WIND, FIRST_TEMP, FIRST_WIND = 70.0, 0.0, 60.0, 8.0


def impute_roof(games: DataFrame) -> DataFrame:
    """roof, else the stadium's most frequent roof, else outdoors."""
    usual = modal(games.filter("roof is not null"), ["stadium_id"], "roof", "_usual")
    return games.join(usual, "stadium_id", "left").withColumn("roof", F.coalesce("roof", "_usual", F.lit("outdoors"))).drop("_usual")


def team_games(spark: SparkSession, games: DataFrame) -> DataFrame:
    """One row for each team of each game, with the venue and the team's own home."""
    home, eras = dimensions.homes(spark), dimensions.eras(spark)
    g = venue_cascade(impute_roof(games), home, eras, dimensions.neutral(spark), dimensions.stadiums(spark))
    g = g.withColumn("kickoff", kickoff(F.col("gameday"), F.col("gametime"))).withColumn("neutral_site", flag(F.col("location") == "Neutral"))
    own = ["team", "opponent", "rest", "team_score", "opp_score", "qb_id", "qb_name", "coach"]
    side = lambda a, b: [f"{a}_team", f"{b}_team", f"{a}_rest", f"{a}_score", f"{b}_score", f"{a}_qb_id", f"{a}_qb_name", f"{a}_coach"]
    common = ["game_id", "season", "week", "game_type", "kickoff", "gameday", "weekday", "gametime", "neutral_site", "roof", "surface", "temp", "wind", "div_game",
              "stadium_id", "venue_lat", "venue_lon", "venue_tz", "venue_known", "spread_line", "total_line"]
    tg = unpivot_sides(g, {"home": side("home", "away"), "away": side("away", "home")}, common, "side")
    tg = tg.withColumnsRenamed(dict(zip(side("home", "away"), own)))
    tg = tg.select("*", flag(F.col("side") == "home").alias("is_home")).drop("side").withColumnsRenamed({"temp": "temp_observed", "wind": "wind_observed"})
    tg = era_lookup(tg, "team", "season", home, eras, ["lat", "lon", "tz"], "team")
    return tg.withColumn("margin", F.col("team_score") - F.col("opp_score")).withColumn("played", F.col("team_score").isNotNull())


def travel(tg: DataFrame, trailing: int = 3) -> DataFrame:
    """Miles, time-zone shift and direction, and the miles of the last games."""
    t = tg.withColumn("travel_miles", geo.snapped(geo.miles(F.col("home_lat"), F.col("home_lon"), F.col("venue_lat"), F.col("venue_lon"))))
    t = t.withColumn("tz_delta", geo.zone_shift(F.col("venue_tz"), F.col("home_tz")))
    return t.select(
        "*", F.abs("tz_delta").alias("tz_abs"), flag(F.col("tz_delta") > 0).alias("travel_east"), flag(F.col("tz_delta") < 0).alias("travel_west"),
        TEAM.sum("travel_miles", trailing).alias("travel_load_3g"),
    )


def rest(tg: DataFrame) -> DataFrame:
    """Rest days (7 in week one, 21 at most) and the flags of weekday, hour and body clock."""
    days = number(F.col("rest"))
    r = F.when(F.col("week") > 1, days).otherwise(F.lit(7.0))
    t = tg.withColumn("rest_days", F.when(r.isNotNull(), F.least(r, F.lit(21.0))))
    day, at = F.col("weekday"), hour(F.col("gametime"))
    early = flag((day == "Sunday") & (at <= 13))
    return t.select(
        "*", flag(F.col("rest_days") <= 4).alias("short_week"), flag(F.col("rest_days") >= 10).alias("long_rest"), flag(F.col("rest_days") >= 13).alias("off_bye"),
        flag(day == "Thursday").alias("is_thursday"), flag(day == "Monday").alias("is_monday"), flag(day == "Sunday").alias("is_sunday"),
        flag(((day == "Sunday") & (at >= 19)) | day.isin("Thursday", "Monday", "Friday", "Saturday")).alias("primetime"),
        early.alias("early_kick"), flag((early == 1) & (F.col("home_tz") <= -8)).alias("west_team_early_east_kick"),
    )


def venue(spark: SparkSession, tg: DataFrame) -> DataFrame:
    """Roof, surface, division and conference flags."""
    div = dimensions.divisions(spark)
    league = lambda team, name: F.broadcast(div.select(F.col("team").alias(team), F.substring("division", 1, 3).alias(name)))
    t = tg.join(league("team", "_own"), "team", "left").join(league("opponent", "_their"), "opponent", "left")
    surface = F.lower("surface")
    t = t.withColumn("div_game", F.coalesce(number(F.col("div_game")), F.lit(0.0)).cast("int"))
    return t.select(
        *tg.columns, flag(F.col("roof").isin(*INDOOR)).alias("is_indoor"), flag(F.col("roof") == "open").alias("is_retractable_open"),
        flag(~surface.isin("grass", "nan")).alias("is_turf"), flag(F.col("_own") == F.col("_their")).alias("conference_game"),
    )


def weather(tg: DataFrame, mode: str = "climatology") -> DataFrame:
    """temp, wind and their flags: as observed, as usual at the stadium in that month of earlier seasons, or not at all."""
    if mode not in ("observed", "climatology", "none"):
        raise ValueError(f"unknown weather mode: {mode!r}")
    if mode == "none":
        return tg
    inside = F.col("roof").isin(*INDOOR)
    t = tg.withColumn("_month", F.month("gameday")).withColumn("_t", number(F.col("temp_observed"))).withColumn("_w", number(F.col("wind_observed")))
    if mode == "climatology":
        counted = ~F.coalesce(inside, F.lit(False)) & F.col("_t").isNotNull()
        for c in ("_t", "_w"):
            value = F.when(counted, F.col(c))
            for k, by in enumerate((["stadium_id", "_month"], ["_month"], [])):
                t = prior_mean(t, by, "season", value, f"{c}{k}")
        t = t.withColumn("_t", F.coalesce("_t0", "_t1", "_t2", F.lit(FIRST_TEMP))).withColumn("_w", F.coalesce("_w0", "_w1", "_w2", F.lit(FIRST_WIND)))
    temp = F.when(inside, F.lit(INDOOR_TEMP)).otherwise(F.col("_t"))
    wind = F.when(inside, F.lit(INDOOR_WIND)).otherwise(F.col("_w"))
    return t.select(*tg.columns, temp.alias("temp"), wind.alias("wind"), flag(wind > 15).alias("wind_gt15"), flag(temp <= 32).alias("temp_freezing"))


def context(spark: SparkSession, tg: DataFrame, mode: str = "climatology") -> DataFrame:
    """All of the above on the rows of tg."""
    return weather(venue(spark, travel(rest(tg))), mode)


def half_scores(plays: DataFrame, home: str = "total_home_score", away: str = "total_away_score", half: str | None = "Half1") -> DataFrame:
    """The greatest running score of each game's first half, or of the whole game if half is None."""
    missing = [c for c in (home, away, "game_half") if c not in plays.columns]
    if missing:
        raise KeyError(", ".join(missing))
    p = plays.filter(F.col("game_half") == half) if half else plays
    return p.groupBy("game_id").agg(F.max(number(F.col(home))).alias("home"), F.max(number(F.col(away))).alias("away"))


def outcome(own: Column, other: Column) -> Column:
    """1, 0, or one half for a tie; null if unknown."""
    return F.when(own > other, 1.0).when(own < other, 0.0).when(own == other, 0.5)


def attach_half_targets(games: DataFrame, halves: DataFrame) -> DataFrame:
    h = halves.select("game_id", F.col("home").alias("h1_home_score"), F.col("away").alias("h1_away_score"))
    g = games.join(h, "game_id", "left")
    a, b = F.col("h1_home_score"), F.col("h1_away_score")
    return g.select("*", (a - b).alias("h1_spread_actual"), (a + b).alias("h1_total_actual"), outcome(a, b).alias("h1_home_win"))
