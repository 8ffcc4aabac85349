"""Scans: tolerant of missing files and columns, pruned to what is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorframe.functions.numbers import flag
from priorframe.operators.relational import union_all

# The columns of the sources.
PLAY_COLUMNS = {
    "game_id": "string", "season": "int", "week": "int", "season_type": "string", "posteam": "string", "defteam": "string", "play_type": "string", "epa": "double", "success": "double", "pass": "double",
    "rush": "double", "down": "double", "ydstogo": "double", "yardline_100": "double", "qtr": "double", "score_differential": "double", "xpass": "double", "qb_epa": "double", "cpoe": "double",
    "yards_gained": "double", "penalty": "double", "special": "double", "sack": "double", "interception": "double", "fumble_lost": "double", "touchdown": "double", "first_down": "double",
    "air_yards": "double", "series_success": "double", "drive": "double", "shotgun": "double", "no_huddle": "double", "wp": "double", "game_half": "string", "total_home_score": "double", "total_away_score": "double",
}
GAME_COLUMNS = {
    "game_id": "string", "season": "int", "game_type": "string", "week": "int", "gameday": "date", "weekday": "string", "gametime": "string", "away_team": "string", "away_score": "double",
    "home_team": "string", "home_score": "double", "location": "string", "result": "double", "away_rest": "int", "home_rest": "int", "spread_line": "double", "total_line": "double", "div_game": "int",
    "roof": "string", "surface": "string", "temp": "double", "wind": "double", "away_qb_id": "string", "home_qb_id": "string", "away_qb_name": "string", "home_qb_name": "string",
    "away_coach": "string", "home_coach": "string", "stadium_id": "string",
}
PLAYER_COLUMNS = {
    "player_id": "string", "player_name": "string", "player_display_name": "string", "position": "string", "season": "int", "week": "int", "season_type": "string", "team": "string", "opponent_team": "string",
    "attempts": "double", "completions": "double", "passing_yards": "double", "passing_epa": "double", "passing_tds": "double", "passing_interceptions": "double", "carries": "double", "rushing_yards": "double",
    "receptions": "double", "targets": "double", "receiving_yards": "double", "receiving_tds": "double", "rushing_tds": "double", "target_share": "double", "air_yards_share": "double",
}
SNAP_COLUMNS = {"game_id": "string", "season": "int", "week": "int", "player": "string", "position": "string", "team": "string", "offense_snaps": "double", "offense_pct": "double"}
INJURY_COLUMNS = {"season": "int", "week": "int", "team": "string", "gsis_id": "string", "position": "string", "full_name": "string", "report_status": "string"}
# The columns of plays that mining reads.
MINING_COLUMNS = {
    "game_id": "string", "play_id": "double", "season": "int", "week": "int", "qtr": "double", "quarter_seconds_remaining": "double", "game_seconds_remaining": "double", "half_seconds_remaining": "double",
    "down": "double", "ydstogo": "double", "yardline_100": "double", "score_differential": "double", "posteam": "string", "defteam": "string", "home_team": "string", "away_team": "string",
    "play_type": "string", "epa": "double", "wp": "double", "success": "double", "yards_gained": "double", "touchdown": "double", "interception": "double", "fumble_lost": "double", "sack": "double",
    "penalty": "double", "fourth_down_converted": "double", "fourth_down_failed": "double", "third_down_converted": "double", "third_down_failed": "double", "drive": "double",
    "fixed_drive_result": "string", "goal_to_go": "double", "shotgun": "double", "no_huddle": "double", "posteam_timeouts_remaining": "double", "game_half": "string",
    "total_home_score": "double", "total_away_score": "double",
}
ABSENT = ("Out", "Doubtful")


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist and aren't empty, in any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for x in paths:
        p = jvm.org.apache.hadoop.fs.Path(x)
        fs = p.getFileSystem(conf)
        if fs.exists(p) and fs.getContentSummary(p).getLength() > 0:
            out.append(x)
    return out


def conformed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Those columns in that order and type; what the table lacks, or can't be read as that type, is null."""
    have = set(df.columns)
    return df.select(*((F.col(c).try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in columns.items()))


def read_parquet(spark: SparkSession, paths: list[str], columns: dict[str, str]) -> DataFrame:
    """One table from files whose schemas drift: each is read with its own schema, pruned and conformed."""
    found = present(spark, paths)
    if not found:
        return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))
    return union_all([conformed(spark.read.parquet(p), columns) for p in found])


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """The schedule, from CSV by header name; malformed values are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, nullValue="NA")
    games = conformed(raw.withColumn("gameday", F.to_date(F.try_to_timestamp("gameday"))) if "gameday" in raw.columns else raw, GAME_COLUMNS)
    return games.filter("game_id is not null")


def read_plays(spark: SparkSession, folder: str, seasons: list[int], columns: list[str] | None = None) -> DataFrame:
    wanted = {c: PLAY_COLUMNS[c] for c in columns} if columns else PLAY_COLUMNS
    return read_parquet(spark, [f"{folder}/pbp_{s}.parquet" for s in seasons], wanted)


def read_mining_plays(spark: SparkSession, folder: str, seasons: list[int]) -> DataFrame:
    """The plays of those seasons with the columns that mining reads; an empty table if there are none."""
    return read_parquet(spark, [f"{folder}/pbp_{s}.parquet" for s in seasons], MINING_COLUMNS)


def read_starters(spark: SparkSession, paths: list[str], attempts: int = 10) -> DataFrame:
    """Quarterback weeks with enough attempts; both filters reach the scan."""
    return read_parquet(spark, paths, PLAYER_COLUMNS).filter((F.col("position") == "QB") & (F.col("attempts") >= attempts))


def read_player_weeks(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_parquet(spark, paths, PLAYER_COLUMNS).filter((F.col("season_type") == "REG") & F.col("position").isin("WR", "TE", "RB", "QB"))


def read_snaps(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_parquet(spark, paths, SNAP_COLUMNS)


def read_injuries(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_parquet(spark, paths, INJURY_COLUMNS).withColumn("is_out", flag(F.col("report_status").isin(*ABSENT)))


def season_range(df: DataFrame, first: int, last: int, warm: int = 0) -> DataFrame:
    return df.filter(F.col("season").between(first - warm, last))


def schema_of(columns: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in columns.items()))
