"""Lookups by range, and cascades of lookups. Dimension tables are literals of a fixed size, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def era_lookup(df: DataFrame, key: str, period: str, default: DataFrame, eras: DataFrame, values: list[str], name: str, prefix: str = "home_") -> DataFrame:
    """df with `values` of its key: from the era (key, first, last) that holds the period, else from the default table.

    Both tables have the key under `name`. An unknown key gives null; see assert_known.
    """
    e = F.broadcast(eras.select(F.col(name).alias("_e"), "first", "last", *(F.col(v).alias(f"_e_{v}") for v in values)))
    d = F.broadcast(default.select(F.col(name).alias("_d"), *(F.col(v).alias(f"_d_{v}") for v in values)))
    got = df.join(e, (F.col(key) == F.col("_e")) & F.col(period).between(F.col("first"), F.col("last")), "left").join(d, F.col(key) == F.col("_d"), "left")
    return got.select(*(df[c] for c in df.columns), *(F.coalesce(f"_e_{v}", f"_d_{v}").alias(prefix + v) for v in values))


def assert_known(c: Column, what: str) -> Column:
    """The value; the query fails with a message where it is null."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"unknown {what}")).cast("double")).otherwise(c)


def venue_cascade(games: DataFrame, home: DataFrame, eras: DataFrame, neutral: DataFrame, stadiums: DataFrame) -> DataFrame:
    """games with venue_lat, venue_lon, venue_tz and venue_known.

    A neutral site is the mapped stadium, else the team whose stadium it is, else the home team's venue with venue_known
    false; any other game is at the home team's venue.
    """
    away = F.col("location") == "Neutral"
    n = F.broadcast(neutral.select(F.col("stadium_id").alias("_n"), *(F.col(v).alias(f"_n_{v}") for v in ("lat", "lon", "tz"))))
    s = F.broadcast(stadiums.select(F.col("stadium_id").alias("_s"), F.col("team").alias("_owner")))
    g = games.join(n, away & (F.col("stadium_id") == F.col("_n")), "left").join(s, away & (F.col("stadium_id") == F.col("_s")), "left")
    g = g.withColumn("_at", F.coalesce("_owner", "home_team"))
    g = era_lookup(g, "_at", "season", home, eras, ["lat", "lon", "tz"], "team", "_v_")
    known = ~F.coalesce(away, F.lit(False)) | F.col("_n").isNotNull() | F.col("_owner").isNotNull()
    return g.select(*(g[c] for c in games.columns), *(F.coalesce(f"_n_{v}", f"_v_{v}").alias(f"venue_{v}") for v in ("lat", "lon", "tz")), known.alias("venue_known"))


def fallback(*levels: Column | str) -> Column:
    """The first level that is known."""
    return F.coalesce(*levels)
