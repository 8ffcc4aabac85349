"""Boxes, pivots, lookups and set operations over keyed tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorframe.functions.numbers import number

#: Columns that a play table must have as numbers.
NUMERIC = ("epa", "success", "pass", "rush", "down", "ydstogo", "yards_gained", "xpass", "wp", "sack", "interception", "fumble_lost", "qb_dropback")
BOX = ("epa_play", "success_rate", "pass_epa", "rush_epa", "pass_success", "rush_success", "early_epa", "explosive_rate", "pass_rate", "proe", "sack_rate", "turnover_rate")


def pick(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column, or null of that type where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def scrimmage(plays: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Passes and runs with both teams and a value, without garbage time: win probability inside the band or unknown."""
    p = plays.select(*(number(F.col(c)).alias(c) if c in NUMERIC else F.col(c) for c in plays.columns))
    ok = F.col("play_type").isin("pass", "run") & F.col("epa").isNotNull() & F.col("posteam").isNotNull() & F.col("defteam").isNotNull()
    return p.filter(ok & (F.col("wp").between(low, high) | F.col("wp").isNull()) if "wp" in p.columns else ok)


def rates(plays: DataFrame, prefix: str = "", of: Column | None = None) -> list[Column]:
    """Aggregates of BOX and plays over the rows where `of` holds (all without it); null where there are none.

    A play counts as a pass if pass is 1, so an unknown one is none; an unknown sack stays unknown; a play with both an
    interception and a lost fumble has two turnovers.
    """
    of = F.lit(True) if of is None else of
    passing, rushing = F.coalesce(F.col("pass") == 1, F.lit(False)), F.coalesce(F.col("rush") == 1, F.lit(False))
    early = F.coalesce(F.col("down").isin(1, 2), F.lit(False))
    gained = pick(plays, "yards_gained")
    explosive = F.coalesce((passing & (gained >= 20)) | (rushing & (gained >= 10)), F.lit(False)).cast("double")
    lost = F.coalesce(pick(plays, "interception"), F.lit(0.0)) + F.coalesce(pick(plays, "fumble_lost"), F.lit(0.0))
    means = {
        "epa_play": (of, F.col("epa")), "success_rate": (of, F.col("success")), "pass_epa": (passing, F.col("epa")), "rush_epa": (rushing, F.col("epa")),
        "pass_success": (passing, F.col("success")), "rush_success": (rushing, F.col("success")), "early_epa": (early, F.col("epa")), "explosive_rate": (of, explosive),
        "pass_rate": (of, passing.cast("double")), "proe": (of, F.col("pass") - pick(plays, "xpass")), "sack_rate": (passing, pick(plays, "sack")), "turnover_rate": (of, lost),
    }
    return [*(F.avg(F.when(of & when, x)).alias(prefix + name) for name, (when, x) in means.items()), F.sum(F.when(of, F.lit(1).cast("long"))).alias(f"{prefix}plays")]


def box(plays: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of one side by keys; one hash aggregation with map-side partials."""
    return plays.groupBy(*keys).agg(*rates(plays))


def game_box(plays: DataFrame, band: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """(game_id, team): what each team did with the ball and against it, and the difference of the two.

    Every play is laid out for both of its teams and aggregated once, so plays are read and shuffled once; a team that
    only defended has null for its attack, as a full outer join of two boxes would.
    """
    good = scrimmage(plays, *band)
    sides = F.explode(F.array(F.struct(F.col("posteam").alias("team"), F.lit(True).alias("off")), F.struct(F.col("defteam").alias("team"), F.lit(False).alias("off"))))
    laid = good.withColumn("_side", sides)
    both = laid.groupBy("game_id", F.col("_side.team").alias("team")).agg(*rates(good, "off_", F.col("_side.off")), *rates(good, "def_", ~F.col("_side.off")))
    return both.withColumn("net_epa", F.col("off_epa_play") - F.col("def_epa_play"))


def unpivot_sides(games: DataFrame, sides: dict[str, list[str]], common: list[str], key: str = "side") -> DataFrame:
    """One row for each side: sides maps a name to that side's columns, in the order of the first side's names. No shuffle."""
    names = next(iter(sides.values()))
    parts = [F.struct(F.lit(s).alias(key), *(F.col(c).alias(n) for n, c in zip(names, cols))) for s, cols in sides.items()]
    return games.select(*common, F.explode(F.array(*parts)).alias("_s")).select(*common, "_s.*")


def pivot_sides(rows: DataFrame, by: str, is_home: str, columns: list[str]) -> DataFrame:
    """One row a game: home_<column> and away_<column>, by one conditional aggregation."""
    one = lambda flag, c: F.max(F.when(F.col(is_home) == flag, F.col(c)))
    return rows.groupBy(by).agg(*(one(1, c).alias(f"home_{c}") for c in columns), *(one(0, c).alias(f"away_{c}") for c in columns))


def differences(df: DataFrame, columns: list[str], prefix: str = "d_") -> DataFrame:
    return df.select("*", *((F.col(f"home_{c}") - F.col(f"away_{c}")).alias(prefix + c) for c in columns))


def sums(df: DataFrame, columns: list[str], prefix: str = "s_") -> DataFrame:
    return df.select("*", *((F.col(f"home_{c}") + F.col(f"away_{c}")).alias(prefix + c) for c in columns))


def matchup(off: str, defence: str, name: str) -> list[Column]:
    """Each attack less what the other defence allows, and the difference of the two."""
    home = F.col(f"home_{off}") - F.col(f"away_{defence}")
    away = F.col(f"away_{off}") - F.col(f"home_{defence}")
    return [home.alias(f"mu_home_{name}"), away.alias(f"mu_away_{name}"), (home - away).alias(f"mu_net_{name}")]


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def modal(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """The most frequent known value of each key, the smallest of equally frequent ones."""
    return df.groupBy(*keys).agg(F.mode(column, True).alias(name))


def unique_on(df: DataFrame, keys: list[str]) -> bool:
    return df.groupBy(*keys).count().filter("count > 1").limit(1).count() == 0


def demand_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, whose rows fail with a message where a key occurs more than once: checked inside the plan, without a job of its own."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    message = F.concat(F.lit(f"more than one row for ({', '.join(keys)}) = "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    return df.withColumn("_many", many).filter(F.when(F.col("_many") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_many")


def semi_by(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def anti_by(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """old without the keys that new has, and new."""
    return anti_by(old, new, on).unionByName(new, allowMissingColumns=True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By name; a column that a part lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def null_rates(df: DataFrame, columns: list[str], over: float = 0.05) -> DataFrame:
    """feature and null_rate of the columns that are null more often than `over`, in one pass."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    long = one.unpivot([], columns, "feature", "null_rate")
    return long.filter(F.col("null_rate") > over).orderBy(F.desc("null_rate"), "feature")


def correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature and its Pearson correlation with the target, in one pass."""
    one = df.agg(*(F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns))
    return one.unpivot([], columns, "feature", "r")


def cells(df: DataFrame, dims: list[str], depth: int, aggregates: list[Column]) -> DataFrame:
    """Aggregates for every combination of up to `depth` of the dims, in one Expand and one aggregation.

    Columns of dims outside a combination are null; `level` is how many are in, `mask` which (bit i: dims[i]).
    Rows with a null in a combination's dims are left out of it.
    """
    sets = [list(c) for k in range(1, depth + 1) for c in combinations(dims, k)]
    ids = [F.grouping(d).alias(f"_g_{d}") for d in dims]
    got = df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, dims)).agg(*ids, *aggregates)
    known = F.lit(True)
    for d in dims:
        known = known & (F.col(d).isNotNull() | (F.col(f"_g_{d}") == 1))
    level = sum(((1 - F.col(f"_g_{d}").cast("int")) for d in dims), F.lit(0))
    mask = sum(((1 - F.col(f"_g_{d}").cast("int")) * (1 << i) for i, d in enumerate(dims)), F.lit(0))
    return got.filter(known).withColumn("level", level).withColumn("mask", mask).drop(*(f"_g_{d}" for d in dims))
