"""Strictly-prior windows and as-of joins: the leakage barrier.

``History`` is an ordering of rows within an entity; everything it offers looks
at earlier rows only. Columns made from one History share one sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class History:
    """Rows of an entity (columns by), in time order (columns order, the last ones breaking ties)."""

    by: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def window(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    @property
    def before(self):
        return self.window.rowsBetween(Window.unboundedPreceding, -1)

    def last_n(self, n: int):
        return self.window.rowsBetween(-n, -1)

    def lag(self, c: str | Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.window)

    def lead(self, c: str | Column, n: int = 1) -> Column:
        return F.lead(c, n).over(self.window)

    def count(self) -> Column:
        """How many rows stand before."""
        return (F.row_number().over(self.window) - 1).cast("long")

    def ewma(self, c: str, halflife: float) -> Column:
        """The mean of earlier values, each weighing half as much for every `halflife` values after it; nulls don't age.

        Folds the earlier values in order, so it is exact at any length; quadratic in an entity's rows. with_running_ewma
        is linear and gives the same: use it where histories are long or columns are many.
        """
        a = 0.5 ** (1.0 / halflife)
        state = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
        earlier = F.collect_list(F.col(c).cast("double")).over(self.before)
        step = lambda s, x: F.struct((s["n"] * a + x).alias("n"), (s["d"] * a + 1.0).alias("d"))
        return F.aggregate(earlier, state, step, lambda s: F.when(s["d"] > 0, s["n"] / s["d"]))

    def mean(self, c: str, n: int, least: int = 2) -> Column:
        w = self.last_n(n)
        return F.when(F.count(c).over(w) >= least, F.avg(c).over(w))

    def std(self, c: str, n: int, least: int = 3) -> Column:
        w = self.last_n(n)
        return F.when(F.count(c).over(w) >= least, F.stddev_samp(c).over(w))

    def sum(self, c: str | Column, n: int) -> Column:
        return F.coalesce(F.sum(c).over(self.last_n(n)), F.lit(0.0))

    def changed(self, c: str) -> Column:
        """1 where the value differs from the one before, both known."""
        return F.coalesce(self.lag(c) != F.col(c), F.lit(False)).cast("int")


def with_running_ewma(df: DataFrame, history: History, columns: list[str], halflife: float, names: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """df with <column>_ewma (or names) for all columns by running sums: linear in an entity's rows.

    Equal to History.ewma; inclusive also takes the row's own value. Rows are cut into blocks of 100 half-lives, the
    same for all columns, so weights stay within range: inside a block sums run with weights counted from its start,
    and what a block leaves behind is carried to the next ones by a fold over blocks, not rows. One exchange and two
    sorts, by time and by block and time, serve all columns.
    """
    names = names or [f"{c}_ewma" for c in columns]
    block, fade = max(1, int(100 * halflife)), 0.5 ** (1.0 / halflife)
    a, grow = f"{fade!r}D", f"{1 / fade!r}D"
    by, order = ", ".join(f"`{c}`" for c in history.by), ", ".join(f"`{c}`" for c in history.order)
    line, own = f"partition by {by} order by {order}", f"partition by {by}, _b order by {order}"
    upto, before = "rows between unbounded preceding and current row", "rows between unbounded preceding and 1 preceding"
    d = df.selectExpr("*", f"floor((row_number() over ({line}) - 1) / {block}) as _b")
    # of each column the values before this row in its block
    seen = [f"count(`{c}`) over ({own} {before}) as _k{i}" for i, c in enumerate(columns)]
    d = d.selectExpr("*", f"coalesce(lead(_b) over ({line}) <> _b, true) as _end", *seen)
    sums = []
    for i, c in enumerate(columns):
        for j, value in enumerate((f"cast(`{c}` as double) * power({grow}, _k{i})", f"case when `{c}` is not null then power({grow}, _k{i}) end")):
            sums.append(f"coalesce(sum({value}) over ({own} {upto if inclusive else before}), 0D) as _s{i}{j}")
            sums.append(f"case when _end then coalesce(sum({value}) over ({own} {upto}), 0D) end as _t{i}{j}")
    d = d.selectExpr("*", *sums)
    # what the blocks before leave, the latest value with weight one
    ends = []
    for i, c in enumerate(columns):
        m = f"(_k{i} + cast(`{c}` is not null as int))"
        state = f"named_struct('n', _t{i}0 * power({a}, {m} - 1), 'd', _t{i}1 * power({a}, {m} - 1), 'f', power({a}, {m}))"
        ends.append(f"collect_list(case when _end then {state} end) over (partition by {by} order by _b range between unbounded preceding and 1 preceding) as _p{i}")
    d = d.selectExpr("*", *ends)
    left = "aggregate(_p{0}, named_struct('n', 0D, 'd', 0D), (s, x) -> named_struct('n', s.n * x.f + x.n, 'd', s.d * x.f + x.d)) as _l{0}"
    d = d.selectExpr("*", *(left.format(i) for i in range(len(columns))))
    made = []
    for i, (c, name) in enumerate(zip(columns, names)):
        m = f"(_k{i} + cast(`{c}` is not null as int))" if inclusive else f"_k{i}"
        part = lambda j, f: f"(_s{i}{j} * power({a}, {m} - 1) + _l{i}.{f} * power({a}, {m}))"  # noqa: B023, E731
        made.append(f"case when {part(1, 'd')} > 0 then {part(0, 'n')} / {part(1, 'd')} end as `{name}`")
    return d.selectExpr(*(f"`{c}`" for c in df.columns), *made)


def with_games_in_season(df: DataFrame, history: History, season: str, name: str, reset: bool = False) -> DataFrame:
    """df with how often the previous row had the same season, counted over the whole history, or within the season if reset."""
    if reset:
        own = Window.partitionBy(*history.by, season).orderBy(*history.order)
        return df.withColumn(name, (F.row_number().over(own) - 1).cast("long"))
    same = F.coalesce(history.lag(season) == F.col(season), F.lit(False)).cast("long")
    running = F.sum("_same").over(history.window.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_same", same).withColumn(name, running).drop("_same")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, columns: list[str], ties: str | None = None, strict: bool = False) -> DataFrame:
    """left with, for each row, `columns` of the latest row of right with the same `by` and on <= left's on (< if strict).

    One union, one sort: rows of both sides are laid on one line per key and the last right row is carried
    forward. Of right rows at one time the one with the greatest `ties` counts. Linear in both sides; neither is
    broadcast. Left rows come back once each, whether they match or not; rows with a null key never match.
    """
    payload = F.struct(F.lit(True).alias("is"), *columns)
    null = F.lit(None)
    r = right.select(*by, F.col(on).alias("_at"), F.lit(1 if strict else 0).alias("_side"), (F.col(ties) if ties else F.lit(0)).alias("_tie"),
                     payload.alias("_payload"), null.cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_left"))
    tie_type = r.schema["_tie"].dataType
    lf = left.select(*by, F.col(on).alias("_at"), F.lit(0 if strict else 1).alias("_side"), null.cast(tie_type).alias("_tie"),
                     null.cast(r.schema["_payload"].dataType).alias("_payload"), F.struct(*left.columns).alias("_left"))
    line = Window.partitionBy(*by).orderBy("_at", "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("_payload.is"), F.col("_payload")), ignorenulls=True).over(line)
    keyed = F.lit(True)
    for b in by:
        keyed = keyed & F.col(b).isNotNull()
    both = r.unionByName(lf).withColumn("_found", F.when(keyed, known)).filter("_left is not null")
    return both.select("_left.*", *(F.col(f"_found.{c}").alias(c) for c in columns))


def fold_join(train: DataFrame, folds: DataFrame, time: str, boundary: str = "asof") -> DataFrame:
    """Every training row with every fold whose boundary is after it: what each fold may learn from.

    folds is a table of boundaries, whose number is that of evaluation dates, not of rows.
    """
    return train.join(folds, F.col(time) < F.col(boundary))


def fold_sums(df: DataFrame, folds: DataFrame, time: str, boundary: str, start: list[Column], merged) -> DataFrame:
    """folds with `state`: aggregates of the rows before each boundary, without a row for each pair of row and fold.

    start: aggregates of a group, aliased; merged(a, b): the state of two groups as a struct of the same fields. Rows are
    aggregated by the number of boundaries they are not before (map-side, to as many groups as boundaries); those states
    are then merged in order.
    """
    bounds = folds.select(F.array_sort(F.collect_set(boundary))).scalar()
    past = F.size(F.filter("_bounds", lambda x: x <= F.col(time)))
    groups = df.filter(F.col(time).isNotNull()).withColumn("_bounds", bounds).withColumn("_at", past).groupBy("_at").agg(*start)
    names = [c for c in groups.columns if c != "_at"]
    ladder = folds.select(boundary).distinct().withColumn("_at", F.row_number().over(Window.orderBy(boundary)) - 1)  # one row a boundary
    upto = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    state = F.struct(*names)
    step = ladder.join(groups, "_at", "left").select(boundary, F.collect_list(F.when(F.col(names[0]).isNotNull(), state)).over(upto).alias("_all"))
    total = F.aggregate(F.slice("_all", 2, F.greatest(F.lit(1), F.size("_all"))), F.get("_all", 0), merged)
    return folds.join(step.select(boundary, F.when(F.size("_all") > 0, total).alias("state")), boundary)


def prior_mean(df: DataFrame, by: list[str], period: str, value: Column, name: str) -> DataFrame:
    """df with the mean of value over all rows of earlier periods with the same `by`.

    Aggregates to periods first, so even without keys the window only orders the periods.
    """
    sums = df.groupBy(*by, period).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    w = Window.partitionBy(*by).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    means = sums.select(*(F.col(c).alias(f"_k_{c}") for c in (*by, period)), (F.sum("_s").over(w) / F.when(F.sum("_c").over(w) > 0, F.sum("_c").over(w))).alias(name))
    cond = F.lit(True)
    for c in (*by, period):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(means, cond, "left").select(*df.columns, name)
