"""Hand-computed fixtures, twins in plain Python, and metamorphic tests."""

import hashlib
import shutil
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from priorframe import metrics, predlog
from priorframe.config import Config
from priorframe.functions import geo, stats
from priorframe.functions.calendar import age_days, instant, kickoff, stamp, to_utc
from priorframe.functions.text import general, row_hash
from priorframe.operators import context, mining, players, ratings, relational, ridge
from priorframe.operators.temporal import History, asof_join, fold_join, with_games_in_season, with_running_ewma
from priorframe.plans import features, walkforward, week

PLAYS = "game_id string, season int, week int, season_type string, posteam string, defteam string, play_type string, epa double, success int, pass int, rush int, down int, ydstogo int, yards_gained int, xpass double, wp double, sack int, interception int, fumble_lost int"


def plays(spark, wp=(0.5,) * 6):
    a = [(1.0, 1, 1, 0, 1, 25, 0.6), (0.0, 0, 0, 1, 2, 3, 0.5), (2.0, 1, 1, 0, 1, 22, 0.8)]
    b = [(-1.0, 0, 1, 0, 1, 2, 0.5), (1.0, 1, 0, 1, 3, 5, 0.5), (0.0, 0, 1, 0, 2, 1, 0.5)]
    rows = []
    for i, (e, s, p, r, dn, y, x) in enumerate(a + b):
        team, other = ("A", "B") if i < 3 else ("B", "A")
        rows.append(("g", 2020, 1, "REG", team, other, "pass" if p else "run", e, s, p, r, dn, 10, y, x, wp[i], 0, 0, 0))
    return spark.createDataFrame(rows, PLAYS)


def by_team(df):
    return {r.team: r for r in df.collect()}


def test_box(spark):
    b = by_team(relational.game_box(plays(spark)))
    assert b["A"].off_epa_play == 1.0 and b["B"].off_epa_play == 0.0 and b["A"].def_epa_play == 0.0 and b["B"].def_epa_play == 1.0 and b["A"].net_epa == 1.0
    assert b["A"].off_explosive_rate == pytest.approx(2 / 3) and b["A"].off_pass_rate == pytest.approx(2 / 3) and b["A"].off_success_rate == pytest.approx(2 / 3)
    assert b["A"].off_proe == pytest.approx(((1 - 0.6) + (0 - 0.5) + (1 - 0.8)) / 3)


def test_box_of_odd_plays(spark):
    """Both kinds of turnover in one play count twice; an unknown sack is no sack and no chance of one; an unknown pass is none."""
    rows = [("g", "A", "B", "pass", 1.0, 1, 1, 0, 1, 1, 1), ("g", "A", "B", "pass", 0.0, 0, 1, 0, None, 0, 0), ("g", "A", "B", "run", 0.0, 0, None, 1, 0, None, 1), ("g", "A", "B", "pass", 0.0, 0, 1, 0, 0, 0, 0)]
    p = spark.createDataFrame(rows, "game_id string, posteam string, defteam string, play_type string, epa double, success int, pass int, rush int, sack int, interception int, fumble_lost int").withColumn("down", F.lit(3)).withColumn("yards_gained", F.lit(0))
    b = by_team(relational.game_box(p))
    a = b["A"]
    assert a.off_turnover_rate == 0.75 and a.off_sack_rate == 0.5 and a.off_pass_rate == 0.75 and a.off_plays == 4 and a.off_early_epa is None and a.off_proe is None
    assert a.def_plays is None and a.net_epa is None and b["B"].off_plays is None and b["B"].def_turnover_rate == 0.75


def test_uniqueness_is_demanded(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "a int, b int")
    assert relational.demand_unique(df, ["a", "b"]).count() == 3
    with pytest.raises(Exception, match="more than one row for \\(a\\) = 1"):
        relational.demand_unique(df, ["a"]).collect()


def test_garbage_time(spark):
    p = plays(spark, (0.5, 0.5, 0.99, 0.5, 0.5, 0.5))
    assert by_team(relational.game_box(p))["A"].off_epa_play == 0.5
    assert by_team(relational.game_box(p, (0.0, 1.0)))["A"].off_epa_play == 1.0


def test_prior_ewma_closed_form(spark):
    k = datetime(2020, 9, 1)
    tg = spark.createDataFrame([(f"g{i}", "A", 2020, i, k + timedelta(days=7 * i), v) for i, v in enumerate((0.2, 0.4, 0.6))], "game_id string, team string, season int, week int, kickoff timestamp_ntz, x double")
    got = tg.select("game_id", context.TEAM.ewma("x", 6.0).alias("e"), context.TEAM.count().alias("n")).orderBy("game_id").collect()
    a = 0.5 ** (1 / 6)
    assert [r.n for r in got] == [0, 1, 2] and got[0].e is None and got[1].e == pytest.approx(0.2) and got[2].e == pytest.approx((0.4 + 0.2 * a) / (1 + a))


def test_windows_against_pandas(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{j}", i, None if rng.random() < 0.2 else float(rng.normal())) for j in range(4) for i in range(700 if j == 0 else 40)]
    df = spark.createDataFrame(rows, "p string, t int, v double")
    h = History(("p",), ("t",))
    got = with_running_ewma(df, h, ["v"], 0.5).select("p", "t", "v", F.col("v_ewma").alias("fast"), h.ewma("v", 0.5).alias("e"), h.mean("v", 8).alias("m"), h.std("v", 8).alias("s"), h.sum("v", 3).alias("u")).toPandas().sort_values(["p", "t"])
    for _, g in got.groupby("p"):
        prior = g["v"].shift(1)
        close = lambda a, b: np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9, atol=1e-9)
        close(g["e"], prior.ewm(halflife=0.5, min_periods=1, ignore_na=True).mean())
        close(g["fast"], g["e"])
        close(g["m"], prior.rolling(8, min_periods=2).mean())
        close(g["s"], prior.rolling(8, min_periods=3).std())
        close(g["u"], prior.rolling(3, min_periods=1).sum().fillna(0.0))


def test_leak_barrier(spark):
    """Changing the value at one time changes only later rows; cutting the table changes nothing that stays."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    h = History(("user_id",), ("ts", "event_id"))
    form = lambda d: d.select("event_id", "ts", h.ewma("value", 6.0).alias("e"), h.mean("value", 8).alias("m"), h.std("value", 8).alias("s"))
    cut = datetime(2024, 1, 15)
    whole = form(e).filter(F.col("ts") <= F.lit(cut)).toPandas().set_index("event_id").sort_index()
    early = form(e.filter(F.col("ts") <= F.lit(cut))).toPandas().set_index("event_id").sort_index()
    pd.testing.assert_frame_equal(whole, early, rtol=1e-9, atol=1e-9)
    bent = form(e.withColumn("value", F.when(F.col("ts") == F.lit(whole["ts"].max()), F.col("value") + 1000).otherwise(F.col("value")))).filter(F.col("ts") <= F.lit(whole["ts"].max())).toPandas().set_index("event_id").sort_index()
    pd.testing.assert_frame_equal(whole, bent.loc[whole.index], rtol=1e-9, atol=1e-9)
    leaky = e.withColumn("value", F.when(F.col("ts") == F.lit(whole["ts"].max()), F.col("value") + 1000).otherwise(F.col("value")))
    own = lambda d: d.select("event_id", F.avg("value").over(h.window.rowsBetween(-8, 0)).alias("m")).toPandas().set_index("event_id")["m"].sort_index()
    assert not np.allclose(own(e).loc[whole.index], own(leaky).loc[whole.index])


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 0), (3, "b", 9), (4, None, 9), (5, "a", 7)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 5, "x", 1), ("a", 5, "y", 2), ("a", 1, "z", 1), (None, 1, "n", 1), ("b", 10, "late", 1)], "k string, t int, v string, tie int")
    got = {r.i: r.v for r in asof_join(left, right, ["k"], "t", ["v"], ties="tie").collect()}
    assert got == {1: "y", 2: None, 3: None, 4: None, 5: "y"}
    assert {r.i: r.v for r in asof_join(left, right, ["k"], "t", ["v"], ties="tie", strict=True).collect()} == {1: "z", 2: None, 3: None, 4: None, 5: "y"}


def test_season_counts(spark):
    df = spark.createDataFrame([("a", t, s) for t, s in enumerate((1, 1, 1, 2, 2))], "k string, t int, s int")
    h = History(("k",), ("t",))
    assert [r.n for r in with_games_in_season(df, h, "s", "n").orderBy("t").collect()] == [0, 1, 2, 2, 3]
    assert [r.n for r in with_games_in_season(df, h, "s", "n", True).orderBy("t").collect()] == [0, 1, 2, 0, 1]


def test_geography(spark):
    def miles(a, b):
        return spark.range(1).select(geo.miles(F.lit(a[0]), F.lit(a[1]), F.lit(b[0]), F.lit(b[1]))).first()[0]

    sea, mia, gb, chi = (47.5952, -122.3316), (25.9580, -80.2389), (44.5013, -88.0622), (41.8623, -87.6167)
    assert 2650 < miles(sea, mia) < 2800 and 160 < miles(gb, chi) < 210 and miles(sea, sea) == 0
    assert spark.range(1).select(geo.zone_shift(F.lit(10.0), F.lit(-8.0))).first()[0] == -6.0


def games(spark, rows):
    base = {"game_type": "REG", "weekday": "Sunday", "gametime": "13:00", "location": "Home", "home_rest": 7, "away_rest": 7, "roof": None, "surface": "grass", "temp": None, "wind": None, "div_game": 0, "stadium_id": "SEA00",
            "spread_line": 1.0, "total_line": 40.0, "home_qb_id": "h", "away_qb_id": "a", "home_qb_name": "H", "away_qb_name": "A", "home_coach": "x", "away_coach": "y"}
    from priorframe.sources.tables import GAME_COLUMNS, conformed

    full = [base | r for r in rows]
    return conformed(spark.createDataFrame(pd.DataFrame(full).astype(object).where(pd.notna(pd.DataFrame(full)), None).to_dict("records"), ", ".join(f"{c} {GAME_COLUMNS[c]}" for c in sorted(GAME_COLUMNS) if c in full[0] or c in ("result",))), GAME_COLUMNS)


def season(n=6, year=2020):
    teams = ["SEA", "SF", "LA", "ARI"]
    rows, g = [], 0
    rng = np.random.default_rng(year)
    for w in range(1, n + 1):
        for a, b in (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))[w % 3]:
            h, v = float(rng.integers(3, 40)), float(rng.integers(3, 40))
            rows.append({"game_id": f"{year}_{w:02d}_{g}", "season": year, "week": w, "gameday": date(year, 9, 1) + timedelta(days=7 * w), "home_team": teams[a], "away_team": teams[b], "home_score": h, "away_score": v, "result": h - v})
            g += 1
    return rows


def test_team_games_and_context(spark):
    g = games(spark, season(4))
    tg = context.team_games(spark, g)
    assert tg.count() == 16 and tg.filter("home_lat is null or venue_lat is null").count() == 0
    c = context.context(spark, tg, "climatology").toPandas()
    assert (c.loc[c.is_home == 1, "travel_miles"] == 0).all() and (c.loc[c.is_home == 0, "travel_miles"] > 50).all()
    assert (c["temp"] == 60.0).all() and (c["wind"] == 8.0).all() and (c["conference_game"] == 1).all() and (c["roof"] == "outdoors").all()
    for _, t in c.sort_values("kickoff").groupby("team"):
        m = t["travel_miles"].to_numpy()
        assert np.allclose(t["travel_load_3g"], [m[max(0, i - 3) : i].sum() for i in range(len(m))])


def test_rest(spark):
    rows = [(4, 2, "Thursday", "20:15", -5.0), (7, 2, "Sunday", "16:00", -5.0), (14, 2, "Sunday", "16:00", -5.0), (7, 2, "Sunday", "13:00", -8.0), (100, 1, "Sunday", "bad", -5.0)]
    got = context.rest(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, rest int, week int, weekday string, gametime string, home_tz double")).orderBy("i").collect()
    assert [r.short_week for r in got] == [1, 0, 0, 0, 0] and [r.off_bye for r in got] == [0, 0, 1, 0, 0]
    assert got[0].is_thursday == got[0].primetime == 1 and [r.west_team_early_east_kick for r in got] == [0, 0, 0, 1, 0] and got[4].rest_days == 7


def test_weather(spark):
    df = spark.createDataFrame([(1, 2019, "s", date(2019, 9, 1), "outdoors", 50.0, 20.0), (2, 2020, "s", date(2020, 9, 1), "outdoors", 10.0, None), (3, 2020, "s", date(2020, 9, 1), "dome", None, None)],
                               "i int, season int, stadium_id string, gameday date, roof string, temp_observed double, wind_observed double")
    c = {r.i: r for r in context.weather(df).collect()}
    assert (c[1].temp, c[1].wind) == (60.0, 8.0) and (c[2].temp, c[2].wind, c[2].wind_gt15) == (50.0, 20.0, 1) and (c[3].temp, c[3].wind) == (70.0, 0.0)
    o = {r.i: r for r in context.weather(df, "observed").collect()}
    assert o[2].temp == 10.0 and o[2].temp_freezing == 1 and o[3].temp == 70.0
    assert "temp" not in context.weather(df, "none").columns
    with pytest.raises(ValueError):
        context.weather(df, "guess")


def test_ratings(spark):
    def row(i, a, b, result, location="Home", season=2020):
        return (f"g{i}", season, datetime(season, 9, 1) + timedelta(days=i), a, b, result, location)

    schema = "game_id string, season int, kickoff timestamp_ntz, home_team string, away_team string, result double, location string"
    rows = [row(0, "A", "B", 7.0), row(1, "B", "A", None), row(2, "A", "B", -3.0, "Neutral"), row(3, "A", "B", 0.0, season=2021)]
    got = {r.game_id: r for r in ratings.elo(spark.createDataFrame(rows, schema)).collect()}
    assert got["g0"].elo_home == 1500 and got["g0"].elo_diff == 55 and got["g0"].elo_prob_home == pytest.approx(1 / (1 + 10 ** (-55 / 400)))
    assert got["g1"].elo_home + got["g1"].elo_away == pytest.approx(3000) and got["g2"].elo_home == got["g1"].elo_away
    assert got["g2"].elo_diff == pytest.approx(got["g2"].elo_home - got["g2"].elo_away)
    flipped = [*rows[:3], row(3, "A", "B", 20.0, season=2021)]
    assert {r.game_id: tuple(r) for r in ratings.elo(spark.createDataFrame(flipped, schema)).collect()} == {k: tuple(v) for k, v in got.items()}


def test_ridge_recovers(spark):
    rng = np.random.default_rng(3)
    names = [f"t{i}" for i in range(6)]
    off, deff = rng.normal(size=6), rng.normal(size=6)
    rows = []
    for i in range(400):
        a, b = rng.choice(6, 2, replace=False)
        rows.append((names[a], names[b], float(rng.integers(2)), datetime(2020, 1, 1) + timedelta(hours=i), float(off[a] + deff[b])))
    df = spark.createDataFrame(rows, "team string, opponent string, is_home double, kickoff timestamp_ntz, off_epa_play double")
    ends = spark.createDataFrame([(2020, 9, datetime(2020, 6, 1)), (2020, 1, datetime(2020, 1, 2))], "season int, week int, asof timestamp_ntz")
    got = ridge.adjusted(df, ends, ("epa_play",), alpha=1e-3).toPandas()
    assert set(got["week"]) == {9}
    r = got.set_index("team").loc[names]
    assert np.allclose(r["epa_play_off"] - r["epa_play_off"].mean(), off - off.mean(), atol=0.02) and np.allclose(r["epa_play_net"], r["epa_play_off"] - r["epa_play_def"])


def test_statistics():
    assert stats.binom_test(7, 10, 0.5) == pytest.approx(0.34375) and stats.binom_test(0, 5, 0.5) == pytest.approx(0.0625)
    assert stats.student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and stats.student_two_sided(0.0, 5) == pytest.approx(1.0)
    lo, hi = stats.clopper_pearson(8, 10)
    assert (lo, hi) == (pytest.approx(0.4439, abs=1e-4), pytest.approx(0.9748, abs=1e-4)) and stats.clopper_pearson(0, 10)[0] == 0.0
    assert float(stats.normal_two_sided(1.959963985)) == pytest.approx(0.05, abs=1e-9)


def test_negative_binomial(spark):
    from math import comb, exp, factorial

    df = spark.createDataFrame([(4.0, 8.0), (4.0, 1.0), (None, 2.0)], "m double, v double")
    a, b, c = (r[0] for r in df.select(players.negbinom_over(F.col("m"), F.col("v"), 3.5)).collect())
    assert a == pytest.approx(1 - sum(comb(k + 3, k) * 0.5**4 * 0.5**k for k in range(4)))
    assert b == pytest.approx(1 - sum(exp(-4) * 4**k / factorial(k) for k in range(4)), abs=1e-3) and c is None


def test_metrics(spark):
    p = spark.createDataFrame([("m", 1.0, 3.0, 40.0, 1.0, 41.0, 0.7), ("m", 0.0, -3.0, 50.0, -7.0, 50.0, 0.4), ("m", 0.5, 0.0, 45.0, 0.0, 45.0, 0.6)], "model string, home_win double, spread_actual double, total_actual double, vegas_spread double, vegas_total double, p_home double")
    r = metrics.evaluate(p, metrics.TARGETS[0], ["model"]).first()
    assert (r.n_games, r.n_scored, r.accuracy) == (3, 2, 1.0)
    assert metrics.evaluate(p, metrics.TARGETS[1], ["model"]).first().mae is None
    with pytest.raises(ValueError):
        metrics.summarize(p.drop("p_home"))


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("m", f"g{i}", 2020, 1, "2020-09-13T13:00:00", "A", "B", 0.6 + i / 100, 3.0, 44.0, 0.55) for i in range(3)]
    p = spark.createDataFrame(rows, "model string, game_id string, season int, week int, kickoff string, home_team string, away_team string, p_home double, pred_spread double, pred_total double, p_home_h1 double")
    early = F.lit("2020-09-01T00:00:00+00:00").cast("timestamp")
    assert predlog.append(spark, p, path, "v", early) == 3 and predlog.append(spark, p, path, "v", early) == 0
    log = spark.read.parquet(path)
    assert {r.status for r in predlog.verify(log).collect()} == {"ok"} and log.filter("vegas_spread is not null").count() == 0
    edited = log.withColumn("p_home", F.when(F.col("game_id") == "g1", 0.99).otherwise(F.col("p_home")))
    assert predlog.verify(edited).filter("status = 'tampered'").count() == 1
    assert {r.status for r in predlog.verify(log.withColumn("new", F.lit(1))).collect()} == {"ok"}
    # rows older than the lists of fields: verified against today's fields, or those of them that they have
    untagged = log.drop("hash_fields")
    assert {r.status for r in predlog.verify(untagged).collect()} == {"ok"} == {r.status for r in predlog.verify(log.withColumn("hash_fields", F.lit(None).cast("string"))).collect()}
    assert {r.status for r in predlog.verify(untagged.withColumn("p_home", F.lit(0.9))).collect()} == {"unverifiable"} == {r.status for r in predlog.verify(log.drop("row_hash")).collect()}
    older = log.withColumn("row_hash", row_hash(predlog.FIELDS, dict(log.dtypes), known_only=True)).drop("hash_fields", "vegas_total", "pred_h1_total")
    assert {r.status for r in predlog.verify(older).collect()} == {"ok"}
    assert {r.status for r in predlog.verify(log.drop("p_home")).collect()} == {"unverifiable"}
    # neither the time of writing nor the vintage can be changed, and half-time predictions are kept
    for c, v in (("logged_at", "2020-01-01T00:00:00+00:00"), ("vintage", "w")):
        assert {r.status for r in predlog.verify(log.withColumn(c, F.lit(v))).collect()} == {"tampered"}
    assert [r.p_home_h1 for r in log.orderBy("game_id").collect()] == [0.55, 0.55, 0.55] and set(predlog.FIELDS) < set(log.columns)
    r = log.filter("game_id = 'g1'").first().asDict()
    told = "|".join(f"{f}=" + ("nan" if r[f] is None else f"{r[f]:.10g}" if isinstance(r[f], float) else f"{r[f]}") for f in predlog.FIELDS)
    assert r["row_hash"] == hashlib.sha256(told.encode()).hexdigest()[:16]
    assert predlog.before_kickoff(log).filter("before_kickoff").count() == 3
    assert predlog.before_kickoff(log.withColumn("logged_at", F.lit("2020-09-13T18:00:00+00:00"))).filter("before_kickoff").count() == 0
    actual = spark.createDataFrame([("g0", 1.0, 7.0, 40.0), ("g1", 0.0, -7.0, 50.0)], "game_id string, home_win double, spread_actual double, total_actual double")
    got = predlog.score(log, actual)
    assert got.filter("target = 'win'").first().n_scored == 2
    perf = str(tmp_path / "perf")
    predlog.update_performance(spark, perf, got)
    last = predlog.update_performance(spark, perf, got)
    assert predlog.current(spark, perf).count() == got.count()
    # a state that isn't whole, as of a job that died, doesn't count
    shutil.copytree(last, f"{perf}/state-000009-abc", ignore=shutil.ignore_patterns("_SUCCESS", "._SUCCESS*"))
    assert predlog.current(spark, perf).count() == got.count() and predlog.current(spark, perf).inputFiles()[0].startswith("file://" + last)
    # two writers at once: the entry that was written first counts
    twice = log.unionByName(log.withColumn("logged_at", F.lit("2020-09-02T00:00:00+00:00")))
    assert {r.logged_at for r in predlog.entries(twice).collect()} == {"2020-09-01T00:00:00+00:00"} and predlog.entries(twice).count() == 3


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
def test_session_zones(spark, zone):
    """Clock changes at home and in the session's own zone: wall clocks, instants, stamps and the log's honesty don't move."""
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        walls = {"2024-03-10 01:59:00": "2024-03-10T06:59:00", "2024-03-10 02:30:00": None, "2024-03-10 03:00:00": "2024-03-10T07:00:00", "2024-03-10 05:30:00": "2024-03-10T09:30:00", "2024-11-03 00:59:00": "2024-11-03T04:59:00",
                 "2024-11-03 01:30:00": None, "2024-11-03 02:00:00": "2024-11-03T07:00:00", "2024-11-03 04:30:00": "2024-11-03T09:30:00", "2024-07-01 13:00:00": "2024-07-01T17:00:00"}
        t = spark.createDataFrame([(w, u and u + "+00:00") for w, u in walls.items()], "w string, u string")
        for r in t.select("u", stamp(to_utc(F.col("w").cast("timestamp_ntz"))).alias("got"), stamp(instant(F.col("u"))).alias("again"), stamp(instant(F.substring("u", 1, 19))).alias("bare")).collect():
            assert r.got == r.u == r.again == r.bare
        log = t.filter("u is not null").select(F.regexp_replace("w", " ", "T").alias("kickoff"), F.col("u").alias("at"))
        late = predlog.before_kickoff(log.withColumn("logged_at", F.col("at")))
        early = predlog.before_kickoff(log.withColumn("logged_at", stamp(F.timestamp_add("SECOND", F.lit(-1), instant(F.col("at"))))))
        assert not late.filter("before_kickoff").count() and early.filter("before_kickoff").count() == len(walls) - 2
        k = spark.createDataFrame([("2024-03-10", "02:30")], "d string, t string").select(kickoff(F.col("d"), F.col("t")).cast("string").alias("k"), F.round(age_days(F.lit("2024-03-09 02:30:00").cast("timestamp_ntz"), kickoff(F.col("d"), F.col("t"))), 9).alias("a"))
        assert tuple(k.first()) == ("2024-03-10 02:30:00", 1.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_general_format(spark):
    values = [0.0, -0.0, 1.0, 0.1, -2.5, 1 / 3, 1e-4, 9.9999e-5, 1234567890.0, 12345678901.0, 9999999999.6, 1e22, -3.25e-12, 0.61, 44.0, 123456.789012345, float("inf"), float("nan"), None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", general("v").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["nan" if v is None else f"{v:.10g}" for v in values]


def test_clock(spark):
    t = spark.createDataFrame([("2026-09-13 13:00:00",), ("2026-11-01 01:30:00",), ("2026-03-08 02:30:00",), ("2026-11-01 03:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r[0] for r in t.select(F.date_format(to_utc(F.col("t")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2026-09-13 17:00", None, None, "2026-11-01 08:00"]
    k = spark.createDataFrame([("2020-01-02", "20:15"), ("2020-01-02", None), ("2020-01-02", "TBD")], "d string, t string")
    assert [str(r[0]) for r in k.select(kickoff(F.col("d"), F.col("t"))).collect()] == ["2020-01-02 20:15:00", "2020-01-02 13:00:00", "2020-01-02 13:00:00"]


def test_slate(spark):
    rows = [("w1", 1, 1, datetime(2020, 9, 13, 13), True), ("w2_sun", 1, 2, datetime(2020, 9, 20, 13), False), ("w2_mon", 1, 2, datetime(2020, 9, 21, 20), False), ("w3", 1, 3, datetime(2020, 9, 27, 13), False)]
    df = spark.createDataFrame(rows, "game_id string, season int, week int, kickoff timestamp_ntz, played boolean")
    ids = lambda now: {r.game_id for r in week.upcoming(df, now).collect()}
    assert ids("2020-09-21 09:00:00") == {"w2_mon"} and ids("2020-09-22 09:00:00") == {"w3"} and ids("2020-09-14 00:00:00") == {"w2_sun", "w2_mon"}
    with pytest.raises(LookupError):
        week.upcoming(df, "2021-01-01 00:00:00")


class Spy:
    name = "spy"
    targets: list = []

    def fit(self, train):
        self.last, self.ids = train["kickoff"].max(), set(train["game_id"])
        self.n = len(train)
        return self

    def predict(self, test):
        assert self.last < test["kickoff"].min() and not self.ids & set(test["game_id"]) and test["played"].all()
        return {"p_home": np.full(len(test), float(self.n))}


def test_folds_never_look_ahead(spark):
    rows = [(f"g{w}_{i}", 2020, w, datetime(2020, 9, 1) + timedelta(days=7 * w, hours=i), "REG", w < 9, 1.0) for w in range(1, 11) for i in range(4)]
    df = spark.createDataFrame(rows, "game_id string, season int, week int, kickoff timestamp_ntz, game_type string, played boolean, home_win double")
    got = walkforward.run(df, lambda: [Spy()], 2020, 4, min_train=4).toPandas()
    sizes = got.groupby("week")["p_home"].first()
    assert list(sizes.index) == [4, 5, 6, 7, 8] and sizes.is_monotonic_increasing and list(sizes) == [12, 16, 20, 24, 28]
    joined = fold_join(df, walkforward.folds(df, 2020, 4).select("asof"), "kickoff")
    assert joined.filter("kickoff >= asof").count() == 0


def test_mining_finds_a_planted_cell(spark):
    rng = np.random.default_rng(0)
    rows = [(a, b, float(rng.random() < (0.75 if (a, b) == ("x", "p") else 0.5))) for a in "xy" for b in "pq" for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    m = mining.mine(df, "y", ["a", "b"], 300, 2).toPandas()
    top = m.iloc[0]
    assert (top.a, top.b) == ("x", "p") and top.survives and len(m) == 8
    assert bool(mining.confirm(mining.mine(df, "y", ["a", "b"], 300, 2), df, "y", ["a", "b"], 100, 2).filter("a = 'x' and b = 'p'").first().replicated)


# The modelling table's columns.
COLUMNS = """game_id season week game_type kickoff gameday home_team away_team home_qb_id away_qb_id played
home_score away_score spread_actual total_actual home_win h1_home_score h1_away_score h1_spread_actual h1_total_actual h1_home_win vegas_spread vegas_total
ctx_div_game ctx_conference_game ctx_neutral_site ctx_is_indoor ctx_is_retractable_open ctx_is_turf ctx_primetime ctx_is_thursday ctx_is_monday ctx_temp ctx_wind ctx_wind_gt15 ctx_temp_freezing ctx_week
d_rest_days d_short_week d_long_rest d_off_bye d_travel_miles d_tz_delta d_tz_abs d_travel_load_3g d_west_team_early_east_kick
d_off_epa_play_ewma d_off_success_rate_ewma d_off_pass_epa_ewma d_off_rush_epa_ewma d_off_early_epa_ewma d_off_explosive_rate_ewma d_off_proe_ewma d_off_sack_rate_ewma d_off_turnover_rate_ewma
d_def_epa_play_ewma d_def_success_rate_ewma d_def_pass_epa_ewma d_def_rush_epa_ewma d_def_early_epa_ewma d_def_explosive_rate_ewma d_net_epa_ewma d_off_plays_ewma d_def_plays_ewma
d_off_epa_play_r8 d_def_epa_play_r8 d_net_epa_r8 d_off_success_rate_r8 d_games_this_season d_margin_r5
d_adj_off_epa_play_off d_adj_off_epa_play_def d_adj_off_epa_play_net d_adj_off_success_rate_net d_qb_epa_ewma d_qb_starts d_qb_is_new d_qb_is_rookie_ish d_qb_epa_delta
s_off_epa_play_ewma s_def_epa_play_ewma s_off_success_rate_ewma s_off_explosive_rate_ewma s_off_pass_epa_ewma s_off_proe_ewma s_off_plays_ewma s_def_plays_ewma
s_points_for_ewma s_points_against_ewma s_points_for_r8 s_points_against_r8 s_expected_total s_expected_plays d_expected_margin
mu_home_epa mu_away_epa mu_net_epa mu_home_pass_epa mu_away_pass_epa mu_net_pass_epa mu_home_rush_epa mu_away_rush_epa mu_net_rush_epa mu_home_success mu_away_success mu_net_success
elo_diff elo_prob_home elo_spread_home"""


def test_running_sums_carry_over_sparse_blocks(spark):
    """Values far apart, across many blocks, and rows' own values, against the fold over all earlier rows."""
    rng = np.random.default_rng(2)
    rows = [(e, t, float(rng.normal()) if (e == "dense" or t % 911 == 5) else None, float(rng.normal())) for e in ("dense", "sparse") for t in range(3000)]
    df = spark.createDataFrame(rows, "e string, t int, v double, w double")
    h = History(("e",), ("t",))
    got = with_running_ewma(df, h, ["v", "w"], 2.0).withColumn("fold", h.ewma("v", 2.0)).withColumn("fold_w", h.ewma("w", 2.0))
    got = with_running_ewma(got, h, ["v"], 2.0, ["own"], inclusive=True).toPandas().sort_values(["e", "t"])
    np.testing.assert_allclose(got["v_ewma"], got["fold"], rtol=1e-9)
    np.testing.assert_allclose(got["w_ewma"], got["fold_w"], rtol=1e-9)
    want = got.groupby("e")["v"].transform(lambda x: x.ewm(halflife=2.0, ignore_na=True).mean())
    np.testing.assert_allclose(got["own"], want, rtol=1e-9)


def test_failed_folds_are_told(spark):
    class Broken(Spy):
        name = "broken"

        def fit(self, train):
            raise ValueError("no")

    rows = [(f"g{w}_{i}", 2020, w, datetime(2020, 9, 1) + timedelta(days=7 * w, hours=i), "REG", True, 1.0) for w in range(1, 8) for i in range(4)]
    df = spark.createDataFrame(rows, "game_id string, season int, week int, kickoff timestamp_ntz, game_type string, played boolean, home_win double")
    got = walkforward.run(df, lambda: [Spy(), Broken()], 2020, 4, min_train=4, errors=True)
    assert [tuple(r) for r in walkforward.failures(got).collect()] == [("broken", 4, "ValueError: no")] and got.filter("error is null").count() == 16
    fine = walkforward.run(df, lambda: [Spy()], 2020, 4, min_train=4, errors=True)
    assert fine.count() == 16 and walkforward.failures(fine).count() == 0 and fine.columns[-1] == "error"
    with pytest.raises(KeyError):
        walkforward.run(df, lambda: [Spy()], 2020, 4, names=["nobody"])


def test_tables_to_read(spark):
    rows = [("win", "elo", 10, 0.61234, None, None), ("spread", "elo", 10, None, 10.5, -3.25), ("win", "lean", 10, 0.7, None, None), ("h1_win", "zz", 4, None, None, None)]
    df = spark.createDataFrame(rows, "target string, model string, n_games long, accuracy double, mae double, ats_units double")
    text = metrics.format_table(df, ["lean", "elo"])
    assert text.index("win:") < text.index("lean") < text.index("elo") < text.index("spread:") < text.index("h1_win: Leading at halftime   [no market benchmark exists]")
    assert "0.6123" in text and "10.500" in text and "-3.2" in text and text.endswith("0.5238") and metrics.format_table(df.filter("false"), []) == "(no results)"


def test_whole_table(spark):
    rows = season(6, 2019) + season(6, 2020)
    g = games(spark, rows)
    rng = np.random.default_rng(5)
    ps = []
    for r in rows:
        for i in range(12):
            a, b = (r["home_team"], r["away_team"]) if i % 2 else (r["away_team"], r["home_team"])
            p = int(rng.integers(2))
            ps.append({"game_id": r["game_id"], "posteam": a, "defteam": b, "play_type": "pass" if p else "run", "epa": float(rng.normal()), "success": float(rng.integers(2)), "pass": float(p), "rush": float(1 - p), "down": 1.0,
                       "yards_gained": float(rng.integers(30)), "xpass": 0.5, "wp": 0.5, "game_half": "Half1" if i < 6 else "Half2", "total_home_score": float(i), "total_away_score": float(i // 2)})
    from priorframe.sources.tables import PLAY_COLUMNS, conformed

    p = conformed(spark.createDataFrame(ps), PLAY_COLUMNS)
    cfg = Config({"data": {"start_season": 2020, "end_season": 2020}, "features": {"opponent_adjust": {"min_games_required": 10}}})
    starts = spark.createDataFrame([("h", 2019, w, 20.0, 2.0 * w) for w in range(1, 7)], "player_id string, season int, week int, attempts double, passing_epa double")
    t = features.build(spark, g, p, starts, cfg)
    assert t.count() == 12 and len(t.columns) == 109, len(t.columns)
    groups = features.feature_groups(t.columns)
    default = features.select_features(t.columns, ["context", "form", "adjusted", "matchup", "elo", "totals"])
    assert set(t.columns) == set(COLUMNS.split()) and len(default) == 80
    assert groups["lean"] == "elo_diff d_adj_off_epa_play_net d_net_epa_ewma d_rest_days s_expected_total d_margin_r5".split()
    assert groups["lean_qb"] == [*groups["lean"], "d_qb_epa_ewma", "d_qb_is_new"]
    prefixed = lambda *p: {c for c in COLUMNS.split() if c.startswith(p)}
    side = set("d_rest_days d_short_week d_long_rest d_off_bye d_travel_miles d_tz_delta d_tz_abs d_travel_load_3g d_west_team_early_east_kick".split())
    assert set(groups["context"]) == prefixed("ctx_") | side and set(groups["form"]) == prefixed("d_off_", "d_def_", "d_net_") | {"d_margin_r5", "d_games_this_season"} and "d_off_bye" in groups["form"]
    assert set(groups["totals"]) == prefixed("s_") and set(groups["matchup"]) == prefixed("mu_") and set(groups["elo"]) == prefixed("elo_") and set(groups["vegas"]) == prefixed("vegas_")
    assert set(groups["adjusted"]) == prefixed("d_adj_") and set(groups["qb"]) == prefixed("d_qb_") and len(groups) == 10
    with pytest.raises(KeyError):
        features.select_features(t.columns, ["nonsense"])
    whole = t.toPandas().set_index("game_id").sort_index()
    cut = features.build(spark, g, p, starts, cfg, "2020-10-01 00:00:00").toPandas().set_index("game_id").sort_index()
    made = [c for c in cut.columns if c.startswith(("ctx_", "d_", "s_", "mu_", "elo_"))]
    assert 0 < len(cut) < len(whole)
    np.testing.assert_allclose(whole.loc[cut.index, made].to_numpy(float), cut[made].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_config():
    c = Config({"backtest": {"first_test_week": 3}})
    assert c.get("backtest.first_test_week") == 3 and c.get("backtest.first_test_season") == 2017 and c.get("no.such", None) is None
    assert c.event_seasons[0] == c.seasons[0] - 1
    with pytest.raises(KeyError):
        c.get("no.such")
