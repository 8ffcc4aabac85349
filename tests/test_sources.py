"""Scans, caches, the stream and the models of one fold."""

import json

import numpy as np
import pandas as pd
import pytest

from priorframe.metrics import TARGETS
from priorframe.models.base import logistic_fit
from priorframe.models.baselines import Market
from priorframe.models.ensemble import Ensemble
from priorframe.models.linear import Linear
from priorframe.models.neural import Neural
from priorframe.models.trees import Booster, BoostedTrees
from priorframe.sources import cache, tables


def test_drifting_parquet(spark, tmp_path):
    spark.createDataFrame([("g", 1.0)], "game_id string, epa double").write.parquet(f"{tmp_path}/pbp_2019.parquet")
    spark.createDataFrame([("h", "2.5", 3)], "game_id string, epa string, extra int").write.parquet(f"{tmp_path}/pbp_2020.parquet")
    got = tables.read_plays(spark, str(tmp_path), [2018, 2019, 2020], ["game_id", "epa", "wp"]).orderBy("game_id").collect()
    assert [tuple(r) for r in got] == [("g", 1.0, None), ("h", 2.5, None)]
    assert tables.read_plays(spark, str(tmp_path), [1990]).count() == 0


def test_games_csv(spark, tmp_path):
    (tmp_path / "games.csv").write_text("game_id,season,week,gameday,home_team,away_team,home_score,result\na,2020,1,2020-09-10,KC,HOU,34,14\nb,2020,1,not a day,KC,HOU,NA,NA\n")
    rows = {r.game_id: r for r in tables.read_games(spark, str(tmp_path / "games.csv")).collect()}
    assert str(rows["a"].gameday) == "2020-09-10" and rows["a"].home_score == 34 and rows["b"].gameday is None and rows["b"].home_score is None


def test_fetch(tmp_path):
    calls = []

    def get(url, dest):
        calls.append(url)
        if "missing" in url:
            raise OSError(url)
        dest.write_text(url)
        return {"url": url, "sha256": cache.file_sha256(dest)}

    (tmp_path / "kept").write_text("here")
    files = [cache.Source("kept", "u0", "kept"), cache.Source("new", "u1", "new"), cache.Source("later", "missing", "later.parquet", optional=True)]
    m = cache.fetch(tmp_path, files, get=get)
    assert calls == ["u1", "missing"] and set(m.entries) == {"kept", "new"} and len(m.vintage) == 12 and m.entries["kept"]["note"]
    assert cache.Manifest(tmp_path / "manifest.json").vintage == m.vintage and list(json.loads((tmp_path / "manifest.json").read_text())) == ["kept", "new"]
    with pytest.raises(OSError):
        cache.fetch(tmp_path, [cache.Source("later", "missing", "later.parquet")], get=get)
    assert cache.Manifest(tmp_path / "none.json").vintage == "unknown"


def test_download_retries(tmp_path):
    src = tmp_path / "src"
    src.write_text("data")
    waits = []
    assert cache.download(src.as_uri(), tmp_path / "d")["bytes"] == 4
    with pytest.raises(OSError):
        cache.download((tmp_path / "nope").as_uri(), tmp_path / "e", retries=3, wait=waits.append)
    assert waits == [2.0, 4.0] and not (tmp_path / "e.part").exists()


def test_cached(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for settings, force in (({"a": 1}, False), ({"a": 1}, False), ({"a": 2}, False), ({"a": 2}, True)):
        assert cache.cached(spark, str(tmp_path), "t", "v", settings, build, force).count() == 3
    assert len(built) == 3
    for name in ("games.csv", "pbp_2019.parquet", "pbp_2020.parquet"):
        (tmp_path / "raw").mkdir(exist_ok=True)
        (tmp_path / "raw" / name).write_text(name)
    h = cache.keyed(cache.content_hashes(spark, str(tmp_path / "raw")))
    m = cache.fetch(tmp_path / "raw", [cache.Source(n.split(".")[0], "u", n) for n in ("pbp_2020.parquet", "games.csv", "pbp_2019.parquet")])
    assert cache.vintage_of(h).first()[0] == m.vintage and len(m.vintage) == 12 and cache.vintage_of(h.filter("false")).first()[0] == "unknown"


def test_stream(spark, tmp_path):
    from priorframe.streaming.append import append_stream

    schema = "model string, game_id string, p_home double"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        append_stream(spark, f"{tmp_path}/in", schema, f"{tmp_path}/log", f"{tmp_path}/cp", "v").awaitTermination()

    put([("m", "g1", 0.5), ("m", "g2", 0.6)])
    run()
    put([("m", "g2", 0.9), ("m", "g3", 0.7)])
    run()
    assert {r.game_id: r.p_home for r in spark.read.parquet(f"{tmp_path}/log").collect()} == {"g1": 0.5, "g2": 0.6, "g3": 0.7}


def frame(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.normal(size=n)
    margin = 6 * x - 2 * z + rng.normal(size=n) * 3
    df = pd.DataFrame({"a": x, "b": z, "spread_actual": margin, "total_actual": 40 + 5 * z + rng.normal(size=n), "home_win": (margin > 0).astype(float), "home_team": rng.choice(list("ABCD"), n), "away_team": rng.choice(list("ABCD"), n)})
    df["vegas_spread"], df["vegas_total"], df["kickoff"] = 6 * x, 40 + 5 * z, pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n), "h")
    df.loc[::17, "a"] = np.nan
    return df


NAMES = ["win", "spread", "total"]


def makers():
    f = ["a", "b"]
    return [Linear(f, targets=NAMES), BoostedTrees(f, targets=NAMES, rounds=60), Neural(f, targets=NAMES, epochs=30), Ensemble([Linear(f, targets=NAMES), BoostedTrees(f, targets=NAMES, rounds=30)])]


@pytest.mark.parametrize("i", range(4))
def test_models(i):
    train, test = frame(), frame(100, 1)
    p = makers()[i].fit(train).predict(test)
    assert all(np.isfinite(v).all() and len(v) == 100 for v in p.values()) and ((p["p_home"] >= 0) & (p["p_home"] <= 1)).all()
    assert ((p["p_home"] > 0.5) == (test["home_win"] > 0.5)).mean() > 0.7
    assert np.abs(p["pred_spread"] - test["spread_actual"]).mean() < 0.8 * np.abs(test["spread_actual"]).mean()


def test_saved_models(tmp_path):
    from priorframe.models.registry import load, save

    fitted = [m.fit(frame()) for m in makers()[:2]]
    save(fitted, str(tmp_path / "models"))
    for a, b in zip(fitted, load(str(tmp_path / "models"))):
        assert np.allclose(a.predict(frame(20, 3))["p_home"], b.predict(frame(20, 3))["p_home"])


def test_coherence():
    train, test = frame(), frame(100, 1)
    p = Linear(["a", "b"], targets=NAMES, coherent=True).fit(train).predict(test)
    assert ((p["p_home"] > 0.5) == (p["pred_spread"] > 0)).all()
    order = np.argsort(p["pred_spread"])
    assert (np.diff(p["p_home"][order]) >= 0).all()


def test_market_line_is_passed_on():
    test = frame(50, 2)
    p = Market(targets=NAMES).fit(frame()).predict(test)
    assert np.allclose(p["pred_spread"], test["vegas_spread"]) and np.allclose(p["pred_total"], test["vegas_total"])


def test_logistic_is_stationary():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x @ [1, -2, 0.5] + rng.normal(size=300) > 0).astype(float)
    w = logistic_fit(x, y, c=0.5)
    g = np.column_stack([x, np.ones(300)]).T @ (1 / (1 + np.exp(-(x @ w[:3] + w[3]))) - y) + np.append(w[:3] / 0.5, 0)
    assert np.abs(g).max() < 1e-6


def test_shapley_adds_up():
    df = frame()
    x = df[["a", "b"]].to_numpy()
    b = Booster(False, rounds=20).fit(x, df["spread_actual"].to_numpy())
    phi = b.shapley(x)
    base = b.base + sum(t.expected(b.binned(x), frozenset()) for t in b.trees)
    assert np.allclose(phi.sum(1) + base, b.predict(x))
    s = BoostedTrees(["a", "b"], targets=NAMES, rounds=20).fit(df).shapley(df, "pred_spread")
    assert s["feature"][0] == "a" and len(TARGETS) == 6
