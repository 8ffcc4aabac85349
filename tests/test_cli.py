"""The commands end to end on a made-up league: table, backtest, training, a week's predictions, scores."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from priorframe import cli, predlog
from priorframe.config import Config
from tests.test_operators import season


@pytest.fixture(scope="module")
def league(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("league")
    raw = root / "raw"
    raw.mkdir()
    rows = season(6, 2019) + season(6, 2020)
    for i, (a, b) in enumerate((("SEA", "SF"), ("LA", "ARI"))):
        rows.append({"game_id": f"2020_07_{i}", "season": 2020, "week": 7, "gameday": date(2020, 10, 27), "home_team": a, "away_team": b, "home_score": None, "away_score": None, "result": None})
    rng = np.random.default_rng(3)
    base = {"game_type": "REG", "weekday": "Sunday", "gametime": "13:00", "location": "Home", "home_rest": 7, "away_rest": 7, "roof": "", "surface": "grass", "temp": "", "wind": "", "div_game": 0, "stadium_id": "SEA00",
            "spread_line": 1.5, "total_line": 41.5, "home_qb_id": "h", "away_qb_id": "a"}
    pd.DataFrame([base | r | {"spread_line": float(rng.integers(-7, 8))} for r in rows]).to_csv(raw / "games.csv", index=False)
    for year in (2019, 2020):
        plays = []
        for r in rows:
            if r["season"] == year and r["home_score"] is not None:
                for i in range(10):
                    a, b = (r["home_team"], r["away_team"]) if i % 2 else (r["away_team"], r["home_team"])
                    p = int(rng.integers(2))
                    plays.append({"game_id": r["game_id"], "posteam": a, "defteam": b, "play_type": "pass" if p else "run", "epa": float(rng.normal()), "success": float(rng.integers(2)), "pass": float(p), "rush": float(1 - p), "down": 1.0,
                                  "yards_gained": 5.0, "xpass": 0.5, "wp": 0.5, "game_half": "Half1" if i < 5 else "Half2", "total_home_score": float(i), "total_away_score": float(i // 2)})
        pd.DataFrame(plays).to_parquet(raw / f"pbp_{year}.parquet")
    settings = {
        "paths": {"raw_cache": str(raw), "feature_cache": str(root / "features"), "artifacts": str(root / "out"), "prediction_log": str(root / "log"), "performance_log": str(root / "perf")},
        "data": {"start_season": 2019, "end_season": 2020}, "features": {"opponent_adjust": {"min_games_required": 10}},
        "backtest": {"first_test_season": 2020, "first_test_week": 4, "min_train_games": 8},
        "models": {"lightgbm": {"n_estimators": 2, "min_child_samples": 3}, "neural": {"max_epochs": 2}},
    }
    conf = root / "conf.yaml"
    conf.write_text(json.dumps(settings))
    return root, str(conf)


def test_commands(spark, league, capsys, monkeypatch):
    root, conf = league
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["-c", conf, "build-features"]) == 0
    assert "26 games, 109 columns" in capsys.readouterr().out
    assert cli.main(["-c", conf, "backtest", "--models", "home_team,elo,linear", "--targets", "win,spread", "--by-season"]) == 0
    p = spark.read.parquet(str(root / "out/backtest.parquet"))
    assert {r[0] for r in p.select("model").distinct().collect()} == {"home_team", "elo", "linear"} and p.filter("week < 4").count() == 0
    summary = spark.read.csv(str(root / "out/backtest_summary"), header=True).toPandas()
    assert list(zip(summary["target"], summary["model"])) == [(t, m) for t in ("win", "spread") for m in ("home_team", "elo", "linear")]
    assert "ATS break-even" in capsys.readouterr().out
    with pytest.raises(KeyError):
        cli.main(["-c", conf, "backtest", "--models", "nobody"])
    with pytest.raises(KeyError):
        cli.main(["-c", conf, "backtest", "--targets", "home_win"])
    assert cli.main(["-c", conf, "audit"]) == 0
    told = capsys.readouterr().out
    assert "data vintage      : unknown" in told and "prediction log    : none yet" in told and "completed games   : 24" in told
    assert cli.main(["-c", conf, "train"]) == 0 and "neural_qb" in capsys.readouterr().out
    from priorframe.models.registry import load

    kept = load(str(root / "out/production_models.pkl"))
    assert [m.name for m in kept][:6] == ["home_team", "lean", "lean_qb", "elo", "vegas", "linear"] and len(kept) == 14
    assert cli.main(["-c", conf, "score-recent", "--season", "2020"]) == 0 and "hit_rate" in capsys.readouterr().out
    assert cli.main(["-c", conf, "scorecard", "--model", "elo", "--since", "2020"]) == 0 and "who wins" in capsys.readouterr().out
    assert cli.main(["-c", conf, "mine-patterns", "--split", "2020", "--min-n", "5"]) == 0 and "posteam_wins" in capsys.readouterr().out
    monkeypatch.setattr(cli, "eastern_now", lambda: datetime(2020, 10, 20))
    assert cli.main(["-c", conf, "predict-week"]) == 0
    log = spark.read.parquet(str(root / "log"))
    assert log.count() == 28 and log.select("game_id").distinct().count() == 2
    assert cli.main(["-c", conf, "predict-week", "--season", "2020", "--week", "7", "--model", "elo"]) == 0
    assert spark.read.parquet(str(root / "log")).count() == 28
    # logged long after kickoff: nothing may be scored
    assert cli.main(["-c", conf, "score"]) == 0 and datetime.now() - timedelta(days=1) > datetime(2020, 10, 27)
    assert predlog.current(spark, str(root / "perf")).count() == 0
    capsys.readouterr()
    assert cli.main(["-c", conf, "audit"]) == 0 and "prediction log    : OK" in capsys.readouterr().out


def test_parser():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["dance"])
    a = cli.parser().parse_args(["-v", "predict-week", "--no-log"])
    assert a.verbose and a.no_log and a.season is None
    with pytest.raises(KeyError):
        Config().get("sources.games_url")
