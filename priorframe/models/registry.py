"""The slate of configured models, in report order."""

from __future__ import annotations

import os
import pickle
from collections.abc import Callable

from priorframe.config import Config
from priorframe.models.base import Model
from priorframe.models.baselines import Elo, HomeTeam, Market
from priorframe.models.ensemble import Ensemble
from priorframe.models.linear import Linear
from priorframe.models.neural import Neural
from priorframe.models.trees import BoostedTrees

DEFAULT_GROUPS = ["context", "form", "adjusted", "matchup", "elo", "totals"]


def slate(cfg: Config, select: Callable[[list[str]], list[str]], targets: list[str] | None = None) -> list[Model]:
    """select: the columns of feature groups (plans.features.select_features over the table at hand)."""
    plain, market, lean, lean_qb = select(DEFAULT_GROUPS), select([*DEFAULT_GROUPS, "vegas"]), select(["lean"]), select(["lean_qb"])
    lin = {"c": cfg.get("models.logistic.C"), "alpha": cfg.get("models.ridge.alpha")}
    g = cfg.get("models.lightgbm")
    gbm = {"rounds": g["n_estimators"], "rate": g["learning_rate"], "leaves": g["num_leaves"], "depth": g["max_depth"], "least": g["min_child_samples"], "rows": g["subsample"],
           "columns": g["colsample_bytree"], "l1": g["reg_alpha"], "l2": g["reg_lambda"], "seed": cfg.seed}
    n = cfg.get("models.neural")
    net = {"dim": n["emb_dim"], "hidden": n["hidden"], "dropout": n["dropout"], "decay": n["weight_decay"], "rate": n["lr"], "epochs": n["max_epochs"], "patience": n["patience"],
           "validation": n["val_fraction"], "batch": n["batch_size"], "seed": cfg.seed}
    t = {"targets": targets}
    with_qb = select([*DEFAULT_GROUPS, "qb"])
    return [
        HomeTeam(**t),
        Linear(lean, "lean", coherent=True, **t, **lin), Linear(lean_qb, "lean_qb", coherent=True, **t, **lin),
        Elo(**t), Market(**t),
        Linear(plain, "linear", **t, **lin), BoostedTrees(plain, "lightgbm", **t, **gbm),
        Linear(market, "linear_plus_vegas", **t, **lin), BoostedTrees(market, "lightgbm_plus_vegas", **t, **gbm),
        Linear(with_qb, "linear_qb", coherent=True, **t, **lin),
        Linear(plain, "linear_coherent", coherent=True, **t, **lin), BoostedTrees(plain, "lightgbm_coherent", coherent=True, **t, **gbm),
        Neural(plain, "neural", **t, **net), Neural(with_qb, "neural_qb", starters=True, **t, **net),
    ]


def ensemble_of(models: list[Model], names: list[str], weights: list[float] | None = None) -> Ensemble:
    by = {m.name: m for m in models}
    return Ensemble([by[n] for n in names], weights)


def save(models: list[Model], path: str) -> None:
    """Fitted models in one file, replaced at once."""
    part = f"{path}.part"
    with open(part, "wb") as f:
        pickle.dump(models, f)
    os.replace(part, path)


def load(path: str) -> list[Model]:
    """What save wrote; only for files of one's own, since unpickling runs code."""
    with open(path, "rb") as f:
        return pickle.load(f)  # noqa: S301
