"""The network's steps against plain ones of the same draws, in less time; what is only predicted takes little memory."""

import time
import tracemalloc

import numpy as np
import pandas as pd

from priorframe.models.base import sigmoid
from priorframe.models.neural import Neural


def plain(m, w, x, ids, y, rng, batches):
    """Weights after a step for each batch of rows."""
    one, two = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for count, r in enumerate(batches, 1):
        layers, masks = [np.concatenate([x[r], *(w[k][i[r]] for k, i in ids)], axis=1)], []
        for k in (1, 2):
            z = layers[-1] @ w[f"w{k}"] + w[f"b{k}"]
            keep = (rng.random(z.shape) >= m.dropout) / (1 - m.dropout)
            layers.append(np.maximum(z, 0) * keep)
            masks.append(keep * (z > 0))
        out, d = layers[2] @ w["w3"] + w["b3"], np.zeros((len(r), y.shape[1]))
        for j, t in enumerate(m.used):
            ok = np.isfinite(y[r, j])
            if ok.any():
                z, v = out[ok, j], y[r, j][ok]
                d[ok, j] = (sigmoid(z) - v if t.kind == "binary" else 2 * (z - v)) / ok.sum()
        g = {k: np.zeros_like(v) for k, v in w.items()}
        for k in (3, 2, 1):
            g[f"w{k}"], g[f"b{k}"] = layers[k - 1].T @ d, d.sum(0)
            d = d @ w[f"w{k}"].T
            d = d * masks[k - 2] if k > 1 else d
        for n, (k, i) in enumerate(ids):
            np.add.at(g[k], i[r], d[:, x.shape[1] + n * m.dim :][:, : m.dim])
        for k, v in g.items():
            one[k] = 0.9 * one[k] + 0.1 * v
            two[k] = 0.999 * two[k] + 0.001 * v * v
            w[k] = w[k] * (1 - m.rate * m.decay) - m.rate * (one[k] / (1 - 0.9**count)) / (np.sqrt(two[k] / (1 - 0.999**count)) + 1e-8)
    return w


def games(n):
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"kickoff": np.arange(n), "home_team": rng.integers(0, 32, n).astype(str), "away_team": rng.integers(0, 32, n).astype(str), "a": rng.normal(size=n), "b": rng.random(n)})
    d["spread_actual"], d["total_actual"] = np.round(d["a"] + rng.normal(size=n)), np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n))
    return d.assign(home_win=np.sign(d["spread_actual"]) / 2 + 0.5)


def test_steps_equal_plain_ones_and_take_less_time():
    m = Neural(["a", "b"], targets=["win", "spread", "total"], epochs=1, coherent=False).fit(games(2000))
    rng = np.random.default_rng(6)
    n = 256 * 400
    x, ids = rng.normal(size=(n, 2)), [("team", rng.integers(0, 33, n)) for _ in range(2)]
    y = np.column_stack([np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 2, n)), rng.normal(size=n), rng.normal(size=n)])
    y[:256, 0] = np.nan  # a batch without a target
    batches = np.array_split(np.arange(n), 400)
    w = {k: v.copy() for k, v in m.w.items()}
    began = time.process_time()
    want = plain(m, w, x, ids, y, np.random.default_rng(7), batches)
    plain_s, began = time.process_time() - began, time.process_time()
    step = m.stepper(x, ids, y, np.random.default_rng(7))
    for r in batches:
        step(r)
    assert time.process_time() - began < 0.8 * plain_s
    for k, v in want.items():
        assert np.allclose(m.w[k], v, rtol=0, atol=1e-9), k


def test_predictions_take_little_memory():
    m = Neural(["a", "b"], targets=["win", "spread", "total"], epochs=1).fit(games(500))
    d = games(200_000)
    tracemalloc.start()
    p = m.predict(d)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6 and len(p["p_home"]) == 200_000
    assert np.allclose(p["pred_total"][150_000:150_010], m.predict(d.iloc[150_000:150_010])["pred_total"])
