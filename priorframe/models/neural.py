"""A small network with team (and starter) embeddings, in NumPy: one trunk, one head a target."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from priorframe.models.base import column, known, sigmoid
from priorframe.models.linear import Featured, Scale

#: Rows that pass the layers at once when nothing is learnt.
ROWS = 8192


class Neural(Featured):
    """AdamW with dropout and early stopping on the last part of the training rows by time.

    Team 0, and starter 0, stand for names that training lacks; starters need `seen` appearances.
    """

    name = "neural"

    def __init__(self, features: list[str], name: str | None = None, targets: list[str] | None = None, coherent: bool = True, starters: bool = False, dim: int = 8, hidden: int = 32,
                 dropout: float = 0.4, decay: float = 0.001, rate: float = 0.003, epochs: int = 400, patience: int = 30, validation: float = 0.15, batch: int = 256, seen: int = 4, seed: int = 1729):
        super().__init__(features, name, targets, coherent)
        self.starters, self.dim, self.hidden, self.dropout, self.decay, self.rate = starters, dim, hidden, dropout, decay, rate
        self.epochs, self.patience, self.validation, self.batch, self.seen, self.seed = epochs, patience, validation, batch, seen, seed

    def inputs(self) -> list[str]:
        return [*self.features, "kickoff", "home_team", "away_team", *(["home_qb_id", "away_qb_id"] if self.starters else [])]

    def ids(self, df: pd.DataFrame) -> list[tuple[str, np.ndarray]]:
        look = lambda names, c: np.array([names.get(v, 0) for v in (df[c] if c in df else [None] * len(df))])
        out = [("team", look(self.teams, "home_team")), ("team", look(self.teams, "away_team"))]
        if self.starters:
            out += [("qb", look(self.qbs, "home_qb_id")), ("qb", look(self.qbs, "away_qb_id"))]
        return out

    def forward(self, x: np.ndarray, ids: list) -> np.ndarray:
        """The heads' outputs, without dropout, for so many rows at a time that layers stay small."""
        w, out = self.w, np.empty((len(x), len(self.used)))
        for at in range(0, len(x), ROWS):
            r = slice(at, at + ROWS)
            a = np.concatenate([x[r], *(w[k][i[r]] for k, i in ids)], axis=1)
            for k in (1, 2):
                a = np.maximum(a @ w[f"w{k}"] + w[f"b{k}"], 0)
            out[r] = a @ w["w3"] + w["b3"]
        return out

    def loss(self, out: np.ndarray, y: np.ndarray) -> float:
        """Summed mean losses of the targets, each over the rows that have it."""
        total = 0.0
        for j, t in enumerate(self.used):
            ok = np.isfinite(y[:, j])
            if not ok.any():
                continue
            z, v = out[ok, j], y[ok, j]
            total += float((np.logaddexp(0, z) - v * z if t.kind == "binary" else (z - v) ** 2).mean())
        return total

    def fit(self, train: pd.DataFrame) -> Neural:
        self.fitted, self.maps = {}, {}
        self.used = [t for t in self.targets if t.column in train]
        order = train.sort_values("kickoff", kind="stable") if "kickoff" in train else train
        self.teams = {n: i + 1 for i, n in enumerate(sorted({*order.get("home_team", []), *order.get("away_team", [])} - {None}))}
        counts = pd.concat([order[c] for c in ("home_qb_id", "away_qb_id") if c in order]).value_counts() if self.starters and "home_qb_id" in order else pd.Series(dtype=int)
        self.qbs = {n: i + 1 for i, n in enumerate(sorted(counts[counts >= self.seen].index))}
        m = self.matrix(order)
        self.scale = Scale(m)
        x, ids = self.scale(m), self.ids(order)
        del m  # large, and not needed any more
        y = np.full((len(order), len(self.used)), np.nan)
        self.mean, self.sd = np.zeros(len(self.used)), np.ones(len(self.used))
        for j, t in enumerate(self.used):
            ok = known(order, t)
            y[ok, j] = column(order, t.column)[ok]
            if t.kind != "binary" and ok.sum() > 1:
                self.mean[j], self.sd[j] = y[ok, j].mean(), y[ok, j].std(ddof=1) or 1.0
                y[:, j] = (y[:, j] - self.mean[j]) / self.sd[j]
        del order
        rng = np.random.default_rng(self.seed)
        width = x.shape[1] + self.dim * len(ids)
        init = lambda a, b: rng.uniform(-1, 1, (a, b)) / np.sqrt(a)
        self.w = {"team": rng.normal(0, 0.1, (len(self.teams) + 1, self.dim)), "qb": rng.normal(0, 0.1, (len(self.qbs) + 1, self.dim)),
                  "w1": init(width, self.hidden), "b1": np.zeros(self.hidden), "w2": init(self.hidden, self.hidden // 2), "b2": np.zeros(self.hidden // 2),
                  "w3": init(self.hidden // 2, len(self.used)), "b3": np.zeros(len(self.used))}
        hold = max(60, int(round(self.validation * len(x))))
        cut = len(x) - hold if len(x) > 2 * hold else len(x)
        step = self.stepper(x[:cut], [(k, i[:cut]) for k, i in ids], y[:cut], rng)
        tail = slice(cut if cut < len(x) else 0, len(x))
        best, kept, waited = np.inf, None, 0
        for _ in range(self.epochs):
            for r in np.array_split(rng.permutation(cut), max(1, -(-cut // self.batch))):
                step(r)
            now = self.loss(self.forward(x[tail], [(k, i[tail]) for k, i in ids]), y[tail])
            if now < best - 1e-5:
                best, kept, waited = now, {k: v.copy() for k, v in self.w.items()}, 0
            else:
                waited += 1
                if waited > self.patience:
                    break
        self.w = kept or self.w
        if self.coherent:
            from priorframe.models.base import MarginMap

            own = self.predict_raw(train)
            for win, margin, c in (("p_home", "pred_spread", "home_win"), ("p_home_h1", "pred_h1_spread", "h1_home_win")):
                if win in own and margin in own and c in train:
                    self.maps[win] = MarginMap(own[margin], column(train, c))
        return self

    def stepper(self, x: np.ndarray, ids: list, y: np.ndarray, rng: np.random.Generator) -> Callable[[np.ndarray], None]:
        """A step of AdamW on some of these rows.

        A step is small, so what counts is the number of NumPy's calls: weights, their gradients and moments lie in one
        array each, self.w becomes views of it, and layers are written to buffers.
        """
        at = np.cumsum([0, *(v.size for v in self.w.values())])
        flat = np.concatenate([v.ravel() for v in self.w.values()])
        grad, m1, m2, one, two = (np.zeros_like(flat) for _ in range(5))
        views = lambda a: {k: a[i:j].reshape(v.shape) for (k, v), i, j in zip(self.w.items(), at, at[1:])}
        w, g = views(flat), views(grad)
        self.w = w
        most, wide, dim = self.batch + 1, x.shape[1], self.dim
        inputs = np.empty((most, w["w1"].shape[0]))
        z1, z2 = np.empty((most, self.hidden)), np.empty((most, self.hidden // 2))
        r1, r2 = np.empty_like(z1), np.empty_like(z2)
        ok = np.isfinite(y)
        binary = [j for j, t in enumerate(self.used) if t.kind == "binary"]
        twice = np.array([1.0 if t.kind == "binary" else 2.0 for t in self.used])
        tables = {k: [n for n, (of, _) in enumerate(ids) if of == k] for k in ("team", "qb")}
        cells, scale, count = np.arange(dim), 1 / (1 - self.dropout), 0

        def layer(a: np.ndarray, k: int, z: np.ndarray, r: np.ndarray) -> np.ndarray:
            """z becomes the layer's output; what it is to be multiplied with on the way back."""
            np.matmul(a, w[f"w{k}"], out=z)
            z += w[f"b{k}"]
            rng.random(out=r)
            mask = (r >= self.dropout) & (z > 0)
            np.multiply(mask, scale, out=r)
            z *= r
            return r

        def step(some: np.ndarray) -> None:
            nonlocal count
            n = len(some)
            a0, a1, a2 = inputs[:n], z1[:n], z2[:n]
            a0[:, :wide] = x[some]
            own = [i[some] for _, i in ids]
            for j, ((k, _), i) in enumerate(zip(ids, own)):
                a0[:, wide + j * dim : wide + (j + 1) * dim] = w[k][i]
            back1, back2 = layer(a0, 1, a1, r1[:n]), layer(a1, 2, a2, r2[:n])
            d = a2 @ w["w3"] + w["b3"]
            for j in binary:
                d[:, j] = sigmoid(d[:, j])
            known_ = ok[some]
            d -= y[some]
            d *= twice
            d /= np.maximum(known_.sum(0), 1)
            d[~known_] = 0
            np.matmul(a2.T, d, out=g["w3"])
            d.sum(0, out=g["b3"])
            d = (d @ w["w3"].T) * back2
            np.matmul(a1.T, d, out=g["w2"])
            d.sum(0, out=g["b2"])
            d = (d @ w["w2"].T) * back1
            np.matmul(a0.T, d, out=g["w1"])
            d.sum(0, out=g["b1"])
            d = d @ w["w1"].T
            for k, places in tables.items():
                if places:
                    i = np.concatenate([own[j] for j in places])
                    v = np.concatenate([d[:, wide + j * dim : wide + (j + 1) * dim] for j in places])
                    g[k][:] = np.bincount((i[:, None] * dim + cells).ravel(), v.ravel(), g[k].size).reshape(g[k].shape)
            count += 1
            m1.__imul__(0.9)
            m1.__iadd__(np.multiply(grad, 0.1, out=one))
            m2.__imul__(0.999)
            np.multiply(grad, 0.001, out=one)
            m2.__iadd__(np.multiply(one, grad, out=one))
            np.divide(m2, 1 - 0.999**count, out=one)
            np.sqrt(one, out=one)
            one.__iadd__(1e-8)
            np.divide(m1, 1 - 0.9**count, out=two)
            two.__imul__(self.rate)
            np.divide(two, one, out=two)
            flat.__imul__(1 - self.rate * self.decay)
            flat.__isub__(two)

        return step

    def predict_raw(self, test: pd.DataFrame) -> dict[str, np.ndarray]:
        out = self.forward(self.scale(self.matrix(test)), self.ids(test))
        return {t.prediction: sigmoid(out[:, j]) if t.kind == "binary" else out[:, j] * self.sd[j] + self.mean[j] for j, t in enumerate(self.used)}

    def team_embeddings(self) -> pd.DataFrame:
        return pd.DataFrame({"team": list(self.teams), "embedding": [self.w["team"][i].tolist() for i in self.teams.values()]})
