"""Multilayer perceptron classifier and autoencoder, trained by summed gradients."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlume.detectors.base import Detector, Fitted, class_index, classify_in_arrow
from netlume.detectors.gradient import Schedule, descend, score_models
from netlume.operators.sampling import SEED

DECAY = 1e-4
PATIENCE = 10
BLOCK_ROWS = 2_048  # rows whose layers fit a core's cache


class Network:
    """ReLU layers over flat parameter vectors. ``targets`` is "class" (softmax) or "input" (reconstruction).

    ``models`` networks of one shape are trained together; with ``folds``, network m does not see the rows of fold m.
    """

    def __init__(self, sizes: list[int], targets: str, models: int = 1, folds: bool = False):
        self.sizes, self.targets, self.models, self.folds = sizes, targets, models, folds
        self.size = sum(a * b + b for a, b in zip(sizes, sizes[1:]))

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            bound = np.sqrt(6.0 / (a + b))
            parts.append(rng.uniform(-bound, bound, a * b + b))
        return np.tile(np.concatenate(parts), (self.models, 1))

    def forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        seen, layers = [x], self.layers(flat)
        for i, (w, b) in enumerate(layers):
            z = seen[-1] @ w
            z += b
            seen.append(z if i == len(layers) - 1 else np.maximum(z, 0.0, out=z))
        return seen

    def predict(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = self.forward(flat, x)[-1]
        return softmax(out) if self.targets == "class" else out

    def _losses(self, out: np.ndarray, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        if self.targets == "class":
            return -np.log(np.clip(softmax(out)[np.arange(len(t)), t], 1e-12, None))
        return ((out - x) ** 2).mean(axis=1) / 2

    def _blocks(self, x: np.ndarray, t: np.ndarray, fold: np.ndarray):
        """Per block of rows and model its number, the rows it sees and their targets."""
        for at in range(0, len(x), BLOCK_ROWS):
            rows, want, of = (v[at : at + BLOCK_ROWS] for v in (x, t.astype(int, copy=False), fold))
            for m in range(self.models):
                keep = of != m if self.folds else slice(None)
                yield m, rows[keep], want[keep]

    def gradient(self, params: np.ndarray, x: np.ndarray, t: np.ndarray, fold: np.ndarray) -> tuple:
        grads, losses, rows = np.zeros_like(params), np.zeros(self.models), np.zeros(self.models)
        pairs = [list(zip(self.layers(params[m]), self.layers(grads[m]))) for m in range(self.models)]
        for m, mine, want in self._blocks(x, t, fold):
            seen = self.forward(params[m], mine)
            losses[m] += self._losses(seen[-1], mine, want).sum()
            rows[m] += len(mine)
            if self.targets == "class":
                delta = softmax(seen[-1])
                delta[np.arange(len(want)), want] -= 1.0
            else:
                delta = (seen[-1] - mine) / x.shape[1]
            for i in range(len(pairs[m]) - 1, -1, -1):
                (w, _), (gw, gb) = pairs[m][i]
                gw += seen[i].T @ delta
                gb += delta.sum(axis=0)
                if i:
                    delta = delta @ w.T
                    delta *= seen[i] > 0
        return grads, losses, rows

    def loss(self, params: np.ndarray, x: np.ndarray, t: np.ndarray, fold: np.ndarray) -> tuple:
        losses, rows = np.zeros(self.models), np.zeros(self.models)
        for m, mine, want in self._blocks(x, t, fold):
            losses[m] += self._losses(self.forward(params[m], mine)[-1], mine, want).sum()
            rows[m] += len(mine)
        return losses, rows

    def penalty(self, params: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros_like(params)
        for m in range(self.models):
            for (w, _), (gw, _) in zip(self.layers(params[m]), self.layers(out[m])):
                gw += DECAY / rows[m] * w
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def width_of(train: DataFrame) -> int:
    return len(train.select("x").first()["x"])


@dataclass
class Mlp(Detector):
    name: str = "mlp"
    hidden: tuple[int, ...] = (128, 64)
    rounds: int = 300
    patience: int = PATIENCE

    def _train(self, train: DataFrame, target: Column, k: int, folds: int = 0) -> tuple[Network, np.ndarray]:
        net = Network([width_of(train), *self.hidden, k], "class", max(folds, 1), folds > 0)
        return net, descend(train, target, net, net.start(SEED), Schedule(self.rounds, self.patience), True)

    def fit(self, train: DataFrame) -> Fitted:
        net, params = self._train(train, F.col("y"), 2)
        return lambda df: score_models(df, lambda x, m: net.predict(params[m], x)[:, 1], False)

    def fit_folds(self, train: DataFrame, folds: int) -> Fitted:
        net, params = self._train(train, F.col("y"), 2, folds)
        return lambda df: score_models(df, lambda x, m: net.predict(params[m], x)[:, 1], True)

    def fit_classes(self, train: DataFrame, classes: list[str]) -> Fitted:
        net, params = self._train(class_index(train, classes, "label"), F.col("label"), len(classes))
        return lambda df: classify_in_arrow(df, lambda x: net.predict(params[0], x), classes)


@dataclass
class Autoencoder(Detector):
    """Trained to reconstruct benign rows; the score is the mean squared reconstruction error."""

    name: str = "autoencoder"
    anomaly: bool = True
    fold_rule: str = "p90"
    strategy_type: str = "anomaly_reconstruction"
    hidden: tuple[int, ...] = (64, 16, 64)
    rounds: int = 100
    patience: int = PATIENCE

    def _score(self, train: DataFrame, folds: int) -> Fitted:
        benign, width = train.where(F.col("y") == 0), width_of(train)
        net = Network([width, *self.hidden, width], "input", max(folds, 1), folds > 0)
        params = descend(benign, F.lit(0), net, net.start(SEED), Schedule(self.rounds, self.patience), True)
        error = lambda x, m: ((net.predict(params[m], x) - x) ** 2).mean(axis=1)
        return lambda df: score_models(df, error, folds > 0)

    def fit(self, train: DataFrame) -> Fitted:
        return self._score(train, 0)

    def fit_folds(self, train: DataFrame, folds: int) -> Fitted:
        return self._score(train, folds)
