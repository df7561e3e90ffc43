"""Federated averaging of a linear log-loss model over sites."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.detectors.averaging import train_rounds, with_workers
from netlume.detectors.base import Detector, Fitted, class_index, classify_in_arrow, score_in_arrow
from netlume.operators.sampling import SEED, stratified_parts

RATE = 0.01
DECAY = 1e-4
STEP_ROWS = 8


class LinearSgd:
    """k one-against-rest logistic units, trained at a constant rate.

    The updates of ``STEP_ROWS`` rows are summed before they are applied; at this small rate that
    hardly differs from one row at a time. For two classes one unit with target 1 is enough (k = 1).
    """

    def __init__(self, k: int, width: int, state: np.ndarray):
        self.k = k
        weights = np.array(state).reshape(k, width + 1)
        self.w, self.b = weights[:, :-1].copy(), weights[:, -1].copy()

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w.T + self.b

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x)[:, 0], -500, 500)))

    def learn(self, x: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> None:
        self.learn_together([self], [x], [t], [rng])

    @staticmethod
    def learn_together(models: list, xs: list, ts: list, rngs: list) -> None:
        """A step takes ``STEP_ROWS`` rows of every model, as one product; short models get rows of zeros at their end."""
        k, width = models[0].w.shape
        steps = max(-(-len(t) // STEP_ROWS) for t in ts)
        x = np.zeros((steps, len(models), STEP_ROWS, width + 1))  # the last input is 1, for the bias
        wanted = np.zeros((steps, len(models), STEP_ROWS, k))
        kept = np.ones((steps, len(models), width + 1, 1))  # what a step leaves of the weights
        for j, (own, t, rng) in enumerate(zip(xs, ts, rngs)):
            order, n = rng.permutation(len(t)), len(t)
            rows = np.zeros((steps * STEP_ROWS, width + 1))
            rows[:n, :width], rows[:n, width] = own[order], 1.0
            x[:, j] = rows.reshape(steps, STEP_ROWS, width + 1)
            hits = np.zeros((steps * STEP_ROWS, k))
            hits[:n] = t[order][:, None] == (np.arange(k) if k > 1 else 1)
            wanted[:, j] = hits.reshape(steps, STEP_ROWS, k)
            taken = np.clip(n - np.arange(steps) * STEP_ROWS, 0, STEP_ROWS)
            kept[:, j, :width, 0] = ((1.0 - RATE * DECAY) ** taken)[:, None]
        w = np.stack([np.hstack([m.w, m.b[:, None]]).T for m in models])
        with np.errstate(over="ignore"):  # exp of a large margin is infinite and its probability 0
            for rows, hits, rest in zip(x, wanted, kept):
                step = RATE * (hits - 1.0 / (1.0 + np.exp(-(rows @ w))))
                w = w * rest + rows.transpose(0, 2, 1) @ step
        for m, made in zip(models, w):
            m.w, m.b = made[:-1].T.copy(), made[-1].copy()

    def loss(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        z = self.margins(x)
        wanted = t[:, None] == (np.arange(self.k) if self.k > 1 else 1)
        return np.logaddexp(0.0, np.where(wanted, -z, z)).sum(axis=1)

    def state(self) -> np.ndarray:
        return np.hstack([self.w, self.b[:, None]]).ravel()


@dataclass
class FederatedSgd(Detector):
    """Each round every site runs one local epoch from the global weights; the new global weights
    are the average of the site weights by site size. Sites are a ``site`` column if the table has
    one, otherwise equal stratified shards."""

    name: str = "federated_sgd"
    sites: int = 5
    rounds: int = 20
    rows_per_worker: int | None = None  # a site is one local model

    def _train(self, train: DataFrame, stratum: str, target: str, k: int) -> LinearSgd:
        width = len(train.select("x").first()["x"])
        sited = train
        if "site" not in train.columns:
            sited = stratified_parts(train, stratum, "_h", self.sites, "site")
        data = with_workers(sited, "site", self.rows_per_worker).select(
            "worker", "slice", "x", F.col(target).cast("int").alias("t"), F.lit(False).alias("holdout")
        )
        load = partial(LinearSgd, k, width)
        zero = np.zeros(k * (width + 1))
        return load(train_rounds(data, load, zero, self.rounds, SEED))

    def fit(self, train: DataFrame) -> Fitted:
        model = self._train(train, "y", "y", 1)
        return lambda df: score_in_arrow(df, model.probability)

    def fit_classes(self, train: DataFrame, classes: list[str]) -> Fitted:
        indexed = class_index(train, classes, "label")
        model = self._train(indexed, "attack", "label", len(classes))
        return lambda df: classify_in_arrow(df, model.margins, classes)


def weighted_average(models: DataFrame, weight: str, size: str, by: list[str]) -> DataFrame:
    """Average model coefficients by the number of rows each was trained on."""
    mean = F.sum(F.col(weight) * F.col(size)) / F.sum(size)
    return models.groupBy(*by).agg(mean.alias(weight), F.sum(size).cast("bigint").alias(size))
