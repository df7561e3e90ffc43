"""Hinge-loss linear model with sigmoid calibration.

Three parts, one model per part and class, fitted on the other parts and calibrated on its own part;
the probability is the mean over the parts. All of them, and those of all folds, are trained in the same
summed gradient steps and calibrated in the same aggregates, so the number of jobs does not grow with the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlume.detectors.base import Detector, Fitted, class_index, classify_in_arrow, rows_to_numpy
from netlume.detectors.gradient import NO_FOLD, Schedule, descend, score_models
from netlume.operators.sampling import SEED, stratified_parts
from netlume.staging import stage

DECAY = 1e-4
RATE = 2e-3
NEWTON_STEPS = 25
BLOCK_ROWS = 8_192  # rows whose margins fit a core's cache


class HingeUnits:
    """``parts * k`` linear units per model. ``t`` is class * parts + part; a unit skips the rows of its part, and with
    ``folds`` model m skips the rows of fold m."""

    def __init__(self, parts: int, k: int, width: int, models: int = 1, folds: bool = False):
        self.parts, self.k, self.width, self.models, self.folds = parts, k, width, models, folds
        self.units, self.size = parts * k, parts * k * (width + 1)

    def wanted(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row and unit: the side (+1 or -1) and whether the unit learns from the row."""
        cls, part = np.divmod(t.astype(int), self.parts)
        classes = np.arange(self.k) if self.k > 1 else np.array([1])
        side = np.tile(np.where(cls[:, None] == classes, 1.0, -1.0), (1, self.parts))
        learns = np.repeat(part[:, None] != np.arange(self.parts), self.k, axis=1)
        return side, learns

    def margins(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = flat.reshape(self.units, self.width + 1)
        return x @ w[:, :-1].T + w[:, -1]

    def _slack(self, params: np.ndarray, x: np.ndarray, t: np.ndarray, fold: np.ndarray):
        """Per block its rows, their sides (1 or k, rows), the slack (models, parts, k, rows), 0 where a unit does not
        learn from a row, and which rows a model sees. Rows are the last axis: they lie side by side."""
        w = params.reshape(self.models * self.units, self.width + 1)
        classes = np.arange(self.k) if self.k > 1 else np.array([1])
        for at in range(0, len(x), BLOCK_ROWS):
            mine, of = x[at : at + BLOCK_ROWS], fold[at : at + BLOCK_ROWS]
            cls, part = np.divmod(t[at : at + BLOCK_ROWS].astype(int), self.parts)
            side = np.where(cls == classes[:, None], 1.0, -1.0)
            slack = (w[:, :-1] @ mine.T + w[:, -1:]).reshape(self.models, self.parts, self.k, len(mine))
            slack *= -side
            slack += 1.0
            np.maximum(slack, 0.0, out=slack)
            slack *= (part != np.arange(self.parts)[:, None])[:, None]
            seen = of != np.arange(self.models)[:, None] if self.folds else np.ones((self.models, len(mine)), bool)
            if self.folds:
                slack *= seen[:, None, None]
            yield mine, side, slack, seen

    def gradient(self, params: np.ndarray, x: np.ndarray, t: np.ndarray, fold: np.ndarray) -> tuple:
        grads, (losses, rows) = np.zeros_like(params), (np.zeros(self.models), np.zeros(self.models))
        of_unit = grads.reshape(self.models * self.units, self.width + 1)
        for mine, side, slack, seen in self._slack(params, x, t, fold):
            push = ((slack > 0) * side).reshape(len(of_unit), len(mine))
            of_unit[:, :-1] -= push @ mine
            of_unit[:, -1] -= push.sum(axis=1)
            losses += slack.sum(axis=(1, 2, 3)) / self.units
            rows += seen.sum(axis=1) * (self.parts - 1) / self.parts
        return grads, losses, rows

    def loss(self, params: np.ndarray, x: np.ndarray, t: np.ndarray, fold: np.ndarray) -> tuple:
        losses, rows = np.zeros(self.models), np.zeros(self.models)
        for _, _, slack, seen in self._slack(params, x, t, fold):
            losses += slack.sum(axis=(1, 2, 3)) / self.units
            rows += seen.sum(axis=1) * (self.parts - 1) / self.parts
        return losses, rows

    def penalty(self, params: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = DECAY * params.reshape(self.models, self.units, self.width + 1)
        out[:, :, -1] = 0.0
        return out.reshape(params.shape)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def held_margins(data: DataFrame, model: HingeUnits, params: np.ndarray) -> DataFrame:
    """(unit, t, m): per row the margins of the units of its own part, which did not learn from it, of every model that
    learnt from the row's fold. Units are numbered through all models."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_to_numpy(batch.column("x"))
            t, fold = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("t", "fold"))
            side, learns = model.wanted(t)
            for m in range(model.models):
                rows, units = np.nonzero(~learns & ((fold != m) | (not model.folds))[:, None])
                made = model.margins(params[m], x)
                yield pa.RecordBatch.from_pydict(
                    {
                        "unit": pa.array(units + m * model.units, pa.int32()),
                        "t": pa.array((side[rows, units] > 0).astype(np.int32), pa.int32()),
                        "m": pa.array(made[rows, units], pa.float64()),
                    }
                )

    return data.mapInArrow(work, "unit int, t int, m double")


def platt_sigmoids(held: DataFrame, units: int) -> np.ndarray:
    """Slope and intercept of P(t=1 | m) per unit, by Newton steps on Platt's smoothed targets.

    A step that does not lower the loss is halved. Each step is one small aggregate.
    """
    counts = {r["unit"]: r for r in held.groupBy("unit").agg(F.sum("t").alias("p"), F.count("*").alias("n")).collect()}
    pos = np.array([counts[u]["p"] if u in counts else 0 for u in range(units)], dtype=float)
    neg = np.array([counts[u]["n"] if u in counts else 0 for u in range(units)], dtype=float) - pos
    high, low = (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0)

    def of_unit(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("unit") + 1)

    goal = F.when(F.col("t") == 1, of_unit(high)).otherwise(of_unit(low))

    def sums(at: np.ndarray) -> np.ndarray:
        z = of_unit(at[:, 0]) * F.col("m") + of_unit(at[:, 1])
        p = 1.0 / (1.0 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) - z * F.col("goal") + F.log1p(F.exp(-F.abs(z)))
        gap, curve, m = p - F.col("goal"), p * (1.0 - p), F.col("m")
        terms = [loss, gap * m, gap, curve * m * m, curve * m, curve]
        rows = held.withColumn("goal", goal).groupBy("unit").agg(*[F.sum(v).alias(f"s{i}") for i, v in enumerate(terms)])
        out = np.zeros((units, 6))
        for r in rows.collect():
            out[r["unit"]] = r[1:]
        return out

    best = np.stack([np.zeros(units), np.log((pos + 1.0) / (neg + 1.0))], axis=1)
    at_best = sums(best)
    step = newton_step(at_best)
    for _ in range(NEWTON_STEPS):
        trial = best - step
        found = sums(trial)
        better = found[:, 0] < at_best[:, 0] * (1.0 - 1e-9)
        best = np.where(better[:, None], trial, best)
        at_best = np.where(better[:, None], found, at_best)
        step = np.where(better[:, None], newton_step(at_best), step / 2)
        if not better.any() and np.abs(step).max() < 1e-3:
            break
    return best


def newton_step(sums: np.ndarray) -> np.ndarray:
    _, ga, gb, haa, hab, hbb = sums.T
    haa, hbb = haa + 1e-9, hbb + 1e-9
    det = haa * hbb - hab**2
    return np.stack([(hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det], axis=1)


@dataclass
class PlattSvm(Detector):
    name: str = "sgd"
    rounds: int = 1000
    patience: int = 5
    tolerance: float = 1e-3
    parts: int = 3

    def _train(self, train: DataFrame, target: str, k: int, folds: int = 0):
        """Function from rows and a model's number to calibrated probabilities, shape (rows, parts, k)."""
        code = (F.col(target) * self.parts + F.col("_part")).cast("int")
        model = HingeUnits(self.parts, k, len(train.select("x").first()["x"]), max(folds, 1), folds > 0)
        plan = Schedule(self.rounds, self.patience, self.tolerance, RATE, fading=True)
        params = descend(train, code, model, np.zeros((model.models, model.size)), plan, False)
        fold = F.col("fold").cast("int") if folds else F.lit(NO_FOLD)
        held = held_margins(train.select("x", code.alias("t"), fold.alias("fold")), model, params)
        curves = platt_sigmoids(stage(held, "margins"), model.models * model.units).reshape(model.models, model.units, 2)

        def probability(x: np.ndarray, m: int) -> np.ndarray:
            z = model.margins(params[m], x)
            return sigmoid(z * curves[m, :, 0] + curves[m, :, 1]).reshape(len(x), self.parts, k)

        return probability

    def _binary(self, train: DataFrame, folds: int) -> Fitted:
        probability = self._train(stratified_parts(train, "y", "_h", self.parts, "_part"), "y", 1, folds)
        return lambda df: score_models(df, lambda x, m: probability(x, m)[:, :, 0].mean(axis=1), folds > 0)

    def fit(self, train: DataFrame) -> Fitted:
        return self._binary(train, 0)

    def fit_folds(self, train: DataFrame, folds: int) -> Fitted:
        return self._binary(train, folds)

    def fit_classes(self, train: DataFrame, classes: list[str]) -> Fitted:
        indexed = class_index(train, classes, "label")
        parted = stratified_parts(indexed, "attack", "_h", self.parts, "_part")
        probability = self._train(parted, "label", len(classes))

        def scores(x: np.ndarray) -> np.ndarray:
            p = probability(x, 0)
            return (p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300)).mean(axis=1)

        return lambda df: classify_in_arrow(df, scores, classes)
