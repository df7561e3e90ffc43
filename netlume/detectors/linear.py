"""Majority class, logistic regression and Gaussian naive Bayes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.detectors.base import Detector, Fitted, class_index, classify_in_arrow, index_class, score_in_arrow, with_vector
from netlume.detectors.gradient import score_models


def positive_probability(model) -> Fitted:
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(with_vector(df))
        made = [n for n in out.columns if n not in df.columns and n != "probability"]
        return out.withColumn("score", vector_to_array("probability")[1]).drop("probability", *made)

    return score


def predicted_class(model, classes: list[str]) -> Fitted:
    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(with_vector(df))
        return index_class(out, "prediction", classes).select(*df.columns, "pred_class")

    return predict


@dataclass
class Majority(Detector):
    name: str = "dummy"
    calibrated: bool = False

    def fit(self, train: DataFrame) -> Fitted:
        top = train.groupBy("y").count().orderBy(F.desc("count"), "y").first()["y"]
        return lambda df: df.withColumn("score", F.lit(float(top)))

    def fit_folds(self, train: DataFrame, folds: int) -> Fitted:
        """The counts of a fold's complement are the total less the fold's own: one aggregate for all folds."""
        counts = np.zeros((folds, 2), dtype=object)
        for r in train.groupBy("fold", "y").count().collect():
            counts[r["fold"], r["y"]] = r["count"]
        rest = counts.sum(axis=0) - counts
        tops = F.array(*[F.lit(float(n[1] > n[0])) for n in rest])
        return lambda df: df.withColumn("score", F.get(tops, F.col("fold").cast("int")))

    def fit_classes(self, train: DataFrame, classes: list[str]) -> Fitted:
        top = train.groupBy("attack").count().orderBy(F.desc("count"), "attack").first()["attack"]
        return lambda df: df.withColumn("pred_class", F.lit(top))


@dataclass
class Logistic(Detector):
    name: str = "logistic_regression"
    max_iter: int = 1000

    def _estimator(self, train: DataFrame, label: str) -> LogisticRegression:
        # unit inverse penalty on the summed loss is 1/n on the mean loss
        return LogisticRegression(
            labelCol=label, maxIter=self.max_iter, regParam=1.0 / train.count(), standardization=False
        )

    def fit(self, train: DataFrame) -> Fitted:
        return positive_probability(self._estimator(train, "y").fit(with_vector(train)))

    def fit_classes(self, train: DataFrame, classes: list[str]) -> Fitted:
        indexed = class_index(train, classes, "label")
        return predicted_class(self._estimator(train, "label").fit(with_vector(indexed)), classes)


class Moments:
    """Rows, means and summed squared deviations per class; those of several folds can be merged without loss of
    precision, so the complement of every fold comes from one pass over the rows."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        self.n, self.mean, self.spread = n, mean, spread  # (classes,), (classes, features) twice

    @staticmethod
    def of(train: DataFrame, target: str, classes: int, folds: int = 0) -> list["Moments"]:
        """One for all rows, or one per fold. The result of the aggregate has one row per fold and class."""
        width = len(train.select("x").first()["x"])
        values = [F.col("x")[i] for i in range(width)]
        fold = F.col("fold") if folds else F.lit(0)
        rows = train.groupBy(fold.cast("int").alias("fold"), F.col(target).cast("int").alias("cls")).agg(
            F.count("*").alias("n"),
            F.array(*[F.avg(v) for v in values]).alias("mean"),
            F.array(*[F.var_pop(v) for v in values]).alias("var"),
        )
        parts = max(folds, 1)
        out = [Moments(np.zeros(classes), *(np.zeros((classes, width)) for _ in range(2))) for _ in range(parts)]
        for r in rows.collect():
            m, j = out[r["fold"]], r["cls"]
            m.n[j], m.mean[j], m.spread[j] = r["n"], r["mean"], np.array(r["var"]) * r["n"]
        return out

    @staticmethod
    def merged(parts: list["Moments"]) -> "Moments":
        n = np.sum([p.n for p in parts], axis=0)
        whole = np.maximum(n, 1.0)[:, None]
        mean = np.sum([p.n[:, None] * p.mean for p in parts], axis=0) / whole
        spread = np.sum([p.spread + p.n[:, None] * (p.mean - mean) ** 2 for p in parts], axis=0)
        return Moments(n, mean, spread)

    def joint(self):
        """Function from rows to the log likelihood of each class, prior included; classes without rows have none."""
        known = self.n > 0
        n = self.n[known]
        every = Moments.merged([Moments(self.n[[j]], self.mean[[j]], self.spread[[j]]) for j in np.flatnonzero(known)])
        smoothing = 1e-9 * (every.spread / every.n[:, None]).max()
        mean, var = self.mean[known], self.spread[known] / n[:, None] + smoothing
        constant = np.log(n / n.sum()) - np.log(2 * np.pi * var).sum(axis=1) / 2

        def score(x: np.ndarray) -> np.ndarray:
            out = np.full((len(x), len(known)), -np.inf)
            for at, j in enumerate(np.flatnonzero(known)):
                out[:, j] = constant[at] - ((x - mean[at]) ** 2 / var[at]).sum(axis=1) / 2
            return out

        return score


def attack_probability(joint: np.ndarray) -> np.ndarray:
    """P(1) from the log likelihoods of 0 and 1."""
    gap = np.where(np.isfinite(joint).all(axis=1), joint[:, 0] - joint[:, 1], np.where(joint[:, 1] > joint[:, 0], -700, 700))
    return 1.0 / (1.0 + np.exp(np.clip(gap, -700, 700)))


@dataclass
class GaussianBayes(Detector):
    name: str = "gaussian_nb"

    def fit(self, train: DataFrame) -> Fitted:
        joint = Moments.of(train, "y", 2)[0].joint()
        return lambda df: score_in_arrow(df, lambda x: attack_probability(joint(x)))

    def fit_folds(self, train: DataFrame, folds: int) -> Fitted:
        parts = Moments.of(train, "y", 2, folds)
        joints = [Moments.merged(parts[:i] + parts[i + 1 :]).joint() for i in range(folds)]
        return lambda df: score_models(df, lambda x, m: attack_probability(joints[m](x)), True)

    def fit_classes(self, train: DataFrame, classes: list[str]) -> Fitted:
        # a class only in test has no rows, hence no likelihood, and is never predicted
        joint = Moments.of(class_index(train, classes, "label"), "label", len(classes))[0].joint()
        return lambda df: classify_in_arrow(df, joint, classes)
