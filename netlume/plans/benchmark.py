"""Detector runs over datasets, cross-dataset runs and the leaderboard."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlume.detectors.base import Detector
from netlume.detectors.boosting import HistBoost, SecondOrderBoost
from netlume.detectors.extra_trees import ExtraTrees
from netlume.detectors.federated import FederatedSgd
from netlume.detectors.linear import GaussianBayes, Logistic, Majority
from netlume.detectors.neural import Autoencoder, Mlp
from netlume.detectors.outliers import IsolationForest, LocalOutlierFactor
from netlume.detectors.svm import PlattSvm
from netlume.detectors.trees import Forest
from netlume.functions.columns import c
from netlume.plans.evaluate import Evaluation, evaluate, evaluation_table
from netlume.sources.artifact import load_artifact
from netlume.sources.results import read_results, write_results

MIN_COMMON_FEATURES = 5
DETECTORS: dict[str, type[Detector]] = {
    d().name: d
    for d in (
        Majority,
        Logistic,
        PlattSvm,
        GaussianBayes,
        Mlp,
        Forest,
        ExtraTrees,
        HistBoost,
        SecondOrderBoost,
        IsolationForest,
        Autoencoder,
        LocalOutlierFactor,
        FederatedSgd,
    )
}


def run_benchmark(
    spark: SparkSession,
    base: str,
    detector: Detector,
    results: str | None = None,
    rebuild: Callable[[], object] | None = None,
    force: bool = False,
) -> Evaluation:
    """One detector on one artifact; the result tables are written if a folder is given.

    With a builder, an artifact that is missing or stale is built first, and any with ``force``.
    """
    return _run_detectors(spark, base, [detector], results, rebuild, force)[0]


def _run_detectors(
    spark: SparkSession,
    base: str,
    detectors: list[Detector],
    results: str | None,
    rebuild: Callable[[], object] | None,
    force: bool,
) -> list[Evaluation]:
    """Several detectors on one artifact, which is loaded, checked and packed once for all of them."""
    rows, meta = load_artifact(spark, base, rebuild, force)
    data = evaluation_table(rows, meta)
    runs = [evaluate(d, data, meta["dataset"]) for d in detectors]
    return [replace(r, tables=write_results(r.tables, results)) for r in runs] if results else runs


def run_all(
    spark: SparkSession,
    bases: list[str],
    detector: Detector | list[Detector],
    results: str | None = None,
    rebuild: dict[str, Callable[[], object]] | None = None,
    force: bool = False,
) -> DataFrame:
    """One or several detectors on every artifact: the binary metrics of all. ``rebuild`` has a builder per artifact."""
    many = detector if isinstance(detector, list) else [detector]
    runs = [_run_detectors(spark, base, many, results, (rebuild or {}).get(base), force) for base in bases]
    return reduce(DataFrame.unionByName, [r.tables["binary"] for own in runs for r in own])


def stored_leaderboard(spark: SparkSession, results: str, datasets: list[str]) -> DataFrame:
    """The leaderboard of everything that runs have written to a results folder."""
    return leaderboard(read_results(spark, results, "binary"), read_results(spark, results, "multiclass"), datasets)


def common_features(source: dict, target: dict) -> list[str]:
    return sorted(set(source["feature_columns"]) & set(target["feature_columns"]))


def cross_rows(
    source: tuple[DataFrame, dict], target: tuple[DataFrame, dict]
) -> tuple[DataFrame, dict] | None:
    """Train and val of one dataset with test of another, on their common features; None if they
    have too few of them."""
    (rows_a, meta_a), (rows_b, meta_b) = source, target
    features = common_features(meta_a, meta_b)
    if len(features) < MIN_COMMON_FEATURES:
        return None
    keys = ("target_binary", "target_multiclass")
    renamed = [c(meta_b[k]).alias(meta_a[k]) for k in keys]
    kept = [c(n) for n in features]
    near = rows_a.where(F.col("split") != "test").select("split", *kept, *[c(meta_a[k]) for k in keys])
    far = rows_b.where(F.col("split") == "test").select("split", *kept, *renamed)
    meta = meta_a | {
        "feature_columns": features,
        "dataset": f"{meta_a['dataset']} -> {meta_b['dataset']}",
    }
    return near.unionByName(far), meta


def cross_evaluate(
    detector: Detector,
    source: tuple[DataFrame, dict],
    targets: list[tuple[DataFrame, dict]],
    keys: list[str] | None = None,
    results: str | None = None,
) -> tuple[list[Evaluation], int]:
    """Train on one dataset, test on each other one; also the number of skipped targets.

    Every table says what was trained on, what was tested on and how many features both have. The tables are written
    if a folder is given.
    """
    done, skipped = [], 0
    for target in targets:
        pair = cross_rows(source, target)
        if pair is None:
            skipped += 1
            continue
        rows, meta = pair
        run = evaluate(detector, evaluation_table(rows, meta, keys), meta["dataset"])
        ends = {
            "train_on": F.lit(source[1]["dataset"]),
            "test_on": F.lit(target[1]["dataset"]),
            "common_features": F.lit(len(meta["feature_columns"])),
        }
        tables = {name: table.withColumns(ends) for name, table in run.tables.items()}
        done.append(replace(run, tables=write_results(tables, results) if results else tables))
    return done, skipped


def leaderboard(binary: DataFrame, multiclass: DataFrame, datasets: list[str]) -> DataFrame:
    """One row per strategy; per dataset the test F1, balanced accuracy and macro F1."""
    test = binary.where(F.col("stage") == "test").select("dataset", "strategy", "f1", "balanced_accuracy")
    both = test.join(multiclass.select("dataset", "strategy", "macro_f1"), ["dataset", "strategy"], "left")
    wide = both.groupBy("strategy").agg(
        *[
            F.max(F.when(F.col("dataset") == d, F.col(m))).alias(f"{d}_{m}")
            for d in datasets
            for m in ("f1", "balanced_accuracy", "macro_f1")
        ]
    )
    first = F.col(f"`{datasets[0]}_f1`")
    return wide.orderBy(F.desc_nulls_last(first), "strategy")
