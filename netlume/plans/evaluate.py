"""The one evaluation protocol that all detectors share.

Out-of-fold predictions over train in five folds, a final fit on train, a threshold chosen on
validation, metrics on test, and a separate multiclass model.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.detectors.base import Detector, matrix
from netlume.operators import metrics as M
from netlume.operators.sampling import CV_FOLDS, with_folds
from netlume.staging import stage

@dataclass(frozen=True)
class Evaluation:
    dataset: str
    strategy: str
    threshold: float | None
    tables: dict[str, DataFrame]


def dealt_evenly(rows: DataFrame) -> DataFrame:
    """``rows`` as they are if every core has work: no partition holds over twice a core's share of them.

    A table whose files cannot be cut so is dealt out in turn, not by a hash: copies of one row would all land in one task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = rows.groupBy(F.spark_partition_id().alias("_part")).count()
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    return rows if (largest or 0) * cores <= 2 * (total or 0) else rows.repartition(cores)


def evaluation_table(rows: DataFrame, meta: dict, keys: list[str] | None = None) -> DataFrame:
    """Packed rows with folds on the train split. Rows stay in the tasks that read them and are not sorted."""
    spread = stage(
        matrix(dealt_evenly(rows), meta["feature_columns"], meta["target_binary"], meta["target_multiclass"], keys),
        "packed",
        partition_by="split",
    )
    train = with_folds(spread.where(F.col("split") == "train"), "y", "_h")
    rest = spread.where(F.col("split") != "train").withColumn("fold", F.lit(None).cast("int"))
    return stage(train.unionByName(rest), "evaluation", partition_by="split")


def out_of_fold(detector: Detector, train: DataFrame, folds: int = CV_FOLDS) -> DataFrame:
    """Every train row scored by the model that was fitted without its fold."""
    return detector.fit_folds(train, folds)(train)


def label_folds(detector: Detector, scored: DataFrame) -> DataFrame:
    if detector.fold_rule == "p90":
        return M.cut_per_group(scored, "score", 0.9, ["fold"])
    test = F.col("score") >= 0.5 if detector.fold_rule == "half" else F.col("score") > 0
    return scored.withColumn("pred", test.cast("int"))


def choose_threshold(detector: Detector, val: DataFrame) -> float | None:
    if not detector.calibrated:
        return None
    grid = detector.grid or M.score_percentiles(val, "score", detector.percentiles)
    return M.best_threshold(val, "y", "score", grid).first()["threshold"]


def evaluate(
    detector: Detector, data: DataFrame, dataset: str, cross_validate: bool = True
) -> Evaluation:
    """``data`` is an evaluation table; the result tables hold one row per metric group. Without
    ``cross_validate`` the five out-of-fold fits are left out and there is no ``cv`` stage."""
    train = data.where(F.col("split") == "train")
    val, test = (data.where(F.col("split") == s) for s in ("val", "test"))
    columns = ["fold", "y", "attack", "score"]

    model = detector.fit(train)
    held = stage(model(val.unionByName(test)).select("split", *columns), "held-out", partition_by="split")
    threshold = choose_threshold(detector, held.where(F.col("split") == "val"))
    cut = 0.5 if threshold is None else threshold
    later = held.withColumn("pred", (F.col("score") >= cut).cast("int"))
    scored = later.select(F.col("split").alias("stage"), *columns, "pred")
    if cross_validate:
        oof = stage(out_of_fold(detector, train).select(*columns), "out-of-fold")
        cv = label_folds(detector, oof).select(F.lit("cv").alias("stage"), *columns, "pred")
        scored = cv.unionByName(scored)

    tables = {"binary": M.binary_metrics(scored, "y", "pred", "score", ["stage"])}
    tables["binary"] = tables["binary"].withColumns(
        {
            "threshold": F.lit(threshold).cast("double"),
            "params": F.lit(json.dumps(detector.params())),
            "strategy_type": F.lit(detector.strategy_type),
        }
    )
    if detector.anomaly:
        tables["per_attack"] = M.per_attack(scored.where(F.col("stage") == "test"), "attack", "pred")
    else:
        tables |= multiclass_tables(detector, train, test)
    keys = {"dataset": F.lit(dataset), "strategy": F.lit(detector.name)}
    named = {k: t.withColumns(keys) for k, t in tables.items()}
    return Evaluation(dataset, detector.name, threshold, named)


def multiclass_tables(detector: Detector, train: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    present = train.select("attack").union(test.select("attack")).distinct()
    classes = sorted(r[0] for r in present.collect())
    predict = detector.fit_classes(train, classes)
    predicted = stage(predict(test).select("attack", "pred_class"), "predicted")
    report = M.per_class(predicted, "attack", "pred_class", classes)
    return {
        "multiclass": M.multiclass_summary(report),
        "per_class": M.per_class_report(report),
        "confusion": M.confusion_long(predicted, "attack", "pred_class"),
    }
