"""Binary, multiclass and per-attack metrics as tables.

Inputs are scored rows: true and predicted labels and a score. ``by`` columns (stage, fold, dataset,
strategy) compute several tables in one pass. Ratios are rounded to four digits; an undefined ratio
is 0, an undefined ranking metric is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlume.functions.columns import c
from netlume.operators.ordering import running_sums
from netlume.operators.selection import exact_quantiles

THRESHOLD_GRID = [i / 100 for i in range(10, 91, 5)]
PERCENTILE_GRID = [i / 100 for i in range(5, 100, 5)]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def confusion_binary(df: DataFrame, true: str, pred: str, by: list[str] = ()) -> DataFrame:
    def cell(t: int, p: int) -> Column:
        hit = (F.col(true) == t) & (F.col(pred) == p)
        return F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).cast("bigint")

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def binary_rates(confusion: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy, precision, recall and F1 next to the four cells."""
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    # a class that never occurs takes no part in the balance
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    rates = {
        "balanced_accuracy": ratio(recall + specificity, present),
        "f1": _f1(tp, fp, fn),
        "precision": ratio(tp, tp + fp),
        "recall": recall,
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
    }
    return confusion.withColumns({k: F.round(v, 4) for k, v in rates.items()})


def ranking_metrics(
    df: DataFrame, true: str, score: str, by: list[str] = (), ranges: int | None = None
) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step rule) per group, from ``ranges`` sorted ranges of scores."""
    by = list(by)
    keys = by or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    sums = {"pos": F.col(true), "neg": 1 - F.col(true)}
    run = running_sums(source, score, sums, keys, descending=True, ranges=ranges)
    area = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2))
    steps = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    out = run.groupBy(*keys).agg(
        F.round(area / F.nullif(pos * neg, F.lit(0.0)), 4).alias("roc_auc"),
        F.round(F.coalesce(steps / F.nullif(pos, F.lit(0.0)), F.lit(0.0)), 4).alias("pr_auc"),
    )
    return out if by else out.drop("_all")


def binary_metrics(
    df: DataFrame, true: str, pred: str, score: str, by: list[str]
) -> DataFrame:
    rates = binary_rates(confusion_binary(df, true, pred, by))
    return rates.join(ranking_metrics(df, true, score, by), list(by))


def threshold_counts(
    df: DataFrame, true: str, score: str, thresholds: list[float], by: list[str] = ()
) -> DataFrame:
    """(by..., threshold, tp, fp, fn, f1), all thresholds counted in one pass over the rows."""
    y = F.col(true)
    cells = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.coalesce(F.sum(F.when(F.col(score) >= t, y).otherwise(0)), F.lit(0)).cast("bigint").alias("tp"),
            F.coalesce(F.sum(F.when(F.col(score) >= t, 1 - y).otherwise(0)), F.lit(0)).cast("bigint").alias("fp"),
        )
        for t in thresholds
    ]
    counted = df.groupBy(*by).agg(F.sum(y).cast("bigint").alias("_pos"), F.array(*cells).alias("_cells"))
    out = counted.select(*by, "_pos", F.inline("_cells")).withColumn("fn", F.col("_pos") - F.col("tp"))
    out = out.withColumn("f1", _f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.select(*by, "threshold", "tp", "fp", "fn", "f1")


def best_threshold(
    df: DataFrame, true: str, score: str, thresholds: list[float], by: list[str] = ()
) -> DataFrame:
    """(by..., threshold, f1) with the highest F1; the first (lowest) of tied thresholds wins."""
    counts = threshold_counts(df, true, score, thresholds, by)
    order = F.struct(F.col("f1"), -F.col("threshold"))
    return counts.groupBy(*by).agg(
        F.max_by("threshold", order).alias("threshold"), F.round(F.max("f1"), 4).alias("f1")
    )


def score_percentiles(df: DataFrame, score: str, probs: list[float] | None = None) -> list[float]:
    """Exact score percentiles, 19 by default, as thresholds."""
    rows = exact_quantiles(df, score, probs or PERCENTILE_GRID).collect()
    return [r["quantile"] for r in sorted(rows, key=lambda r: r["prob"])]


def cut_per_group(df: DataFrame, score: str, prob: float, by: list[str]) -> DataFrame:
    """Add ``pred`` = 1 where the score reaches the given percentile of its own group."""
    from netlume.staging import stage

    cuts = exact_quantiles(df, score, [prob], by=by).select(*by, F.col("quantile").alias("cut"))
    joined = df.join(stage(cuts, "group-cuts"), list(by))
    return joined.withColumn("pred", (F.col(score) >= F.col("cut")).cast("int")).drop("cut")


def confusion_long(df: DataFrame, true: str, pred: str, by: list[str] = ()) -> DataFrame:
    """(by..., true_class, pred_class, n) for the pairs that occur."""
    pairs = df.groupBy(*by, F.col(true).alias("true_class"), F.col(pred).alias("pred_class"))
    return pairs.agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, true: str, pred: str, classes: list[str]) -> DataFrame:
    """One row per true class of the list, one column ``pred_<class>`` per predicted class."""
    listed = class_table(df, classes)
    cells = confusion_long(df, true, pred)
    wide = listed.join(cells, listed["class"] == cells["true_class"], "left").groupBy("class")
    return wide.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("pred_class") == p, F.col("n"))), F.lit(0)).alias(f"pred_{p}")
            for p in classes
        ]
    ).withColumnRenamed("class", "true_class")


def class_table(df: DataFrame, classes: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in classes], "class string")


def per_class(df: DataFrame, true: str, pred: str, classes: list[str]) -> DataFrame:
    """precision, recall, F1 and support of every listed class, unrounded, with its raw counts."""
    cells = confusion_long(df, true, pred)
    marks = F.array(
        F.struct(
            F.col("true_class").alias("class"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0).alias("tp"),
        ),
        F.struct(
            F.col("pred_class").alias("class"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("bigint").alias("tp"),
        ),
    )
    sums = cells.select(F.inline(marks)).groupBy("class")
    sums = sums.agg(*[F.sum(n).alias(n) for n in ("support", "predicted", "tp")])
    full = class_table(df, classes).join(sums, "class", "left").fillna(0)
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return full.withColumns(
        {
            "precision": ratio(tp, predicted),
            "recall": ratio(tp, support),
            "f1": ratio(2 * tp, support + predicted),
        }
    )


def per_class_report(classes: DataFrame) -> DataFrame:
    rounded = [F.round(n, 4).alias(n) for n in ("precision", "recall", "f1")]
    return classes.select("class", *rounded, "support")


def multiclass_summary(classes: DataFrame) -> DataFrame:
    """macro and weighted F1 over the list; balanced accuracy over the classes that truth has."""
    support = F.col("support")
    total = F.sum(support)
    return classes.agg(
        F.round(F.avg(F.when(support > 0, F.col("recall"))), 4).alias("balanced_accuracy"),
        F.round(F.avg("f1"), 4).alias("macro_f1"),
        F.round(ratio(F.sum(F.col("f1") * support), total), 4).alias("weighted_f1"),
        F.round(ratio(F.sum("tp"), total), 4).alias("accuracy"),
    )


def per_attack(df: DataFrame, attack: str, pred: str, by: list[str] = ()) -> DataFrame:
    """support, detected and recall by attack type; for the benign type recall is its false alarm rate."""
    return df.groupBy(*by, c(attack).alias("attack_type")).agg(
        F.count("*").alias("support"),
        F.sum(pred).cast("bigint").alias("detected"),
        F.round(F.avg(F.col(pred)), 4).alias("recall"),
    )
