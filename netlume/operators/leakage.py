"""Duplicates, contradictory labels, and rows that leak between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlume.functions.columns import FP, c, with_fingerprint
from netlume.operators.sampling import SPLITS
from netlume.staging import stage

_TARGET_FP = ("_tfp_hi", "_tfp_lo")


def split_number(split: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), split)


def drop_conflicts(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Drop every row whose feature vector occurs with more than one target tuple.

    The aggregate carries only fingerprints and combines before its shuffle. Its result is staged, so
    Spark knows its size: a small one is broadcast and the rows are not shuffled at all. Beyond the
    broadcast limit, adaptive skew handling cuts up a vector shared by very many rows (left side).
    """
    marked = with_fingerprint(with_fingerprint(df, features), targets, _TARGET_FP)
    bad = (
        marked.groupBy(*FP)
        .agg(F.min(_TARGET_FP[0]).alias("_lo"), F.max(_TARGET_FP[0]).alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select(*FP)
    )
    return marked.join(stage(bad, "conflicts"), list(FP), "left_anti").drop(*FP, *_TARGET_FP)


def dedup_and_drop_conflicts(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Both steps where ``df`` holds nothing but features and targets: two shuffles and no join.

    After the distinct a feature vector has at most one row per target tuple, so the window groups
    are as small as the label set and a vector with more than one row is a conflict.
    """
    marked = with_fingerprint(df.distinct(), features)
    rows = F.count("*").over(Window.partitionBy(*FP))
    return marked.withColumn("_rows", rows).where(F.col("_rows") == 1).drop("_rows", *FP)


def remove_overlaps(df: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """Keep a feature vector only in the first split (train, val, test) that has it.

    Train never loses rows. One aggregate finds the vectors that occur in several splits; only those
    take part in the anti join, which broadcasts them when they are few (see ``drop_conflicts``).
    """
    marked = with_fingerprint(df, features).withColumn("_sn", split_number(F.col(split)))
    shared = (
        marked.groupBy(*FP)
        .agg(F.min("_sn").alias("_first"), F.max("_sn").alias("_last"))
        .where(F.col("_first") < F.col("_last"))
        .select(*[F.col(f).alias(f"s{f}") for f in FP], "_first")
    )
    shared = stage(shared, "shared-vectors")
    same = (F.col(FP[0]) == F.col(f"s{FP[0]}")) & (F.col(FP[1]) == F.col(f"s{FP[1]}"))
    later = F.col("_sn") > F.col("_first")
    return marked.join(shared, same & later, "left_anti").drop(*FP, "_sn")


def count_overlaps(df: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """One row with the number of distinct feature vectors shared by each pair of splits."""
    seen = (
        with_fingerprint(df, features)
        .groupBy(*FP)
        .agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in SPLITS])
    )

    def both(a: str, b: str) -> Column:
        return F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("bigint").alias(f"{a}_{b}")

    return seen.agg(both("train", "val"), both("train", "test"), both("val", "test"))


def class_union(df: DataFrame, column: str) -> list[str]:
    """Sorted classes over all splits, as text. Class lists are metadata and small by nature."""
    values = df.select(c(column).cast("string").alias("v")).distinct()
    return sorted(r[0] for r in values.collect())
