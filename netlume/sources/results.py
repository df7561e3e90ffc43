"""Sink and source of metric tables, partitioned by dataset and strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netlume.staging import stage

TABLES = ["binary", "multiclass", "per_class", "confusion", "per_attack"]
KEYS = ["dataset", "strategy"]


def write_results(tables: dict[str, DataFrame], base: str, fmt: str = "json") -> dict[str, DataFrame]:
    """Replace the results of the (dataset, strategy) pairs in ``tables`` and keep all others.

    The metrics are computed once, by all tasks, and the small computed tables are returned.
    """
    done = {name: stage(table, "metrics") for name, table in tables.items()}
    for name, table in done.items():
        writer = table.coalesce(1).write.mode("overwrite").partitionBy(*KEYS)
        writer.option("partitionOverwriteMode", "dynamic").format(fmt).save(f"{base}/{name}")
    return done


def read_results(spark: SparkSession, base: str, table: str, fmt: str = "json") -> DataFrame:
    return spark.read.format(fmt).load(f"{base}/{table}")
