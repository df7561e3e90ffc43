"""Registered queries against their SQL on the smallest tables; ALL_QUERIES=1 checks every one."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
QUICK = [
    "proportional_rates",
    "stratified_sample_rate",
    "stratified_split",
    "benign_subsample",
    "numeric_coerce",
    "categorical_clean",
    "time_features",
    "csv_scan",
    "union_devices",
    "drop_conflicts",
    "dedup_conflicts",
    "label_encode",
    "best_threshold_pct",
    "per_class",
    "leaderboard",
    "lof",
    "prepare_edge",
]
NAMES = sorted(registry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


def normal(rows, order):
    return sorted((tuple(0.0 if r[i] == 0 else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = registry.queries()[name](spark, sf)
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [df.columns.index(n) for n in names]
    assert normal(df.collect(), order) == normal(result.fetchall(), range(len(names)))


def test_registry_is_consistent(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry(spark).count() == 3  # out of fold, validation, test
