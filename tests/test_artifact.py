import pytest
from pyspark.sql import functions as F

from netlume.sources import artifact as A
from netlume.sources.results import read_results, write_results
from netlume.staging import staging_path

TARGETS = ("y", "multi", "family")


@pytest.fixture(scope="module")
def good(spark):
    """Ten rows per split, all vectors different."""
    rows = spark.range(30).select(
        F.col("id").cast("double").alias("a.b"),
        (F.col("id") * 2).cast("double").alias("c"),
        (F.col("id") % 2).cast("int").alias("y"),
        F.when(F.col("id") % 2 == 0, "normal").otherwise("ddos").alias("multi"),
        F.when(F.col("id") % 2 == 0, "benign").otherwise("ddos_dos").alias("family"),
        F.expr("element_at(array('train', 'val', 'test'), int(id / 10) + 1)").alias("split"),
    )
    scaler = {"mean": [0.0, 0.0], "scale": [1.0, 1.0], "columns": ["a.b", "c"]}
    meta = A.build_metadata(rows, "demo", ["a.b", "c"], TARGETS, scaler, {"0": "Normal", "1": "Attack"})
    return rows, meta


def failed(rows, meta):
    return {name for name, ok, _ in A.artifact_checks(rows, meta) if not ok}


def test_roundtrip_and_validation(spark, good):
    rows, meta = good
    base = staging_path(spark, "artifact")
    assert not A.is_ready(spark, base)
    with pytest.raises(ValueError, match="no current artifact"):
        A.load_artifact(spark, base)
    A.write_rows(rows, base)
    assert not A.is_ready(spark, base)  # the metadata record comes last
    A.write_metadata(spark, meta, base)
    read, read_meta = A.load_artifact(spark, base)
    assert read_meta == {k: v for k, v in meta.items() if v is not None}
    assert read.count() == 30 and A.validate_output(spark, base).where("not ok").isEmpty()
    assert meta["split_rows"] == {"train": 10, "val": 10, "test": 10}
    assert meta["family_classes"] == ["benign", "ddos_dos"]
    report = A.audit(spark, [base]).first()
    assert report.clean and report.failed_checks == 0 and report.train_rows == 10


@pytest.mark.parametrize(
    "change, name",
    [
        (lambda m: {k: v for k, v in m.items() if k != "split_rows"}, "metadata_keys"),
        (lambda m: m | {"artifact_schema": "other"}, "artifact_schema"),
        (lambda m: m | {"preprocess_version": 4}, "preprocess_version"),
        (lambda m: m | {"family_classes": ["benign", "new"]}, "family_classes"),
        (lambda m: m | {"feature_columns": ["a.b", "c", "gone"]}, "columns_present"),
        (lambda m: m | {"feature_columns": ["a.b", "c", "y"]}, "targets_not_features"),
        (lambda m: m | {"split_rows": {"train": 10, "val": 9, "test": 10}}, "val:row_count"),
    ],
)
def test_each_metadata_defect_is_found(good, change, name):
    rows, meta = good
    assert failed(rows, change(meta)) == {name}


@pytest.mark.parametrize(
    "column, value, name",
    [
        ("c", float("nan"), "test:no_missing"),
        ("c", None, "test:no_missing"),
        ("c", float("inf"), "test:finite"),
        ("multi", None, "test:target_multi"),
    ],
)
def test_each_row_defect_is_found(spark, good, column, value, name):
    rows, meta = good
    broken = rows.withColumn(column, F.when(F.col("`a.b`") == 25, F.lit(value)).otherwise(F.col(column)))
    assert failed(broken, meta) == {name}
    base = staging_path(spark, "artifact")
    A.write_rows(broken, base)
    A.write_metadata(spark, meta, base)
    with pytest.raises(ValueError, match="1 artifact checks failed"):
        A.validate_output(spark, base)
    if name == "test:finite":  # the load check lets infinities pass
        A.load_artifact(spark, base)
    else:
        with pytest.raises(ValueError, match=name):
            A.load_artifact(spark, base)


def test_shared_vector_is_found_and_all_failures_are_listed(spark, good):
    rows, meta = good
    copy = rows.withColumns({"a.b": F.when(F.col("`a.b`") == 25, 1.0).otherwise(F.col("`a.b`"))})
    copy = copy.withColumn("c", F.when(F.col("`a.b`") == 1.0, 2.0).otherwise(F.col("c")))
    assert failed(copy, meta) == {"overlap:train_test"}
    base = staging_path(spark, "artifact")
    A.write_rows(copy, base)
    A.write_metadata(spark, meta | {"split_rows": {"train": 1, "val": 10, "test": 10}}, base)
    with pytest.raises(ValueError, match="2 artifact checks failed.*train:row_count.*overlap:train_test"):
        A.validate_output(spark, base)
    assert not A.audit(spark, [base]).first().clean


def test_column_order_and_rebuild(spark, good):
    rows, meta = good
    checks = A.artifact_checks(rows, meta, {"train": ["a.b", "c"], "val": ["c", "a.b"], "test": ["a.b", "c"]})
    assert [n for n, ok, _ in checks if not ok] == ["val:same_columns"]
    base = staging_path(spark, "artifact")
    built = []

    def build():
        built.append(1)
        A.write_rows(rows, base)
        A.write_metadata(spark, meta, base)

    A.load_artifact(spark, base, build)
    A.load_artifact(spark, base, build)
    assert len(built) == 1
    A.load_artifact(spark, base, build, force=True)
    A.write_metadata(spark, meta | {"preprocess_version": 4}, base)
    A.load_artifact(spark, base, build)
    assert len(built) == 3


def test_results_of_other_strategies_are_kept(spark):
    base = staging_path(spark, "results")

    def table(strategy, f1):
        return {"binary": spark.createDataFrame([("d", strategy, f1)], "dataset string, strategy string, f1 double")}

    for strategy, f1 in (("a", 0.1), ("b", 0.2), ("a", 0.3)):
        write_results(table(strategy, f1), base)
    got = {r.strategy: r.f1 for r in read_results(spark, base, "binary").collect()}
    assert got == {"a": 0.3, "b": 0.2}
