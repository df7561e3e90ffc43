"""The prepared artifact: Parquet partitioned by split, plus one JSON metadata record.

The metadata is written last, so an artifact whose write was interrupted is never ready.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlume.functions.columns import c
from netlume.functions.taxonomy import FAMILIES
from netlume.operators.leakage import class_union, count_overlaps
from netlume.operators.sampling import SPLITS

ARTIFACT_SCHEMA = "netlume.prepared.v1"
PREPROCESS_VERSION = 5

_S, _L = T.StringType(), T.LongType()
_SA = T.ArrayType(_S)
_SCALER = T.StructType(
    [
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("scale", T.ArrayType(T.DoubleType())),
        T.StructField("columns", _SA),
    ]
)
# The fields of a metadata record. The first part every record must have.
REQUIRED_FIELDS = {
    "artifact_schema": _S,
    "preprocess_version": _L,
    "dataset": _S,
    "target_binary": _S,
    "target_multiclass": _S,
    "target_family": _S,
    "feature_columns": _SA,
    "split_rows": T.MapType(_S, _L),
    "family_classes": _SA,
    "multiclass_classes": _SA,
}
OTHER_FIELDS = {
    "feature_view": _S,
    "cross_dataset_ready": T.BooleanType(),
    "default_target": _S,
    "feature_count": _L,
    "categorical_columns": _SA,
    "dropped_columns": _SA,
    "encoding_method": _S,
    "scaler": _SCALER,
    "binary_mapping": T.MapType(_S, _S),
    "split_ratio": _S,
    "integrity": T.MapType(_S, _S),
    "onehot_columns": _SA,
    "categorical_encoders": T.MapType(_S, _SA),
    "source": _S,
    "source_files": _SA,
    "sampling_mode": _S,
    "sample_target": _S,
    "n_rows_before_cleaning": _L,
    "n_rows_after_cleaning": _L,
}
REQUIRED_KEYS = list(REQUIRED_FIELDS)
METADATA_SCHEMA = T.StructType([T.StructField(n, kind) for n, kind in (REQUIRED_FIELDS | OTHER_FIELDS).items()])
CONSTANT_FIELDS = {
    "artifact_schema": ARTIFACT_SCHEMA,
    "preprocess_version": PREPROCESS_VERSION,
    "feature_view": "native",
    "cross_dataset_ready": False,
    "default_target": "binary",
    "split_ratio": "70/15/15",
    "integrity": {
        "shared_vectors": "stay in the first of train, val and test that has them",
        "contradicting_vectors": "left out with all their rows",
    },
}


def build_metadata(
    df: DataFrame,
    dataset: str,
    features: list[str],
    targets: tuple[str, str, str],
    scaler: dict,
    binary_mapping: dict[str, str],
    categorical: list[str] = (),
    dropped: list[str] = (),
    encoding: str | None = None,
    extra: dict | None = None,
) -> dict:
    """Self-describing record of prepared rows (``df`` has a ``split`` column): what never changes, what the caller
    knows, and what is counted here. A field that the schema does not have is an error."""
    names = dict(zip(("target_binary", "target_multiclass", "target_family"), targets))
    told = {"dataset": dataset, "scaler": scaler, "binary_mapping": binary_mapping, "encoding_method": encoding, **names}
    lists = {"feature_columns": features, "categorical_columns": categorical, "dropped_columns": dropped}
    by_split = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    counted = {
        "feature_count": len(features),
        "split_rows": {s: by_split.get(s, 0) for s in SPLITS},
        "n_rows_after_cleaning": sum(by_split.get(s, 0) for s in SPLITS),
        "multiclass_classes": class_union(df, names["target_multiclass"]),
        "family_classes": class_union(df, names["target_family"]),
    }
    meta = CONSTANT_FIELDS | told | {n: list(v) for n, v in lists.items()} | counted | (extra or {})
    unknown = set(meta) - set(METADATA_SCHEMA.names)
    if unknown:
        raise ValueError(f"no such metadata fields: {sorted(unknown)}")
    return meta


def metadata_frame(spark: SparkSession, meta: dict) -> DataFrame:
    row = [meta.get(f.name) for f in METADATA_SCHEMA.fields]
    return spark.createDataFrame([row], METADATA_SCHEMA)


def write_metadata(spark: SparkSession, meta: dict, base: str) -> None:
    metadata_frame(spark, meta).coalesce(1).write.mode("overwrite").json(f"{base}/metadata")


def read_metadata(spark: SparkSession, base: str) -> dict:
    """The metadata record; keys the file does not have are absent."""
    row = spark.read.schema(METADATA_SCHEMA).json(f"{base}/metadata").first()
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


def write_rows(df: DataFrame, base: str) -> DataFrame:
    """Write the splits; an older record goes first so that it cannot vouch for the new rows."""
    spark = df.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/metadata")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    df.write.mode("overwrite").partitionBy("split").parquet(f"{base}/data")
    return read_rows(spark, base)


def write_categories(codes: DataFrame, columns: list[str], base: str) -> None:
    """The dictionary of encoded columns as a table (column, value, code), however many values it has."""
    named = F.get(F.array(*[F.lit(n) for n in columns]), F.col("i"))
    codes.select(named.alias("column"), F.col("v").alias("value"), "code").write.mode("overwrite").parquet(f"{base}/categories")


def read_categories(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/categories")


def read_rows(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/data")


# ---- checks ------------------------------------------------------------------------------------

Check = tuple[str, bool, str]


def metadata_checks(meta: dict) -> list[Check]:
    missing = sorted(set(REQUIRED_KEYS) - set(meta))
    unknown = sorted(set(meta.get("family_classes", [])) - set(FAMILIES))
    return [
        ("metadata_keys", not missing, f"missing keys: {missing}"),
        ("artifact_schema", meta.get("artifact_schema") == ARTIFACT_SCHEMA, str(meta.get("artifact_schema"))),
        (
            "preprocess_version",
            meta.get("preprocess_version") == PREPROCESS_VERSION,
            str(meta.get("preprocess_version")),
        ),
        ("family_classes", not unknown, f"unknown families: {unknown}"),
    ]


def split_health(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Per split: rows, rows with a missing or infinite feature, and NULLs per target. One pass."""
    kinds = dict(df.dtypes)
    floats = [n for n in features if kinds[n] in ("double", "float")]

    def any_of(tests: list) -> F.Column:
        return F.exists(F.array(*tests), lambda t: t) if tests else F.lit(False)

    gap = any_of([c(n).isNull() for n in features] + [F.isnan(c(n)) for n in floats])
    inf = any_of([F.coalesce(F.abs(c(n)) == float("inf"), F.lit(False)) for n in floats])
    return df.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum(F.coalesce(gap, F.lit(False)).cast("bigint")).alias("missing"),
        F.sum(inf.cast("bigint")).alias("infinite"),
        *[F.sum(c(t).isNull().cast("bigint")).alias(f"null_{i}") for i, t in enumerate(targets)],
    )


def artifact_checks(
    df: DataFrame, meta: dict, split_columns: dict[str, list[str]] | None = None
) -> list[Check]:
    """All checks of written splits against their metadata, failed or not."""
    checks = metadata_checks(meta)
    features = meta.get("feature_columns", [])
    targets = [meta[k] for k in ("target_binary", "target_multiclass", "target_family") if k in meta]
    absent = [n for n in [*features, *targets] if n not in df.columns]
    checks.append(("columns_present", not absent, f"missing columns: {absent}"))
    mixed = sorted(set(features) & set(targets))
    checks.append(("targets_not_features", not mixed, f"targets among features: {mixed}"))
    for split, columns in (split_columns or {}).items():
        same = columns == split_columns["train"]
        checks.append((f"{split}:same_columns", same, "columns differ from train"))
    if absent or "metadata_keys" in {name for name, ok, _ in checks if not ok}:
        return checks
    health = {r["split"]: r for r in split_health(df, features, targets).collect()}
    for split in SPLITS:
        row = health.get(split)
        rows = row["rows"] if row else 0
        expected = meta["split_rows"].get(split)
        checks.append((f"{split}:row_count", rows == expected, f"{rows} rows, expected {expected}"))
        missing, infinite = (row["missing"], row["infinite"]) if row else (0, 0)
        checks.append((f"{split}:no_missing", missing == 0, f"{missing} rows with a missing feature"))
        checks.append((f"{split}:finite", infinite == 0, f"{infinite} rows with an infinite feature"))
        for i, target in enumerate(targets):
            n = row[f"null_{i}"] if row else 0
            checks.append((f"{split}:target_{target}", n == 0, f"{n} NULL targets"))
    for pair, n in count_overlaps(df, features).first().asDict().items():
        checks.append((f"overlap:{pair}", n == 0, f"{n} shared feature vectors"))
    return checks


def check_table(spark: SparkSession, checks: list[Check]) -> DataFrame:
    return spark.createDataFrame(checks, "check string, ok boolean, detail string")


def split_columns(spark: SparkSession, base: str) -> dict[str, list[str]]:
    return {s: spark.read.parquet(f"{base}/data/split={s}").columns for s in SPLITS}


def validate_output(spark: SparkSession, base: str) -> DataFrame:
    """The full check table of a written artifact; raises with every failure at once."""
    meta = read_metadata(spark, base)
    checks = artifact_checks(read_rows(spark, base), meta, split_columns(spark, base))
    failed = [f"{name}: {detail}" for name, ok, detail in checks if not ok]
    if failed:
        raise ValueError(f"{len(failed)} artifact checks failed: " + "; ".join(failed))
    return check_table(spark, checks)


def load_artifact(
    spark: SparkSession,
    base: str,
    rebuild: Callable[[], object] | None = None,
    force: bool = False,
    validate: bool = True,
) -> tuple[DataFrame, dict]:
    """Rows and metadata. A missing or stale artifact is rebuilt first if a builder is given."""
    if force or not is_ready(spark, base):
        if rebuild is None:
            raise ValueError(f"no current artifact at {base}")
        rebuild()
    meta = read_metadata(spark, base)
    rows = read_rows(spark, base)
    checks = artifact_checks(rows, meta, split_columns(spark, base)) if validate else metadata_checks(meta)
    for name, ok, detail in checks:
        lenient = name.endswith(":finite") or name == "targets_not_features"
        if not ok and not lenient:
            raise ValueError(f"{name}: {detail}")
    return rows, meta


def is_ready(spark: SparkSession, base: str) -> bool:
    try:
        meta = read_metadata(spark, base)
        split_columns(spark, base)
    except (AnalysisException, AttributeError):  # no such path, or an empty record
        return False
    return all(ok for _, ok, _ in metadata_checks(meta))


def audit(spark: SparkSession, bases: list[str]) -> DataFrame:
    """One row per artifact with its shape, shared vectors and the checks it fails."""
    rows = []
    for base in bases:
        meta = read_metadata(spark, base)
        df = read_rows(spark, base)
        checks = artifact_checks(df, meta, split_columns(spark, base))
        shared = count_overlaps(df, meta["feature_columns"]).first()
        rows.append(
            (
                meta["dataset"],
                meta["preprocess_version"],
                meta["feature_count"],
                *[meta["split_rows"][s] for s in SPLITS],
                ",".join(meta["family_classes"]),
                *shared,
                sum(not ok for _, ok, _ in checks),
                not any(shared),
            )
        )
    return spark.createDataFrame(
        rows,
        "dataset string, preprocess_version bigint, feature_count bigint, train_rows bigint, "
        "val_rows bigint, test_rows bigint, family_classes string, train_val bigint, "
        "train_test bigint, val_test bigint, failed_checks bigint, clean boolean",
    )
