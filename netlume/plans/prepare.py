"""Raw table to prepared splits: one job per dataset kind, with one shared end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlume.functions import columns as C
from netlume.functions.columns import c
from netlume.operators.leakage import dedup_and_drop_conflicts, drop_conflicts, remove_overlaps
from netlume.operators.sampling import sample_by_quota, sample_by_rate, stratified_split
from netlume.operators.transform import (
    LabelCodes,
    OneHot,
    Scaler,
    exact_medians,
    in_train,
    median_impute,
)
from netlume.plans.specs import DatasetSpec
from netlume.sources import artifact
from netlume.sources.csv import FILE_COLUMN, list_files, scan_csv, scan_devices
from netlume.staging import stage


@dataclass(frozen=True)
class Cleaned:
    rows: DataFrame  # features, targets and the row hash _h
    numeric: list[str]
    categorical: list[str]
    unique: bool  # no feature vector occurs twice


def numeric_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose every present value is a number; one aggregate over all of them."""
    if not columns:
        return []
    kinds = dict(df.dtypes)
    texts = [n for n in columns if kinds[n] == "string"]
    tests = [
        (F.count(c(n)) == F.count(C.to_number(c(n)))).alias(str(i)) for i, n in enumerate(texts)
    ]
    row = df.agg(*tests).first() if texts else ()
    good = {n for n, ok in zip(texts, row) if ok}
    return [n for n in columns if kinds[n] != "string" or n in good]


def _hashed(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    return df.withColumn("_h", C.row_hash(df, spec.row_key))


def clean_flow(raw: DataFrame, spec: DatasetSpec) -> Cleaned:
    """Duplicates and missing values count over all raw columns, before the features are chosen.

    The targets depend on the label alone, so they are derived after the duplicates are gone. A label
    that the taxonomy does not know fails the job, whether its rows are complete or not.
    """
    labels = raw.select(c(spec.label)).distinct()
    labels.select(spec.taxonomy.family(c(spec.label)).alias("family")).collect()  # one row per label; unknown ones raise
    features = [n for n in spec.features if n in raw.columns]
    df = raw.withColumns({n: C.finite_number(c(n)) for n in features})
    extra = [n for n, kind in df.dtypes if kind in ("double", "float") and n not in features]
    df = df.withColumns({n: C.finite_or_null(c(n)) for n in extra})
    complete = C.drop_missing(df, [n for n in df.columns if n != spec.label])

    def targets(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                spec.target_binary: C.is_attack(c(spec.label), spec.benign),
                spec.target_multi: c(spec.label),
                spec.target_family: spec.taxonomy.family(c(spec.label)),
            }
        )

    keep = [*features, *spec.targets]
    if set(raw.columns) == {*features, spec.label}:
        rows = targets(dedup_and_drop_conflicts(complete, features, [spec.label]))
        return Cleaned(_hashed(rows, spec).select(*[c(n) for n in keep], "_h"), features, [], True)
    rows = targets(_hashed(complete.distinct(), spec)).select(*[c(n) for n in keep], "_h")
    return Cleaned(drop_conflicts(stage(rows, "flow-rows"), features, spec.targets), features, [], False)


def clean_edge(raw: DataFrame, spec: DatasetSpec) -> Cleaned:
    df = raw.drop(*spec.drop).withColumn(spec.target_family, spec.taxonomy.family(c(spec.label)))
    categorical = [n for n in spec.categorical if n in df.columns]
    numeric = [n for n in df.columns if n not in spec.targets and n not in categorical]
    typed = {n: C.finite_number(c(n)) for n in numeric}
    typed |= {n: C.canonical_category(c(n)) for n in categorical}
    typed[spec.target_binary] = C.binary_from_text(c(spec.target_binary))
    df = C.drop_missing(df.withColumns(typed))
    features = [n for n in df.columns if n not in spec.targets]
    rows = dedup_and_drop_conflicts(df, features, spec.targets)
    return Cleaned(_hashed(rows, spec), numeric, categorical, True)


def clean_telemetry(raw: DataFrame, spec: DatasetSpec) -> Cleaned:
    """Missing numbers are kept: they are imputed after the split, from the train medians."""
    df = raw.withColumns(
        {
            spec.target_binary: C.binary_from_text(c("label")),
            spec.target_multi: C.normal_label(c(spec.label)),
        }
    ).withColumn(spec.target_family, spec.taxonomy.family(c(spec.target_multi)))
    texts = [n for n, kind in df.dtypes if kind == "string" and n not in spec.targets]
    df = df.withColumns({n: C.text_or_null(c(n)) for n in texts})
    moment = C.event_time(c("date"), c("time"))
    df = df.withColumns(C.time_parts(moment)).drop(*spec.drop)
    features = [n for n in df.columns if n not in spec.targets]
    numeric = numeric_columns(df, features)
    categorical = [n for n in features if n not in numeric]
    typed = {n: C.finite_number(c(n)) for n in numeric}
    typed |= {n: C.fill_category(c(n)) for n in categorical}
    rows = dedup_and_drop_conflicts(df.withColumns(typed), features, spec.targets)
    return Cleaned(_hashed(rows, spec), numeric, categorical, True)


CLEAN = {"flow": clean_flow, "edge": clean_edge, "telemetry": clean_telemetry}


def prepare(raw: DataFrame, spec: DatasetSpec, extra: dict | None = None) -> tuple[DataFrame, dict]:
    """Clean, de-conflict, split 70/15/15, remove leaks, encode and scale.

    Returns the rows with a ``split`` column and what the metadata needs to know. Three tables are
    staged on the way, each the input of several narrow fitting passes.
    """
    cleaned = CLEAN[spec.kind](raw, spec)
    numeric, categorical = cleaned.numeric, cleaned.categorical
    features = [n for n in cleaned.rows.columns if n not in spec.targets and n != "_h"]
    clean = stage(cleaned.rows, "clean")
    df = stratified_split(clean, spec.target_binary, "_h").drop("_h")
    unique = cleaned.unique
    if spec.kind == "telemetry":
        medians = exact_medians(df.where(in_train()), numeric)
        df, unique = median_impute(df, numeric, medians), False
    if not unique:  # distinct vectors cannot be shared by two splits
        df = remove_overlaps(df, features)
    df = stage(df, "split", partition_by="split")

    train = df.where(in_train())
    details: dict = {}
    categories: DataFrame | None = None
    if categorical and spec.encoding == "onehot":
        onehot = OneHot.fit(train, categorical)
        df, details["onehot_columns"] = onehot.transform(df), onehot.columns()
    elif categorical:
        codes = LabelCodes.fit(train, categorical)
        df, details["categorical_encoders"] = codes.transform(df), codes.encoders()
        categories = codes.codes
    features = [n for n in df.columns if n not in spec.targets and n != "split"]
    scaler = Scaler.fit(df.where(in_train()), features)
    df = remove_overlaps(scaler.transform(df), features)
    facts = {
        "features": features,
        "categorical": categorical,
        "dropped": [n for n in spec.drop],
        "encoding": spec.encoding if categorical else None,
        "scaler": {"mean": scaler.mean, "scale": scaler.scale, "columns": features},
        "categories": categories,
        "extra": {**details, **(extra or {})},
    }
    return df, facts


def write_prepared(df: DataFrame, facts: dict, spec: DatasetSpec, base: str) -> dict:
    """Write rows, then metadata counted from the written rows, then validate both."""
    spark = df.sparkSession
    written = artifact.write_rows(df, base)
    if facts["categories"] is not None:
        artifact.write_categories(facts["categories"], facts["categorical"], base)
    meta = artifact.build_metadata(
        written,
        spec.dataset,
        facts["features"],
        (spec.target_binary, spec.target_multi, spec.target_family),
        facts["scaler"],
        {"0": spec.benign, "1": "Attack"},
        facts["categorical"],
        facts["dropped"],
        facts["encoding"],
        facts["extra"],
    )
    artifact.write_metadata(spark, meta, base)
    artifact.validate_output(spark, base)
    return meta


def sample_raw(raw: DataFrame, spec: DatasetSpec, group: str | None) -> DataFrame:
    """Telemetry takes an exact quota per label, the others a rate per input file and label."""
    if spec.sample_n is None:
        return raw
    if spec.kind == "telemetry":
        trimmed = raw.withColumn(spec.label, F.trim(c(spec.label)))
        return sample_by_quota(trimmed, spec.label, spec.sample_n)
    return sample_by_rate(raw, spec.label, spec.sample_n, group)


def prepare_files(spark: SparkSession, spec: DatasetSpec, path: str, base: str) -> dict:
    """CSV files of a dataset to a validated artifact."""
    if spec.kind == "telemetry":
        source = raw = sample_raw(scan_devices(spark, path), spec, None)
    else:
        source = scan_csv(spark, path, spec.drop, with_file=True)
        raw = sample_raw(source, spec, FILE_COLUMN).drop(FILE_COLUMN)
    full = spec.sample_n is None
    extra = {
        "source": path,
        "sampling_mode": "full" if full else f"label_aware_{spec.kind}",
        "sample_target": "all" if full else str(spec.sample_n),
        "source_files": [found.rsplit("/", 1)[-1] for found in list_files(spark, path)],
    }
    if spec.kind != "flow":
        extra["n_rows_before_cleaning"] = source.count()
    df, facts = prepare(raw, spec, extra)
    return write_prepared(df, facts, spec, base)
