"""The table every detector works on, and what a detector has to offer.

Columns: ``x`` array<double> (features in metadata order), ``y`` 0/1, ``attack`` text, ``_h`` seeded
row hash. A fitted model is a function from such a table to the table with ``score`` (higher means
more likely an attack) or ``pred_class`` added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.functions.columns import c, row_hash
from netlume.operators.metrics import PERCENTILE_GRID, THRESHOLD_GRID
from netlume.operators.sampling import SEED
from netlume.sources.csv import union_by_name

Fitted = Callable[[DataFrame], DataFrame]


@dataclass
class Detector:
    """Fixed parameters plus the rules that the evaluation protocol needs."""

    name: str = ""
    anomaly: bool = False  # fitted on benign rows only, no multiclass part
    calibrated: bool = True  # threshold chosen on the validation split
    fold_rule: str = "half"  # out-of-fold label: "half" 0.5, "zero" offset, "p90" of the own fold
    strategy_type: str = "supervised"

    @property
    def grid(self) -> list[float] | None:
        return None if self.anomaly else THRESHOLD_GRID

    @property
    def percentiles(self) -> list[float]:
        return PERCENTILE_GRID

    def params(self) -> dict:
        """The fixed parameters, as they appear in the results."""
        rules = {f.name for f in fields(Detector)}
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in rules}

    def fit(self, train: DataFrame) -> Fitted:
        raise NotImplementedError

    def fit_folds(self, train: DataFrame, folds: int) -> Fitted:
        """Scores every row by the model that was fitted without its ``fold``. Detectors whose folds can share their
        passes over the rows do so."""
        models = [self.fit(train.where(F.col("fold") != i)) for i in range(folds)]
        return lambda df: union_by_name([m(df.where(F.col("fold") == i)) for i, m in enumerate(models)])

    def fit_classes(self, train: DataFrame, classes: list[str]) -> Fitted:
        raise NotImplementedError


def matrix(
    df: DataFrame, features: list[str], target: str, attack: str, keys: list[str] | None = None
) -> DataFrame:
    """Feature columns packed into one array; other columns of ``df`` are kept out."""
    carried = [n for n in ("split", "fold") if n in df.columns]
    return df.select(
        *carried,
        row_hash(df, keys, SEED).alias("_h"),
        F.array(*[c(n).cast("double") for n in features]).alias("x"),
        c(target).cast("int").alias("y"),
        c(attack).cast("string").alias("attack"),
    )


def with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x"))


def rows_to_numpy(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a 2-D array, without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def score_in_arrow(df: DataFrame, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Append ``score`` computed from ``x`` batch by batch on the executors."""

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                values = score(rows_to_numpy(batch.column("x"))).astype(np.float64)
                yield batch.append_column("score", pa.array(values))

    return df.mapInArrow(work, add_field(df, "score", "double"))


def classify_in_arrow(
    df: DataFrame, scores: Callable[[np.ndarray], np.ndarray], classes: list[str]
) -> DataFrame:
    """Append ``pred_class``, the class with the highest of the k scores."""

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                best = scores(rows_to_numpy(batch.column("x"))).argmax(axis=1)
                yield batch.append_column("pred_class", pa.array([classes[i] for i in best], pa.string()))

    return df.mapInArrow(work, add_field(df, "pred_class", "string"))


def add_field(df: DataFrame, name: str, kind: str):
    from pyspark.sql.types import StructType

    return StructType(list(df.schema.fields)).add(name, kind)


def class_index(df: DataFrame, classes: list[str], out: str) -> DataFrame:
    """Position of ``attack`` in the sorted class list, as double."""
    listed = F.array(*[F.lit(v) for v in classes])
    return df.withColumn(out, (F.array_position(listed, F.col("attack")) - 1).cast("double"))


def index_class(df: DataFrame, index: str, classes: list[str]) -> DataFrame:
    listed = F.array(*[F.lit(v) for v in classes])
    return df.withColumn("pred_class", F.element_at(listed, F.col(index).cast("int") + 1))
