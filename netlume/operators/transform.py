"""Transformers that learn from the train split only and apply to every split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlume.functions.columns import c, drop_missing, sanitize_name
from netlume.operators.ordering import running_sums
from netlume.operators.selection import FEW, quantiles_of
from netlume.staging import stage


def in_train(split: str = "split") -> Column:
    return F.col(split) == "train"


def exact_medians(train: DataFrame, columns: list[str], few: int = FEW) -> dict[str, float]:
    """Exact median per column; a column without any value has none."""
    if not columns:
        return {}
    found = quantiles_of(train, [c(n) for n in columns], [0.5], few=few)
    return {columns[r["column"]]: r["quantile"] for r in found.collect()}  # one row per column


def median_impute(df: DataFrame, columns: list[str], medians: dict[str, float]) -> DataFrame:
    """Fill with the train medians; rows that still miss a value are dropped."""
    filled = {n: F.coalesce(c(n), F.lit(medians[n])) for n in columns if n in medians}
    return drop_missing(df.withColumns(filled), columns) if columns else df


def category_codes(train: DataFrame, columns: list[str]) -> DataFrame:
    """(i, v, code): the values of column number ``i`` in train in sorted order as 0..k-1.

    The distinct values of all columns are ranked in one job: sorted ranges, and an offset for each range.
    """
    entries = F.array(
        *[F.struct(F.lit(i).alias("i"), c(n).cast("string").alias("v")) for i, n in enumerate(columns)]
    )
    pairs = train.select(F.explode(entries).alias("e")).select("e.i", "e.v").distinct()
    ranked = running_sums(pairs, "v", {"one": F.lit(1)}, ["i"])
    return stage(ranked.select("i", "v", (F.col("cum_one") - 1).cast("int").alias("code")), "category-codes")


def join_codes(df: DataFrame, columns: list[str], codes: DataFrame, prefix: str) -> DataFrame:
    """Add ``<prefix><i>``, the code of each column's value; NULL for a value that train does not have. Catalyst
    broadcasts a dictionary that is small and shuffles by the value otherwise."""
    for i, name in enumerate(columns):
        own = codes.where(F.col("i") == i).select(F.col("v").alias("_v"), F.col("code").alias(f"{prefix}{i}"))
        df = df.join(own, c(name).cast("string") == F.col("_v"), "left").drop("_v")
    return df


@dataclass(frozen=True)
class OneHot:
    names: list[str]
    codes: DataFrame  # (i, v, code)

    @staticmethod
    def fit(train: DataFrame, columns: list[str]) -> "OneHot":
        return OneHot(list(columns), category_codes(train, columns))

    def sizes(self) -> list[int]:
        """Number of categories per column."""
        found = {r["i"]: r["n"] for r in self.codes.groupBy("i").agg(F.count("*").alias("n")).collect()}
        return [found.get(i, 0) for i in range(len(self.names))]

    def categories(self) -> dict[str, list[str]]:
        """Sorted train values per column. They are column names of the dense form; ``sparse`` does not need them."""
        rows = sorted(self.codes.collect(), key=lambda r: (r["i"], r["code"]))
        return {n: [r["v"] for r in rows if r["i"] == i] for i, n in enumerate(self.names)}

    def columns(self) -> list[str]:
        return [sanitize_name(f"{n}_{v}") for n, values in self.categories().items() for v in values]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each categorical column by its indicators, appended at the end, one column per category. A value
        that train does not have gives all zeros."""
        categories = self.categories()
        names = [sanitize_name(f"{n}_{v}") for n, values in categories.items() for v in values]
        if len(set(names)) < len(names):
            raise ValueError("two categories give the same column name after sanitising")
        keep = [c(n).alias(sanitize_name(n)) for n in df.columns if n not in categories]
        flags = [
            F.coalesce((c(n).cast("string") == v).cast("double"), F.lit(0.0))
            for n, values in categories.items()
            for v in values
        ]
        return df.select(*keep, *[f.alias(n) for f, n in zip(flags, names)])

    def sparse(self, df: DataFrame, out: str) -> DataFrame:
        """Replace the categorical columns by one sparse vector: the indicators of the first column in code order, then
        those of the second, and so on. The number of categories is bounded by the vector's 32-bit index only."""
        sizes = self.sizes()
        coded = join_codes(df, self.names, self.codes, "_code")
        codes = [f"_code{i}" for i in range(len(sizes))]
        flags = [f"_flag{i}" for i in range(len(sizes))]
        # the code after the last stands for a value that train does not have; the encoder drops it
        known = coded.withColumns({n: F.coalesce(F.col(n), F.lit(k)).cast("double") for n, k in zip(codes, sizes)})
        last = df.sparkSession.createDataFrame([[float(k) for k in sizes]], codes)
        encoder = OneHotEncoder(inputCols=codes, outputCols=flags, dropLast=True, handleInvalid="error").fit(last)
        encoded = encoder.transform(known)
        made = VectorAssembler(inputCols=flags, outputCol=out).transform(encoded)
        return made.drop(*codes, *flags, *self.names)


LISTED_CODES = 100_000  # values a metadata record may list; the dictionary itself is a table


@dataclass(frozen=True)
class LabelCodes:
    names: list[str]
    codes: DataFrame  # (i, v, code)

    @staticmethod
    def fit(train: DataFrame, columns: list[str]) -> "LabelCodes":
        return LabelCodes(list(columns), category_codes(train, columns))

    def encoders(self) -> dict[str, list[str]] | None:
        """The values of every column in code order, for the metadata record; None if they are too many to list."""
        rows = self.codes.limit(LISTED_CODES + 1).collect()
        if len(rows) > LISTED_CODES:
            return None
        rows = sorted(rows, key=lambda r: (r["i"], r["code"]))
        return {n: [r["v"] for r in rows if r["i"] == i] for i, n in enumerate(self.names)}

    def transform(self, df: DataFrame) -> DataFrame:
        """Sorted train values become 0..k-1; values that train does not have become -1."""
        coded = join_codes(df, self.names, self.codes, "_code")
        new = {n: F.coalesce(F.col(f"_code{i}"), F.lit(-1)).alias(n) for i, n in enumerate(self.names)}
        return coded.select(*[new.get(n, c(n)) for n in df.columns])


def index_target(train: DataFrame, target: str, out: str = "label_index") -> StringIndexerModel:
    """Classes in sorted order as 0..k-1, as classifiers want them."""
    return StringIndexer(inputCol=target, outputCol=out, stringOrderType="alphabetAsc").fit(train)


def index_to_target(labels: list[str], index: str, out: str) -> IndexToString:
    return IndexToString(inputCol=index, outputCol=out, labels=labels)


@dataclass(frozen=True)
class Scaler:
    columns: list[str]
    mean: list[float]
    scale: list[float]

    @staticmethod
    def fit(train: DataFrame, columns: list[str]) -> "Scaler":
        """Mean and population deviation in one aggregate; a constant column gets scale 1."""
        aggs = []
        for i, n in enumerate(columns):
            x = c(n).cast("double")
            aggs += [
                F.avg(x).alias(f"m{i}"),
                F.stddev_pop(x).alias(f"s{i}"),
                (F.min(x) == F.max(x)).alias(f"k{i}"),
            ]
        row = train.agg(*aggs).first()
        mean = [row[f"m{i}"] for i in range(len(columns))]
        scale = [
            1.0 if row[f"k{i}"] or not row[f"s{i}"] else row[f"s{i}"] for i in range(len(columns))
        ]
        return Scaler(list(columns), mean, scale)

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {
            n: ((c(n).cast("double") - m) / s).alias(n)
            for n, m, s in zip(self.columns, self.mean, self.scale)
        }
        return df.select(*[scaled.get(n, c(n)) for n in df.columns])
