"""Label-aware sampling and splitting. Membership follows the order of a seeded row hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlume.functions.columns import c, row_hash
from netlume.operators.ordering import copies_of, cut_pieces, rank_cuts
from netlume.staging import stage

SEED = 42
SPLITS = ["train", "val", "test"]
TEST_PERCENT = 15
VAL_PERCENT = 15
CV_FOLDS = 5


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    return df.where(c(label).isNotNull()).groupBy(c(label).alias("label")).agg(F.count("*").alias("n"))


def quota(sample_n: int, n: Column, total: Column) -> Column:
    """Rows a label gets of ``sample_n``: its share rounded down, at least one."""
    product = F.lit(sample_n).cast("decimal(19,0)") * n.cast("decimal(19,0)")  # may pass 2^63
    share = ((product - product % total) / total).cast("bigint")
    return F.greatest(F.lit(1), share).cast("bigint")


def proportional_rates(histogram: DataFrame, sample_n: int) -> DataFrame:
    """(label, n, rate) with rate = min(1, quota / n)."""
    total = histogram.agg(F.sum("n")).first()[0]
    rate = F.least(F.lit(1.0), quota(sample_n, F.col("n"), F.lit(total)) / F.col("n"))
    return histogram.withColumn("rate", rate)


def _take_in_hash_order(
    df: DataFrame, strata: list[str], quotas: DataFrame, keys: list[str] | None, seed: int
) -> DataFrame:
    """Keep exactly ``quota`` rows per stratum, the ones with the smallest seeded hash.

    Without ``keys`` the hash covers the whole row, so equal hashes are copies of one row. Copies at
    the cut are counted, not sorted, and the right number of them is put back.
    """
    hashed = df.withColumn("_h", row_hash(df, keys, seed))
    ranks = quotas.select(*strata, F.lit(0).alias("cut"), F.col("quota").alias("rank"))
    return _take_to_cut(hashed, strata, "_h", ranks, df.columns)


def _take_to_cut(
    hashed: DataFrame, strata: list[str], hash_col: str, ranks: DataFrame, columns: list[str]
) -> DataFrame:
    """Exactly ``rank`` rows per stratum, in hash order. Rows with one hash are copies of one row."""
    found = rank_cuts(hashed, strata, hash_col, ranks)
    found = found.withColumn("_need", F.col("rank") - F.col("below"))
    joined = hashed.join(found, strata)
    at_cut = F.col(hash_col) == F.col("cut_hash")
    whole = joined.where(
        (F.col(hash_col) < F.col("cut_hash")) | (at_cut & (F.col("ties") == F.col("_need")))
    ).select(*[c(n) for n in columns])
    if found.where(F.col("ties") > F.col("_need")).isEmpty():
        return whole
    groups = (
        joined.where(at_cut & (F.col("ties") > F.col("_need"))).groupBy(*[c(n) for n in columns], "_need").count()
    )
    copies = copies_of(groups, columns, "_need")
    return whole.unionByName(copies)


def sample_by_rate(
    df: DataFrame,
    label: str,
    sample_n: int,
    group: str | None = None,
    keys: list[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Label-aware sample of about ``sample_n`` rows.

    Rates come from the whole table. Each (group, label), a group being an input file, keeps
    ``max(1, floor(size * rate))`` rows; a rate of 1 keeps them all.
    """
    known = df.where(c(label).isNotNull())
    strata = [group, label] if group else [label]
    sizes = stage(known.groupBy(*[c(s) for s in strata]).agg(F.count("*").alias("n")), "label-sizes")
    per_label = sizes.groupBy(c(label)).agg(F.sum("n").alias("n"))
    rates = proportional_rates(per_label, sample_n).drop("n")
    kept = F.when(F.col("rate") >= 1.0, F.col("n")).otherwise(
        F.greatest(F.lit(1), F.floor(F.col("n") * F.col("rate")))
    )
    quotas = sizes.join(rates, label).withColumn("quota", kept.cast("bigint"))
    return _take_in_hash_order(known, strata, stage(quotas, "quotas"), keys, seed)


def sample_by_quota(
    df: DataFrame, label: str, sample_n: int, keys: list[str] | None = None, seed: int = SEED
) -> DataFrame:
    """Exactly ``max(1, floor(sample_n * share))`` rows per label, all of them if it has fewer.

    One rule for every size of table. Rows without a label are a stratum like any other.
    """
    keyed = df.withColumn("_stratum", F.struct(c(label).alias("v")))  # structs compare equal on NULL
    sizes = stage(keyed.groupBy("_stratum").agg(F.count("*").alias("n")), "label-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    take = F.least(F.col("n"), quota(sample_n, F.col("n"), F.lit(total)))
    quotas = stage(sizes.withColumn("quota", take), "quotas")
    return _take_in_hash_order(keyed, ["_stratum"], quotas, keys or df.columns, seed).drop("_stratum")


def stratified_split(
    df: DataFrame, target: str, hash_col: str, out: str = "split"
) -> DataFrame:
    """Exact 70/15/15 split per class of ``target``; val and test shares round half up."""
    test = F.expr(f"(n * {TEST_PERCENT} + 50) div 100")
    val = F.expr(f"(n * {VAL_PERCENT} + 50) div 100")
    pieces = cut_pieces(df, [target], hash_col, [F.col("n") - test - val, F.col("n") - test], "_piece")
    name = F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.col("_piece") + 1)
    return pieces.withColumn(out, name).drop("_piece")


def stratified_parts(df: DataFrame, target: str, hash_col: str, k: int, out: str) -> DataFrame:
    """Number k parts with equal class shares (sizes differ by at most one row per class)."""
    return cut_pieces(df, [target], hash_col, [F.expr(f"n * {i} div {k}") for i in range(1, k)], out)


def with_folds(df: DataFrame, target: str, hash_col: str, k: int = CV_FOLDS) -> DataFrame:
    return stratified_parts(df, target, hash_col, k, "fold")


def smallest_hashes(df: DataFrame, hash_col: str, k: int) -> DataFrame:
    """Exactly k rows with the smallest hash (all rows if there are fewer), found without collecting
    them in one task and however many copies of one row there are."""
    if df.count() <= k:
        return df
    keyed = df.withColumn("_all", F.lit(0))
    ranks = df.sparkSession.range(1).selectExpr("0 AS _all", "0 AS cut", f"cast({k} AS bigint) AS rank")
    return _take_to_cut(keyed, ["_all"], hash_col, ranks, df.columns)


def benign_subsample(df: DataFrame, target: str, hash_col: str, k: int = 30_000) -> DataFrame:
    return smallest_hashes(df.where(c(target) == 0), hash_col, k)
