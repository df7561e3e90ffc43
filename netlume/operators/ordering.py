"""Exact order statistics over tables of any size.

Nothing here sorts the wide table. Values are first counted per distinct value (copies collapse
before the shuffle), then cumulated in two levels: inside sorted ranges, and over the table of ranges.
No window ever spans a whole stratum of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from netlume.staging import stage

LAST = "~"  # sorts after every hash
HASH_PREFIX = 4  # hex digits: 65,536 buckets per stratum
COPIES_PER_CHUNK = 10_000


def prefix_counts(df: DataFrame, strata: list[str], hash_col: str, prefix: int = HASH_PREFIX) -> DataFrame:
    """(strata..., _prefix, _n): an exact histogram of the hashes, small whatever the size of the table."""
    rows = df.select(*strata, F.substring(hash_col, 1, prefix).alias("_prefix"))
    return stage(rows.groupBy(*strata, "_prefix").agg(F.count("*").alias("_n")), "prefix-counts")


def rank_cuts(
    df: DataFrame,
    strata: list[str],
    hash_col: str,
    cuts: DataFrame,
    prefix: int = HASH_PREFIX,
    prefixes: DataFrame | None = None,
) -> DataFrame:
    """Hash value of the row at each wanted rank of each stratum.

    ``cuts`` has (strata..., cut, rank); the result adds ``cut_hash``, ``below`` (rows with a smaller
    hash) and ``ties`` (rows with this very hash). Two scans of (strata, hash): one counts hash
    prefixes (unless given), one counts full hashes inside the few prefixes that hold a wanted rank.
    """
    rows = df.select(*strata, hash_col, F.substring(hash_col, 1, prefix).alias("_prefix"))
    upto = Window.partitionBy(*strata).rowsBetween(Window.unboundedPreceding, 0)
    counts = prefixes if prefixes is not None else prefix_counts(df, strata, hash_col, prefix)
    counted = counts.withColumn("_upto", F.sum("_n").over(upto.orderBy("_prefix")))
    wanted = stage(
        counted.join(cuts, strata)
        .where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
        .select(*strata, "_prefix", "cut", "rank", (F.col("_upto") - F.col("_n")).alias("_before")),
        "wanted-ranks",
    )
    inside = Window.partitionBy(*strata, "cut").orderBy(hash_col)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    found = (
        rows.join(wanted, [*strata, "_prefix"])
        .groupBy(*strata, "cut", "rank", "_before", hash_col)
        .agg(F.count("*").alias("ties"))
        .withColumn("_upto", F.col("_before") + F.sum("ties").over(inside))
        .withColumn("below", F.col("_upto") - F.col("ties"))
        .where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("below")))
        .select(*strata, "cut", "rank", F.col(hash_col).alias("cut_hash"), "below", "ties")
    )
    return stage(found, "rank-cuts")


def whole_row_hash(df: DataFrame) -> Column:
    """128 bits over all columns, as text that sorts; NULLs in different columns stay apart."""
    parts = [F.struct(F.col(f"`{n}`").isNull(), F.col(f"`{n}`")) for n in df.columns]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (3, 4)])


def copies_of(groups: DataFrame, columns: list[str], count: str) -> DataFrame:
    """Every row of ``groups`` repeated ``count`` times, spread over tasks in chunks."""
    chunks = F.expr(f"sequence(0, int(({count} - 1) div {COPIES_PER_CHUNK}))")
    chunked = groups.where(F.col(count) > 0).withColumn("_chunk", F.explode(chunks))
    left = chunked.withColumn("_left", F.col(count) - F.col("_chunk") * COPIES_PER_CHUNK).repartition("_chunk")
    rows = left.withColumn("_copy_no", F.explode(F.expr(f"sequence(1, int(least({COPIES_PER_CHUNK}, _left)))")))
    return rows.select(*[F.col(f"`{n}`") for n in columns])


def cut_pieces(
    df: DataFrame, strata: list[str], hash_col: str, ranks: list[Column], out: str
) -> DataFrame:
    """Number the pieces into which ``ranks`` cut each stratum in hash order: 0, 1, ... len(ranks).

    ``ranks`` are expressions over ``n``, the size of the stratum; a NULL stratum is cut like any other.
    The wide rows are not shuffled: each compares its hash with the cut values of its stratum. Where rows
    share the hash at a cut, a second hash over the whole row orders them; rows that are equal in every
    column are counted, and as many as belong there are put on either side.
    """
    keyed = df.withColumn("_stratum", F.struct(*strata))  # structs compare equal on NULL
    prefixes = prefix_counts(keyed, ["_stratum"], hash_col)
    totals = prefixes.groupBy("_stratum").agg(F.sum("_n").alias("n"))
    cuts = totals.select(
        "_stratum", F.posexplode(F.array(*[r.cast("bigint") for r in ranks])).alias("cut", "rank")
    )
    found = rank_cuts(keyed, ["_stratum"], hash_col, cuts, prefixes=prefixes)
    split = found.where(F.col("rank") < F.col("below") + F.col("ties"))
    found = found.withColumn("copy_cut", F.lit(LAST))
    edges = None
    if split.isEmpty():
        keyed = keyed.withColumn("_copy", F.lit(""))
    else:
        keyed = keyed.withColumn("_copy", whole_row_hash(df))
        at = keyed.join(split.select("_stratum", "cut", "cut_hash"), "_stratum")
        copies = at.where(F.col(hash_col) == F.col("cut_hash")).select("_stratum", F.col("cut").alias("_at"), "_copy")
        need = split.select(
            "_stratum", F.col("cut").alias("_at"), F.lit(0).alias("cut"), (F.col("rank") - F.col("below")).alias("rank")
        )
        inner = rank_cuts(copies, ["_stratum", "_at"], "_copy", need).select(
            "_stratum",
            F.col("_at").alias("cut"),
            F.col("cut_hash").alias("_inner"),
            (F.col("rank") - F.col("below")).alias("_need"),
            F.col("ties").alias("_ties"),
        )
        found = found.join(inner, ["_stratum", "cut"], "left").withColumn("copy_cut", F.coalesce("_inner", "copy_cut"))
        equal = found.where(F.col("_need") < F.col("_ties"))
        needs = F.array_sort(F.collect_list("_need")).alias("_needs")
        edges = stage(equal.groupBy("_stratum", "cut_hash", "copy_cut").agg(needs), "equal-rows")
    # a rank of 0 matches no row: the empty text sorts before every hash
    none = F.struct(F.lit("").alias("cut_hash"), F.lit(LAST).alias("copy_cut"))
    at_cut = [
        F.coalesce(F.max(F.when(F.col("cut") == i, F.struct("cut_hash", "copy_cut"))), none).alias(f"_cut{i}")
        for i in range(len(ranks))
    ]
    limits = stage(found.groupBy("_stratum").agg(*at_cut), "stratum-cuts")
    place = F.struct(F.col(hash_col).alias("cut_hash"), F.col("_copy").alias("copy_cut"))

    def numbered(rows: DataFrame) -> DataFrame:
        piece = F.lit(0)
        for i in range(len(ranks)):
            piece = piece + F.coalesce((place > F.col(f"_cut{i}")).cast("int"), F.lit(1))
        return rows.join(limits, "_stratum", "left").withColumn(out, piece)

    columns = [*df.columns, out]
    if edges is None or edges.isEmpty():
        return numbered(keyed).select(*[F.col(f"`{n}`") for n in columns])
    same = [
        keyed["_stratum"] == edges["_stratum"],
        keyed[hash_col] == edges["cut_hash"],
        keyed["_copy"] == edges["copy_cut"],
    ]
    plain = numbered(keyed.join(edges, same, "left_anti")).select(*[F.col(f"`{n}`") for n in columns])
    equal = keyed.join(edges.withColumnRenamed("_stratum", "_edge_stratum"), [
        F.col("_stratum") == F.col("_edge_stratum"),
        F.col(hash_col) == F.col("cut_hash"),
        F.col("_copy") == F.col("copy_cut"),
    ]).drop("_edge_stratum", "cut_hash", "copy_cut")
    counted = numbered(equal.groupBy(*[F.col(f"`{n}`") for n in equal.columns]).agg(F.count("*").alias("_size")))
    # equal rows 1.._size: a cut that needs k of them has the first k before it
    bounds = F.concat(F.array(F.lit(0).cast("bigint")), F.col("_needs"), F.array("_size"))
    sizes = F.transform(
        F.sequence(F.lit(0), F.size("_needs")),
        lambda i: F.struct(i.alias("_step"), (F.get(bounds, i + 1) - F.get(bounds, i)).alias("_n")),
    )
    dealt = counted.select(*[F.col(f"`{n}`") for n in columns], F.inline(sizes))
    dealt = dealt.withColumn(out, F.col(out) + F.col("_step"))
    return plain.unionByName(copies_of(dealt, columns, "_n"))


def running_sums(
    df: DataFrame,
    value: str,
    sums: dict[str, Column],
    by: list[str],
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Per distinct value: each sum, and its running total ``cum_<name>`` in value order.

    A prefix scan over sorted ranges: the distinct values are dealt out by (by..., value), every task adds up its own
    range, and the small table of the sums of all ranges gives each range its offset. ``ranges`` fixes their number;
    without it Spark chooses one by size.
    """
    keys, names = [f"_k{i}" for i in range(len(by))], list(sums)
    grouped = stage(
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[F.sum(col).cast("bigint").alias(name) for name, col in sums.items()]),
        "distinct-values",
    )
    order = [*[F.col(n) for n in by], F.col(value).desc() if descending else F.col(value).asc()]
    ranged = grouped.repartitionByRange(ranges, *order) if ranges else grouped.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def scan(batches):
        last, carry = None, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for name in by:
                codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = last != [batch.column(name)[0].as_py() for name in by]
            last = [batch.column(name)[-1].as_py() for name in by]
            starts, group = np.flatnonzero(new), np.cumsum(new)
            for name in names:
                total = np.cumsum(batch.column(name).to_numpy(zero_copy_only=False))
                # rows before the first start go on with the group of the batch before
                base = np.append(-carry[name], np.where(starts > 0, total[starts - 1], 0))
                total = total - base[group]
                carry[name] = int(total[-1])
                batch = batch.append_column(f"cum_{name}", pa.array(total, pa.int64()))
            yield batch

    schema = StructType(list(placed.schema.fields))
    for name in sums:
        schema = schema.add(f"cum_{name}", LongType())
    scanned = stage(placed.mapInArrow(scan, schema), "range-sums")
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    per_range = scanned.groupBy(*[F.col(n).alias(k) for n, k in zip(by, keys)], F.col("_part").alias("_at"))
    offsets = per_range.agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums]).select(
        *keys, "_at", *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums]
    )
    same = [F.col(n).eqNullSafe(F.col(k)) for n, k in zip(by, keys)]
    joined = scanned.join(stage(offsets, "range-offsets"), [F.col("_part") == F.col("_at"), *same])
    out = joined.withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"_off_{s}") for s in sums})
    return out.drop("_part", "_at", *keys, *[f"_off_{s}" for s in sums])
