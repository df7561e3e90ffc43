import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from netlume.functions.columns import row_hash
from netlume.operators import ordering
from netlume.operators import sampling as S
from netlume.operators.ordering import rank_cuts, running_sums
from netlume.operators.selection import exact_quantiles, quantiles_of


def test_rank_cuts_equal_window_ranks(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    rows = ev.withColumn("_h", row_hash(ev, ["event_id"])).select("event_type", "event_id", "_h")
    wanted = F.explode(F.array(F.lit(1).cast("bigint"), F.expr("n div 2"), F.col("n"))).alias("rank")
    cuts = rows.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", wanted)
    cuts = cuts.withColumn("cut", F.col("rank").cast("int"))
    w = Window.partitionBy("event_type").orderBy("_h")
    ranked = rows.withColumn("rank", F.row_number().over(w).cast("bigint"))
    expected = {(r.event_type, r["rank"]): r["_h"] for r in ranked.collect()}
    for prefix in (1, 4):
        found = rank_cuts(rows, ["event_type"], "_h", cuts, prefix).collect()
        assert len(found) == 15
        assert all(expected[(r.event_type, r["rank"])] == r.cut_hash for r in found)
        assert all(r.ties == 1 and r.below == r["rank"] - 1 for r in found)


def test_running_sums_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g) or None, float(v)) for g, v in zip(rng.integers(0, 3, 3000), np.round(rng.exponential(5, 3000), 2))]
    df = spark.createDataFrame(rows, "g int, v double")
    for down in (False, True):
        one, many, free = (
            {(r.g, r.v): (r.n, r.cum_n) for r in running_sums(df, "v", {"n": F.lit(1)}, ["g"], down, ranges).collect()}
            for ranges in (1, 9, None)
        )
        assert one == many == free
        for group in (None, 1, 2):
            values = sorted((v for g, v in rows if g == group), reverse=down)
            assert [c for (g, _), (_, c) in sorted(one.items(), key=lambda x: x[1][1]) if g == group] == [
                i + 1 for i, v in enumerate(values) if i + 1 == len(values) or values[i + 1] != v
            ]


def test_exact_quantiles_equal_numpy(spark):
    values = np.concatenate([np.random.default_rng(2).normal(size=999), np.full(500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.05, 0.333, 0.5, 0.9, 1.0]
    for few in (10**6, 50, 1):
        got = {r.prob: r.quantile for r in exact_quantiles(df, "v", probs, few=few).collect()}
        assert np.allclose([got[p] for p in probs], np.quantile(values, probs), atol=1e-12)


def test_quantiles_of_groups_and_columns_equal_numpy(spark):
    """Several columns and groups in one run, with hot values, NULLs, a group of one row and an empty column."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), float(np.round(rng.normal(), 3)), None if i % 3 else 7.0, None) for i in range(4000)]
    rows += [(9, 1.5, 2.5, None)] + [(0, 0.25, None, None)] * 3000
    df = spark.createDataFrame(rows, "g int, a double, b double, c double")
    probs = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]
    for few in (10**6, 20, 1):
        found = quantiles_of(df, [F.col("a"), F.col("b"), F.col("c")], probs, ["g"], few).collect()
        got = {(r.g, r.column, r.prob): r.quantile for r in found}
        assert len(got) == len(found) == 4 * 2 * len(probs)
        for g in (0, 1, 2, 9):
            for column in (0, 1):
                values = [r[1 + column] for r in rows if r[0] == g and r[1 + column] is not None]
                assert np.allclose([got[g, column, p] for p in probs], np.quantile(values, probs), atol=1e-12)
    assert quantiles_of(df.limit(0), [F.col("a")], probs).collect() == []


def test_sample_with_a_third_of_all_rows_identical(spark):
    rows = [("a", "same")] * 700 + [("a", f"r{i}") for i in range(900)] + [("b", "x")] * 20 + [(None, "n")]
    df = spark.createDataFrame(rows, "label string, v string")
    kept = {r.label: r["count"] for r in S.sample_by_quota(df, "label", 400).groupBy("label").count().collect()}
    assert kept == {"a": 400 * 1600 // 1621, "b": 400 * 20 // 1621, None: 1}
    hashed = df.where("label = 'b'")
    assert S.sample_by_quota(hashed, "label", 7).collect() == [("b", "x")] * 7
    rate = S.sample_by_rate(df, "label", 400).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in rate} == {"a": 400 * 1600 // 1620, "b": 400 * 20 // 1620}


def test_copies_at_the_cut_are_put_back_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COPIES_PER_CHUNK", 3)
    df = spark.createDataFrame([("a", "same")] * 50, "label string, v string")
    assert S.sample_by_quota(df, "label", 17).count() == 17


def test_split_and_parts(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 = 0 AS y").withColumn("y", F.col("y").cast("int"))
    hashed = df.withColumn("_h", row_hash(df, ["id"]))
    split = S.stratified_split(hashed, "y", "_h")
    counts = {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert counts == {(1, "train"): 234, (1, "val"): 50, (1, "test"): 50, (0, "train"): 466, (0, "val"): 100, (0, "test"): 100}
    parts = S.with_folds(hashed, "y", "_h").groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in parts) == 1000 and len(parts) == 10
    for y in (0, 1):
        sizes = [r["count"] for r in parts if r.y == y]
        assert max(sizes) - min(sizes) <= 1
    tiny = hashed.where("id in (0, 1)")
    assert {r.split for r in S.stratified_split(tiny, "y", "_h").collect()} == {"train"}
    assert S.smallest_hashes(hashed, "_h", 77).count() == 77
    assert S.smallest_hashes(hashed, "_h", 5000).count() == 1000
    best = [r["_h"] for r in S.smallest_hashes(hashed, "_h", 10).collect()]
    assert sorted(best) == sorted(r["_h"] for r in hashed.collect())[:10]


def test_smallest_hashes_are_exact_when_most_rows_are_copies(spark):
    df = spark.createDataFrame([("m", [1.0])] * 400 + [(f"{i:x}", [float(i)]) for i in range(16)], "_h string, x array<double>")
    kept = S.smallest_hashes(df, "_h", 100)
    assert kept.count() == 100 and kept.where("_h = 'm'").count() == 84


def test_rates(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 9 + [("c",)], "l string")
    rates = {r.label: r.rate for r in S.proportional_rates(S.label_histogram(df, "l"), 10).collect()}
    assert rates == {"a": 9 / 90, "b": 1 / 9, "c": 1.0}
    big = spark.createDataFrame([("a", 4 * 10**18), ("b", 4 * 10**18)], "label string, n bigint")
    assert {r.rate for r in S.proportional_rates(big, 2_000_000).collect()} == {1_000_000 / (4 * 10**18)}
