import numpy as np
from pyspark.sql import functions as F

from netlume.operators import leakage as L
from netlume.staging import stage
from netlume.operators.transform import LabelCodes, OneHot, Scaler, exact_medians, median_impute


def test_conflicts_are_null_safe(spark):
    rows = [(1.0, None, "a"), (1.0, None, "b"), (None, 1.0, "a"), (2.0, 2.0, "a"), (2.0, 2.0, "a"), (3.0, 3.0, "a"), (3.0, 3.0, None)]
    df = spark.createDataFrame(rows, "f double, g double, t string")
    kept = sorted(L.drop_conflicts(df, ["f", "g"], ["t"]).collect(), key=repr)
    assert kept == sorted([(None, 1.0, "a"), (2.0, 2.0, "a"), (2.0, 2.0, "a")], key=repr)
    fused = sorted(L.dedup_and_drop_conflicts(df, ["f", "g"], ["t"]).collect(), key=repr)
    assert fused == sorted([(None, 1.0, "a"), (2.0, 2.0, "a")], key=repr)


def test_overlaps(spark):
    rows = [(1, "train"), (1, "val"), (1, "test"), (2, "val"), (2, "test"), (3, "test"), (1, "train"), (4, "val")]
    df = spark.createDataFrame(rows, "f int, split string")
    assert tuple(L.count_overlaps(df, ["f"]).first()) == (1, 1, 2)
    kept = L.remove_overlaps(df, ["f"])
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "train"), (1, "train"), (2, "val"), (3, "test"), (4, "val")]
    assert tuple(L.count_overlaps(kept, ["f"]).first()) == (0, 0, 0)


def test_few_conflicts_are_broadcast_and_many_are_skew_split(spark):
    """The anti join never sends the rows of one hot vector to a single task."""
    hot = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("f"), F.md5(F.col("id").cast("string")).alias("v"), F.lit("a").alias("t")
    )
    pairs = spark.range(2_000).selectExpr("-1 - id AS f", "string(id) AS v", "'a' AS t")
    df = stage(hot.unionByName(pairs).unionByName(pairs.withColumn("t", F.lit("b"))), "hot").repartition(8)
    expected = df.count() - 4_000
    plain = L.drop_conflicts(df, ["f"], ["t"])
    assert plain.count() == expected and "BroadcastHashJoin" in plain._jdf.queryExecution().toString()
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        kept = L.drop_conflicts(df, ["f"], ["t"])
        assert len(kept.collect()) == expected
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_medians_and_imputation(spark):
    rows = [(1.0, None, None), (3.0, 5.0, None), (None, 7.0, None), (10.0, 9.0, None)]
    df = spark.createDataFrame(rows, "`a.b` double, c double, d double")
    for size in (10**6, 1):
        assert exact_medians(df, ["a.b", "c", "d"], size) == {"a.b": 3.0, "c": 7.0}
    filled = median_impute(df, ["a.b", "c"], {"a.b": 3.0, "c": 7.0}).collect()
    assert [tuple(r)[:2] for r in filled] == [(1.0, 7.0), (3.0, 5.0), (3.0, 7.0), (10.0, 9.0)]
    assert median_impute(df, ["a.b", "d"], {"a.b": 3.0}).count() == 0


def test_encoders(spark):
    train = spark.createDataFrame([("b", 1), ("a", 2), ("c<", 3)], "`x.y` string, n int")
    other = spark.createDataFrame([("a", 1), ("zz", 2)], "`x.y` string, n int")
    onehot = OneHot.fit(train, ["x.y"])
    assert onehot.columns() == ["x.y_a", "x.y_b", "x.y_c_"]
    assert [tuple(r) for r in onehot.transform(other).collect()] == [(1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)]
    codes = LabelCodes.fit(train, ["x.y"])
    assert codes.encoders() == {"x.y": ["a", "b", "c<"]}
    assert [tuple(r) for r in codes.transform(other).collect()] == [(0, 1), (-1, 2)]


def test_many_categories_are_sparse(spark):
    """50,000 categories and a small column: one sparse vector a row, nothing listed on the driver."""
    train = spark.range(50_000).selectExpr("concat('v', id) AS big", "if(id % 2 = 0, 'x', 'y') AS small", "id AS n")
    coder = OneHot.fit(train, ["big", "small"])
    assert coder.sizes() == [50_000, 2]
    other = spark.createDataFrame([("v7", "y", 1), ("new", "x", 2), ("v49999", None, 3)], "big string, small string, n long")
    rows = {r.n: r.flags for r in coder.sparse(other, "flags").collect()}
    order = sorted(f"v{i}" for i in range(50_000))
    assert {n: v.indices.tolist() for n, v in rows.items()} == {
        1: [order.index("v7"), 50_001],
        2: [50_000],
        3: [order.index("v49999")],
    }
    assert all(v.size == 50_002 and set(v.values) <= {1.0} for v in rows.values())
    codes = LabelCodes.fit(train, ["big", "small"])
    got = {r.n: (r.big, r.small) for r in codes.transform(other).collect()}
    assert got == {1: (order.index("v7"), 1), 2: (-1, 0), 3: (order.index("v49999"), -1)}


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1), (4.0, 0.1)], "a double, k double")
    scaler = Scaler.fit(df, ["a", "k"])
    assert np.allclose(scaler.scale, [np.std([1, 2, 4]), 1.0]) and abs(scaler.mean[1] - 0.1) < 1e-12
    out = np.array([tuple(r) for r in scaler.transform(df).collect()])
    assert np.allclose(out[:, 0].mean(), 0) and np.allclose(out[:, 0].std(), 1) and np.allclose(out[:, 1], 0)
