"""Cases that once gave wrong answers: copies, NULL strata, missing classes, far offsets, table layout."""

import numpy as np
from pyspark.sql import functions as F

from netlume.detectors.linear import GaussianBayes
from netlume.detectors.neural import Autoencoder, Mlp
from netlume.detectors.outliers import nearest
from netlume.detectors.svm import PlattSvm
from netlume.functions.columns import row_hash
from netlume.operators import ordering
from netlume.operators.sampling import sample_by_quota, stratified_split, with_folds


def test_folds_and_splits_deal_out_copies(spark):
    rows = [(1, "a")] * 700 + [(i, "a") for i in range(2, 302)] + [(i, None) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, t string")
    df = df.withColumn("_h", row_hash(df, ["k"]))
    folds = {(r.t, r.fold): r["count"] for r in with_folds(df, "t", "_h").groupBy("t", "fold").count().collect()}
    assert [folds["a", i] for i in range(5)] == [200] * 5
    assert [folds[None, i] for i in range(5)] == [10] * 5
    parts = {(r.t, r.split): r["count"] for r in stratified_split(df, "t", "_h").groupBy("t", "split").count().collect()}
    assert [parts["a", s] for s in ("train", "val", "test")] == [700, 150, 150]
    assert [parts[None, s] for s in ("train", "val", "test")] == [34, 8, 8]


def test_partial_keys_do_not_depend_on_layout(spark):
    """Rows that share a hash but differ elsewhere go to the same fold in every layout; equal rows are dealt by counts."""
    df = spark.range(1000).selectExpr("id % 27 AS k", "id % 400 AS v", "'a' AS t")
    df = df.withColumn("_h", row_hash(df, ["k"]))
    seen = []
    for parts in (2, 5):
        counted = with_folds(df.repartition(parts), "t", "_h").groupBy("k", "v", "fold").count().collect()
        seen.append({(r.k, r.v, r.fold): r["count"] for r in counted})
        assert sum(seen[-1].values()) == 1000
        assert [sum(n for (_, _, f), n in seen[-1].items() if f == i) for i in range(5)] == [200] * 5
    assert seen[0] == seen[1]


def test_equal_rows_across_many_cuts(spark, monkeypatch):
    """One row a thousand times, wide names, all cuts inside it."""
    monkeypatch.setattr(ordering, "COPIES_PER_CHUNK", 7)
    df = spark.createDataFrame([(1, "a", None)] * 103 + [(2, "a", 1.0), (3, "b", 2.0)], "`k.x` int, t string, `v w` double")
    df = df.withColumn("_h", row_hash(df, ["k.x"]))
    folds = with_folds(df, "t", "_h")
    assert folds.columns == [*df.columns, "fold"]
    sizes = {(r.t, r.fold): r["count"] for r in folds.groupBy("t", "fold").count().collect()}
    assert sorted(n for (t, _), n in sizes.items() if t == "a") == [20, 21, 21, 21, 21] and sum(sizes.values()) == 105


def test_quota_treats_missing_labels_alike(spark):
    df = spark.createDataFrame([(i, None if i < 10 else "a") for i in range(100)], "k int, t string")
    assert sample_by_quota(df, "t", 200).where("t IS NULL").count() == 10
    assert sample_by_quota(df, "t", 50).where("t IS NULL").count() == 5
    assert sample_by_quota(df, "t", 50).count() == 50


def test_bayes_names_classes_that_train_lacks(spark):
    rng = np.random.default_rng(1)
    rows = [([float(v)], name) for name, at in (("a", 0), ("c", 9)) for v in rng.normal(at, 1, 150)]
    train = spark.createDataFrame(rows, "x array<double>, attack string")
    out = GaussianBayes().fit_classes(train, ["a", "b", "c"])(train)
    assert out.where("pred_class <> attack").count() == 0


def test_neighbours_far_from_zero():
    rng = np.random.default_rng(2)
    x = 1e6 + rng.normal(0, 1e-3, (3000, 4))
    d, p = nearest(x[:200], x, 20, own=np.arange(200))
    full = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(axis=2))
    full[np.arange(200), np.arange(200)] = np.inf
    assert np.array_equal(p, np.argsort(full, axis=1, kind="stable")[:, :20])
    same = np.zeros((50, 2))
    assert nearest(same, same, 5, own=np.arange(50))[1][0].tolist() == [1, 2, 3, 4, 5]


def test_training_does_not_depend_on_layout(spark):
    """The same rows under 1, 2 and 8 shuffle partitions, laid out in as many parts, give the same scores."""
    rng = np.random.default_rng(3)
    rows = [([float(a), float(b)], int(a + b > 0)) for a, b in rng.normal(0, 1, (9000, 2))]
    df = spark.createDataFrame(rows, "x array<double>, y int")
    df = df.withColumn("_h", F.md5(F.to_json("x"))).withColumn("attack", F.lit("z"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for detector in (Mlp(hidden=(8,), rounds=8), Autoencoder(hidden=(3, 1, 3), rounds=5), PlattSvm(rounds=6)):
            scores = []
            for parts in (1, 2, 8):
                spark.conf.set("spark.sql.shuffle.partitions", parts)
                model = detector.fit(df.repartition(parts))
                scores.append([r.score for r in model(df.orderBy("_h").limit(200)).orderBy("_h").collect()])
            assert np.allclose(scores[0], scores[1], rtol=1e-7) and np.allclose(scores[0], scores[2], rtol=1e-7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
