"""Steps whose disk, shuffle or time must not outgrow the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlume.detectors import boosting, neural, svm, trees
from netlume.detectors.averaging import with_workers
from netlume.detectors.federated import FederatedSgd, LinearSgd
from netlume.detectors.neural import Network
from netlume.detectors.svm import HingeUnits
from netlume.detectors.trees import Forest, tree_groups
from netlume.plans import queries_models
from netlume.plans.evaluate import dealt_evenly


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_even_rows_are_not_shuffled(spark):
    even = spark.range(0, 8000, 1, 8)
    assert "Exchange" not in plan_of(dealt_evenly(even))
    single = dealt_evenly(spark.range(0, 8000, 1, 1))
    sizes = [r["count"] for r in single.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 2000
    assert dealt_evenly(spark.range(0)).count() == 0


def test_trees_are_grown_in_bounded_fits(spark, monkeypatch):
    assert tree_groups(200, 600_000) == [200]
    for rows in (5_000_000, 25_000_000, 150_000_000):
        groups = tree_groups(200, rows)
        assert sum(groups) == 200 and len(groups) > 1
        assert max(groups) * rows <= trees.CELLS or max(groups) <= trees.LEAST_TREES
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    rows = [(v.tolist(), int(v[0] > 0), "abc"[int(v[0] > 0) + int(v[0] > 1)]) for v in x]
    df = spark.createDataFrame(rows, "x array<double>, y int, attack string")
    monkeypatch.setattr(trees, "LEAST_TREES", 4)
    monkeypatch.setattr(trees, "tree_groups", lambda n, rows: tree_groups(n, rows, 1200))
    detector = Forest(trees=10)
    models = detector._grown(df, "y")
    assert [m.getNumTrees for m in models] == [4, 3, 3]
    scored = detector.fit(df)(df)
    assert scored.columns == [*df.columns, "score"]
    alone = [m.transform(trees.with_vector(df)).select("probability").collect() for m in models]
    for i, r in enumerate(scored.collect()):
        mean = sum(p[i].probability[1] * m.getNumTrees for m, p in zip(models, alone)) / 10
        assert r.score == pytest.approx(mean)
    predicted = detector.fit_classes(df, ["a", "b", "c"])(df)
    assert predicted.where("attack = pred_class").count() > 280


def test_models_that_learn_together_learn_as_alone():
    rng = np.random.default_rng(3)
    for k in (1, 3):
        xs = [rng.normal(size=(n, 4)) for n in (50, 1, 17, 64)]
        ts = [rng.integers(0, max(2, k), len(x)) for x in xs]
        start = rng.normal(size=k * 5)
        together = [LinearSgd(k, 4, start) for _ in xs]
        LinearSgd.learn_together(together, xs, ts, [np.random.default_rng(i) for i in range(4)])
        for i, (x, t) in enumerate(zip(xs, ts)):
            alone = LinearSgd(k, 4, start)
            order = np.random.default_rng(i).permutation(len(x))
            for at in range(0, len(x), 8):  # the step written out
                rows = order[at : at + 8]
                wanted = (t[rows][:, None] == (np.arange(k) if k > 1 else 1)).astype(float)
                step = 0.01 * (wanted - 1 / (1 + np.exp(-alone.margins(x[rows]))))
                alone.w = alone.w * (1 - 1e-6) ** len(rows) + step.T @ x[rows]
                alone.b = alone.b + step.sum(axis=0)
            assert np.allclose(together[i].state(), alone.state())


def test_workers_are_dealt_out_evenly_and_whole(spark):
    df = spark.range(40_000).selectExpr("int(id % 5) AS site", "md5(string(id)) AS _h")
    laid = with_workers(df, "site", rows_per_worker=2_000).withColumn("part", F.spark_partition_id())
    pairs = [(r.worker, r.part) for r in laid.select("worker", "part").distinct().collect()]
    assert len(pairs) == 20 and len({w for w, _ in pairs}) == 20
    parts = [p for _, p in pairs]
    assert max(map(parts.count, parts)) == -(-20 // min(20, spark.sparkContext.defaultParallelism))


def test_a_site_of_any_size_is_one_local_model(spark):
    df = spark.range(1_100_000).selectExpr("0 AS site", "string(id) AS _h")
    assert with_workers(df, "site").select("worker").distinct().count() == 1
    assert FederatedSgd().rows_per_worker is None


def test_networks_train_their_published_rounds(spark, monkeypatch):
    monkeypatch.setattr(queries_models.R, "detector_report", lambda spark, sf, detector: detector)
    for name, rounds in (("mlp", 300), ("autoencoder", 100)):
        detector = queries_models.QUERIES[name](spark, "")
        assert detector.rounds == rounds and detector.patience == 10


def test_sums_of_models_do_not_depend_on_blocks(monkeypatch):
    """The gradient and loss of many blocks are those of one; a network holds the layers of one block at a time."""
    rng = np.random.default_rng(2)
    x, fold = rng.normal(size=(500, 4)), rng.integers(0, 3, 500)
    models = [(Network([4, 6, 2], "class", 3, True), 2), (Network([4, 3, 4], "input"), 1), (HingeUnits(3, 2, 4, 3, True), 6)]
    for model, kinds in models:
        t = rng.integers(0, kinds, 500)
        params = rng.normal(size=(model.models, model.size))
        found, largest = [], []
        for rows in (1000, 64):
            monkeypatch.setattr(neural, "BLOCK_ROWS", rows)
            monkeypatch.setattr(svm, "BLOCK_ROWS", rows)
            if isinstance(model, Network):
                seen = []
                monkeypatch.setattr(model, "forward", lambda p, x: seen.append(len(x)) or Network.forward(model, p, x))
                largest.append(seen)
            found.append((*model.gradient(params, x, t, fold), *model.loss(params, x, t, fold)))
        assert all(np.allclose(a, b) for a, b in zip(*found))
        assert not largest or max(largest[1]) <= 64 < max(largest[0])


def test_a_boosting_round_takes_every_tree_once(spark, monkeypatch):
    """The levels of a round find the margins of all trees before them; none is walked again for every level."""
    rows = spark.range(400).selectExpr("array(double(id % 20), double(id % 7)) AS x", "int(id % 20 > 11) AS y")
    waiting, grow = [], boosting.grow_trees
    monkeypatch.setattr(boosting, "grow_trees", lambda *a: waiting.append(len(a[3])) or grow(*a))
    plan = boosting.Growth(3, 0.3, l2=1.0)
    for restage in (10, 2):
        monkeypatch.setattr(boosting, "RESTAGE_ROUNDS", restage)
        made = boosting.boosted(rows, "y", boosting.Loss(1), plan, 4)
        x = np.array([r.x for r in rows.collect()])
        margin, hits = np.zeros(400), np.array([r.y for r in rows.collect()])
        for [tree] in made:  # the root's value is the leaf of a tree without a cut, on the gradients of that round
            p = 1 / (1 + np.exp(-margin))
            assert tree.value[0] == pytest.approx(-0.3 * (p - hits).sum() / ((p * (1 - p)).sum() + 1.0))
            margin += tree.value[tree.leaf(x, tree.cut)]
    assert waiting == [0] * 8
