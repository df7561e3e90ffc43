import numpy as np
import pytest
from pyspark.sql import functions as F

from netlume.detectors.averaging import train_round, with_workers
from netlume.detectors import extra_trees, outliers
from netlume.detectors.base import class_index
from netlume.detectors.boosting import (
    Growth,
    HistBoost,
    Loss,
    SecondOrderBoost,
    Tree,
    bin_table,
    boosted,
    grow_trees,
    level_histograms,
    with_siblings,
)
from netlume.detectors.extra_trees import ExtraTrees
from netlume.detectors.federated import FederatedSgd, LinearSgd
from netlume.detectors.linear import GaussianBayes, Logistic, Majority
from netlume.detectors.gradient import Schedule, descend, summed
from netlume.detectors.neural import Autoencoder, Mlp, Network
from netlume.detectors.outliers import IsolationForest, LocalOutlierFactor, nearest, path_adjustment
from netlume.detectors.svm import HingeUnits, PlattSvm, platt_sigmoids
from netlume.detectors.trees import Forest
from netlume.operators.metrics import ranking_metrics
from netlume.plans.evaluate import evaluate, evaluation_table
from netlume.staging import stage


N = 6000


@pytest.fixture(scope="module")
def data(spark):
    """Three blobs in five dimensions; the third one is the attack."""
    rng = np.random.default_rng(0)
    centre = np.array([[0.0] * 5, [3.0, 3, 0, 0, 0], [0.0, 0, 4, 4, 4]])
    kind = rng.choice(3, N, p=[0.5, 0.3, 0.2])
    x = centre[kind] + rng.normal(size=(N, 5))
    part = np.where(np.arange(N) % 20 < 14, "train", np.where(np.arange(N) % 20 < 17, "val", "test"))
    rows = [
        (i, *map(float, x[i]), int(kind[i] == 2), ["a", "b", "c"][kind[i]], str(part[i])) for i in range(N)
    ]
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame(rows, ["id", *names, "y", "kind", "split"])
    meta = {"feature_columns": names, "target_binary": "y", "target_multiclass": "kind"}
    return evaluation_table(df, meta, ["id"])


SUPERVISED = [
    Logistic(max_iter=30),
    GaussianBayes(),
    PlattSvm(rounds=30),
    Mlp(hidden=(16,), rounds=60),
    Forest(trees=5, max_depth=5),
    ExtraTrees(trees=8),
    HistBoost(rounds=8, max_depth=4, rate=0.3),
    SecondOrderBoost(rounds=2, max_depth=3, rate=0.5),
    FederatedSgd(rounds=2),
]


@pytest.mark.parametrize("detector", SUPERVISED, ids=lambda d: d.name)
def test_supervised_detectors_find_the_attack(data, detector):
    done = evaluate(detector, data, "blobs", cross_validate=False)
    test = done.tables["binary"].where("stage = 'test'").first()
    assert test.roc_auc > 0.97 and test.f1 > 0.85 and 0.1 <= test.threshold <= 0.9
    assert done.tables["multiclass"].first().macro_f1 > 0.85
    assert {r["class"] for r in done.tables["per_class"].collect()} == {"a", "b", "c"}


@pytest.mark.parametrize(
    "detector", [IsolationForest(trees=30), LocalOutlierFactor(), Autoencoder(hidden=(8, 3, 8), rounds=60)], ids=lambda d: d.name
)
def test_anomaly_detectors_find_the_attack(data, detector):
    done = evaluate(detector, data, "blobs", cross_validate=False)
    assert done.tables["binary"].where("stage = 'test'").first().roc_auc > 0.85
    recall = {r.attack_type: r.recall for r in done.tables["per_attack"].collect()}
    assert recall["c"] > recall["a"]


def test_isolation_forest_scores_its_rows_once(data, monkeypatch):
    """The scans for the offset read stored scores; places in the full tree equal a walk from node to node."""
    kept = []
    monkeypatch.setattr(outliers, "stage", lambda df, label: kept.append(label) or stage(df, label))
    IsolationForest(trees=2).fit(data.where("split = 'train'"))
    assert "benign-scores" in kept
    x = np.random.default_rng(1).normal(size=(300, 3))
    tree = {k: np.array(v) for k, v in outliers.isolation_tree(x[:100], np.random.default_rng(2)).items()}
    found = outliers.path_lengths(outliers.full_tree(tree, 7), x, 7)
    for row, length in zip(x, found):
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["right" if row[tree["feature"][at]] > tree["cut"][at] else "left"][at]
        assert length == tree["length"][at]


def test_full_protocol_and_majority(data):
    done = evaluate(Majority(), data, "blobs")
    stages = {r.stage: r for r in done.tables["binary"].collect()}
    assert set(stages) == {"cv", "val", "test"} and done.threshold is None
    assert all(r.roc_auc == 0.5 and r.f1 == 0 for r in stages.values())
    assert sum(stages["cv"][n] for n in ("tn", "fp", "fn", "tp")) == N * 7 // 10
    assert IsolationForest(trees=5).params() == {"trees": 5, "sample": 256}
    forest = evaluate(IsolationForest(trees=5), data, "blobs").tables["binary"].where("stage = 'cv'").first()
    assert forest.roc_auc > 0.8  # labels at the contamination offset, one model per fold
    assert 0.05 < (forest.fp / (forest.tn + forest.fp)) < 0.2


def test_detectors_repeat(data):
    """Fixed seeds: two fits give the same scores."""
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    for detector in (IsolationForest(trees=3), FederatedSgd(rounds=1), SecondOrderBoost(rounds=1, max_depth=2)):
        one, two = ([r.score for r in detector.fit(train)(test).orderBy("_h").collect()] for _ in range(2))
        assert np.allclose(one, two)


def test_federated_round_is_the_weighted_average(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 7 > 1), rng.normal(size=3).tolist(), int(i % 2), f"{i:04d}") for i in range(70)]
    df = spark.createDataFrame(rows, "site int, x array<double>, t int, _h string")
    data = with_workers(df, "site").withColumn("holdout", F.lit(False))

    def load(state):
        return LinearSgd(1, 3, state)

    state, _ = train_round(data, load, np.zeros(4), seed=1)
    expected = np.zeros(4)
    for site in (0, 1):
        mine = [r for r in sorted(rows, key=lambda r: r[3]) if r[0] == site]
        local = load(np.zeros(4))
        local.learn(np.array([r[1] for r in mine]), np.array([r[2] for r in mine]), np.random.default_rng([1, site, 0]))
        expected += local.state() * len(mine) / len(rows)
    assert np.allclose(state, expected)


def test_a_hot_site_is_shared_by_workers(spark):
    df = spark.range(4000).repartition(8).selectExpr("if(id % 3 = 0, 0, int(id % 2)) AS site", "string(id) AS _h")
    sizes = with_workers(df, "site", rows_per_worker=700).groupBy("worker").count().collect()
    assert sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) < 1000
    assert with_workers(df, "site").select("worker").distinct().count() == 2


def numeric_gradient(objective, params, x, t, fold):
    out = np.zeros_like(params)
    for at in np.ndindex(*params.shape):
        for sign in (1, -1):
            moved = params.copy()
            moved[at] += sign * 1e-6
            out[at] += sign * objective.loss(moved, x, t, fold)[0][at[0]] / 2e-6
    return out


def test_gradients_equal_differences(spark):
    rng = np.random.default_rng(1)
    x, t, fold = rng.normal(size=(12, 3)), rng.integers(0, 3, 12), rng.integers(0, 2, 12)
    for folds in (False, True):
        for objective in (Network([3, 5, 4, 3], "class", 2, folds), Network([3, 5, 3], "input", 2, folds)):
            params = rng.normal(size=(2, objective.size))
            gradient, losses, rows = objective.gradient(params, x, t, fold)
            assert np.allclose(gradient, numeric_gradient(objective, params, x, t, fold), atol=1e-4)
            assert np.allclose(losses, objective.loss(params, x, t, fold)[0])
            assert rows.tolist() == [(fold != m).sum() if folds else 12 for m in (0, 1)]
        units = HingeUnits(3, 2, 3, 2, folds)
        params = rng.normal(size=(2, units.size))
        code = (t % 2) * 3 + rng.integers(0, 3, 12)
        gradient = units.gradient(params, x, code, fold)[0]
        assert np.allclose(gradient / units.units, numeric_gradient(units, params, x, code, fold), atol=1e-4)


def test_summed_gradient_equals_one_task(spark):
    rng = np.random.default_rng(2)
    x, t = rng.normal(size=(500, 3)), rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(i % 5)) for i, (a, b) in enumerate(zip(x, t))], "x array<double>, t int, fold int")
    net = Network([3, 4, 2], "class", 5, True)
    params = net.start(1) + rng.normal(size=(5, net.size)) / 9
    want = net.gradient(params, x, t, np.arange(500) % 5)
    for parts, wide in ((1, False), (7, False), (40, True)):
        got = summed(rows.repartition(parts), net, params, True, wide)
        assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(got, want))
    assert summed(rows.limit(0), net, params, False, False)[2].tolist() == [0] * 5


def test_folds_trained_together_equal_single_fits(spark):
    """The model of fold m equals one that was trained on the other rows alone."""
    rng = np.random.default_rng(3)
    rows = [([float(a), float(b)], int(a + b > 0), int(i % 3), f"{rng.integers(2**60):015x}" * 2 + "00") for i, (a, b) in enumerate(rng.normal(size=(900, 2)))]
    df = spark.createDataFrame(rows, "x array<double>, y int, fold int, _h string")
    plan = Schedule(6, 10)
    net = Network([2, 6, 2], "class", 3, True)
    together = descend(df, F.col("y"), net, net.start(4), plan, True)
    single = Network([2, 6, 2], "class")
    alone = descend(df.where("fold <> 1"), F.col("y"), single, single.start(4), plan, True)[0]
    x = rng.normal(size=(50, 2))
    # the step size belongs to the number of all rows, so only the direction of training is compared
    assert np.corrcoef(net.predict(together[1], x)[:, 1], single.predict(alone, x)[:, 1])[0, 1] > 0.99


def test_a_gradient_step_is_one_job_of_one_stage(spark):
    """Two epochs over two slices and the rows held out: six jobs beside those that count and pack the rows."""
    rows = spark.range(45_000).selectExpr("array(id % 7 / 7D, id % 11 / 11D) AS x", "int(id % 2) AS y", "md5(string(id)) AS _h")
    net = Network([2, 3, 2], "class")
    spark.sparkContext.setJobGroup("steps", "steps")
    descend(rows, F.col("y"), net, net.start(4), Schedule(2, 10), True)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup("steps")]
    assert len(jobs) <= 6 + 3


@pytest.mark.parametrize("detector", [Majority(), GaussianBayes()], ids=lambda d: d.name)
def test_fold_complements_equal_refits(data, detector):
    train = data.where("split = 'train'")
    shared = {r["_h"]: r.score for r in detector.fit_folds(train, 5)(train).collect()}
    for i in range(2):
        refit = detector.fit(train.where(f"fold <> {i}"))(train.where(f"fold = {i}")).collect()
        assert refit and all(abs(shared[r["_h"]] - r.score) < 1e-9 for r in refit)


def test_platt_sigmoid_minimises_the_loss(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=400)
    t = (rng.random(400) < 1 / (1 + np.exp(-(2 * m - 0.5)))).astype(int)
    rows = [(0, int(a), float(b)) for a, b in zip(t, m)] + [(1, int(a), float(b * 100)) for a, b in zip(t, m)]
    a, b = platt_sigmoids(stage(spark.createDataFrame(rows, "unit int, t int, m double"), "held"), 2).T
    assert abs(a[0] - 2) < 0.5 and abs(b[0] + 0.5) < 0.4
    assert np.isclose(a[0], a[1] * 100, rtol=1e-3) and np.isclose(b[0], b[1], rtol=1e-3)


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(7)
    ref = rng.normal(size=(300, 4))
    ref[10] = ref[20]
    own = np.arange(300)
    dist, pos = nearest(ref, ref, 5, own=own)
    full = np.sqrt(((ref[:, None] - ref[None]) ** 2).sum(axis=2))
    full[own, own] = np.inf
    assert np.allclose(dist, np.sort(full, axis=1)[:, :5]) and not (pos == own[:, None]).any()
    assert path_adjustment(1) == 0 and path_adjustment(2) == 1 and 10.2 < path_adjustment(256) < 10.3


def test_ranking_of_constant_scores(data):
    scored = Majority().fit(data.where("split = 'train'"))(data)
    assert ranking_metrics(scored, "y", "score").first().roc_auc == 0.5


# ---- tree kernels --------------------------------------------------------------------------------


def test_sibling_subtraction_equals_direct_counts(data):
    """Histograms of siblings that were never counted equal counted ones, for classes and for folds."""
    train = class_index(data.where("split = 'train'"), ["a", "b", "c"], "label")
    for loss, target in ((Loss(3, softmax=True), "label"), (Loss(5, folds=True), "y")):
        binned, edges = bin_table(train, target, loss)
        plan = Growth(3, 0.3, l2=1.0, min_hessian=1.0)
        trees = grow_trees(binned, edges, loss, [], plan)
        assert all(t.feature[0] >= 0 for t in trees)
        parents = level_histograms(binned, 5, loss, [], [Tree(3) for _ in trees], [[0]] * len(trees))
        for t in trees:  # only the first cut
            t.feature[1:] = -1
        counted = level_histograms(binned, 5, loss, [], trees, [[1]] * len(trees))
        other = level_histograms(binned, 5, loss, [], trees, [[2]] * len(trees))
        both = {(r.output, r.node, r.feature): r.sums for r in with_siblings(counted, parents).collect()}
        assert len(both) == 2 * 5 * len(trees)
        for r in other.collect():
            assert np.allclose(both[r.output, 2, r.feature], r.sums, atol=1e-9)


def test_boosting_equals_one_task_reference(spark):
    """One small tree against an exhaustive search over all cuts."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (400, 2)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 8)).astype(int)
    rows = [(a.tolist(), int(b), "n", f"{i:032x}") for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<double>, y int, attack string, _h string")
    [[tree]] = boosted(df, "y", Loss(1), Growth(2, 0.1, l2=1.0, min_hessian=1.0), 1)
    g, h = 0.5 - y, np.full(400, 0.25)

    def best(rows):
        def worth(m):
            return g[m].sum() ** 2 / (h[m].sum() + 1.0)

        found = []
        for f in (0, 1):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows & (x[:, f] <= cut)
                found.append((worth(left) + worth(rows & ~left) - worth(rows), -f, cut))
        return max(found)

    everything = np.ones(400, bool)
    gain, f, cut = best(everything)
    assert tree.feature[0] == -f
    left = x[:, -f] <= tree.cut[0]
    assert (left == (x[:, -f] <= cut)).all()
    for node, rows in ((1, left), (2, ~left)):
        _, f, cut = best(rows)
        assert tree.feature[node] == -f and ((x[rows, -f] <= tree.cut[node]) == (x[rows, -f] <= cut)).all()
        for child, part in ((2 * node + 1, x[:, -f] <= cut), (2 * node + 2, x[:, -f] > cut)):
            mine = rows & part
            assert np.isclose(tree.value[child], -0.1 * g[mine].sum() / (h[mine].sum() + 1.0))


def test_boosting_counts_equal_rows_once(spark):
    """Copies become one row with a number, per target and fold, and weigh like the rows they stand for."""
    rows = spark.range(3000).selectExpr("array(double(id % 4), double(id % 3)) AS x", "int(id % 2) AS y", "int(id % 5) AS fold")
    for loss, cells in ((Loss(1), 12), (Loss(5, folds=True), 60)):
        binned, edges = bin_table(rows, "y", loss)
        assert binned.count() == cells and binned.agg(F.sum("n")).first()[0] == 3000
        sums = level_histograms(binned, 2, loss, [], [Tree(1) for _ in range(loss.outputs)], [[0]] * loss.outputs).collect()
        assert {sum(r.sums[2 * 256 :]) for r in sums} == {3000.0 if cells == 12 else 2400.0}


def test_histogram_boosting_keeps_its_limits(data):
    train = data.where("split = 'train'")
    [[tree]] = boosted(train, "y", Loss(1), Growth(8, 0.1, min_hessian=1e-3, min_rows=20, max_leaves=6), 1)
    assert (tree.feature >= 0).sum() <= 5
    x = np.array([r.x for r in train.collect()])
    assert np.bincount(tree.leaf(x, tree.cut))[np.unique(tree.leaf(x, tree.cut))].min() >= 20


def test_extra_trees_do_not_depend_on_layout(data, monkeypatch):
    """Nodes grown by levels and in one task, in any layout: every leaf's shares are those of its rows."""
    train = data.where("split = 'train'")
    x, y = (np.array(v) for v in zip(*((r.x, r.y) for r in train.collect())))
    for local in (300, 10**6):
        monkeypatch.setattr(extra_trees, "LOCAL_ROWS", local)
        one, two = (ExtraTrees(trees=3, max_depth=9)._grow(part, "y", 2) for part in (train, train.repartition(5)))
        for (tree, shares), (again, shares2) in zip(one, two):
            assert all(np.array_equal(a, b) for a, b in zip(tree, again)) and np.array_equal(shares, shares2)
            at = extra_trees.walk(tree, x)
            sizes = np.bincount(at, minlength=len(shares))
            assert sizes[np.unique(at)].min() >= 2
            assert np.allclose(np.bincount(at, y, len(shares))[sizes > 0] / sizes[sizes > 0], shares[sizes > 0][:, 1])


def test_extra_trees_count_equal_rows_once(spark, monkeypatch):
    """The table behind all levels holds one row per distinct row and class; counts are those of all rows."""
    kept = []
    monkeypatch.setattr(extra_trees, "stage", lambda df, label: kept.append(stage(df, label)) or kept[-1])
    rows = spark.range(2000).selectExpr("array(double(id % 8), double(id % 3)) AS x", "int(id % 8 > 4) AS y")
    for local in (100, 10**6):
        monkeypatch.setattr(extra_trees, "LOCAL_ROWS", local)
        for (feature, *_), shares in ExtraTrees(trees=2, max_depth=6)._grow(rows, "y", 2):
            assert feature[0] >= 0 and np.allclose(shares[0], [5 / 8, 3 / 8])
        assert kept[-1].count() == 24


def test_extra_trees_are_the_same_wherever_they_grow(data, monkeypatch):
    """Whole trees in tasks, by levels, by levels and small nodes, and with models of one tree a piece give equal scores."""
    train = data.where("split = 'train'")
    scores = []
    for sent, local, piece in ((10**9, 4096, 10**6), (0, 1, 10**6), (0, 300, 10**6), (10**9, 4096, 1)):
        monkeypatch.setattr(extra_trees, "SENT_VALUES", sent)
        monkeypatch.setattr(extra_trees, "LOCAL_ROWS", local)
        monkeypatch.setattr(extra_trees, "PIECE_NODES", piece)
        detector = ExtraTrees(trees=3, max_depth=7)
        scores.append([r.score for r in detector.fit(train)(train.select("_h", "x")).orderBy("_h").collect()])
        assert len(detector._pieces(train, "y", 2)) == (3 if piece == 1 else 1)
    assert len(set(scores[0])) > 20 and all(np.allclose(scores[0], v, rtol=1e-12) for v in scores[1:])


def test_extra_trees_grow_whole_whatever_their_size(spark):
    """Labels without a pattern: by default every node is cut until its rows agree or are too few."""
    rng = np.random.default_rng(4)
    x, t = rng.normal(size=(3, 4000)), rng.integers(0, 2, 4000)
    key = extra_trees.root_key(1)
    feature, cut, left, counts = extra_trees.grow_local(x, t, np.ones(4000), 2, 60, 1, 3, key)
    assert ((counts[left == np.arange(len(left))] > 0).sum(axis=1) == 1).all() and counts[0].sum() == 4000
    assert ExtraTrees().max_nodes is None and len(feature) > 1500
    x[:, rng.random(4000) < 0.3] = np.nan  # a missing value goes left; the feature is still cut
    assert len(extra_trees.grow_local(x, t, np.ones(4000), 2, 60, 1, 3, key)[0]) > 1500


def test_extra_trees_bound_their_model(data):
    train = data.where("split = 'train'")
    small = ExtraTrees(trees=3, max_nodes=40)._grow(train, "y", 2)
    assert sum(len(tree[0]) for tree, _ in small) < 40 + 3 * 2 * extra_trees.LOCAL_ROWS
