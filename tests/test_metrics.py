import numpy as np
import pytest

from netlume.operators import metrics as M


def frame(spark, y, s, p=None):
    p = p if p is not None else [int(v >= 0.5) for v in s]
    rows = [("all", int(a), float(b), int(c)) for a, b, c in zip(y, s, p)]
    return spark.createDataFrame(rows, "stage string, y int, score double, pred int")


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def brute_ap(y, s):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - last) * y[hit].mean()
        last = recall
    return total


@pytest.mark.parametrize("size", [None, 7])
def test_ranking_metrics_equal_brute_force(spark, size):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    row = M.ranking_metrics(frame(spark, y, s), "y", "score", ranges=size).first()
    assert row.roc_auc == round(brute_auc(y, s), 4) and row.pr_auc == round(brute_ap(y, s), 4)


def test_degenerate_inputs(spark):
    ties = M.binary_metrics(frame(spark, [0, 1, 0, 1], [0.3] * 4), "y", "pred", "score", ["stage"]).first()
    assert (ties.roc_auc, ties.pr_auc, ties.f1, ties.precision) == (0.5, 0.5, 0.0, 0.0)
    one = M.binary_metrics(frame(spark, [0, 0], [0.1, 0.9]), "y", "pred", "score", ["stage"]).first()
    assert one.roc_auc is None and one.pr_auc == 0.0 and one.balanced_accuracy == 0.5
    assert (one.tn, one.fp, one.fn, one.tp) == (1, 1, 0, 0)


def test_first_of_tied_thresholds_wins(spark):
    df = frame(spark, [0, 1, 1], [0.05, 0.95, 0.95])
    assert tuple(M.best_threshold(df, "y", "score", M.THRESHOLD_GRID).first()) == (0.1, 1.0)
    none = M.best_threshold(frame(spark, [0, 0], [0.5, 0.6]), "y", "score", [0.2, 0.4]).first()
    assert tuple(none) == (0.2, 0.0)


def test_thresholds_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 200), rng.random(200)
    grid = M.score_percentiles(frame(spark, y, s), "score")
    assert np.allclose(grid, np.percentile(s, range(5, 100, 5)))
    f1 = [2 * (y[s >= t]).sum() / ((s >= t).sum() + y.sum()) for t in grid]
    best = M.best_threshold(frame(spark, y, s), "y", "score", grid).first()
    assert best.threshold == grid[int(np.argmax(f1))] and best.f1 == round(max(f1), 4)


# Published test results (confusion cells and the metrics that belong to them).
BINARY = {
    (103403, 509, 163, 21154): (0.9937, 0.9844, 0.9765, 0.9924, 0.9946),
    (48405, 13, 8503, 10806): (0.7797, 0.7173, 0.9988, 0.5596, 0.8743),
}
PER_ATTACK = {"backdoor": (10090, 4118, 0.4081), "ddos": (2165, 1073, 0.4956), "normal": (103912, 22091, 0.2126)}
NAMES = ["backdoor", "ddos", "injection", "normal", "password", "ransomware", "scanning", "xss"]
MATRIX = [
    [10027, 0, 0, 51, 0, 0, 7, 5],
    [0, 2137, 4, 21, 0, 0, 3, 0],
    [0, 0, 2062, 1, 0, 0, 63, 0],
    [293, 109, 82, 102825, 38, 24, 524, 17],
    [0, 15, 0, 28, 5830, 0, 24, 1],
    [0, 0, 0, 85, 0, 569, 0, 0],
    [0, 0, 0, 10, 32, 0, 101, 0],
    [0, 0, 0, 13, 0, 0, 0, 228],
]
SUMMARY = (0.9314, 0.871, 0.9902, 0.9884)
SCANNING = (0.1399, 0.7063, 0.2335, 143)


def expand(spark, counts, schema):
    """Rows repeated as often as counted."""
    cells = spark.createDataFrame(counts, schema + ", n int")
    return cells.selectExpr("*", "explode(sequence(1, n)) AS i").drop("n", "i")


def test_published_binary_results(spark):
    for (tn, fp, fn, tp), expected in BINARY.items():
        rows = expand(spark, [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)], "y int, pred int")
        got = M.binary_rates(M.confusion_binary(rows, "y", "pred")).first()
        assert (got.balanced_accuracy, got.f1, got.precision, got.recall, got.accuracy) == expected


def test_published_per_attack_results(spark):
    counts = [c for t, (n, d, _) in PER_ATTACK.items() for c in ((t, 1, d), (t, 0, n - d))]
    rows = expand(spark, counts, "kind string, pred int")
    got = {r.attack_type: (r.support, r.detected, r.recall) for r in M.per_attack(rows, "kind", "pred").collect()}
    assert got == PER_ATTACK


def test_published_multiclass_results(spark):
    counts = [(t, p, n) for t, row in zip(NAMES, MATRIX) for p, n in zip(NAMES, row) if n]
    rows = expand(spark, counts, "t string, p string")
    report = M.per_class(rows, "t", "p", NAMES)
    assert tuple(M.multiclass_summary(report).first()) == SUMMARY
    scanning = M.per_class_report(report).where("class = 'scanning'").first()
    assert tuple(scanning)[1:] == SCANNING
    wide = {r[0]: list(r[1:]) for r in M.confusion_matrix(rows, "t", "p", NAMES).collect()}
    assert [wide[n] for n in NAMES] == MATRIX


def test_listed_classes_may_be_absent(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "t string, p string")
    got = {r["class"]: r for r in M.per_class(rows, "t", "p", ["a", "b", "c", "d"]).collect()}
    assert (got["b"].support, got["b"].predicted, got["d"].f1) == (0, 1, 0.0)
    summary = M.multiclass_summary(M.per_class(rows, "t", "p", ["a", "b", "c", "d"])).first()
    assert summary.balanced_accuracy == 0.25 and summary.macro_f1 == 0.125
