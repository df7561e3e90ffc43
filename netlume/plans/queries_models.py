"""Registered queries: detectors on planted targets, out-of-fold runs, benchmarks.

Tables are whole. Networks have their published layers and rounds, boosters their published trees with fewer rounds (see
the README for what the published numbers cost), as the hinge and the federated model have; the other detectors have their
published parameters.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlume.detectors.base import Detector
from netlume.detectors.boosting import HistBoost, SecondOrderBoost
from netlume.detectors.extra_trees import ExtraTrees
from netlume.detectors.federated import FederatedSgd, weighted_average
from netlume.detectors.linear import GaussianBayes, Logistic, Majority
from netlume.detectors.gradient import summed
from netlume.detectors.neural import Autoencoder, Mlp, Network
from netlume.detectors.outliers import IsolationForest, LocalOutlierFactor
from netlume.detectors.svm import PlattSvm
from netlume.detectors.trees import Forest
from netlume.operators import metrics as M
from netlume.plans import frames as R
from netlume.plans.benchmark import cross_evaluate, run_all, run_benchmark, stored_leaderboard
from netlume.plans.evaluate import label_folds, multiclass_tables, out_of_fold
from netlume.plans.prepare import prepare_files
from netlume.plans.queries_data import FLOW_SQL, LI, LINE_HASH, SPLIT_LINES, sql_split
from netlume.plans.queries_metrics import line_artifact
from netlume.operators.leakage import remove_overlaps
from netlume.operators.transform import Scaler, in_train
from netlume.sources import artifact as A
from netlume.sources.results import read_results
from netlume.staging import staging_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def split_of(data: DataFrame, name: str) -> DataFrame:
    return data.where(F.col("split") == name)


_NAMES = [n.removeprefix("l_") for n in R.LINE_FEATURES]
_SCALED = ", ".join(
    f"(l_{n} - (SELECT avg(l_{n}) FROM sp WHERE split = 'train')) / "
    f"(SELECT stddev_pop(l_{n}) FROM sp WHERE split = 'train') AS {n}"
    for n in _NAMES
)
FOLDS = f"""{SPLIT_LINES}, z AS (SELECT planted AS y, band, split, {_SCALED}, {LINE_HASH} AS h FROM sp),
fr AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h) AS rn, count(*) OVER (PARTITION BY y) AS n FROM z WHERE split = 'train'),
fo AS (SELECT *, CAST(rn > n // 5 AS INTEGER) + CAST(rn > n * 2 // 5 AS INTEGER) + CAST(rn > n * 3 // 5 AS INTEGER)
  + CAST(rn > n * 4 // 5 AS INTEGER) AS fold FROM fr)"""


def bayes_sql(fit: str, rows: str, by: str, cls: str = "y", tag: str = "", names: list[str] = _NAMES) -> str:
    """Gaussian log likelihood per class from the table ``fit``, applied to ``rows``; ``by`` is the
    column that matches a row with its model. CTE names end in ``tag``."""
    stats = ", ".join(f"avg({n}) AS m_{n}, var_pop({n}) AS v_{n}" for n in names)
    most = ", ".join(f"var_pop({n})" for n in names)
    terms = " + ".join(
        f"ln(2 * pi() * (v_{n} + eps)) + ({n} - m_{n}) * ({n} - m_{n}) / (v_{n} + eps)" for n in names
    )
    score = f"""pr{tag} AS (SELECT {by}, id, any_value(y) AS y,
  1 / (1 + exp(max(lp) FILTER (WHERE cls = 0) - max(lp) FILTER (WHERE cls = 1))) AS score FROM ll{tag} GROUP BY 1, 2)"""
    best = f"pr{tag} AS (SELECT {by}, id, any_value(truth) AS truth, arg_max(cls, lp) AS guess FROM ll{tag} GROUP BY 1, 2)"
    return f"""st{tag} AS (SELECT {by}, {cls} AS cls, count(*) AS cnt, {stats} FROM {fit} GROUP BY 1, 2),
ep{tag} AS (SELECT {by}, 1e-9 * greatest({most}) AS eps, count(*) AS total FROM {fit} GROUP BY 1),
ll{tag} AS (SELECT r.{by}, r.id, r.y, r.{cls} AS truth, cls, ln(cnt / total) - ({terms}) / 2 AS lp FROM {rows} r
  JOIN st{tag} USING ({by}) JOIN ep{tag} USING ({by})),
{score if cls == "y" else best}"""


def report_sql(source: str, folds: str | None = None, names: list[str] = _NAMES) -> str:
    """CTE ``report`` (a row per stage) and ``multi`` (one row): the whole protocol with Gaussian naive Bayes.

    ``source``: id, y, band, split and the scaled features; ``folds``: its train rows with a fold.
    """
    stages = "SELECT split AS stage, pr_t.y, score FROM pr_t JOIN te USING (id)"
    cv = ""
    if folds:
        stages += " UNION ALL SELECT 'cv', y, score FROM pr_c"
        cv = f"""cf AS (SELECT CAST(r.i AS INTEGER) AS g, f.* FROM {folds} f JOIN range(5) r(i) ON f.fold <> r.i),
ce AS (SELECT fold AS g, * FROM {folds}), {bayes_sql('cf', 'ce', 'g', tag='_c', names=names)},"""
    return f"""ft AS (SELECT 0 AS g, * FROM {source} WHERE split = 'train'),
te AS (SELECT 0 AS g, * FROM {source} WHERE split <> 'train'), tt AS (SELECT * FROM te WHERE split = 'test'),
{bayes_sql('ft', 'te', 'g', tag='_t', names=names)}, {cv} {bayes_sql('ft', 'tt', 'g', 'band', '_m', names)},
sg AS ({stages}),
th AS (SELECT i / 100.0::DOUBLE AS t, 2 * sum(CASE WHEN score >= i / 100.0::DOUBLE THEN y ELSE 0 END) AS hit,
  sum(CASE WHEN score >= i / 100.0::DOUBLE THEN 1 ELSE 0 END) + sum(y) AS named FROM sg, range(10, 91, 5) r(i)
  WHERE stage = 'val' GROUP BY i),
best AS (SELECT t FROM th ORDER BY CASE WHEN named = 0 THEN 0 ELSE hit / named END DESC, t LIMIT 1),
pd AS (SELECT *, CASE WHEN score >= CASE WHEN stage = 'cv' THEN 0.5 ELSE t END THEN 1 ELSE 0 END AS pred FROM sg, best),
cm AS (SELECT stage, any_value(t) AS threshold, CAST(sum((1 - y) * (1 - pred)) AS BIGINT) AS tn,
  CAST(sum((1 - y) * pred) AS BIGINT) AS fp, CAST(sum(y * (1 - pred)) AS BIGINT) AS fn,
  CAST(sum(y * pred) AS BIGINT) AS tp FROM pd GROUP BY 1),
gs AS (SELECT stage, score, sum(y) AS pos, sum(1 - y) AS neg FROM sg GROUP BY 1, 2),
gw AS (SELECT *, sum(pos) OVER o AS cp, sum(neg) OVER o AS cn FROM gs
  WINDOW o AS (PARTITION BY stage ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
rk AS (SELECT stage, round(sum(neg::DOUBLE * (cp - pos / 2)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 4) AS roc_auc,
  round(sum(pos * (cp / (cp + cn))) / sum(pos), 4) AS pr_auc FROM gw GROUP BY 1),
report AS (SELECT stage, tn, fp, fn, tp, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 4)
  AS balanced_accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
  round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, roc_auc, pr_auc, threshold FROM cm JOIN rk USING (stage)),
kc AS (SELECT DISTINCT band AS c FROM {source} WHERE split IN ('train', 'test')),
pc AS (SELECT c, count(*) FILTER (truth = c) AS support, count(*) FILTER (guess = c) AS predicted,
  count(*) FILTER (truth = c AND guess = c) AS hit FROM kc, pr_m GROUP BY 1),
multi AS (SELECT round(avg(coalesce(2 * hit / nullif(support + predicted, 0), 0)), 4) AS macro_f1,
  round(sum(support * coalesce(2 * hit / nullif(support + predicted, 0), 0)) / sum(support), 4) AS weighted_f1 FROM pc)"""


@query(f"""
{SPLIT_LINES}, top AS (SELECT planted AS p FROM sp WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT split, planted AS y, CAST(p AS DOUBLE) AS score, count(*) AS n FROM sp, top WHERE split <> 'train' GROUP BY 1, 2, 3
""")
def majority(spark: SparkSession, sf: str) -> DataFrame:
    data = R.line_table(spark, sf)
    scored = Majority().fit(split_of(data, "train"))(data.where(F.col("split") != "train"))
    return scored.groupBy("split", "y", "score").agg(F.count("*").alias("n"))


@query(f"""
{FOLDS}, ft AS (SELECT 0 AS g, * FROM z WHERE split = 'train'), te AS (SELECT 0 AS g, h AS id, * FROM z WHERE split = 'test'),
{bayes_sql('ft', 'te', 'g')}
SELECT y, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n, round(avg(score), 4) AS mean_score FROM pr GROUP BY 1, 2
""")
def gaussian_nb(spark: SparkSession, sf: str) -> DataFrame:
    data = R.line_table(spark, sf)
    scored = GaussianBayes().fit(split_of(data, "train"))(split_of(data, "test"))
    pred = (F.col("score") >= 0.5).cast("int").alias("pred")
    return scored.groupBy("y", pred).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def fold_counts(oof: DataFrame) -> DataFrame:
    return oof.groupBy("fold", "y", "pred").agg(F.count("*").alias("n"))


@query(f"""
{FOLDS}, o AS (SELECT f.fold, t.y, count(*) AS n FROM fo t JOIN range(5) r(f2) ON t.fold <> r.f2
  JOIN (SELECT CAST(i AS INTEGER) AS fold FROM range(5) q(i)) f ON f.fold = r.f2 GROUP BY 1, 2),
top AS (SELECT fold, y AS p FROM o QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, y) = 1)
SELECT fold, y, p AS pred, count(*) AS n FROM fo JOIN top USING (fold) GROUP BY 1, 2, 3
""")
def oof_majority(spark: SparkSession, sf: str) -> DataFrame:
    train = split_of(R.line_table(spark, sf), "train")
    return fold_counts(label_folds(Majority(), out_of_fold(Majority(), train)))


@query(f"""
{FOLDS}, ft AS (SELECT CAST(r.i AS INTEGER) AS g, fo.* FROM fo JOIN range(5) r(i) ON fo.fold <> r.i),
te AS (SELECT fold AS g, h AS id, * FROM fo),
{bayes_sql('ft', 'te', 'g')}
SELECT g AS fold, y, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM pr GROUP BY 1, 2, 3
""")
def oof_gaussian_nb(spark: SparkSession, sf: str) -> DataFrame:
    train = split_of(R.line_table(spark, sf), "train")
    return fold_counts(label_folds(GaussianBayes(), out_of_fold(GaussianBayes(), train)))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) + CASE WHEN
  CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 4) AS INTEGER) % 20 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) AS x,
  CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 4) AS INTEGER) % 20 = 0 AS odd FROM embeddings),
r AS (SELECT vec_id AS id, x FROM v WHERE NOT odd),
kn AS (SELECT a.id, b.id AS nb, list_distance(a.x, b.x) AS d FROM r a JOIN r b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) <= 20),
kd AS (SELECT id, max(d) AS kd FROM kn GROUP BY 1),
rd AS (SELECT kn.id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM kn JOIN kd ON kd.id = nb GROUP BY 1),
own AS (SELECT kn.id, avg(b.lrd) / any_value(a.lrd) AS f FROM kn JOIN rd a ON a.id = kn.id JOIN rd b ON b.id = nb GROUP BY 1),
cut AS (SELECT quantile_cont(f, 0.9) AS c FROM own),
qn AS (SELECT v.vec_id, r.id AS nb, list_distance(v.x, r.x) AS d FROM v, r
  QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY list_distance(v.x, r.x), r.id) <= 20),
qf AS (SELECT vec_id, avg(rd.lrd) * (avg(greatest(d, kd)) + 1e-10) AS f FROM qn JOIN kd ON kd.id = nb JOIN rd ON rd.id = nb GROUP BY 1)
SELECT vec_id, round(f - c, 4) AS score FROM qf, cut
""")
def lof(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.vectors(spark, sf)
    scored = LocalOutlierFactor().fit(rows)(rows.select("vec_id", "x"))
    return scored.select("vec_id", F.round("score", 4).alias("score"))


@query("""
WITH m AS (SELECT event_type, user_id % 5 AS site, count(*) AS n, avg(value) AS w FROM events GROUP BY 1, 2)
SELECT event_type, round(sum(w * n) / sum(n), 4) AS w, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1
""")
def fedavg_round(spark: SparkSession, sf: str) -> DataFrame:
    sites = R.events(spark, sf).groupBy("event_type", (F.col("user_id") % 5).alias("site"))
    models = sites.agg(F.count("*").alias("n"), F.avg("value").alias("w"))
    return weighted_average(models, "w", "n", ["event_type"]).withColumn("w", F.round("w", 4))


# ---- one summed gradient of a small network over all rows ----------------------------------------

_INPUTS = {"x0": "l_quantity / 50", "x1": "l_discount * 10", "x2": "l_tax * 10", "x3": "l_linenumber / 7.0::DOUBLE"}


def _network(targets: str) -> tuple[Network, np.ndarray]:
    net = Network([4, 3, 2 if targets == "class" else 4], targets)
    return net, np.random.default_rng(5).normal(size=(1, net.size))  # no row lies on an edge of a unit


def network_sql(targets: str) -> str:
    """The mean gradient of the network, spelt out parameter by parameter."""
    net, params = _network(targets)
    (w1, b1), (w2, b2) = net.layers(params[0])
    (n_in, n_mid), n_out = w1.shape, len(b2)

    def line(weights: np.ndarray, names: str, bias: float = 0.0) -> str:
        return " + ".join([*(f"{w}::DOUBLE * {names}{i}" for i, w in enumerate(weights)), f"{bias}::DOUBLE"])

    hidden = ", ".join(f"greatest({line(w1[:, j], 'x', b1[j])}, 0) AS h{j}" for j in range(n_mid))
    out = ", ".join(f"{line(w2[:, j], 'h', b2[j])} AS z{j}" for j in range(n_out))
    if targets == "class":
        total = " + ".join(f"exp(z{j})" for j in range(n_out))
        delta = ", ".join(f"exp(z{j}) / ({total}) - CAST(planted = {j} AS INTEGER) AS d{j}" for j in range(n_out))
    else:
        delta = ", ".join(f"(z{j} - x{j}) / {n_in} AS d{j}" for j in range(n_out))
    back = ", ".join(f"({line(w2[i], 'd')}) * CAST(h{i} > 0 AS INTEGER) AS e{i}" for i in range(n_mid))
    sums = [f"avg(x{i} * e{j})" for i in range(n_in) for j in range(n_mid)] + [f"avg(e{j})" for j in range(n_mid)]
    sums += [f"avg(h{i} * d{j})" for i in range(n_mid) for j in range(n_out)] + [f"avg(d{j})" for j in range(n_out)]
    inputs = ", ".join(f"{v} AS {k}" for k, v in _INPUTS.items())
    return f"""
WITH {LI}, a AS (SELECT planted, {inputs} FROM li), b AS (SELECT *, {hidden} FROM a), c AS (SELECT *, {out} FROM b),
d AS (SELECT *, {delta} FROM c), e AS (SELECT *, {back} FROM d), g AS (SELECT [{', '.join(sums)}] AS v FROM e)
SELECT unnest(range(len(v))) AS parameter, round(unnest(v), 6) + 0 AS gradient FROM g"""


def network_gradient(spark: SparkSession, sf: str, targets: str) -> DataFrame:
    net, params = _network(targets)
    inputs = [F.expr(v.replace("::DOUBLE", "D")).cast("double") for v in _INPUTS.values()]
    rows = R.lines(spark, sf).select(F.array(*inputs).alias("x"), F.col("planted").alias("t"), F.lit(-1).alias("fold"))
    total, _, n = summed(rows, net, params, True, False)
    made = [(i, float(round(v, 6)) + 0.0) for i, v in enumerate(total[0] / n[0])]
    return spark.createDataFrame(made, "parameter bigint, gradient double")


@query(network_sql("class"))
def mlp_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return network_gradient(spark, sf, "class")


@query(network_sql("input"))
def autoencoder_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return network_gradient(spark, sf, "input")


def exact_sql(strategy: str) -> str:
    """The report of a detector that recovers the planted target, which two features determine, without an error."""
    return f"""
{FOLDS}, st AS (SELECT split AS stage, y FROM z WHERE split <> 'train' UNION ALL SELECT 'cv', y FROM fo)
SELECT '{strategy}' AS strategy, stage, count(*) FILTER (y = 0) AS tn, 0::BIGINT AS fp, 0::BIGINT AS fn, sum(y)::BIGINT AS tp,
  1.0::DOUBLE AS balanced_accuracy, 1.0::DOUBLE AS f1, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall,
  1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS roc_auc, 1.0::DOUBLE AS pr_auc, 'lineitem' AS dataset,
  1.0::DOUBLE AS macro_f1, 1.0::DOUBLE AS weighted_f1 FROM st GROUP BY 2"""


def exact_report(spark: SparkSession, sf: str, detector: Detector) -> DataFrame:
    """The report without what depends on the fit beyond its predictions."""
    return R.detector_report(spark, sf, detector).drop("threshold", "params", "strategy_type")


# ---- detectors: validation and test metrics ------------------------------------------------------


@query(f"""
{FOLDS}, zi AS (SELECT *, h AS id FROM z), fi AS (SELECT *, h AS id FROM fo), {report_sql('zi', 'fi')}
SELECT report.*, multi.*, '{{}}' AS params, 'supervised' AS strategy_type, 'lineitem' AS dataset, 'gaussian_nb' AS strategy
FROM report, multi
""")
def gaussian_nb_report(spark: SparkSession, sf: str) -> DataFrame:
    return R.detector_report(spark, sf, GaussianBayes())


@query()
def logistic(spark: SparkSession, sf: str) -> DataFrame:
    return R.detector_report(spark, sf, Logistic())


@query()
def svm_platt(spark: SparkSession, sf: str) -> DataFrame:
    return R.detector_report(spark, sf, PlattSvm(rounds=30))


@query()
def mlp(spark: SparkSession, sf: str) -> DataFrame:
    return R.detector_report(spark, sf, Mlp())


@query(exact_sql("random_forest"))
def forest(spark: SparkSession, sf: str) -> DataFrame:
    return exact_report(spark, sf, Forest())


@query(exact_sql("extra_trees"))
def extra_trees(spark: SparkSession, sf: str) -> DataFrame:
    return exact_report(spark, sf, ExtraTrees())


@query(exact_sql("hist_gb"))
def hist_boost(spark: SparkSession, sf: str) -> DataFrame:
    return exact_report(spark, sf, HistBoost(rounds=10))


@query(exact_sql("xgboost"))
def second_order_boost(spark: SparkSession, sf: str) -> DataFrame:
    return exact_report(spark, sf, SecondOrderBoost(rounds=10))


@query()
def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    return R.detector_report(spark, sf, IsolationForest())


@query()
def autoencoder(spark: SparkSession, sf: str) -> DataFrame:
    return R.detector_report(spark, sf, Autoencoder())


@query()
def fedavg_full(spark: SparkSession, sf: str) -> DataFrame:
    return R.detector_report(spark, sf, FederatedSgd(rounds=5))


@query()
def fedavg_oof(spark: SparkSession, sf: str) -> DataFrame:
    train = split_of(R.line_table(spark, sf), "train")
    detector = FederatedSgd(rounds=2)
    oof = label_folds(detector, out_of_fold(detector, train))
    return M.binary_rates(M.confusion_binary(oof, "y", "pred", ["fold"]))


@query()
def fedavg_multi(spark: SparkSession, sf: str) -> DataFrame:
    data = R.line_table(spark, sf)
    return multiclass_tables(FederatedSgd(rounds=5), split_of(data, "train"), split_of(data, "test"))["per_class"]


# ---- benchmarks ----------------------------------------------------------------------------------


def write_line_artifact(spark: SparkSession, sf: str, name: str, target: str, base: str | None = None) -> str:
    """A leak-free artifact of lineitem, scaled on train."""
    family = F.when(F.col("planted") == 1, "malware").otherwise("benign")
    rows = R.split_lines(spark, sf, target).withColumn("family", family)
    rows = rows.select(*R.LINE_FEATURES, "planted", "band", "family", "split")
    scaled = Scaler.fit(rows.where(in_train()), R.LINE_FEATURES).transform(rows)
    base = base or staging_path(spark, f"artifact-{name}")
    written = A.write_rows(remove_overlaps(scaled, R.LINE_FEATURES), base)
    A.write_metadata(spark, line_artifact(written, name), base)
    return base


@query()
def benchmark_one(spark: SparkSession, sf: str) -> DataFrame:
    """The full protocol on one artifact, written to the results folder and read back."""
    results = staging_path(spark, "results")
    base = write_line_artifact(spark, sf, "lines", "planted")
    run_benchmark(spark, base, GaussianBayes(), results)
    return read_results(spark, results, "binary").join(
        read_results(spark, results, "multiclass").select("dataset", "strategy", "macro_f1"),
        ["dataset", "strategy"],
    )


def kept_sql(target: str, tag: str) -> str:
    """CTE ``sc<tag>``: the rows of ``write_line_artifact`` as a source of ``report_sql``."""
    scaled = _SCALED.replace("FROM sp", f"FROM sp{tag}")
    columns = ", ".join(R.LINE_FEATURES)
    return f"""{sql_split('li', target, LINE_HASH, f'sp{tag}')},
ke{tag} AS (SELECT *, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS sn FROM sp{tag}
  QUALIFY sn = min(sn) OVER (PARTITION BY {columns})),
sc{tag} AS (SELECT planted AS y, band, split, {LINE_HASH} AS id, {scaled} FROM ke{tag})"""


def _majority_sql(tag: str) -> str:
    """Test rows of the majority strategy on ``sc<tag>``: f1, balanced accuracy and macro F1."""
    return f"""mj{tag} AS (SELECT (SELECT y FROM sc{tag} WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p,
  (SELECT band FROM sc{tag} WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS b),
mt{tag} AS (SELECT sum(y) AS pos, count(*) AS n, any_value(p) AS p, count(DISTINCT band) AS k,
  2 * count(*) FILTER (band = b) / (count(*) + count(*) FILTER (band = b)) AS f FROM sc{tag}, mj{tag} WHERE split = 'test'),
ml{tag} AS (SELECT round(CASE WHEN p = 1 THEN 2 * pos / (pos + n) ELSE 0 END, 4) AS f1, 0.5::DOUBLE AS balanced_accuracy,
  round(f / k, 4) AS macro_f1 FROM mt{tag})"""


_BOARD = ["planted", "band"]


def _board_sql() -> str:
    """One statement per table, as the protocol's CTE names repeat."""
    parts, columns = [], []
    for t in _BOARD:
        body = f"""WITH {LI}, {kept_sql(t, '_k')}, {report_sql('sc_k')}, {_majority_sql('_k')}
SELECT 'gaussian_nb' AS strategy, f1, balanced_accuracy, macro_f1 FROM report, multi WHERE stage = 'test'
UNION ALL SELECT 'dummy', f1, balanced_accuracy, macro_f1 FROM ml_k"""
        parts.append(f"t_{t} AS ({body})")
        columns += [f'{t}.{m} AS "lines-{t}_{m}"' for m in ("f1", "balanced_accuracy", "macro_f1")]
    tables = " JOIN ".join(f"t_{t} AS {t}" + (" USING (strategy)" if i else "") for i, t in enumerate(_BOARD))
    return f"WITH {', '.join(parts)} SELECT strategy, {', '.join(columns)} FROM {tables}"


@query(_board_sql())
def benchmark_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Two strategies on two artifacts that are built on demand, results written, leaderboard read back from them."""
    results = staging_path(spark, "results")
    bases = {t: staging_path(spark, f"artifact-{t}") for t in _BOARD}
    build = {bases[t]: partial(write_line_artifact, spark, sf, f"lines-{t}", t, bases[t]) for t in _BOARD}
    run_all(spark, list(bases.values()), [Majority(), GaussianBayes()], results, build)
    return stored_leaderboard(spark, results, [f"lines-{t}" for t in _BOARD])


_FLOW_NAMES = ["f1", "f2", "f3", "f4"]
_FLOW_SCALED = ", ".join(
    f"(f{i} - (SELECT avg(f{i}) FROM kept WHERE split = 'train')) / "
    f"(SELECT stddev_pop(f{i}) FROM kept WHERE split = 'train') AS f{i}"
    for i in range(1, 5)
)


@query(f"""
{FLOW_SQL}, zk AS (SELECT y, l_returnflag AS band, split, {LINE_HASH} AS id, {_FLOW_SCALED} FROM kept),
{report_sql('zk', names=_FLOW_NAMES)}
SELECT report.*, multi.* FROM report, multi
""")
def files_to_detector(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job: CSV files, cleaning, split, leak control, scaling, artifact, detector, stored results."""
    raw, base, results = (staging_path(spark, n) for n in ("flow-files", "artifact", "results"))
    for i in range(3):
        part = R.raw_flows(spark, sf).where(F.col("l_orderkey") % 3 == i)
        part.write.option("header", True).csv(f"{raw}/Merged{i}.csv")
    build = partial(prepare_files, spark, R.FLOW_DEMO, f"{raw}/Merged*.csv", base)
    run_benchmark(spark, base, GaussianBayes(), results, rebuild=build)
    multi = read_results(spark, results, "multiclass").select("strategy", "macro_f1", "weighted_f1")
    binary = read_results(spark, results, "binary").where("stage <> 'cv'")
    columns = "stage tn fp fn tp balanced_accuracy f1 precision recall accuracy roc_auc pr_auc threshold".split()
    return binary.join(multi, "strategy").select(*columns, "macro_f1", "weighted_f1")


@query()
def benchmark_all(spark: SparkSession, sf: str) -> DataFrame:
    bases = [write_line_artifact(spark, sf, f"lines-{t}", t) for t in ("planted", "band")]
    return run_all(spark, bases, Majority())


@query()
def cross_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Train on lineitem, test on events with the same five columns; a third table with too few
    common columns is skipped and counted."""
    names = [f"f{i}" for i in range(1, 6)]
    li = R.split_lines(spark, sf).select(
        "split",
        *[F.col(n).alias(f"f{i + 1}") for i, n in enumerate(R.LINE_FEATURES)],
        F.col("l_linenumber").cast("double").alias("f5"),
        "planted",
        "band",
    )
    ev = R.events(spark, sf).select(
        F.lit("test").alias("split"),
        (F.col("k") / 2).alias("f1"),
        (F.col("value") * 100).alias("f2"),
        (F.col("k") % 11 / 100).alias("f3"),
        (F.col("user_id") % 9 / 100).alias("f4"),
        (F.col("user_id") % 7 + 1).cast("double").alias("f5"),
        ((F.col("k") > 80) & (F.col("k") % 11 >= 5)).cast("int").alias("attack"),
        F.when(F.col("k") < 34, "low").when(F.col("k") < 68, "mid").otherwise("high").alias("kind"),
    )
    source = {"feature_columns": names, "target_binary": "planted", "target_multiclass": "band", "dataset": "lines"}
    near = {"feature_columns": names, "target_binary": "attack", "target_multiclass": "kind", "dataset": "events"}
    far = near | {"feature_columns": names[:3], "dataset": "few"}
    results = staging_path(spark, "results")
    _, skipped = cross_evaluate(GaussianBayes(), (li, source), [(ev, near), (ev, far)], results=results)
    return read_results(spark, results, "binary").withColumn("skipped", F.lit(skipped))
