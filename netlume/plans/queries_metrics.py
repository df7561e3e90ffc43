"""Registered queries: binary, multiclass and per-attack metrics, artifacts, audit, leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlume.operators import metrics as M
from netlume.operators.leakage import remove_overlaps
from netlume.operators.sampling import with_folds
from netlume.plans import frames as R
from netlume.plans.benchmark import leaderboard as rank_strategies
from netlume.plans.prepare import prepare, write_prepared
from netlume.plans.queries_data import EDGE_SQL, EV, LI, SPLIT_LINES, _overlap_sql, split_counts
from netlume.sources import artifact as A
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


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    """y, score = value, pred = value > 30, and the parity of the user as a group."""
    return R.events(spark, sf).select(
        "event_id",
        "event_type",
        "y",
        F.col("value").alias("score"),
        (F.col("value") > 30).cast("int").alias("pred"),
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("part"),
    )


SC = f"""{EV}, sc AS (SELECT event_id, event_type, y, value AS score,
  CASE WHEN value > 30 THEN 1 ELSE 0 END AS pred, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS part FROM ev)"""
CM = f"""{SC}, cm AS (SELECT part, CAST(sum((1 - y) * (1 - pred)) AS BIGINT) AS tn, CAST(sum((1 - y) * pred) AS BIGINT) AS fp,
  CAST(sum(y * (1 - pred)) AS BIGINT) AS fn, CAST(sum(y * pred) AS BIGINT) AS tp FROM sc GROUP BY part)"""


@query(f"WITH {CM} SELECT part, tn, fp, fn, tp FROM cm")
def confusion_binary(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion_binary(scored_events(spark, sf), "y", "pred", ["part"])


@query(f"""
WITH {CM} SELECT part, tn, fp, fn, tp, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) AS balanced_accuracy,
  round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
  round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy FROM cm
""")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.binary_rates(M.confusion_binary(scored_events(spark, sf), "y", "pred", ["part"]))


def _ranking_sql(source: str, part: str, y: str, score: str) -> str:
    return f"""g AS (SELECT {part} AS part, {score} AS s, sum({y}) AS pos, sum(1 - {y}) AS neg FROM {source} GROUP BY 1, 2),
w AS (SELECT *, sum(pos) OVER o AS cp, sum(neg) OVER o AS cn FROM g
  WINDOW o AS (PARTITION BY part ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"""
WITH {SC}, {_ranking_sql('sc', 'part', 'y', 'score')}
SELECT part, round(sum(neg::DOUBLE * (cp - pos / 2)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 4) AS roc_auc FROM w GROUP BY 1
""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return M.ranking_metrics(scored_events(spark, sf), "y", "score", ["part"]).select("part", "roc_auc")


@query(f"""
WITH {LI}, {_ranking_sql('li', 'l_linestatus', 'planted', 'l_extendedprice')}
SELECT part, round(sum(pos * (cp / (cp + cn))) / sum(pos), 4) AS pr_auc FROM w GROUP BY 1
""")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.lines(spark, sf).withColumnRenamed("l_linestatus", "part")
    return M.ranking_metrics(rows, "planted", "l_extendedprice", ["part"]).select("part", "pr_auc")


@query(f"""
WITH {EV}, sk AS (SELECT event_type, CASE WHEN value > 30 THEN 1 ELSE 0 END AS pred, k FROM ev),
{_ranking_sql('sk', 'event_type', 'pred', 'k')}
SELECT part, round(sum(neg::DOUBLE * (cp - pos / 2)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0), 4) AS roc_auc,
  round(sum(pos * (cp / (cp + cn))) / sum(pos), 4) AS pr_auc FROM w GROUP BY 1
""")
def ranking_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Both ranking metrics by event type, from a prefix scan over 32 sorted ranges of scores."""
    pred = (F.col("value") > 30).cast("int").alias("pred")
    rows = R.events(spark, sf).select(F.col("event_type").alias("part"), pred, "k")
    return M.ranking_metrics(rows, "pred", "k", ["part"], ranges=32)


_GRID_SQL = f"""
WITH {EV}, c AS (SELECT y, k / 100.0::DOUBLE AS score FROM ev), t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(10, 91, 5) r(i)),
m AS (SELECT threshold, CAST(sum(CASE WHEN score >= threshold THEN y ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN score >= threshold THEN 1 - y ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN score < threshold THEN y ELSE 0 END) AS BIGINT) AS fn FROM c, t GROUP BY 1),
f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1 FROM m)"""


@query(f"{_GRID_SQL} SELECT threshold, tp, fp, fn, round(f1, 4) AS f1 FROM f")
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.events(spark, sf).select("y", (F.col("k") / 100).alias("score"))
    return M.threshold_counts(rows, "y", "score", M.THRESHOLD_GRID).withColumn("f1", F.round("f1", 4))


@query(f"{_GRID_SQL} SELECT threshold, round(f1, 4) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1")
def best_threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.events(spark, sf).select("y", (F.col("k") / 100).alias("score"))
    return M.best_threshold(rows, "y", "score", M.THRESHOLD_GRID)


@query(f"""
WITH {SC}, q AS (SELECT unnest(quantile_cont(score, {M.PERCENTILE_GRID})) AS threshold FROM sc),
m AS (SELECT threshold, sum(CASE WHEN score >= threshold THEN y ELSE 0 END) AS tp,
  sum(CASE WHEN score >= threshold THEN 1 - y ELSE 0 END) AS fp,
  sum(CASE WHEN score < threshold THEN y ELSE 0 END) AS fn FROM sc, q GROUP BY 1),
f AS (SELECT threshold, 2 * tp / (2 * tp + fp + fn) AS f1 FROM m)
SELECT round(threshold, 6) AS threshold, round(f1, 4) AS f1 FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1
""")
def best_threshold_pct(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_events(spark, sf)
    best = M.best_threshold(rows, "y", "score", M.score_percentiles(rows, "score"))
    return best.withColumn("threshold", F.round("threshold", 6))


@query(f"""
WITH {EV}, r AS (SELECT event_id, value, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', event_id, '42'))) AS rn,
  count(*) OVER (PARTITION BY y) AS n FROM ev),
f AS (SELECT event_id, value, CAST(rn > n // 5 AS INTEGER) + CAST(rn > n * 2 // 5 AS INTEGER) + CAST(rn > n * 3 // 5 AS INTEGER)
  + CAST(rn > n * 4 // 5 AS INTEGER) AS fold FROM r),
p AS (SELECT fold, quantile_cont(value, 0.9) AS cut FROM f GROUP BY 1)
SELECT event_id, fold, CASE WHEN value >= cut THEN 1 ELSE 0 END AS pred FROM f JOIN p USING (fold)
""")
def fold_p90(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_folds(R.hashed_events(spark, sf), "y", "_h").select("event_id", "fold", "value")
    return M.cut_per_group(rows, "value", 0.9, ["fold"]).select("event_id", "fold", "pred")


CLASSES = ["A", "N", "R", "T", "X"]  # X is only predicted, T occurs on neither side


def banded_lines(spark: SparkSession, sf: str) -> DataFrame:
    pred = F.when(F.col("l_quantity") < 15, "A").when(F.col("l_quantity") < 30, "N")
    pred = pred.when(F.col("l_quantity") < 45, "R").otherwise("X")
    return R.lines(spark, sf).select(F.col("l_returnflag").alias("t"), pred.alias("p"))


PC = f"""WITH {LI}, b AS (SELECT l_returnflag AS t, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 30 THEN 'N'
  WHEN l_quantity < 45 THEN 'R' ELSE 'X' END AS p FROM li),
c AS (SELECT unnest({CLASSES}) AS class),
s AS (SELECT class, (SELECT count(*) FROM b WHERE t = class) AS support, (SELECT count(*) FROM b WHERE p = class) AS predicted,
  (SELECT count(*) FROM b WHERE p = class AND t = class) AS tp FROM c),
f AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re,
  coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f FROM s)"""


@query(f"{PC} SELECT class, round(pr, 4) AS precision, round(re, 4) AS recall, round(f, 4) AS f1, support FROM f")
def per_class(spark: SparkSession, sf: str) -> DataFrame:
    return M.per_class_report(M.per_class(banded_lines(spark, sf), "t", "p", CLASSES))


@query(f"""
{PC} SELECT round(avg(re) FILTER (WHERE support > 0), 4) AS balanced_accuracy, round(avg(f), 4) AS macro_f1,
  round(sum(f * support) / sum(support), 4) AS weighted_f1, round(sum(tp) / sum(support), 4) AS accuracy FROM f
""")
def macro_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return M.multiclass_summary(M.per_class(banded_lines(spark, sf), "t", "p", CLASSES))


@query(
    f"{PC} SELECT class AS true_class, "
    + ", ".join(f"(SELECT count(*) FROM b WHERE t = class AND p = '{p}') AS \"pred_{p}\"" for p in CLASSES)
    + " FROM c"
)
def confusion_multi(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion_matrix(banded_lines(spark, sf), "t", "p", CLASSES)


@query(f"{PC} SELECT t AS true_class, p AS pred_class, count(*) AS n FROM b GROUP BY 1, 2")
def confusion_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion_long(banded_lines(spark, sf), "t", "p")


@query(f"""
WITH {SC} SELECT event_type AS attack_type, count(*) AS support, CAST(sum(pred) AS BIGINT) AS detected,
  round(avg(pred), 4) AS recall FROM sc GROUP BY 1
""")
def per_attack(spark: SparkSession, sf: str) -> DataFrame:
    return M.per_attack(scored_events(spark, sf), "event_type", "pred")


@query(f"""
WITH {EV}, d AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, y, value, k FROM ev),
p AS (SELECT dataset, 'k_cut' AS strategy, y, CASE WHEN k > 50 THEN 1 ELSE 0 END AS pred FROM d
  UNION ALL SELECT dataset, 'value_cut', y, CASE WHEN value > 30 THEN 1 ELSE 0 END FROM d),
m AS (SELECT dataset, strategy, sum(y * pred) AS tp, sum((1 - y) * pred) AS fp, sum(y * (1 - pred)) AS fn,
  sum((1 - y) * (1 - pred)) AS tn FROM p GROUP BY 1, 2),
r AS (SELECT dataset, strategy, round(2 * tp / (2 * tp + fp + fn), 4) AS f1,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) AS ba,
  round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 4) AS mf FROM m)
SELECT strategy, max(f1) FILTER (WHERE dataset = 'even') AS even_f1, max(ba) FILTER (WHERE dataset = 'even') AS even_balanced_accuracy,
  max(mf) FILTER (WHERE dataset = 'even') AS even_macro_f1, max(f1) FILTER (WHERE dataset = 'odd') AS odd_f1,
  max(ba) FILTER (WHERE dataset = 'odd') AS odd_balanced_accuracy, max(mf) FILTER (WHERE dataset = 'odd') AS odd_macro_f1
FROM r GROUP BY 1
""")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    strategies = F.array(
        F.struct(F.lit("k_cut").alias("strategy"), (F.col("k") > 50).cast("int").alias("pred")),
        F.struct(F.lit("value_cut").alias("strategy"), (F.col("value") > 30).cast("int").alias("pred")),
    )
    part = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    rows = R.events(spark, sf).select(part.alias("dataset"), "y", F.inline(strategies))
    keys = ["dataset", "strategy"]
    binary = M.binary_rates(M.confusion_binary(rows, "y", "pred", keys)).withColumn("stage", F.lit("test"))
    # with two classes the macro F1 is the mean of the F1 of either class
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    macro = (M.ratio(2 * tp, 2 * tp + fp + fn) + M.ratio(2 * tn, 2 * tn + fp + fn)) / 2
    multi = binary.select(*keys, F.round(macro, 4).alias("macro_f1"))
    return rank_strategies(binary, multi, ["even", "odd"])


# ---- artifacts -----------------------------------------------------------------------------------


@query(f"{EDGE_SQL} SELECT split, y, n, CAST(2 + (SELECT count(DISTINCT f3) FROM ok) AS BIGINT) AS features FROM t")
def artifact_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    base = staging_path(spark, "artifact")
    rows, facts = prepare(R.raw_edge(spark, sf), R.EDGE_DEMO)
    write_prepared(rows, facts, R.EDGE_DEMO, base)
    read, meta = A.load_artifact(spark, base)
    counts = split_counts(read, meta["target_binary"])
    return counts.withColumn("features", F.lit(meta["feature_count"]).cast("bigint"))


def line_artifact(rows: DataFrame, name: str) -> dict:
    """Metadata of unscaled lineitem splits with a family that follows the planted target."""
    features = R.LINE_FEATURES
    zero, one = [0.0] * len(features), [1.0] * len(features)
    scaler = {"mean": zero, "scale": one, "columns": features}
    mapping = {"0": "Normal", "1": "Attack"}
    return A.build_metadata(rows, name, features, ("planted", "band", "family"), scaler, mapping)


def artifact_lines(spark: SparkSession, sf: str) -> DataFrame:
    family = F.when(F.col("planted") == 1, "malware").otherwise("benign")
    rows = R.split_lines(spark, sf).withColumn("family", family)
    return rows.select(*R.LINE_FEATURES, "planted", "band", "family", "split")


_GAPS = "SELECT * REPLACE (CASE WHEN l_orderkey % 1000 <> 0 THEN l_tax END AS l_tax) FROM sp"
_LINE_COLUMNS = ", ".join(R.LINE_FEATURES)
_CHECK_SQL = " UNION ALL ".join(
    [
        f"SELECT '{n}' AS check_name, true AS ok"
        for n in (
            "metadata_keys",
            "artifact_schema",
            "preprocess_version",
            "family_classes",
            "columns_present",
            "targets_not_features",
        )
    ]
    + [
        f"SELECT '{s}:{n}', {ok}"
        for s in ("train", "val", "test")
        for n, ok in (
            ("row_count", "true"),
            ("no_missing", f"(SELECT count(*) FROM g WHERE split = '{s}' AND l_tax IS NULL) = 0"),
            ("finite", "true"),
            ("target_planted", f"(SELECT count(*) FROM g WHERE split = '{s}' AND planted IS NULL) = 0"),
            ("target_band", f"(SELECT count(*) FROM g WHERE split = '{s}' AND band IS NULL) = 0"),
            ("target_family", "true"),
        )
    ]
    + [f"SELECT 'overlap:{p}', (SELECT {p} FROM ov) = 0" for p in ("train_val", "train_test", "val_test")]
)


@query(f"{SPLIT_LINES}, g AS ({_GAPS}), ov AS (SELECT {_overlap_sql(_LINE_COLUMNS, 'g')}) {_CHECK_SQL}")
def artifact_checks(spark: SparkSession, sf: str) -> DataFrame:
    family = F.when(F.col("planted") == 1, "malware").otherwise("benign")
    gap = F.when(F.col("l_orderkey") % 1000 != 0, F.col("l_tax"))
    rows = R.split_lines(spark, sf).withColumns({"family": family, "l_tax": gap})
    rows = rows.select(*R.LINE_FEATURES, "planted", "band", "family", "split")
    checks = A.check_table(spark, A.artifact_checks(rows, line_artifact(rows, "gaps")))
    return checks.select(F.col("check").alias("check_name"), "ok")


@query("""
WITH n AS (SELECT count(*) AS n FROM lineitem)
SELECT 'absent' AS step, false AS ready, 0::BIGINT AS n UNION ALL SELECT 'built', true, n FROM n
UNION ALL SELECT 'stale', false, n FROM n UNION ALL SELECT 'rebuilt', true, n FROM n
""")
def artifact_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    base = staging_path(spark, "artifact")
    steps = [("absent", A.is_ready(spark, base), 0)]

    def build() -> None:
        rows = A.write_rows(artifact_lines(spark, sf), base)
        A.write_metadata(spark, line_artifact(rows, "lines"), base)

    rows, meta = A.load_artifact(spark, base, build, validate=False)
    steps.append(("built", A.is_ready(spark, base), rows.count()))
    A.write_metadata(spark, meta | {"preprocess_version": A.PREPROCESS_VERSION - 1}, base)
    steps.append(("stale", A.is_ready(spark, base), A.read_rows(spark, base).count()))
    rows, _ = A.load_artifact(spark, base, build, validate=False)
    steps.append(("rebuilt", A.is_ready(spark, base), rows.count()))
    return spark.createDataFrame(steps, "step string, ready boolean, n bigint")


def _audit_sql(name: str, source: str) -> str:
    def rows(s: str) -> str:
        return f"(SELECT count(*) FROM {source} WHERE split = '{s}') AS {s}_rows"

    return f"""SELECT '{name}' AS dataset, CAST(5 AS BIGINT) AS preprocess_version, CAST(4 AS BIGINT) AS feature_count,
  {rows('train')}, {rows('val')}, {rows('test')}, 'benign,malware' AS family_classes,
  {_overlap_sql(_LINE_COLUMNS, source)}"""


@query(f"""
{SPLIT_LINES}, o AS (SELECT *, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS sn FROM sp),
kept AS (SELECT * FROM o QUALIFY sn = min(sn) OVER (PARTITION BY {_LINE_COLUMNS})),
a AS ({_audit_sql('leaky', 'sp')} UNION ALL {_audit_sql('clean', 'kept')})
SELECT a.*, CAST((train_val > 0)::INTEGER + (train_test > 0)::INTEGER + (val_test > 0)::INTEGER AS BIGINT)
  AS failed_checks, train_val + train_test + val_test = 0 AS clean FROM a
""")
def audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = artifact_lines(spark, sf)
    bases = []
    for name, table in (("leaky", rows), ("clean", remove_overlaps(rows, R.LINE_FEATURES))):
        base = staging_path(spark, f"artifact-{name}")
        A.write_metadata(spark, line_artifact(A.write_rows(table, base), name), base)
        bases.append(base)
    return A.audit(spark, bases)
