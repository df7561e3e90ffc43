"""Registered queries: scans, cleaning, sampling, leakage control, transformers, preparation.

Every function takes (spark, sf_dir). ``SQL`` holds the same question for an independent engine.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlume.functions import columns as C
from netlume.functions.columns import c
from netlume.functions.taxonomy import EDGE, FLOW, TELEMETRY
from netlume.operators import leakage as L
from netlume.operators import sampling as S
from netlume.operators.transform import (
    LabelCodes,
    OneHot,
    Scaler,
    exact_medians,
    in_train,
    index_target,
    index_to_target,
    median_impute,
)
from netlume.plans import frames as R
from netlume.plans.prepare import numeric_columns, prepare
from netlume.sources.csv import FILE_COLUMN, scan_csv, scan_devices
from netlume.staging import stage, staging_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


EV = """ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events)"""
LI = """li AS (SELECT *, CAST(l_quantity AS INTEGER) AS q,
  CASE WHEN l_quantity > 40 AND l_discount >= 0.05 THEN 1 ELSE 0 END AS planted,
  CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'mid' ELSE 'high' END AS band
  FROM lineitem)"""
LINE_HASH = "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, q, '42'))"


def sql_split(source: str, target: str, hash_sql: str, name: str = "sp") -> str:
    """CTE with the 70/15/15 split by plain window ranks."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY {hash_sql}) AS rn,
  count(*) OVER (PARTITION BY {target}) AS n FROM {source}),
{name} AS (SELECT * EXCLUDE (rn, n), CASE WHEN rn <= n - 2 * ((n * 15 + 50) // 100) THEN 'train'
  WHEN rn <= n - (n * 15 + 50) // 100 THEN 'val' ELSE 'test' END AS split FROM {name}_r)"""


SPLIT_LINES = f"WITH {LI}, {sql_split('li', 'planted', LINE_HASH)}"


def split_columns(spark: SparkSession, sf: str, *columns: Column | str) -> DataFrame:
    """Some columns of lineitem with the split, written once for queries that read them in several passes."""
    return stage(R.split_lines(spark, sf).select(*columns, "split"), "split-columns")


# ---- sampling ------------------------------------------------------------------------------------


@query("SELECT event_type AS label, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return S.label_histogram(R.events(spark, sf), "event_type")


@query("""
WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)
SELECT label, n, round(least(1.0, greatest(1, (1000 * n) // (SELECT sum(n) FROM c))::DOUBLE / n), 6) AS rate FROM c
""")
def proportional_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = S.proportional_rates(S.label_histogram(R.events(spark, sf), "event_type"), 1000)
    return rates.withColumn("rate", F.round("rate", 6))


@query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT event_type, least(1.0, greatest(1, (1000 * n) // (SELECT sum(n) FROM c))::DOUBLE / n) AS rate FROM c),
s AS (SELECT event_id, event_type, user_id % 4 AS g,
  row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY md5(concat_ws('|', event_id, '42'))) AS rn,
  count(*) OVER (PARTITION BY user_id % 4, event_type) AS n FROM events)
SELECT g, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM s JOIN r USING (event_type)
WHERE rn <= CASE WHEN rate >= 1 THEN n ELSE greatest(1, floor(n * rate)) END GROUP BY 1, 2
""")
def stratified_sample_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.events(spark, sf).select("event_id", "event_type", (F.col("user_id") % 4).alias("g"))
    kept = S.sample_by_rate(rows, "event_type", 1000, "g", ["event_id"])
    return kept.groupBy("g", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query("""
WITH c AS (SELECT event_type, greatest(1, (1500 * count(*)) // (SELECT count(*) FROM events)) AS quota
  FROM events GROUP BY 1),
s AS (SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', event_id, '42'))) AS rn FROM events)
SELECT event_id, event_type FROM s JOIN c USING (event_type) WHERE rn <= quota
""")
def stratified_sample_quota(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.events(spark, sf).select("event_id", "event_type")
    return S.sample_by_quota(rows, "event_type", 1500, ["event_id"])


@query(f"""
WITH {EV}, {sql_split("ev", "event_type", "md5(concat_ws('|', event_id, '42'))")}
SELECT event_id, split FROM sp
""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.stratified_split(R.hashed_events(spark, sf), "event_type", "_h").select("event_id", "split")


def _parts_sql(k: int, seed: int, out: str, stratum: str) -> str:
    steps = " + ".join(f"CAST(rn > n * {i} // {k} AS INTEGER)" for i in range(1, k))
    return f"""WITH {EV}, r AS (SELECT event_id,
  row_number() OVER (PARTITION BY {stratum} ORDER BY md5(concat_ws('|', event_id, '{seed}'))) AS rn,
  count(*) OVER (PARTITION BY {stratum}) AS n FROM ev)
SELECT event_id, {steps} AS {out} FROM r"""


@query(_parts_sql(5, 42, "fold", "y"))
def kfold(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_folds(R.hashed_events(spark, sf), "y", "_h").select("event_id", "fold")


@query(_parts_sql(5, 7, "site", "event_type"))
def site_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.hashed_events(spark, sf, seed=7)
    return S.stratified_parts(rows, "event_type", "_h", 5, "site").select("event_id", "site")


@query(f"""
WITH {EV} SELECT event_id FROM ev WHERE y = 0
QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', event_id, '42'))) <= 3000
""")
def benign_subsample(spark: SparkSession, sf: str) -> DataFrame:
    return S.benign_subsample(R.hashed_events(spark, sf), "y", "_h", 3000).select("event_id")


# ---- cleaning ------------------------------------------------------------------------------------


@query(f"""
WITH {EV}, t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'bad' WHEN 1 THEN k || 'd'
  WHEN 2 THEN ' ' || k || ' ' WHEN 3 THEN k || 'e1' ELSE CAST(k AS VARCHAR) END AS txt FROM ev)
SELECT event_id, TRY_CAST(trim(txt) AS DOUBLE) AS number FROM t
""")
def numeric_coerce(spark: SparkSession, sf: str) -> DataFrame:
    k, turn = F.col("k").cast("string"), F.col("event_id") % 7
    text = F.when(turn == 0, "bad").when(turn == 1, F.concat(k, F.lit("d")))
    text = text.when(turn == 2, F.concat(F.lit(" "), k, F.lit(" "))).when(turn == 3, F.concat(k, F.lit("e1")))
    rows = R.events(spark, sf).select("event_id", text.otherwise(k).alias("txt"))
    return rows.select("event_id", C.to_number(F.col("txt")).alias("number"))


def _odd_values(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("event_id") % 10
    text = F.when(turn == 0, "inf").when(turn == 1, "-inf").when(turn == 2, "nan")
    text = text.otherwise(F.col("k").cast("string"))
    number = C.finite_or_null(C.to_number(text))
    return R.events(spark, sf).select("event_id", "value", number.alias("x"))


@query(f"WITH {EV} SELECT event_id, CASE WHEN event_id % 10 > 2 THEN CAST(k AS DOUBLE) END AS x FROM ev")
def invalid_to_null(spark: SparkSession, sf: str) -> DataFrame:
    return _odd_values(spark, sf).select("event_id", "x")


@query(f"WITH {EV} SELECT event_id, value, CAST(k AS DOUBLE) AS x FROM ev WHERE event_id % 10 > 2")
def clean_drop(spark: SparkSession, sf: str) -> DataFrame:
    return _odd_values(spark, sf).dropna()


@query("""
WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'nan' WHEN 2 THEN ' None'
  WHEN 3 THEN '<NA> ' WHEN 4 THEN '0.0' ELSE ' ' || event_type || ' ' END AS txt FROM events),
u AS (SELECT event_id, CASE WHEN trim(txt) NOT IN ('', 'nan', 'None', '<NA>') THEN trim(txt) END AS v FROM t)
SELECT event_id, coalesce(CASE WHEN v = '0.0' THEN '0' ELSE v END, '__missing__') AS category FROM u
""")
def categorical_clean(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("event_id") % 8
    text = F.when(turn == 0, " ").when(turn == 1, "nan").when(turn == 2, " None").when(turn == 3, "<NA> ")
    text = text.when(turn == 4, "0.0").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
    rows = R.events(spark, sf).select("event_id", C.text_or_null(text).alias("v"))
    return rows.select("event_id", C.fill_category(C.canonical_category(F.col("v"))).alias("category"))


@query("""
SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_type <> 'click' THEN 1 ELSE 0 END AS label_binary,
  CAST(CAST(event_id % 2 AS VARCHAR) AS INTEGER) AS label_text, lower(event_type) AS label_multi FROM events
""")
def target_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = R.events(spark, sf).select(
        "event_id",
        F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("name"),
        F.concat((F.col("event_id") % 2).cast("string"), F.lit(" ")).alias("flag"),
        F.concat(F.lit(" "), F.upper("event_type")).alias("padded"),
    )
    return raw.select(
        "event_id",
        C.is_attack(F.col("name"), "click").alias("label_binary"),
        C.binary_from_text(F.col("flag")).alias("label_text"),
        C.normal_label(F.col("padded")).alias("label_multi"),
    )


@query("SELECT event_id, value, 0 AS a_b_, 0 AS extra FROM events")
def select_align(spark: SparkSession, sf: str) -> DataFrame:
    train = C.sanitize_columns(R.events(spark, sf).select("event_id", "value", F.lit(1).alias("a[b>"), F.lit(2).alias("extra")))
    other = R.events(spark, sf).select("k", "value", "event_id")
    return C.align_columns(other, train.columns)


@query(f"""
WITH {EV}, t AS (SELECT CAST(k AS VARCHAR) AS a, CASE WHEN event_id % 100 = 0 THEN 'x' ELSE CAST(k AS VARCHAR) END AS b,
  CASE WHEN event_id % 3 = 0 THEN CAST(value AS VARCHAR) END AS d, event_type AS e FROM ev),
s AS (SELECT 'a' AS name, count(a) = count(TRY_CAST(a AS DOUBLE)) AS num FROM t
  UNION ALL SELECT 'b', count(b) = count(TRY_CAST(b AS DOUBLE)) FROM t
  UNION ALL SELECT 'd', count(d) = count(TRY_CAST(d AS DOUBLE)) FROM t
  UNION ALL SELECT 'e', count(e) = count(TRY_CAST(e AS DOUBLE)) FROM t)
SELECT name, CASE WHEN num THEN 'numeric' ELSE 'categorical' END AS kind FROM s
""")
def infer_types(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    rows = R.events(spark, sf).select(
        k.alias("a"),
        F.when(F.col("event_id") % 100 == 0, "x").otherwise(k).alias("b"),
        F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).alias("d"),
        F.col("event_type").alias("e"),
    )
    numeric = numeric_columns(rows, rows.columns)
    kinds = [(n, "numeric" if n in numeric else "categorical") for n in rows.columns]
    return spark.createDataFrame(kinds, "name string, kind string")


@query("""
SELECT event_id, CASE WHEN ok THEN CAST(month(ts) AS INTEGER) END AS month,
  CASE WHEN ok THEN CAST(day(ts) AS INTEGER) END AS day, CASE WHEN ok THEN CAST(hour(ts) AS INTEGER) END AS hour,
  CASE WHEN ok THEN CAST(minute(ts) AS INTEGER) END AS minute,
  CASE WHEN ok THEN CAST(second(ts) AS INTEGER) END AS second
FROM (SELECT *, event_id % 17 <> 0 AS ok FROM events)
""")
def time_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.events(spark, sf)
    date = F.when(F.col("event_id") % 17 == 0, "31-Feb-x").otherwise(F.date_format("ts", "d-MMM-yy"))
    text = rows.select("event_id", date.alias("date"), F.date_format("ts", " H:mm:ss  ").alias("time"))
    return text.select(
        "event_id", *[v.alias(n) for n, v in C.time_parts(C.event_time(F.col("date"), F.col("time"))).items()]
    )


def _sql_case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


_FLOW_EVENTS = {
    "click": "BENIGN",
    "view": "DDoS-ICMP_Flood",
    "error": "Recon-PingSweep",
    "purchase": "SqlInjection",
    "signup": "Backdoor_Malware",
}
_FAMILIES = {
    "flow": ["benign", "ddos_dos", "recon", "web_injection", "malware"],
    "edge": ["benign", "ddos_dos", "recon", "web_injection", "malware"],
    "telemetry": ["benign", "ddos_dos", "recon", "web_injection", "malware"],
}


@query(
    "WITH t AS ("
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {_sql_case('event_type', dict(zip(_FLOW_EVENTS, names)))} AS family FROM events"
        for kind, names in _FAMILIES.items()
    )
    + ") SELECT kind, family, count(*) AS n FROM t GROUP BY 1, 2"
)
def family_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.events(spark, sf)
    families = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), taxonomy.family(R.named("event_type", names)).alias("family"))
            for kind, taxonomy, names in (
                ("flow", FLOW, _FLOW_EVENTS),
                ("edge", EDGE, R.EDGE_LABELS),
                ("telemetry", TELEMETRY, R.TELEMETRY_LABELS),
            )
        ]
    )
    return rows.select(F.inline(families)).groupBy("kind", "family").agg(F.count("*").alias("n"))


# ---- scans ---------------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS event_type, value,
  true AS has_file FROM events
""")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "csv")
    label = F.when(F.col("event_id") % 6 == 0, "N/A").otherwise(F.col("event_type"))
    rows = R.events(spark, sf).select("event_id", label.alias("event_type"), "value", "props")
    rows.repartition(4, "event_id").write.option("header", True).csv(path)
    read = scan_csv(spark, path, drop=["props"], with_file=True)
    return read.select(
        F.col("event_id").cast("bigint"),
        "event_type",
        C.to_number(F.col("value")).alias("value"),
        F.col(FILE_COLUMN).endswith(".csv").alias("has_file"),
    )


@query(f"""
WITH {EV} SELECT event_id, event_type AS device, CASE WHEN event_type <> 'view' THEN value END AS value,
  CASE WHEN event_type IN ('view', 'error') THEN k END AS k FROM ev
""")
def union_devices(spark: SparkSession, sf: str) -> DataFrame:
    base = staging_path(spark, "devices")
    for name in ("click", "error", "purchase", "signup", "view"):
        own = R.events(spark, sf).where(F.col("event_type") == name)
        columns = ["event_id"] + (["value"] if name != "view" else [])
        columns += ["k"] if name in ("view", "error") else []
        own.select(*columns).write.option("header", True).csv(f"{base}/IoT_{name.title()}.csv")
    read = scan_devices(spark, f"{base}/IoT_*.csv")
    return read.select(
        F.col("event_id").cast("bigint"),
        "device",
        C.to_number(F.col("value")).alias("value"),
        F.col("k").cast("bigint"),
    )


# ---- duplicates, conflicts, overlaps -------------------------------------------------------------


@query("""
SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
FROM (SELECT DISTINCT text, lang, source FROM documents) GROUP BY 1
""")
def dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").distinct()
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""
WITH {EV}, t AS (SELECT event_id, k, floor(value) AS v, event_type FROM ev),
bad AS (SELECT k, v FROM t GROUP BY k, v HAVING count(DISTINCT event_type) > 1)
SELECT event_id FROM t WHERE NOT EXISTS
  (SELECT 1 FROM bad WHERE bad.k IS NOT DISTINCT FROM t.k AND bad.v IS NOT DISTINCT FROM t.v)
""")
def drop_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.events(spark, sf).select("event_id", "k", F.floor("value").alias("v"), "event_type", "y")
    return L.drop_conflicts(rows, ["k", "v"], ["event_type", "y"]).select("event_id")


@query("""
WITH d AS (SELECT DISTINCT l_quantity, l_discount, l_tax, l_suppkey, l_returnflag FROM lineitem),
c AS (SELECT *, count(*) OVER (PARTITION BY l_quantity, l_discount, l_tax, l_suppkey) AS m FROM d)
SELECT l_returnflag, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS supp_sum FROM c WHERE m = 1 GROUP BY 1
""")
def dedup_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    features = ["l_quantity", "l_discount", "l_tax", "l_suppkey"]
    rows = R.lines(spark, sf).select(*features, "l_returnflag")
    kept = L.dedup_and_drop_conflicts(rows, features, ["l_returnflag"])
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("supp_sum"))


_COARSE = ["l_quantity", "l_discount", "l_suppkey"]


@query(f"""
{SPLIT_LINES}, o AS (SELECT *, min(CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END)
  OVER (PARTITION BY l_quantity, l_discount, l_suppkey) AS first,
  CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS sn FROM sp)
SELECT split, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM o WHERE sn = first GROUP BY 1
""")
def remove_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_columns(spark, sf, *_COARSE, "l_orderkey")
    kept = L.remove_overlaps(rows, _COARSE)
    return kept.groupBy("split").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"))


def _overlap_sql(columns: str, source: str = "sp") -> str:
    def pair(a: str, b: str) -> str:
        return f"""(SELECT count(*) FROM (SELECT {columns} FROM {source} WHERE split = '{a}'
  INTERSECT SELECT {columns} FROM {source} WHERE split = '{b}')) AS {a}_{b}"""

    return ", ".join(pair(a, b) for a, b in (("train", "val"), ("train", "test"), ("val", "test")))


@query(f"{SPLIT_LINES} SELECT {_overlap_sql('l_quantity, l_discount, l_suppkey')}")
def count_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return L.count_overlaps(R.split_lines(spark, sf), _COARSE)


@query("SELECT DISTINCT event_type AS class FROM events")
def class_union(spark: SparkSession, sf: str) -> DataFrame:
    names = L.class_union(R.events(spark, sf), "event_type")
    return spark.createDataFrame([(n,) for n in names], "class string")


_SCALED = ", ".join(
    f"round(({n} - (SELECT avg({n}) FROM sp WHERE split = 'train')) / "
    f"(SELECT stddev_pop({n}) FROM sp WHERE split = 'train'), 6) AS {n}"
    for n in ("l_quantity", "l_discount", "l_suppkey")
)


@query(f"""
{SPLIT_LINES}, z AS (SELECT split, {_SCALED} FROM sp)
SELECT {_overlap_sql('l_quantity, l_discount, l_suppkey', 'z')}
""")
def rescaled_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_columns(spark, sf, *_COARSE)
    scaled = Scaler.fit(rows.where(in_train()), _COARSE).transform(rows)
    return L.count_overlaps(scaled, _COARSE)


# ---- fitted transformers -------------------------------------------------------------------------


@query(f"""
{SPLIT_LINES}, g AS (SELECT split, CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity END AS a,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS b FROM sp),
m AS (SELECT median(a) AS ma, median(b) AS mb FROM g WHERE split = 'train')
SELECT split, count(*) AS n, round(sum(coalesce(a, ma)), 2) AS a_sum, round(avg(mb), 4) AS b_median
FROM g, m GROUP BY 1
""")
def median_imputation(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_columns(
        spark,
        sf,
        F.when(F.col("l_orderkey") % 10 != 0, F.col("l_quantity")).alias("a"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("b"),
    )
    medians = exact_medians(rows.where(in_train()), ["a", "b"])
    filled = median_impute(rows, ["a", "b"], medians)
    return filled.groupBy("split").agg(
        F.count("*").alias("n"),
        F.round(F.sum("a"), 2).alias("a_sum"),
        F.lit(round(medians["b"], 4)).alias("b_median"),
    )


_CATEGORY_SQL = "CASE WHEN split = 'test' AND l_linenumber = 7 THEN 'only_test' ELSE l_returnflag END"


def _categories(spark: SparkSession, sf: str) -> DataFrame:
    unseen = (F.col("split") == "test") & (F.col("l_linenumber") == 7)
    flag = F.when(unseen, "only_test").otherwise(F.col("l_returnflag"))
    return split_columns(spark, sf, flag.alias("flag"), F.col("l_linestatus").alias("st"))


@query(f"""
{SPLIT_LINES}, k AS (SELECT split, {_CATEGORY_SQL} AS flag, l_linestatus AS st FROM sp)
SELECT split, count(*) AS n, CAST(sum(CASE WHEN flag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS "flag_A",
  CAST(sum(CASE WHEN flag = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS "flag_N",
  CAST(sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS "flag_R",
  CAST(sum(CASE WHEN st = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS "st_F",
  CAST(sum(CASE WHEN st = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS "st_O" FROM k GROUP BY 1
""")
def onehot(spark: SparkSession, sf: str) -> DataFrame:
    rows = _categories(spark, sf)
    coder = OneHot.fit(rows.where(in_train()), ["flag", "st"])
    coded = coder.transform(rows).groupBy("split")
    return coded.agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in coder.columns()])


@query(f"""
{SPLIT_LINES}, k AS (SELECT split, {_CATEGORY_SQL} AS flag, l_linestatus AS st FROM sp),
d AS (SELECT flag, CAST(row_number() OVER (ORDER BY flag) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT flag FROM k WHERE split = 'train'))
SELECT split, coalesce(code, -1) AS flag, CASE st WHEN 'F' THEN 0 ELSE 1 END AS st, count(*) AS n
FROM k LEFT JOIN d USING (flag) GROUP BY 1, 2, 3
""")
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = _categories(spark, sf)
    coded = LabelCodes.fit(rows.where(in_train()), ["flag", "st"]).transform(rows)
    return coded.groupBy("split", "flag", "st").agg(F.count("*").alias("n"))


@query(f"""
{SPLIT_LINES}, k AS (SELECT split, CAST(l_partkey AS VARCHAR) AS part, l_linestatus AS st FROM sp),
d AS (SELECT part, row_number() OVER (ORDER BY part) - 1 AS code FROM (SELECT DISTINCT part FROM k WHERE split = 'train')),
e AS (SELECT st, row_number() OVER (ORDER BY st) - 1 + (SELECT count(*) FROM d) AS code
  FROM (SELECT DISTINCT st FROM k WHERE split = 'train'))
SELECT split, CAST(code AS INTEGER) AS at, count(*) AS n FROM (SELECT split, d.code FROM k JOIN d USING (part)
  UNION ALL SELECT split, e.code FROM k JOIN e USING (st)) GROUP BY 1, 2
""")
def onehot_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators of all part keys and line states as sparse vectors: how many rows of a split set each of them."""
    rows = split_columns(spark, sf, F.col("l_partkey").cast("string").alias("part"), "l_linestatus")
    coder = OneHot.fit(rows.where(in_train()), ["part", "l_linestatus"])
    sums = coder.sparse(rows, "flags").groupBy("split").agg(Summarizer.sum(F.col("flags")).alias("n"))
    counts = sums.select("split", F.posexplode(vector_to_array("n")).alias("at", "n")).where("n > 0")
    return counts.select("split", "at", F.col("n").cast("bigint").alias("n"))


@query(f"""
{SPLIT_LINES}, m AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_tax) AS m2,
  stddev_pop(l_tax) AS s2 FROM sp WHERE split = 'train')
SELECT split, round(avg((l_quantity - m1) / s1), 6) AS quantity_mean,
  round(stddev_pop((l_quantity - m1) / s1), 6) AS quantity_dev, round(max((l_tax - m2) / s2), 6) AS tax_max,
  max(0.0::DOUBLE) AS same FROM sp, m GROUP BY 1
""")
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_columns(spark, sf, "l_quantity", "l_tax", F.lit(3.0).cast("double").alias("same"))
    columns = ["l_quantity", "l_tax", "same"]
    scaled = Scaler.fit(rows.where(in_train()), columns).transform(rows)
    return scaled.groupBy("split").agg(
        (F.round(F.avg("l_quantity"), 6) + F.lit(0.0).cast("double")).alias("quantity_mean"),
        F.round(F.stddev_pop("l_quantity"), 6).alias("quantity_dev"),
        F.round(F.max("l_tax"), 6).alias("tax_max"),
        F.max("same").alias("same"),
    )


@query("""
WITH d AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS idx
  FROM (SELECT DISTINCT event_type FROM events))
SELECT idx, event_type AS back, count(*) AS n FROM events JOIN d USING (event_type) GROUP BY 1, 2
""")
def onehot_index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.events(spark, sf).select("event_type")
    model = index_target(rows, "event_type", "idx")
    back = index_to_target(list(model.labels), "idx", "back").transform(model.transform(rows))
    return back.groupBy("idx", "back").agg(F.count("*").alias("n"))


# ---- preparation ---------------------------------------------------------------------------------


def split_counts(df: DataFrame, binary: str) -> DataFrame:
    return df.groupBy("split", c(binary).alias("y")).agg(F.count("*").alias("n"))


FLOW_SQL = f"""WITH {LI}, raw AS (SELECT *, l_quantity AS f1, CASE WHEN l_orderkey % 50 = 0 OR l_orderkey % 51 = 0
  THEN NULL ELSE l_extendedprice END AS f2, l_discount AS f3, l_tax AS f4,
  CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS y FROM li),
cl AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, f1, f2, f3, f4, l_returnflag, y
  FROM raw WHERE f2 IS NOT NULL),
ok AS (SELECT * FROM cl WHERE (f1, f2, f3, f4) NOT IN
  (SELECT (f1, f2, f3, f4) FROM cl GROUP BY f1, f2, f3, f4 HAVING count(DISTINCT l_returnflag) > 1)),
{sql_split('ok', 'y', LINE_HASH)},
o AS (SELECT *, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS sn FROM sp),
kept AS (SELECT * FROM o QUALIFY sn = min(sn) OVER (PARTITION BY f1, f2, f3, f4))"""


def unscaled(name: str, facts: dict) -> Column:
    """A scaled feature in its own units."""
    scaler = facts["scaler"]
    i = scaler["columns"].index(name)
    return c(name) * F.lit(scaler["scale"][i]) + F.lit(scaler["mean"][i])


def mean_of(column: Column | str) -> Column:
    return F.round(F.avg(column), 5) + F.lit(0.0)


_FLOW_MEANS = ", ".join(
    f"round(avg((f{i} - (SELECT avg(f{i}) FROM kept WHERE split = 'train')) / "
    f"(SELECT stddev_pop(f{i}) FROM kept WHERE split = 'train')), 5) + 0 AS m{i}"
    for i in range(1, 5)
)


@query(f"{FLOW_SQL} SELECT split, y, count(*) AS n, {_FLOW_MEANS} FROM kept GROUP BY 1, 2")
def prepare_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and mean scaled features of every split and class."""
    rows, facts = prepare(R.raw_flows(spark, sf), R.FLOW_DEMO)
    means = [mean_of(c(n)).alias(f"m{i}") for i, n in enumerate(R.FLOW_DEMO.features, 1)]
    return rows.groupBy("split", F.col("label_binary").alias("y")).agg(F.count("*").alias("n"), *means)


EDGE_SQL = f"""WITH {EV}, cl AS (SELECT DISTINCT floor(value) AS f1, k AS f2, user_id % 7 AS f3, event_type,
  CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS y FROM ev WHERE event_id % 11 <> 0),
ok AS (SELECT * FROM cl QUALIFY count(*) OVER (PARTITION BY f1, f2, f3) = 1),
s AS (SELECT y, count(*) AS n, (count(*) * 15 + 50) // 100 AS part FROM ok GROUP BY 1),
t AS (SELECT 'train' AS split, y, n - 2 * part AS n FROM s UNION ALL SELECT 'val', y, part FROM s
  UNION ALL SELECT 'test', y, part FROM s)"""
_EDGE_HASH = """md5(concat_ws('|', CAST(CAST(f1 AS DOUBLE) AS VARCHAR), CAST(CAST(f2 AS DOUBLE) AS VARCHAR),
  CASE WHEN f3 = 0 THEN '0' ELSE 't' || f3 END, '42'))"""


@query(f"""
{EDGE_SQL}, {sql_split('ok', 'y', _EDGE_HASH)},
m AS (SELECT avg(f1) AS a1, stddev_pop(f1) AS s1, avg(f2) AS a2, stddev_pop(f2) AS s2 FROM sp WHERE split = 'train')
SELECT split, y, count(*) AS n, round(avg((f1 - a1) / s1), 5) + 0 AS len_mean, round(avg((f2 - a2) / s2), 5) + 0 AS delta_mean,
  count(*) FILTER (f3 = 0) AS topic_zero, count(*) FILTER (f3 = 3) AS topic_three FROM sp, m GROUP BY 1, 2
""")
def prepare_edge(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, mean scaled numbers and totals of two indicator columns of every split and class."""
    rows, facts = prepare(R.raw_edge(spark, sf), R.EDGE_DEMO)
    return rows.groupBy("split", c("Attack_label").alias("y")).agg(
        F.count("*").alias("n"),
        mean_of(c("tcp.len")).alias("len_mean"),
        mean_of(c("udp.time_delta")).alias("delta_mean"),
        F.round(F.sum(unscaled("mqtt.topic_0", facts))).cast("bigint").alias("topic_zero"),
        F.round(F.sum(unscaled("mqtt.topic_t3", facts))).cast("bigint").alias("topic_three"),
    )


@query(f"""
WITH {EV}, t AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS temp,
  CASE WHEN event_id % 13 <> 0 THEN k % 3 END AS state, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS y FROM ev),
{sql_split('t', 'y', "md5(concat_ws('|', CAST(CAST(event_id AS DOUBLE) AS VARCHAR), '42'))")},
f AS (SELECT *, coalesce(temp, (SELECT median(temp) FROM sp WHERE split = 'train')) AS full_temp FROM sp),
m AS (SELECT avg(full_temp) AS a, stddev_pop(full_temp) AS s FROM f WHERE split = 'train')
SELECT split, y, count(*) AS n, round(sum(full_temp), 2) AS temp_sum, round(avg((full_temp - a) / s), 5) + 0 AS temp_mean,
  count(*) FILTER (state IS NULL) AS no_state, count(*) FILTER (state = 1) AS state_one FROM f, m GROUP BY 1, 2
""")
def prepare_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, imputed and scaled temperatures and totals of two indicator columns of every split and class."""
    rows, facts = prepare(R.raw_telemetry(spark, sf), R.TELEMETRY_DEMO)
    return rows.groupBy("split", c("label_binary").alias("y")).agg(
        F.count("*").alias("n"),
        F.round(F.sum(unscaled("temp", facts)), 2).alias("temp_sum"),
        mean_of("temp").alias("temp_mean"),
        F.round(F.sum(unscaled("state___missing__", facts))).cast("bigint").alias("no_state"),
        F.round(F.sum(unscaled("state_s1", facts))).cast("bigint").alias("state_one"),
    )
