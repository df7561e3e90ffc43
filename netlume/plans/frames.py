"""The given tables in the shapes that the registered queries work on."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlume.detectors.base import Detector, matrix
from netlume.functions.columns import row_hash
from netlume.operators.sampling import stratified_split
from netlume.operators.transform import Scaler, in_train
from netlume.plans.evaluate import evaluate, evaluation_table
from netlume.plans.specs import DatasetSpec
from netlume.functions.taxonomy import EDGE, FLOW, TELEMETRY
from netlume.sources.csv import union_by_name

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def events(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn(
        "y", (F.col("event_type") == "error").cast("int")
    )


def hashed_events(spark: SparkSession, sf: str, seed: int = 42) -> DataFrame:
    rows = events(spark, sf)
    return rows.withColumn("_h", row_hash(rows, ["event_id"], seed))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a planted target that the features determine."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    band = F.when(F.col("l_quantity") < 17, "low").when(F.col("l_quantity") < 34, "mid")
    planted = (F.col("l_quantity") > 40) & (F.col("l_discount") >= F.lit(0.05))
    return rows.withColumns(
        {
            "q": F.col("l_quantity").cast("int"),
            "planted": planted.cast("int"),
            "band": band.otherwise("high"),
        }
    )


def split_lines(spark: SparkSession, sf: str, target: str = "planted") -> DataFrame:
    rows = lines(spark, sf)
    hashed = rows.withColumn("_h", row_hash(rows, LINE_KEY))
    return stratified_split(hashed, target, "_h")


@lru_cache(maxsize=8)
def _line_table(app: str, spark: SparkSession, sf: str) -> DataFrame:
    rows = split_lines(spark, sf).drop("_h")
    scaled = Scaler.fit(rows.where(in_train()), LINE_FEATURES).transform(rows)
    meta = {
        "feature_columns": LINE_FEATURES,
        "target_binary": "planted",
        "target_multiclass": "band",
    }
    return evaluation_table(scaled, meta, LINE_KEY)


def line_table(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation table over all of lineitem, built once per session."""
    return _line_table(spark.conf.get("spark.app.id", "app"), spark, sf)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as a matrix in which a hash-chosen twentieth is shifted (y = 1)."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    odd = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 4), 16, 10).cast("int") % 20 == 0
    shift = F.when(odd, 0.2).otherwise(0.0)
    return rows.select(
        "vec_id",
        row_hash(rows, ["vec_id"]).alias("_h"),
        F.transform("embedding", lambda v: v.cast("double") + shift).alias("x"),
        odd.cast("int").alias("y"),
        F.col("label").cast("string").alias("attack"),
    )


def detector_report(spark: SparkSession, sf: str, detector: Detector) -> DataFrame:
    """Metrics of one detector on lineitem (out of fold, validation, test), with its multiclass result."""
    done = evaluate(detector, line_table(spark, sf), "lineitem")
    report = done.tables["binary"]
    if "multiclass" in done.tables:
        multi = done.tables["multiclass"].select("strategy", "macro_f1", "weighted_f1")
        report = report.join(multi, "strategy", "left")
    return report


# ---- raw tables for the three preparation jobs ---------------------------------------------------

FLOW_DEMO = DatasetSpec(
    dataset="lineitem-flows",
    kind="flow",
    taxonomy=FLOW,
    label="Label",
    target_binary="label_binary",
    target_multi="label_multi",
    benign="BENIGN",
    features=["Header_Length", "Rate", "IAT", "Number"],
    row_key=LINE_KEY,
)
EDGE_DEMO = DatasetSpec(
    dataset="events-edge",
    kind="edge",
    taxonomy=EDGE,
    label="Attack_type",
    target_binary="Attack_label",
    target_multi="Attack_type",
    drop=["ip.src_host"],
    categorical=["mqtt.topic"],
    row_key=["tcp.len", "udp.time_delta", "mqtt.topic"],
)
TELEMETRY_DEMO = DatasetSpec(
    dataset="events-telemetry",
    kind="telemetry",
    taxonomy=TELEMETRY,
    label="type",
    target_binary="label_binary",
    target_multi="label_multi",
    drop=["date", "time", "label", "type"],
    row_key=["seq"],
)


def named(column: str, names: dict[str, str]) -> F.Column:
    out = None
    for old, new in names.items():
        test = F.col(column) == old
        out = F.when(test, new) if out is None else out.when(test, new)
    return out


FLOW_LABELS = {"N": "BENIGN", "A": "DDoS-ICMP_Flood", "R": "XSS"}
EDGE_LABELS = {
    "click": "Normal",
    "view": "DDoS_UDP",
    "error": "Port_Scanning",
    "purchase": "XSS",
    "signup": "Backdoor",
}
TELEMETRY_LABELS = {
    "click": "normal",
    "view": " DDoS ",
    "error": "Scanning",
    "purchase": "xss",
    "signup": "backdoor",
}


def raw_flows(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as a flow table: text features, some not finite or not numeric, and key columns."""
    rate = F.col("l_extendedprice").cast("string")
    odd = F.when(F.col("l_orderkey") % 50 == 0, "inf").when(F.col("l_orderkey") % 51 == 0, "bad")
    return lines(spark, sf).select(
        *LINE_KEY,
        F.col("l_quantity").cast("string").alias("Header_Length"),
        odd.otherwise(rate).alias("Rate"),
        F.col("l_discount").cast("string").alias("IAT"),
        F.col("l_tax").cast("string").alias("Number"),
        named("l_returnflag", FLOW_LABELS).alias("Label"),
    )


def raw_edge(spark: SparkSession, sf: str) -> DataFrame:
    """events as an edge table: dotted names, padded categories and missing numbers."""
    topic = F.concat(F.lit(" t"), (F.col("user_id") % 7).cast("string"), F.lit(" "))
    return events(spark, sf).select(
        F.when(F.col("event_id") % 11 != 0, F.floor("value").cast("string")).alias("tcp.len"),
        F.col("k").cast("string").alias("udp.time_delta"),
        F.when(F.col("user_id") % 7 == 0, "0.0").otherwise(topic).alias("mqtt.topic"),
        F.lit("10.0.0.1").alias("ip.src_host"),
        F.when(F.col("event_type") == "click", "0").otherwise("1").alias("Attack_label"),
        named("event_type", EDGE_LABELS).alias("Attack_type"),
    )


def raw_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """events as telemetry: date and time as text, missing values, and one row in 20 twice."""
    rows = events(spark, sf)
    twice = union_by_name([rows, rows.where(F.col("event_id") % 20 == 0)])
    return twice.select(
        F.date_format("ts", "d-MMM-yy").alias("date"),
        F.concat(F.lit(" "), F.date_format("ts", "H:mm:ss"), F.lit(" ")).alias("time"),
        F.col("event_id").cast("string").alias("seq"),
        F.when(F.col("event_id") % 9 == 0, "nan").otherwise(F.col("value").cast("string")).alias("temp"),
        F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit(" s"), F.col("k") % 3)).alias("state"),
        F.when(F.col("event_type") == "click", "0").otherwise("1").alias("label"),
        named("event_type", TELEMETRY_LABELS).alias("type"),
    )
