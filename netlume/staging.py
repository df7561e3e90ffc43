"""Intermediate tables that cut lineage and survive the loss of executors.

Every table goes to the folder that the session names in ``spark.checkpoint.dir`` (shared storage on
a cluster). Reading a table back gives Catalyst its true size, so joins against a small staged table
become broadcast joins exactly when Spark's own size limit allows it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.conf.get("spark.app.id", "app")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="netlume-")
    return _local_roots[app]


def staging_path(spark: SparkSession, label: str) -> str:
    app = spark.conf.get("spark.app.id", "app")
    return f"{staging_root(spark)}/netlume/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = staging_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    # an explicit schema keeps the type of the partition column and spares the footer inference job
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables this application staged; call it when its results have been written."""
    app = spark.conf.get("spark.app.id", "app")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{staging_root(spark)}/netlume/{app}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
