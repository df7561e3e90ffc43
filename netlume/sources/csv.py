"""CSV scans. Every column is read as text; typing is a later, explicit step."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlume.functions.columns import c

# Cell texts that a reader treats as missing.
READ_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
FILE_COLUMN = "_source_file"
DEVICE_PREFIX = "IoT_"
HEADER_READERS = 16


def header_names(spark: SparkSession, path: str | list[str]) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def scan_csv(
    spark: SparkSession, path: str | list[str], drop: list[str] = (), with_file: bool = False
) -> DataFrame:
    """All files of a path, a glob or a list of paths with one common header; dropped columns are never parsed.

    A file whose header differs from the first one fails the job instead of shifting columns.
    """
    names = header_names(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.option("header", True).option("enforceSchema", False)
    rows = reader.schema(schema).csv(path)
    cells = [F.when(~c(n).isin(READ_MISSING), c(n)).alias(n) for n in names if n not in set(drop)]
    if with_file:
        cells.append(F.col("_metadata.file_path").alias(FILE_COLUMN))
    return rows.select(*cells)


def clean_header(df: DataFrame) -> DataFrame:
    """Trim column names and strip a byte order mark."""
    return df.toDF(*[n.strip().replace("\ufeff", "") for n in df.columns])


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of a glob in name order. A path may be one file or a folder of part files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(status.getPath()) for status in found or [])


def header_line(spark: SparkSession, path: str) -> str:
    """First line of a file, or of the first part file of a folder that has one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getFileStatus(where).isDirectory():
        parts = sorted(str(s.getPath()) for s in store.listStatus(where) if s.getLen() > 0)
        parts = [p for p in parts if not p.rsplit("/", 1)[-1].startswith(("_", "."))]
        return header_line(spark, parts[0]) if parts else ""
    stream = store.open(where)
    try:
        reader = spark._jvm.java.io.InputStreamReader(stream, "UTF-8")
        return spark._jvm.java.io.BufferedReader(reader).readLine() or ""
    finally:
        stream.close()


def by_header(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Paths by their header line. One line of each file is read, several files at a time."""
    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for path, line in zip(paths, pool.map(lambda p: header_line(spark, p), paths)):
            groups.setdefault(line, []).append(path)
    return {line: found for line, found in groups.items() if line}


def device_name(path: Column) -> Column:
    """Device of a file path: the name of the file, or of the folder of part files, without prefix and suffix."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    stem = F.regexp_extract(plain, r"([^/]+?)(?:\.csv)?(?:/part-[^/]*)?$", 1)
    return F.lower(F.regexp_replace(stem, f"^{DEVICE_PREFIX}", ""))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_devices(spark: SparkSession, pattern: str) -> DataFrame:
    """One file per device, each with its own columns: union by column name plus a device column.

    Files with the same header are one scan, so the plan has a branch per header and not per file.
    """
    frames = []
    for paths in by_header(spark, list_files(spark, pattern)).values():
        rows = scan_csv(spark, paths, with_file=True)
        named = rows.withColumn("device", device_name(F.col(FILE_COLUMN))).drop(FILE_COLUMN)
        frames.append(clean_header(named))
    return union_by_name(frames)
