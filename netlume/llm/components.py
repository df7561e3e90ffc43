"""Connected components by alternating large-star and small-star steps over edge tables.

Each step is one aggregate (map-side minimum per node) and one join whose hot nodes adaptive execution splits. Every
round is a table in the shared staging folder, so a lost executor costs one round at most; the driver sees two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of each node, and for large stars of its larger neighbours only, to the smallest node nearby."""
    pairs = edges.union(edges.select("b", "a")).toDF("a", "b") if large else edges
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    near = pairs.join(least, "a")
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component. edges: (a, b)."""
    turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(turned.where(F.col("a") != F.col("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = stage(_star(_star(now, True), False), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
