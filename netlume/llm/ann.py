"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised separately, with ``centroids`` centroids each, fitted on a bounded sample; a cell is
a pair of centroids and every vector is in the list of its cell. A query walks the cells by summed distance: a heap over
the two sorted lists of half distances gives the next best pair, until the cells passed hold ``share`` of all vectors
(at least ``least`` of them). Everything in those cells is reranked exactly, in double precision.

Equal vectors are one entry that carries its smallest ids (more of them than a result has rows, so none is missed); a
vector that a third of all rows share costs one product per query. Entries are dealt over partitions by a hash, queries
go to them in bounded blocks, and each partition sends on its best few rows per query. Cell sizes, a table of at most
centroids^2 numbers, are all the driver sees.

Rows: vectors that are NULL, zero, or hold NULL or values that are not finite take no part, nor do rows without an id.
Vectors of other than the most frequent length take no part either. Rows with one id are candidates one by one; a query
id has one result, for its first vector in hash order.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlume.llm.common import Shared
from netlume.staging import stage


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as array<double>."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(ok & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes[0] if sizes else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


class MultiIndex:
    """Codebooks of both halves and the number of entries in each cell."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray | None = None):
        self.books, self.sizes = books, sizes

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.books[0].shape[1]
        return nearest(x[:, :half], self.books[0]) * len(self.books[1]) + nearest(x[:, half:], self.books[1])

    def walk(self, q: np.ndarray, want: int) -> np.ndarray:
        """Cells by summed distance until they hold ``want`` entries, as a mask over all cells."""
        half = self.books[0].shape[1]
        # for inner products the nearest pair is the one with the largest sum
        d = [-(self.books[0] @ q[:half]), -(self.books[1] @ q[half:])]
        order = [np.argsort(x, kind="stable") for x in d]
        d = [x[o].tolist() for x, o in zip(d, order)]
        n0, n1 = len(d[0]), len(d[1])
        taken = np.zeros(n0 * n1, bool)
        done = [0] * n0  # cells taken in each row of the sorted grid
        heap, held = [(d[0][0] + d[1][0], 0, 0)], 0
        while heap and held < want:
            _, i, j = heapq.heappop(heap)
            cell = order[0][i] * n1 + order[1][j]
            taken[cell] = True
            held += int(self.sizes[cell])
            done[i] = j + 1
            if i + 1 < n0 and done[i + 1] == j:
                heapq.heappush(heap, (d[0][i + 1] + d[1][j], i + 1, j))
            if j + 1 < n1 and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (d[0][i] + d[1][j + 1], i, j + 1))
        return taken


def build(entries: DataFrame, centroids: int, sample_rows: int) -> MultiIndex:
    """Codebooks from a bounded sample of the distinct vectors, by hash order."""
    sample = entries.orderBy(F.xxhash64("v")).limit(sample_rows).select("v").toPandas()["v"]
    x = np.stack(sample.to_numpy()) if len(sample) else np.zeros((1, 2))
    half = x.shape[1] // 2
    return MultiIndex((kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)))


def _same(value):
    return value


def _assign(entries: DataFrame, index: MultiIndex) -> DataFrame:
    shared = Shared(entries.sparkSession, index, _same)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(shared.get().cells(np.stack(v.to_numpy())).astype(np.int32))

    return entries.withColumn("cell", cell("v"))


def _search_block(shared: Shared, k: int):
    def run(frames):
        index, qid, q, masks = shared.get()
        for frame in frames:
            for lo in range(0, len(frame), 4096):
                part = frame.iloc[lo : lo + 4096]
                x, cell = np.stack(part["v"].to_numpy()), part["cell"].to_numpy()
                ids = part["ids"].to_numpy()
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), sizes)
                for at in range(0, len(qid), 512):
                    block = slice(at, at + 512)
                    # einsum adds in one fixed order, so a score does not depend on the block
                    s = np.where(masks[block][:, cell], q[block] @ x.T, -np.inf)[:, owner]
                    s[flat[None, :] == qid[block][:, None]] = -np.inf
                    keep = min(k + 8, s.shape[1])
                    cut = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
                    rows, cols = np.nonzero((s >= cut[:, None] - 1e-9) & (s > -np.inf))
                    exact = np.einsum("ij,ij->i", q[block][rows], x[owner[cols]])
                    order = np.lexsort((flat[cols], -exact, rows))
                    rows, cols, exact = rows[order], cols[order], exact[order]
                    first = np.searchsorted(rows, rows)
                    top = np.arange(len(rows)) - first < k
                    yield pd.DataFrame(
                        {"query_id": qid[block][rows[top]], "vec_id": flat[cols[top]], "score": exact[top]}
                    )

    return run


def search(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    centroids: int = 32,
    share: float = 0.6,
    least: int = 4096,
    sample_rows: int = 20_000,
    query_block: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors), "vectors")
    smallest = F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1)
    # a partial set per task and vector first: one vector may be a third of all rows
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(smallest.alias("ids"))
    entries = salted.groupBy("v").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    entries = stage(entries, "entries")
    index = build(entries, centroids, sample_rows)
    placed = stage(_assign(entries, index), "cells")
    sizes = np.zeros(len(index.books[0]) * len(index.books[1]), np.int64)
    for r in placed.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    index.sizes = sizes
    want = max(least, math.ceil(share * int(sizes.sum())))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    blocks = max(1, math.ceil(queries.count() / query_block))
    queries = stage(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "queries")
    dealt, found = placed, None
    for block in range(blocks):
        part = queries.where(F.col("block") == block).select("vec_id", "v").toPandas()  # about query_block vectors
        if not len(part):
            continue
        q = np.stack(part["v"].to_numpy())
        masks = np.stack([index.walk(x, want) for x in q])
        shared = Shared(spark, (index, part["vec_id"].to_numpy(np.int64), q, masks), _same)
        hits = dealt.mapInPandas(_search_block(shared, k), "query_id long, vec_id long, score double")
        found = hits if found is None else found.union(hits)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
