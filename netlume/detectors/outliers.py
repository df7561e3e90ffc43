"""Isolation forest and local outlier factor. Both are fitted on benign rows.

Both learn from a sample whose size is a fixed parameter of the method (256 rows per tree, 30,000
reference rows), whatever the size of the table; every row of the table is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlume.detectors.base import Detector, Fitted, rows_to_numpy, score_in_arrow
from netlume.operators.selection import exact_quantiles
from netlume.operators.sampling import SEED, benign_subsample
from netlume.staging import stage

CONTAMINATION = 0.1


def shifted(score: Fitted, offset: float) -> Fitted:
    return lambda df: score(df).withColumn("score", F.col("score") - F.lit(offset))


# ---- isolation forest --------------------------------------------------------------------------


def path_adjustment(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def isolation_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Nodes of one random tree; a leaf has feature -1 and ``length`` = its adjusted depth."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "length": []}

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes["feature"])
        for key, value in (("feature", -1), ("cut", 0.0), ("left", at), ("right", at)):
            nodes[key].append(value)
        nodes["length"].append(float(depth + path_adjustment(len(rows))))
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        splittable = np.flatnonzero(lo < hi)
        if depth < limit and len(splittable):
            f = int(rng.choice(splittable))
            cut = float(rng.uniform(lo[f], hi[f]))
            below = rows[:, f] <= cut
            if below.all():
                return at
            nodes["feature"][at], nodes["cut"][at] = f, cut
            nodes["left"][at] = grow(rows[below], depth + 1)
            nodes["right"][at] = grow(rows[~below], depth + 1)
        return at

    grow(x, 0)
    return nodes


def full_tree(tree: dict[str, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, length) of the complete binary tree of ``depth`` levels: node i has children 2i+1 and 2i+2, and
    below a leaf all nodes repeat it."""
    size = 2 ** (depth + 1) - 1
    own = np.zeros(size, int)
    for i in range(size // 2):
        own[2 * i + 1], own[2 * i + 2] = tree["left"][own[i]], tree["right"][own[i]]
    return np.maximum(tree["feature"][own], 0), tree["cut"][own], tree["length"][own]


def path_lengths(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, depth: int) -> np.ndarray:
    """``tree`` is a ``full_tree``: the place of a child needs no look at the tree."""
    feature, cut, length = tree
    flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    at = np.zeros(len(x), int)
    for _ in range(depth):
        right = flat.take(first + feature.take(at)) > cut.take(at)
        at = 2 * at + 1 + right
    return length.take(at)


@dataclass
class IsolationForest(Detector):
    name: str = "isolation_forest"
    anomaly: bool = True
    fold_rule: str = "zero"
    strategy_type: str = "anomaly_baseline"
    trees: int = 100
    sample: int = 256

    def _samples(self, benign: DataFrame) -> DataFrame:
        """(tree, _h, x): ``sample`` rows per tree, drawn for each tree by its own hash from a pool of
        trees * sample benign rows (all of them, if there are fewer). The draw sees ids only; a tree's vectors are
        joined to it afterwards."""
        drawn = benign_subsample(benign, "y", "_h", self.trees * self.sample).select("_h", "x")
        pool = stage(drawn.withColumn("_id", F.monotonically_increasing_id()), "tree-pool")
        each = pool.select("_id", "_h", F.explode(F.expr(f"sequence(0, {self.trees - 1})")).alias("tree"))
        draw = Window.partitionBy("tree").orderBy(F.md5(F.concat_ws("|", "tree", "_h")), "_id")
        picked = each.withColumn("_rn", F.row_number().over(draw)).where(F.col("_rn") <= self.sample)
        return picked.select("tree", "_id").join(pool, "_id").select("tree", "_h", "x")

    def fit(self, train: DataFrame) -> Fitted:
        benign = train.where(F.col("y") == 0)

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            tree = int(rows["tree"].iloc[0])
            x = np.stack(rows["x"].to_numpy())
            x = x[np.lexsort((*x.T, rows["_h"].to_numpy().astype(str)))]
            nodes = isolation_tree(x, np.random.default_rng([SEED, tree]))
            return pd.DataFrame([{"size": len(x), **nodes}])

        schema = (
            "size int, feature array<int>, cut array<double>, left array<int>, "
            "right array<int>, length array<double>"
        )
        rows = self._samples(benign).groupBy("tree").applyInPandas(build, schema).collect()
        size = max(r["size"] for r in rows)
        forest = [{k: np.array(r[k]) for k in ("feature", "cut", "left", "right", "length")} for r in rows]
        depth = int(np.ceil(np.log2(max(size, 2))))
        forest = [full_tree(tree, depth) for tree in forest]
        typical = max(float(path_adjustment(size)), 1e-12)

        def anomaly(x: np.ndarray) -> np.ndarray:
            mean = sum(path_lengths(tree, x, depth) for tree in forest) / len(forest)
            return 2.0 ** (-mean / typical)

        def score(df: DataFrame) -> DataFrame:
            return score_in_arrow(df, anomaly)

        scored = stage(score(benign.select("x")).select("score"), "benign-scores")  # several scans follow
        offset = exact_quantiles(scored, "score", [1.0 - CONTAMINATION]).first()["quantile"]
        return shifted(score, offset)


# ---- local outlier factor ----------------------------------------------------------------------

QUERY_ROWS = 256
CANDIDATES = 100_000


def nearest(
    queries: np.ndarray, reference: np.ndarray, k: int, own: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Distances and positions of the k nearest reference rows; ``own`` excludes the row itself.

    A matrix product on centred rows finds candidates: all whose rough distance is within the rounding
    bound of the k-th. Their distances are then taken from differences. Ties are broken by position.
    """
    centre = reference.mean(axis=0)
    moved = reference - centre
    norms = (moved**2).sum(axis=1)
    dist, pos = [], []
    for at in range(0, len(queries), QUERY_ROWS):
        q = queries[at : at + QUERY_ROWS] - centre
        own_norms = (q**2).sum(axis=1)
        rough = own_norms[:, None] + norms - 2.0 * (q @ moved.T)
        if own is not None:
            rough[np.arange(len(q)), own[at : at + QUERY_ROWS]] = np.inf
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = 8 * (q.shape[1] + 4) * np.finfo(float).eps * (own_norms + norms.max())
        rows, cols = np.nonzero((rough <= (kth + slack)[:, None]) & (rough < np.inf))
        exact = np.empty(len(rows))
        for lo in range(0, len(rows), CANDIDATES):
            part = slice(lo, lo + CANDIDATES)
            exact[part] = np.sqrt(((reference[cols[part]] - queries[at + rows[part]]) ** 2).sum(axis=1))
        order = np.lexsort((cols, exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        dist.append(exact[first].reshape(len(q), k))
        pos.append(cols[first].reshape(len(q), k))
    return np.vstack(dist), np.vstack(pos)


def density(dist: np.ndarray, pos: np.ndarray, k_dist: np.ndarray) -> np.ndarray:
    """Inverse mean reachability distance."""
    return 1.0 / (np.maximum(dist, k_dist[pos]).mean(axis=1) + 1e-10)


@dataclass
class LocalOutlierFactor(Detector):
    name: str = "lof"
    anomaly: bool = True
    fold_rule: str = "zero"
    strategy_type: str = "anomaly_novelty"
    neighbours: int = 20
    reference_rows: int = 30_000

    def fit(self, train: DataFrame) -> Fitted:
        spark = train.sparkSession
        picked = benign_subsample(train, "y", "_h", self.reference_rows)
        block = picked.select("_h", "x").toArrow().sort_by("_h").column("x")  # at most reference_rows
        reference = rows_to_numpy(block)
        k = min(self.neighbours, len(reference) - 1)
        shared = spark.sparkContext.broadcast(reference)

        def neighbours(batches):
            for batch in batches:
                ids = batch.column("id").to_numpy()
                if len(ids):
                    dist, pos = nearest(shared.value[ids], shared.value, k, own=ids)
                    yield pa.RecordBatch.from_pydict(
                        {"id": pa.array(ids), "dist": pa.array(dist.tolist()), "pos": pa.array(pos.tolist())}
                    )

        found = (
            spark.range(len(reference))
            .mapInArrow(neighbours, "id bigint, dist array<double>, pos array<bigint>")
            .toArrow()
            .sort_by("id")
        )
        dist, pos = rows_to_numpy(found.column("dist")), rows_to_numpy(found.column("pos"))
        k_dist = dist[:, -1]
        own_density = density(dist, pos, k_dist)
        own_factor = own_density[pos].mean(axis=1) / own_density
        offset = float(np.percentile(own_factor, 100 * (1.0 - CONTAMINATION)))
        learnt = spark.sparkContext.broadcast((k_dist, own_density))

        def factor(x: np.ndarray) -> np.ndarray:
            reach, densities = learnt.value
            d, p = nearest(x, shared.value, k)
            return densities[p].mean(axis=1) / density(d, p, reach)

        return shifted(lambda df: score_in_arrow(df, factor), offset)
