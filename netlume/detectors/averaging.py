"""Data-parallel training in rounds: local epochs on the partitions, then a size-weighted average.

A round is one Spark job of one stage over packed blocks that executors keep in memory or on their disks. A block holds
one slice of the rows of every worker of its partition, and the local models of a partition take their steps together,
on one array, which costs little more than the steps of one of them. Only sums over models cross the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from math import ceil
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.detectors.base import rows_to_numpy

SLICE_ROWS = 10_000  # rows of a worker in one block, on average at most


class LocalModel(Protocol):
    """A model whose whole state is one flat vector."""

    @staticmethod
    def learn_together(models: list, xs: list, ts: list, rngs: list) -> None:
        """Every model learns from its own rows, in steps that all of them take at once."""

    def loss(self, x: np.ndarray, t: np.ndarray) -> np.ndarray: ...

    def state(self) -> np.ndarray: ...


def packed(data: DataFrame) -> RDD:
    """One pickled block (worker, x, t, holdout) per slice and partition of rows that ``with_workers`` has laid out."""

    def pack(batches):
        held: list[tuple] = []

        def flush():
            block = tuple(np.concatenate(v) for v in zip(*held))
            held.clear()
            return pa.RecordBatch.from_pydict({"rows": pa.array([pickle.dumps(block)], pa.binary())})

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_to_numpy(batch.column("x"))
            named = ("worker", "t", "holdout", "slice")
            worker, t, out, slices = (batch.column(n).to_numpy(zero_copy_only=False) for n in named)
            edges = [0, *(np.flatnonzero(np.diff(slices)) + 1), len(slices)]
            for lo, hi in zip(edges, edges[1:]):
                if held and slices[lo] != at:
                    yield flush()
                at = slices[lo]
                held.append((worker[lo:hi], x[lo:hi], t[lo:hi], out[lo:hi]))
        if held:
            yield flush()

    return data.mapInArrow(pack, "rows binary").rdd.map(lambda r: bytes(r["rows"]))


def train_round(
    data: DataFrame | RDD, load: Callable[[np.ndarray], LocalModel], state: np.ndarray, seed: int
) -> tuple[np.ndarray, float | None]:
    """One round from ``state``: the averaged new state, and the mean loss of the old one on the
    rows marked ``holdout``. ``data``: worker, slice, x, t, holdout as laid out by ``with_workers``, or its blocks."""

    def work(blocks: Iterable[bytes]):
        start = load(state)
        local, sizes = {}, {}
        loss, held = 0.0, 0
        for block in blocks:
            worker, x, t, out = pickle.loads(block)
            if out.any():
                loss += float(start.loss(x[out], t[out]).sum())
                held += int(out.sum())
            names = [int(w) for w in np.unique(worker[~out])]
            mine = [np.flatnonzero((worker == w) & ~out) for w in names]
            for w in names:
                if w not in local:
                    local[w], sizes[w] = load(state), 0
            if names:
                rngs = [np.random.default_rng([seed, w, sizes[w]]) for w in names]
                start.learn_together([local[w] for w in names], [x[i] for i in mine], [t[i] for i in mine], rngs)
            for w, i in zip(names, mine):
                sizes[w] += len(i)
        total = sum((m.state() * sizes[w] for w, m in local.items()), np.zeros(len(state)))
        yield np.r_[total, sum(sizes.values()), loss, held]

    blocks = data if isinstance(data, RDD) else packed(data)
    *total, n, loss, held = np.sum(blocks.mapPartitions(work).collect(), axis=0)
    return (np.array(total) / n if n else state), (loss / held if held else None)


def train_rounds(
    data: DataFrame,
    load: Callable[[np.ndarray], LocalModel],
    state: np.ndarray,
    rounds: int,
    seed: int,
    patience: int | None = None,
    tolerance: float = 1e-4,
) -> np.ndarray:
    """At most ``rounds`` rounds; with ``patience``, stop once the held-out loss stops falling. Returns
    the best state seen, the last one included."""
    blocks = packed(data).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _rounds(blocks, load, state, rounds, seed, patience, tolerance)
    finally:
        blocks.unpersist()


def _rounds(data: RDD, load, state: np.ndarray, rounds: int, seed: int, patience: int | None, tolerance: float):
    best, best_loss, stale = state, float("inf"), 0
    for i in range(rounds):
        new, loss = train_round(data, load, state, seed + i)
        if patience is not None and loss is not None:
            stale = 0 if loss < best_loss - tolerance else stale + 1
            if loss < best_loss:
                best, best_loss = state, loss
            if stale >= patience:
                return best
        state = new
    if patience is not None and best_loss < float("inf"):
        loss = train_round(data, load, state, seed + rounds)[1]  # a round reports the loss it began with
        return best if loss is not None and best_loss < loss else state
    return state


def with_workers(data: DataFrame, site: str, rows_per_worker: int | None = None) -> DataFrame:
    """Number the local models and lay the rows out by them: all rows of a worker in one partition, the workers dealt out
    evenly to as many partitions as there are cores, and inside one sorted by slice, worker and hash.

    A site is one local model, whatever its size. Only if ``rows_per_worker`` is given, a larger site is shared by several
    workers by a hash: another method, as each of them then learns from a part of the site.
    """
    order = F.xxhash64(*data.columns)
    sites, largest = data.groupBy(site).count().agg(F.count("*"), F.max("count")).first()
    shares = max(1, ceil((largest or 0) / rows_per_worker)) if rows_per_worker else 1
    slices = max(1, ceil((largest or 0) / shares / SLICE_ROWS))
    parts = max(1, min(sites * shares, data.sparkSession.sparkContext.defaultParallelism))
    worker = (F.col(site) * shares + F.pmod(order, F.lit(shares))).cast("int")
    first = F.col("_h") if "_h" in data.columns else order
    laid = data.withColumn("worker", worker).withColumn("_order", first)
    laid = laid.withColumn("slice", F.pmod(F.xxhash64("_order"), F.lit(slices)).cast("int"))
    laid = laid.repartitionById(parts, F.pmod(F.col("worker"), F.lit(parts)).cast("int"))
    return laid.sortWithinPartitions("slice", "worker", "_order").drop("_order")
