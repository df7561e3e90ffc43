"""Training by summed gradients.

One step is one Spark job of one stage: every task adds up the gradient of its rows, the driver adds the sums of the tasks
(at most ``MAX_PARTS``), takes one Adam step and sends the parameters out with the next job. A sum does not care which task
held a row, so the fitted model is the same for every layout of the table, up to the rounding of the additions.

Several models of one shape (those of the cross-validation folds) are trained in the same jobs. An epoch visits every
slice of the rows once; slices are fixed by the row hash. They are packed into arrays once, as partitions of their own that
executors keep in memory or on their disks, so that a step runs on the partitions of its slice only. A model stops when
its loss on the rows held out, or on the training rows if none are, has not fallen for ``patience`` epochs; it keeps its
best parameters.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlume.detectors.base import rows_to_numpy

ROWS_PER_STEP = 20_000
MAX_STEPS = 64  # slices of an epoch
ROWS_PER_RATE = 200  # the step size belongs to a batch of so many rows and grows with the root of the batch
MAX_RATE_FACTOR = 20.0
ROWS_PER_PART = 2_000  # a slice is dealt to one task for so many rows, up to the cores there are
MAX_PARTS = 64  # tasks of a step
BLOCK_ROWS = 100_000  # rows of one array
NO_FOLD = -1


class Objective(Protocol):
    """A sum over rows, for ``models`` parameter vectors at once. A row counts for a model unless it is of its fold."""

    models: int
    size: int

    def gradient(self, params: np.ndarray, x: np.ndarray, t: np.ndarray, fold: np.ndarray) -> tuple:
        """Summed gradients (models, size), summed losses (models,) and numbers of rows (models,)."""

    def loss(self, params: np.ndarray, x: np.ndarray, t: np.ndarray, fold: np.ndarray) -> tuple:
        """Summed losses and numbers of rows."""

    def penalty(self, params: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Gradient of the regularisation, for a mean over ``rows`` rows."""


@dataclass
class Schedule:
    epochs: int
    patience: int
    tolerance: float = 1e-4
    rate: float = 1e-3
    fading: bool = False  # the rate falls as 1 / sqrt(epoch)


def hash_digits(first: int) -> Column:
    """24 bits of the row hash from the given hex digit."""
    return F.conv(F.substring("_h", first, 6), 16, 10).cast("int")


def tenth_held_out() -> Column:
    """A fixed tenth of the rows, by hash digits that the sampling order hardly depends on."""
    return hash_digits(25) % 10 == 0


def sliced(rows: DataFrame, target: Column, hold_out: bool) -> tuple[RDD, int, int, int]:
    """Blocks (x, t, fold) of the rows; the number of slices, of partitions a slice and of rows.

    Partition ``slice * parts + part`` holds the rows of one part of a slice; the rows held out come last.
    """
    n = rows.count()
    steps = int(min(MAX_STEPS, max(1, n // ROWS_PER_STEP)))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = int(min(MAX_PARTS, cores, max(1, n // steps // ROWS_PER_PART)))
    own = hash_digits(17) % steps
    fold = F.coalesce(F.col("fold"), F.lit(NO_FOLD)) if "fold" in rows.columns else F.lit(NO_FOLD)
    at = F.when(tenth_held_out(), steps).otherwise(own) if hold_out else own
    data = rows.select(
        "x",
        target.cast("int").alias("t"),
        fold.cast("int").alias("fold"),
        (at * parts + hash_digits(9) % parts).cast("int").alias("at"),
    )

    def deal(batches):
        held: list[tuple] = []

        def flush():
            x, t, fold, at = (np.concatenate(v) for v in zip(*held))
            held.clear()
            order = np.argsort(at, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0, True])
            keys = [int(at[order[lo]]) for lo in edges[:-1]]
            made = [pickle.dumps((x[r], t[r], fold[r])) for r in np.split(order, edges[1:-1])]
            return pa.RecordBatch.from_pydict({"at": pa.array(keys, pa.int32()), "rows": pa.array(made, pa.binary())})

        seen = 0
        for batch in batches:
            if batch.num_rows:
                t, fold, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "fold", "at"))
                held.append((rows_to_numpy(batch.column("x")), t, fold, at))
                seen += batch.num_rows
                if seen >= BLOCK_ROWS:
                    yield flush()
                    seen = 0
        if held:
            yield flush()

    def merge(pairs):
        held: list[tuple] = []
        for _, made in pairs:
            held.append(pickle.loads(made))
            if sum(len(t) for _, t, _ in held) >= BLOCK_ROWS:
                yield tuple(np.concatenate(v) for v in zip(*held))
                held = []
        if held:
            yield tuple(np.concatenate(v) for v in zip(*held))

    dealt = data.mapInArrow(deal, "at int, rows binary").rdd.map(lambda r: (r["at"], bytes(r["rows"])))
    blocks = dealt.partitionBy((steps + 1) * parts, int).mapPartitions(merge)
    return blocks.persist(StorageLevel.MEMORY_AND_DISK), steps, parts, n


def slice_sums(blocks: RDD, partitions: list[int], size: int, models: int, add: Callable) -> tuple:
    """Gradients (of ``size`` parameters), losses and row numbers over some partitions: one job of one stage."""

    def work(held):
        total = np.zeros((models, size + 2))
        for block in held:
            *gradient, loss, n = add(*block)
            if gradient:
                total[:, :size] += gradient[0]
            total[:, size] += loss
            total[:, size + 1] += n
        yield total

    total = np.sum(blocks.context.runJob(blocks, work, partitions), axis=0)
    return total[:, :size], total[:, size], total[:, size + 1]


def summed(rows: DataFrame, objective: Objective, params: np.ndarray, with_gradient: bool, wide: bool) -> tuple:
    """Gradients (or None), losses and row numbers over all rows: one job, one row per task."""
    models, size = objective.models, objective.size if with_gradient else 0

    def work(batches):
        total = np.zeros((models, size + 2))
        for batch in batches:
            if batch.num_rows:
                x = rows_to_numpy(batch.column("x"))
                t, fold = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("t", "fold"))
                if with_gradient:
                    gradient, loss, n = objective.gradient(params, x, t, fold)
                    total[:, :size] += gradient
                else:
                    loss, n = objective.loss(params, x, t, fold)
                total[:, size] += loss
                total[:, size + 1] += n
        offsets = pa.array([0, total.size], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], ["v"])

    made = rows.mapInArrow(work, "v array<double>").select(array_to_vector("v").alias("v"))
    if wide:
        part = made.withColumn("part", F.spark_partition_id() % 32).groupBy("part")
        made = part.agg(Summarizer.sum(F.col("v")).alias("v"))
    total = made.groupBy(F.lit(0).alias("all")).agg(Summarizer.sum(F.col("v")).alias("v")).first()
    if total is None:  # no rows, no task
        return None, np.zeros(models), np.zeros(models)
    values = total["v"].toArray().reshape(models, size + 2)
    return values[:, :size], values[:, size], values[:, size + 1]


def descend(
    rows: DataFrame, target: Column, objective: Objective, start: np.ndarray, plan: Schedule, hold_out: bool
) -> np.ndarray:
    """Parameters (models, size) after at most ``plan.epochs`` epochs. ``rows``: x, _h and, if models leave folds out,
    fold."""
    blocks, steps, parts, n = sliced(rows, target, hold_out)
    *slices, held = [list(range(i * parts, (i + 1) * parts)) for i in range(steps + 1)]
    factor = min(MAX_RATE_FACTOR, max(1.0, np.sqrt(n / steps / ROWS_PER_RATE)))
    params = np.array(start, float)
    best, best_loss = params.copy(), np.full(objective.models, np.inf)
    stale = np.zeros(objective.models, int)
    first, second, taken = np.zeros_like(params), np.zeros_like(params), 0
    for epoch in range(plan.epochs):
        rate = plan.rate * factor / (np.sqrt(epoch + 1.0) if plan.fading else 1.0)
        live = stale < plan.patience
        before, loss, seen = params.copy(), np.zeros(objective.models), np.zeros(objective.models)
        for part in slices:
            add = partial(objective.gradient, params)
            gradient, part_loss, part_rows = slice_sums(blocks, part, objective.size, objective.models, add)
            if not part_rows.any():
                continue
            loss, seen = loss + part_loss, seen + part_rows
            count = np.maximum(part_rows, 1.0)
            gradient = gradient / count[:, None] + objective.penalty(params, count)
            taken += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            step = first / (1 - 0.9**taken) / (np.sqrt(second / (1 - 0.999**taken)) + 1e-8)
            params = np.where(live[:, None], params - rate * step, params)
        if not seen.any():
            break
        judged = params
        if hold_out:
            _, loss, seen = slice_sums(blocks, held, 0, objective.models, partial(objective.loss, params))
        else:
            judged = before  # the training loss was met on the way; it belongs to where the epoch began
        mean = np.where(seen > 0, loss / np.maximum(seen, 1.0), 0.0)
        better = live & (mean < best_loss)
        stale = np.where(mean < best_loss - plan.tolerance, 0, stale + 1)
        best[better], best_loss = judged[better], np.where(better, mean, best_loss)
        if (stale >= plan.patience).all():
            break
    else:
        if not hold_out:
            best = params
    blocks.unpersist()
    return best


def score_models(df: DataFrame, score, folds: bool) -> DataFrame:
    """Append ``score``: that of model 0, or of the model of the row's fold. ``score(x, model)`` gives one per row."""
    from netlume.detectors.base import add_field

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x = rows_to_numpy(batch.column("x"))
                model = batch.column("fold").to_numpy(zero_copy_only=False) if folds else np.zeros(len(x), int)
                out = np.zeros(len(x))
                for m in np.unique(model):
                    out[model == m] = score(x[model == m], int(m))
                yield batch.append_column("score", pa.array(out))

    return df.mapInArrow(work, add_field(df, "score", "double"))
