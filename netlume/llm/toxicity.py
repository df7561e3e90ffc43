"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A feature is one n-gram of 3 to 6 bytes of the text in lower case (A-Z), hashed to one of 2^20 buckets, present or not. The
log-count ratio of a bucket compares how many toxic and how many other labelled documents hold it; it is counted over
``ratio_rows`` labelled training rows, give or take the hash (all of them, if there are fewer; chosen by hash), whose ids are
broadcast, as sums of fixed-size count vectors. The ``features`` buckets whose ratio is surest stay; each is scaled
by its ratio, and a logistic regression with an L2 penalty is fitted on a bounded, documented sample of the training
rows (``fit_rows``, chosen by hash). Scoring is one narrow pass over whole texts with the bounded weight vector.

Rows: NULL and empty texts have no feature and score as the intercept says. A document whose id has several labels is
toxic if one of them says so. NULL ids are held out by rule (their crc32 is NULL) and never trained on. Repeated rows
score alike; labels, language, source and id are no inputs. With one class only in training all scores are its rate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.llm.common import Shared, crc_mod, utf8_of
from netlume.staging import stage

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
BLOCK = 1 << 12
_LOWER = bytes([c + 32 if 65 <= c <= 90 else c for c in range(256)])
_MIX = np.uint32(0x9E3779B1)


def buckets(text: bytes) -> list[np.ndarray]:
    """Buckets of all n-grams, one array per size."""
    raw = np.frombuffer(text.translate(_LOWER), np.uint8).astype(np.uint32)
    out, code = [], raw
    for size in range(2, max(SIZES) + 1):
        if len(raw) < size:
            break
        code = (code[:-1] * np.uint32(0x01000193)) ^ (raw[size - 1 :] * np.uint32(0x85EBCA6B))
        if size in SIZES:
            mixed = (code ^ (code >> np.uint32(15))) * _MIX
            out.append(mixed >> np.uint32(12))
    return out


def present(text: bytes) -> np.ndarray:
    """Distinct buckets of a text."""
    found = buckets(text)
    if not found:
        return np.zeros(0, np.int64)
    if len(text) < 100_000:
        return np.unique(np.concatenate(found))
    seen = np.zeros(BUCKETS, bool)
    for codes in found:
        seen[codes] = True
    return np.flatnonzero(seen)


def _marks(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learned from, one row per id."""
    marks = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    return stage(marks.where(crc_mod(F.col("doc_id"), 5) != 0), "toxic-marks")


def _ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents by class, bucket counts by class): each task sends 2 x 256 blocks of counts."""

    def count(frames):
        total = np.zeros((2, BUCKETS), np.int32)
        size = np.zeros(2, np.int64)
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                total[toxic, present(text)] += 1
                size[toxic] += 1
        if size.any():
            parts = total.reshape(2, -1, BLOCK)
            yield pd.DataFrame(
                {
                    "toxic": np.repeat([0, 1], parts.shape[1]),
                    "block": np.tile(np.arange(parts.shape[1]), 2),
                    "docs": np.repeat(size, parts.shape[1]),
                    "counts": [p.tobytes() for half in parts for p in half],
                }
            )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int32) for x in frame["counts"]], axis=0, dtype=np.int64)
        first = frame.iloc[0]
        return pd.DataFrame(
            {"toxic": [first.toxic], "block": [first.block], "docs": [frame["docs"].sum()], "counts": [total.tobytes()]}
        )

    schema = "toxic int, block int, docs long, counts binary"
    summed = rows.select("text", "toxic").mapInPandas(count, schema)
    counts, docs = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for r in summed.groupBy("toxic", "block").applyInPandas(add, schema).collect():  # 512 rows
        counts[r.toxic, r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
        docs[r.toxic] = r.docs
    return docs, counts[0], counts[1]


def _fit(blocks: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, scale: np.ndarray, penalty: float, rounds: int):
    """Weights and intercept of a logistic regression on present features times ``scale``, by accelerated gradient steps.

    blocks: (all present features, how many each row has) of a few rows each; numbers per feature exist for one block at a
    time, which keeps the driver small.
    """
    n, m = max(1, len(y)), len(scale)

    def per_row(w: np.ndarray) -> np.ndarray:
        sums = [np.bincount(np.repeat(np.arange(len(k)), k), w[x], minlength=len(k)) for x, k in blocks]
        return np.concatenate(sums) if sums else np.zeros(0)

    def per_feature(r: np.ndarray) -> np.ndarray:
        total, at = np.zeros(m), 0
        for x, k in blocks:
            total += np.bincount(x, np.repeat(r[at : at + len(k)], k), minlength=m)
            at += len(k)
        return total * scale

    v = np.full(m, m**-0.5)
    largest = 1.0
    for _ in range(20):  # the largest curvature, by power iteration
        v = per_feature(per_row(scale * v)) / n
        largest = np.linalg.norm(v) or 1.0
        v = v / largest
    step = 1.0 / (0.25 * (1.1 * largest + 1) + penalty)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(m), np.log(rate / (1 - rate))
    look_w, look_b, t = w, b, 1.0
    for _ in range(rounds):
        margin = per_row(scale * look_w) + look_b
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        grad = per_feature(error) / n + penalty * look_w
        new_w, new_b = look_w - step * grad, look_b - step * error.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 20_000,
    ratio_rows: int = 250_000,
    features: int = 8192,
    penalty: float = 1e-5,
    rounds: int = 400,
) -> Shared:
    texts, marks = utf8_of(docs), _marks(labels)
    learnable = texts.where(crc_mod(F.col("doc_id"), 5) != 0)  # held-out texts have no mark, so they are not shuffled
    # bounded: the ids of ratio_rows labelled rows are broadcast, so no text is shuffled
    found = stage(marks.join(learnable.select("doc_id"), "doc_id", "left_semi"), "toxic-found")
    share = min(1.0, ratio_rows / max(1, found.count()))
    labelled = stage(found.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000), "toxic-labels")
    size, other, toxic = _ratios(learnable.join(F.broadcast(labelled), "doc_id"))
    if not size.all():
        rate = float(size[1] / max(1, size.sum()))
        return Shared(docs.sparkSession, (np.zeros(0, np.int64), np.zeros(0), _logit(rate)), _dense)
    ratio = np.log((toxic + 1) / (size[1] + 2)) - np.log((other + 1) / (size[0] + 2))
    spread = np.sqrt(1 / (toxic + 1) + 1 / (other + 1))
    sure = np.where(toxic + other >= 3, np.abs(ratio) / spread, 0.0)
    kept = np.sort(np.argsort(-sure, kind="stable")[:features])
    place = Shared(docs.sparkSession, kept, _places)

    @F.pandas_udf("binary")
    def pick(texts: pd.Series) -> pd.Series:
        at = place.get()
        return pd.Series([(lambda x: x[x >= 0].astype("<i4").tobytes())(at[present(t)]) for t in texts])

    # the first fit_rows of them come back as rows of at most ``features`` numbers
    chosen = stage(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "toxic-fit")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("toxic", pick("text").alias("x"))
    blocks, y = [], []
    for batch in sample.toArrow().to_batches(max_chunksize=512):
        toxic, x = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        blocks.append((np.frombuffer(b"".join(x), "<i4"), np.fromiter(map(len, x), np.int64, len(x)) // 4))
        y.append(toxic.astype(float))
    w, b = _fit(blocks, np.concatenate(y), ratio[kept], penalty, rounds)
    return Shared(docs.sparkSession, (kept, w * ratio[kept], float(b)), _dense)


def _logit(rate: float) -> float:
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return float(np.log(rate / (1 - rate)))


def _places(kept: np.ndarray) -> np.ndarray:
    at = np.full(BUCKETS, -1, np.int32)
    at[kept] = np.arange(len(kept))
    return at


def _dense(value):
    kept, weights, intercept = value
    dense = np.zeros(BUCKETS)
    dense[kept] = weights
    used = np.zeros(BUCKETS, bool)
    used[kept] = True
    return dense, used, intercept


def score(docs: DataFrame, model: Shared) -> DataFrame:
    """(doc_id, score) of every row."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        dense, used, intercept = model.get()
        out = []
        for text in texts:
            hits = [c[used[c]] for c in buckets(text)]
            margin = intercept + (dense[np.unique(np.concatenate(hits))].sum() if hits else 0.0)
            out.append(1 / (1 + np.exp(-min(max(margin, -700.0), 700.0))))
        return pd.Series(out)

    return utf8_of(docs).select("doc_id", run("text").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score(docs, train(docs, labels, **options))
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
