"""SimHash fingerprints and near-duplicate groups from a Gray-order hierarchical index.

Fingerprints are 64 bits; equal ones collapse before any search. Two fingerprints at distance 3 or less agree in three of
six blocks, so each distinct fingerprint goes to the 20 choices of three blocks, about 32 bits each. Inside one such
bucket the fingerprints are sorted by Gray rank and indexed: a leaf holds neighbours in that order, an upper node holds
the bits on which everything below agrees (a masked pattern). A search goes down from the roots, adds up the differences
on the bits that a node factors out and drops the whole group once they exceed the limit. A bucket sends on only a
spanning set of its links. Buckets with more than ``chunk`` fingerprints are dealt as pairs of chunks to several tasks,
so no task holds more than two chunks and no pair is missed.

Rows: NULL and empty texts have no words and fingerprint zero, and link like any other. Repeated rows share a
fingerprint. NULL ids never name a group; a group of NULL ids only has a NULL component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlume.llm.common import utf8_of
from netlume.llm.components import connected
from netlume.staging import stage

BITS = 64
FANOUT = 16
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256
_BIT_VALUE = (np.uint64(1) << np.arange(64, dtype=np.uint64)).reshape(8, 8)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text: a bit is set if over half the shingle hashes have it."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    flat = b" ".join(found)
    ends = list(accumulate(map(len, found), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(flat[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(_BIT_VALUE[2 * counts > len(hashes)].sum(dtype=np.uint64))


def _fp_udf(words: int, seed: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        made = np.array([fingerprint(t, words, seed) for t in texts], np.uint64)
        return pd.Series(made.view(np.int64))

    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed 64-bit integer."""
    return utf8_of(docs).select("doc_id", _fp_udf(words, seed)("text").alias("fp"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy of masked patterns over codes in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        full = np.full(len(codes), np.iinfo(np.uint64).max, np.uint64)
        self.levels = [(self.codes, full)]  # from the leaves up: (pattern, mask)
        while len(self.levels[-1][0]) > FANOUT:
            pattern, mask = self.levels[-1]
            cuts = np.arange(0, len(pattern), FANOUT)
            ones = np.bitwise_and.reduceat(pattern & mask, cuts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, cuts)
            self.levels.append((ones, ones | zeros))

    def near(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) positions of all pairs at ``limit`` or fewer differing bits."""
        pattern, mask = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        spent = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node]).astype(np.int16)
        for depth in range(len(self.levels) - 2, -1, -1):
            ok = spent <= limit
            q, node, spent = q[ok], node[ok], spent[ok]
            above = self.levels[depth + 1][1][node]
            pattern, mask = self.levels[depth]
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            q, above, spent = (np.repeat(x, FANOUT) for x in (q, above, spent))
            there = child < len(pattern)
            q, node, above, spent = q[there], child[there], above[there], spent[there]
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node] & ~above)
        ok = spent <= limit
        return q[ok], node[ok]


def spanning(codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the codes into the same groups as all pairs at ``limit`` or fewer bits do."""
    index = GrayIndex(codes)
    parent = np.arange(len(codes))
    step = max(1, 1_000_000 // max(1, len(codes)))
    for lo in range(0, len(codes), step):
        a, b = index.near(index.codes[lo : lo + step], limit)
        a = a + lo
        while True:
            ra, rb = parent[a], parent[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(codes)))
    return index.codes[child], index.codes[parent[child]]


def _bucket_links(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(keys: np.ndarray, codes: np.ndarray):
            cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            size = np.diff(cut)
            small = np.repeat(size <= FANOUT, size)  # one leaf each: compared in step over the whole batch
            group = np.repeat(np.arange(len(size)), size)
            for shift in range(1, min(FANOUT, len(codes))):
                same = (group[shift:] == group[:-shift]) & small[shift:]
                if not same.any():
                    break
                at = np.flatnonzero(same)
                at = at[np.bitwise_count(codes[at] ^ codes[at + shift]) <= limit]
                yield codes[at + shift], codes[at]
            for k in np.flatnonzero(size > FANOUT):
                yield spanning(np.unique(codes[cut[k] : cut[k + 1]]), limit)

        def send(keys, codes):
            for a, b in links(keys, codes):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            held.append((keys, batch.column(3).to_numpy().view(np.uint64)))
            if (keys[0] == keys[-1]).all() or (held[0][0][0] == keys[-1]).all():
                continue  # the bucket may go on in the next batch
            keys, codes = (np.concatenate(x) for x in zip(*held))
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1
            held = [(keys[last:], codes[last:])]
            yield from send(keys[:last], codes[:last])
        if held:
            yield from send(*(np.concatenate(x) for x in zip(*held)))

    return run


def near_links(codes: DataFrame, limit: int = 3, chunk: int = 4096) -> DataFrame:
    """(a, b): links of distinct fingerprints that span every group of codes at ``limit`` or fewer bits. codes: (fp)."""
    blocks = 2 * limit
    widths = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    ends = list(accumulate(widths))
    masks = [sum(((1 << widths[i]) - 1) << (ends[i] - widths[i]) for i in chosen) for chosen in combinations(range(blocks), limit)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = codes.select(
        "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "key")
    )
    large = keyed.groupBy("t", "key").count().where(F.col("count") > chunk)
    large = stage(large.select("t", "key", F.ceil(F.col("count") / chunk).cast("int").alias("parts")), "hot-buckets")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    dealt = keyed.join(large, ["t", "key"], "left").withColumn("own", own).withColumn("other", other)
    pair = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
    dealt = dealt.select(F.col("t").cast("long").alias("t"), "key", pair.alias("pair"), "fp")
    sorted_ = dealt.repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair", "fp")
    return sorted_.mapInArrow(_bucket_links(limit), "a long, b long")


def groups(docs: DataFrame, limit: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id of the linked group."""
    return _grouped(fingerprints(docs, words, seed), limit)


def _grouped(made: DataFrame, limit: int) -> DataFrame:
    """Groups of (doc_id, fp); the id may be of any type that has an order."""
    made = stage(made, "fingerprints")
    codes = stage(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    roots = stage(connected(near_links(codes.select("fp"), limit)), "roots")
    named = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = stage(named.join(best, "root").select("fp", "component_id"), "code-groups")
    return made.join(of_code, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    """A signed 64-bit integer as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, limit: int = 3) -> DataFrame:
    """``docs`` with one row per group: the smallest id, NULL ids last, then the smallest text hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.struct(
        F.col("doc_id").isNull().alias("n"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(text).alias("t")
    )
    made = docs.select(order.alias("doc_id"), _fp_udf(3, 42)(text.cast("binary")).alias("fp"))
    keys = _grouped(made, limit).where(F.col("doc_id") == F.col("component_id"))
    once = stage(keys.groupBy(F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("rows")), "kept")
    # "==" on structs calls equal NULL ids equal, and so does the hash of a join key
    kept = docs.select(F.struct("*").alias("doc"), order.alias("key")).join(once, "key")
    single = kept.where(F.col("rows") == 1).select("doc.*")
    return single.union(kept.where(F.col("rows") > 1).dropDuplicates(["key"]).select("doc.*"))
