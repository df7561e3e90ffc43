"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

Every ``span``-byte string of a text has one anchor: the position of the smallest hash among its ``gram``-byte grams (the
first, of equal ones). Equal strings have equal anchors at equal offsets, so a string can only repeat under one anchor
hash. The strings of a text fall into runs with one anchor each; a run is a stretch of bytes.

1. Runs become narrow rows: 64-bit anchor hash, 64-bit content hash, place. Counts of contents and anchors are aggregates with
   map-side sums, so any number of exact copies collapses before the shuffle.
2. A content with two or more places is repeated as a whole. Only anchors with two or more different contents need their
   bytes: one copy of each content goes to the partition of its anchor.
3. There, contents arrive in batches. Each batch gets a suffix array of its span-byte strings, is merge-scanned against
   the arrays of all existing levels for equal strings, and is added; levels of about equal size merge, so a string
   takes part in O(log n) merges. The strings of an anchor with more than ``chunk`` contents are dealt one by one, by
   their hash, so no task depends on how often an anchor occurs; ``part`` bounds the strings of a task.
4. Repeated offsets go back to the places of each content, and one aggregate per document unites them.

Rows: a NULL or empty text has no bytes. Repeated rows repeat each other and lose all but what is shorter than ``span``.
Rows with one id and different texts are told apart by a text hash. NULL ids are allowed. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from netlume.llm.common import utf8_of
from netlume.staging import stage

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
PIECE = 1 << 18
#: Strings in one batch of a task.
BATCH = 1 << 15
#: Runs in one batch of rows.
RUN_ROWS = 1 << 14


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


_UP: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A well mixed 64-bit hash of every gram; equal grams have equal hashes wherever they are."""
    size = 1 << max(16, int(len(raw)).bit_length())
    if size not in _UP:
        _UP.clear()
        _UP[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
    up, down = (x[: len(raw)] for x in _UP[size])
    sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up)
    h = sums[gram - 1 :].copy()
    h[1:] -= sums[:-gram]
    h *= down[: len(h)]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def window_first_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the position of its smallest value (the first of equals)."""
    n = len(h)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    least = np.minimum(right[:starts], left[width - 1 : width - 1 + starts])
    # the first place with that value: windows with one minimum share it while it stays inside
    change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    length = np.diff(np.r_[change, starts])
    out = np.empty(starts, np.int64)
    single = np.empty(len(change), np.int64)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    # first position >= the start of the run that holds the value
    lo = np.searchsorted(ranked, least[change], "left")
    hi = np.searchsorted(ranked, least[change], "right")
    alone = hi - lo == 1
    single[alone] = order[lo[alone]]
    out[:] = np.repeat(single, length)
    for k in np.flatnonzero(~alone):
        places = order[lo[k] : hi[k]]
        at = np.arange(change[k], change[k] + length[k])
        out[at] = places[np.searchsorted(places, at)]
    return out


def runs(text: bytes, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, anchor, anchor hash) of every run of a text."""
    parts, width, n = [], span - gram + 1, len(text) - span + 1
    for lo in range(0, max(n, 0), PIECE):  # bounded memory for very long texts
        size = min(PIECE, n - lo)
        h = gram_hashes(np.frombuffer(text, np.uint8)[lo : lo + size + span - 1], gram)
        anchor = window_first_min(h, width)
        cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        parts.append((cut + lo, np.diff(np.r_[cut, size]), anchor[cut] + lo, h[anchor[cut]].view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


class SuffixFamily:
    """Sorted arrays of span-byte strings; a level is more than twice as large as the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (sorted strings, their numbers)

    def add(self, strings: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
        """Numbers of the strings that repeat within the batch or between it and a level; then the batch is added."""
        order = np.argsort(strings, kind="stable")
        strings, numbers = strings[order], numbers[order]
        same = strings[1:] == strings[:-1]
        found = [numbers[1:][same], numbers[:-1][same]]
        for old, of in self.levels:
            lo = np.searchsorted(old, strings)
            hit = old[np.minimum(lo, len(old) - 1)] == strings
            found += [numbers[hit], of[lo[hit]]]
        # one of equal strings is enough to find later ones: all of them are found already
        self.levels.append((strings, numbers))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, of_a), (b, of_b) = self.levels.pop(), self.levels.pop()
            both = np.concatenate([b, a])
            order = np.argsort(both, kind="stable")  # two sorted halves: one merge
            self.levels.append((both[order], np.concatenate([of_b, of_a])[order]))
        return found


def _strings(contents: list[bytes], span: int) -> np.ndarray:
    """All span-byte strings of the contents, with a last byte that keeps zero bytes before it in comparisons."""
    windows = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(c, np.uint8), span) for c in contents]
    out = np.ones((sum(map(len, windows)), span + 1), np.uint8)
    at = 0
    for w in windows:
        out[at : at + len(w), :span] = w
        at += len(w)
    return out.view(f"S{span + 1}").ravel()


def _ranges(offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [o, o + span) over sorted offsets."""
    gap = np.diff(offsets) > span
    return offsets[np.r_[True, gap]], offsets[np.r_[gap, True]] + span


def _scan(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = SuffixFamily()
        keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        owners, offsets, repeated, held, size, total = [], [], [], [], 0, 0

        def take(contents: list[bytes], first: int):
            nonlocal total
            sizes = np.array([len(c) - span + 1 for c in contents])
            n = int(sizes.sum())
            owners.append(np.repeat(np.arange(first, first + len(contents)), sizes))
            offsets.append(np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            repeated.extend(family.add(_strings(contents, span), np.arange(total, total + n)))
            total += n

        first = 0
        for batch in batches:
            keys.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            for content in batch.column(3).to_pylist():
                held.append(content)
                size += len(content) - span + 1
                if size >= BATCH:
                    take(held, first)
                    first, held, size = first + len(held), [], 0
        if held:
            take(held, first)
        if not total:
            return
        owner, offset = np.concatenate(owners), np.concatenate(offsets)
        at = np.unique(np.concatenate(repeated))
        anchor, c, base = (np.concatenate(x) for x in zip(*keys))
        rows = []
        cut = np.flatnonzero(np.r_[True, np.diff(owner[at]) != 0, True]) if len(at) else np.zeros(1, int)
        for lo, hi in zip(cut[:-1], cut[1:]):
            k = owner[at[lo]]
            a, b = _ranges(offset[at[lo:hi]] + base[k], span)
            rows.append((np.full(len(a), anchor[k]), np.full(len(a), c[k]), a, b))
        if rows:
            columns = [pa.array(np.concatenate(x)) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "c", "a", "b"])

    return run


def _find_runs(span: int, gram: int):
    """(doc_id, row, anchor, c, start, n) of the runs of every text, in batches of about ``RUN_ROWS``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "c", "start", "n")
        held, at, size = [], [], 0

        def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = dict(zip(names, map(np.concatenate, zip(*held))))
            place = pa.array(np.repeat(at, [len(h[0]) for h in held]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            made = {c: pa.array(columns[c], k) for c, k in zip(names, kinds)}
            return pa.RecordBatch.from_pydict({**{c: batch.column(c).take(place) for c in ("doc_id", "row")}, **made})

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                start, n, _, anchor = runs(text, span, gram)
                ends = (start + n + span - 1).tolist()
                c = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(start.tolist(), ends)), np.uint64, len(n))
                held.append((anchor, c.view(np.int64), start, n))
                at.append(i)
                size += len(n)
                if size >= RUN_ROWS:
                    yield flush(batch)
                    held, at, size = [], [], 0
            if size:
                yield flush(batch)
            held, at, size = [], [], 0

    return work


def repeated_ranges(docs: DataFrame, span: int = 200, gram: int = 50, chunk: int = 64, part: int = 200_000) -> DataFrame:
    """(doc_id, row, a, b): stretches [a, b) of bytes to remove; they may overlap."""
    rows = utf8_of(docs).select("doc_id", F.xxhash64("text").alias("row"), "text")
    long_enough = rows.where(F.octet_length("text") >= span)
    schema = StructType(long_enough.select("doc_id", "row").schema.fields)
    for name, kind in (("anchor", LongType()), ("c", LongType()), ("start", IntegerType()), ("n", IntegerType())):
        schema = schema.add(name, kind)
    all_runs = stage(long_enough.mapInArrow(_find_runs(span, gram), schema), "runs")
    twice = all_runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    places = stage(all_runs.join(stage(twice, "anchors"), "anchor"), "places")
    at = F.struct("doc_id", "row", "start", "n")
    contents = places.groupBy("anchor", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(at).alias("at"))
    contents = stage(contents, "contents")
    whole = contents.where("copies > 1").select("anchor", "c", F.lit(0).alias("a"), (F.col("at.n") + span - 1).alias("b"))
    mixed = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum("at.n").alias("strings")).where("k > 1")
    mixed = stage(mixed, "mixed")
    strings = mixed.agg(F.sum("strings")).first()[0] or 0
    needed = contents.join(mixed.withColumn("hot", F.col("k") > chunk).select("anchor", "hot"), "anchor")
    wanted = needed.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.row").alias("_row")).agg(
        F.collect_list(F.struct("anchor", "c", "hot", F.col("at.start").alias("start"), F.col("at.n").alias("n"))).alias("w")
    )
    once = long_enough.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    cut = F.transform("w", lambda r: r.withField("bytes", F.substring(F.col("text"), r["start"] + 1, r["n"] + span - 1)))
    pieces = once.select(F.explode(cut).alias("r")).select("r.*")
    pieces = stage(pieces.dropDuplicates(["anchor", "c"]), "pieces")
    cold = pieces.where("NOT hot").select("anchor", "c", F.lit(0).alias("base"), "bytes", F.lit(0).alias("salt"))
    i = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.substring(F.col("bytes"), k, F.lit(span))))
    hot = pieces.where("hot").select("anchor", "c", i.alias("base", "bytes"))
    hot = hot.select("anchor", "c", "base", "bytes", F.xxhash64("bytes").alias("salt"))
    parts = max(1, int(strings) // part)
    dealt = cold.union(hot).repartition(parts, "anchor", "salt").drop("salt")
    some = dealt.mapInArrow(_scan(span), "anchor long, c long, a long, b long")
    marks = stage(whole.union(some.selectExpr("anchor", "c", "int(a)", "int(b)")), "marks")
    hits = places.join(marks, ["anchor", "c"])
    return hits.select("doc_id", "row", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def _remove(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    out = []
    for text, lo, hi in zip(texts, a, b):
        if lo is None or not len(lo):
            out.append((0, 0, text))
            continue
        edge = np.zeros(len(text) + 1, np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, span: int = 200, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept is what stays of the UTF-8 bytes."""
    ranges = repeated_ranges(docs, span, **options)
    # equal ranges come from repeated rows
    pairs = F.collect_set(F.struct("a", "b"))
    per_row = ranges.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(pairs.alias("r"))
    rows = utf8_of(docs).withColumn("row", F.xxhash64("text"))
    joined = rows.join(per_row, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    remove = F.pandas_udf(_remove, "n_removed long, n_spans long, kept binary")
    done = remove("text", F.col("r.a"), F.col("r.b"))
    return joined.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), done.alias("d")).select(
        "doc_id", "n_bytes", "d.*"
    )
