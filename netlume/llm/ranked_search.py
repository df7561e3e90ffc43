"""Ranked lexical search over a K2-treap of the term-document grid.

The grid has one row per term that occurs in an item, and one column per document; a point holds the impact of the term in
the document. A K2-treap is the quadtree of that grid without its empty cells: four bits say which quarters of a cell are
there, and every cell stores the largest impact below it. Rows stand in the order of falling document frequency, so that
rare terms share cells that are mostly empty, and columns in the order of document ids.

An item follows one row path per term. All its paths descend together over one range of documents: the sum of weight
times stored maximum over the paths bounds the score of every document in the range. The ranges with the highest bounds
are halved first (several in one numpy step), until no bound can still enter the item's list. Of equal bounds the range
with the smaller documents comes first, and a range whose bound equals the last listed score is left out only if its
documents come later, so that ties end in the order of ids. The result is exact.

Spark deals out the documents: each task builds the treap of one block of documents after the other and carries the lists
of the items along, which cut the search in later blocks short; the lists of all tasks are merged by a window in two
steps. Items above ``ITEM_BYTES`` of text are dealt out to several runs.

Rows: an item or document whose text is NULL has no terms; NULL ids stay and come first among equal scores; repeated
documents count and are listed each; repeated (item_id, text) rows are one item; other columns, whatever their names, are
ignored; empty tables give an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush, nsmallest
from math import floor, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlume.staging import stage

TOP = 50
ITEM_BYTES = 16_000_000  # of item texts whose terms share one grid
BLOCK_DOCS = 1 << 13  # columns of one treap
BLOCK_POINTS = 1_000_000
STEP = 128  # ranges halved together
SALTS = 64

#: Fixed value: bytes that are part of a term are ASCII letters and digits, and whatever is not ASCII.
_IN_TERM = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _IN_TERM else 0x20 for b in range(256))
_BELOW = np.array([[(bits & ((1 << quarter) - 1)).bit_count() for quarter in range(4)] for bits in range(16)], np.int64)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class K2Treap:
    """Cells of all levels in one numbering, level by level, each level in Morton order; cell 0 is the whole grid.

    ``first`` is the number of a cell's first quarter, ``bits`` says which quarters exist (2 * lower half of the rows +
    right half of the columns), ``most`` is the largest impact in the cell.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, height: int):
        self.height = height
        code = np.zeros(len(rows), np.int64)
        for bit in range(height):
            code |= ((rows >> bit) & 1) << (2 * bit + 1) | ((columns >> bit) & 1) << (2 * bit)
        order = np.argsort(code)
        code, most = code[order], impacts[order].astype(np.int64)
        levels = []
        bits, counts = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for _ in range(height):
            levels.append((bits, counts, most))
            quarter, code = code & 3, code >> 2
            starts = np.flatnonzero(np.append(True, np.diff(code) != 0))
            bits = np.bitwise_or.reduceat(1 << quarter, starts)
            counts = np.diff(np.append(starts, len(code)))
            most = np.maximum.reduceat(most, starts)
            code = code[starts]
        levels.append((bits, counts, most))
        levels.reverse()
        bits, counts, self.most = (np.concatenate([level[i] for level in levels]) for i in range(3))
        self.bits = bits.astype(np.int8)
        self.first = np.cumsum(counts) - counts + 1  # every cell but the first is a quarter of one before it


def search(treap: K2Treap, ids: list[tuple], rows: np.ndarray, weights: np.ndarray, best: list[tuple]) -> list[tuple]:
    """The ``TOP`` least (-score, document) of ``best`` and the documents of the treap, sorted.

    ``ids``: the sort key of every column, ascending; ``rows``, ``weights``: the item's terms.
    """
    height = treap.height
    limit = best[-1] if len(best) == TOP else None
    # (-bound, key of the first document, level, first column, the cell of every path)
    ranges = [(-int(treap.most[0] * weights.sum()), ids[0], 0, 0, np.zeros(len(rows), np.int64))]
    while ranges:
        taken = []
        while ranges and len(taken) < STEP:
            if limit is not None and ranges[0][:2] > limit:
                ranges.clear()
                break
            taken.append(heappop(ranges))
        if not taken:
            break
        level = np.array([r[2] for r in taken])
        column = np.array([r[3] for r in taken])
        cells = np.stack([r[4] for r in taken])
        shift = height - 1 - level
        half = 2 * ((rows >> shift[:, None]) & 1)
        bits, first = treap.bits[cells], treap.first[cells]
        found = False
        for right in (0, 1):
            quarter = half + right
            there = (cells >= 0) & ((bits >> quarter) & 1 == 1)
            child = np.where(there, first + _BELOW[bits, quarter], -1)
            bound = np.where(there, treap.most[child] * weights, 0).sum(axis=1)
            start = column + (right << shift)
            open_ = np.flatnonzero(bound >= (1 if limit is None else -limit[0]))
            for i, score, at, depth in zip(*(x.tolist() for x in (open_, bound[open_], start[open_], level[open_] + 1))):
                key = (-score, ids[at])
                if limit is not None and key > limit:
                    continue
                if depth == height:
                    best.append(key)
                    found = True
                else:
                    heappush(ranges, (*key, depth, at, child[i]))
        if found and len(best) >= TOP:
            best = nsmallest(TOP, best)
            limit = best[-1]
    return sorted(best)


def _item_blocks(items: DataFrame) -> Iterator[pd.DataFrame]:
    """(item_id, terms) of bounded blocks of items; terms are distinct."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stage(items.select(F.col("item_id").cast("long"), text.alias("text")).distinct(), "items")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // ITEM_BYTES)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        got = part.select(F.col("item_id").cast("string"), "text").toPandas()
        got["terms"] = [list(dict.fromkeys(terms_of(bytes(x)))) for x in got["text"]]
        yield got[got["terms"].map(len) > 0]


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts) per document: how many terms it has, and which of the vocabulary how often, as
    little-endian 32-bit numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {term: i for i, term in enumerate(sent.value)}
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch["text"]:
                found = terms_of(text)
                seen = Counter(map(number.get, found))
                seen.pop(None, None)
                sizes.append(len(found))
                terms.append(np.fromiter(seen.keys(), "<i4", len(seen)).tobytes())
                counts.append(np.fromiter(seen.values(), "<i4", len(seen)).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": sizes, "terms": terms, "counts": counts})

    texts = docs.select(
        F.col("doc_id").cast("long").cast("string").alias("doc_id"),  # an integer column with NULLs would become doubles
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    return texts.mapInPandas(work, "doc_id string, n bigint, terms binary, counts binary")


def document_frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"]), "<i4"), minlength=n_terms)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"term": hit, "df": total[hit]})

    counted = rows.select("terms").mapInPandas(work, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(n_terms, np.int64)
    for r in counted.toPandas().itertuples():  # one row per term of one block of items
        out[r.term] = r.df
    return out


def top_of_shards(rows: DataFrame, items: list[list[int]], df: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, score): the ``TOP`` documents of each item in every task."""
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(df), np.int64)
    place[order] = np.arange(len(df))
    heavy = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    wanted = []
    for terms in items:
        mine = np.array([t for t in terms if df[t] and heavy[t]], np.int64)
        wanted.append((place[mine], heavy[mine]))
    sent = rows.sparkSession.sparkContext.broadcast((wanted, place))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, place = sent.value
        best: list[list[tuple]] = [[] for _ in wanted]
        held: list[tuple] = []
        points = 0

        def flush() -> None:
            # a document's key: documents without an id first, then by id
            held.sort(key=lambda x: x[0])
            sizes = [len(x[2]) // 4 for x in held]
            terms = place[np.frombuffer(b"".join(x[2] for x in held), "<i4")]
            if len(terms):
                tf = np.frombuffer(b"".join(x[3] for x in held), "<i4").astype(np.int64)
                m = np.repeat(np.array([50 + 50 * x[1] * n_docs // n_terms for x in held], np.int64), sizes)
                columns = np.repeat(np.arange(len(held)), sizes)
                impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
                height = max(1, (max(len(held), len(place)) - 1).bit_length())
                treap, ids = K2Treap(terms, columns, impacts, height), [x[0] for x in held]
                for i, (mine, weights) in enumerate(wanted):
                    if len(mine):
                        best[i] = search(treap, ids, mine, weights, best[i])
            held.clear()

        for batch in batches:
            for doc, n, terms, counts in zip(batch["doc_id"], batch["n"], batch["terms"], batch["counts"]):
                if not terms:
                    continue
                held.append(((0, 0) if doc is None else (1, int(doc)), n, terms, counts))
                points += len(terms) // 4
                if len(held) >= BLOCK_DOCS or points >= BLOCK_POINTS:
                    flush()
                    points = 0
        flush()
        for i, found in enumerate(best):
            if found:
                ids = [str(key[1]) if key[0] else None for _, key in found]
                yield pd.DataFrame({"item": i, "doc_id": ids, "score": [-s for s, _ in found]})

    made = rows.mapInPandas(work, "item int, doc_id string, score bigint")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def search_all(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item, at most ``TOP``."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id long, doc_id long, score long, item string")
    for number, block in enumerate(_item_blocks(items)):
        if not len(block):
            continue
        vocabulary = sorted({t for terms in block["terms"] for t in terms})
        at = {t: i for i, t in enumerate(vocabulary)}
        rows = stage(postings(docs, vocabulary), "postings")
        n_docs, n_terms = rows.where(F.col("n") > 0).agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = document_frequencies(rows, len(vocabulary))
        shards = top_of_shards(rows, [[at[t] for t in terms] for terms in block["terms"]], df, n_docs, n_terms)
        named = pd.DataFrame({"item": range(len(block)), "item_id": block["item_id"].tolist()}, dtype=object)
        names = spark.createDataFrame(named, "item int, item_id string")
        key = F.concat_ws(":", F.lit(number), F.col("item")).alias("item")
        made = shards.join(names, "item").select(F.col("item_id").cast("long"), "doc_id", "score", key)
        found = found.union(made)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    salted = Window.partitionBy("item", "_salt").orderBy(*order)
    few = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    few = few.withColumn("_at", F.row_number().over(salted)).where(F.col("_at") <= top).drop("_salt", "_at")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
