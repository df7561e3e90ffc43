"""Benchmark decontamination: BM25 retrieval of test items by training passages, with block-max WAND.

Test items are cut into segments of at most ``segment`` words and indexed: per term, postings in segment order with their
BM25 impact divided by the score that the segment gives itself, so 1 means a passage that holds all of it. Each posting
list has its largest impact, and so has every block of postings. All passages (overlapping windows of all whole texts)
query the index. First the impacts of a passage's rare terms are added up per segment in numpy; only passages in which some
segment can still reach the threshold start block-max WAND, which returns every segment above it. For each item so found the document must
overlap with its question and with its answer: at least ``overlap`` of the five-word shingles of either.

The index goes to tasks in blocks of at most ``block_items`` items, one broadcast and one pass each, so what is
broadcast is bounded however many items there are; documents are never shuffled.

Rows: NULL and empty texts match nothing; items without words are left out. Repeated rows give repeated results; several
rows of one id are tested one by one. NULL ids stay NULL. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.llm.common import Shared, utf8_of
from netlume.staging import stage

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_FOLD = bytes.maketrans(_PUNCTUATION + bytes(range(65, 91)), b" " * len(_PUNCTUATION) + bytes(range(97, 123)))
_SENTENCE = re.compile(rb"[.?!]+[\x20\x09-\x0D]+")
BLOCK = 16
#: Terms in at most so many segments are added up for each segment before a search starts.
RARE = 12
SHINGLE = 5


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), ASCII punctuation taken as space."""
    return text.translate(_FOLD).split()


def question_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of all sentences but the last, and of the last one; an item of one sentence is cut in the middle."""
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    for end in reversed(ends):
        question, answer = words_of(text[:end]), words_of(text[end:])
        if question and answer:
            return question, answer
    words = words_of(text)
    return words[: (len(words) + 1) // 2], words[len(words) // 2 :]


def shingles(words: list[bytes]) -> set[bytes]:
    if len(words) < SHINGLE:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


class Index:
    """Inverted index of one block of items."""

    def __init__(self, items: list[tuple[int, bytes]], segment: int, k1: float = 1.2, b: float = 0.75):
        self.items = []  # (item id, question shingles, answer shingles)
        self.segment_item: list[int] = []
        bags: list[Counter] = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            question, answer = question_answer(text)
            parts = math.ceil(len(words) / segment)
            size = math.ceil(len(words) / parts)
            for i in range(0, len(words), size):
                bags.append(Counter(words[i : i + size]))
                self.segment_item.append(len(self.items))
            self.items.append((item_id, shingles(question), shingles(answer)))
        df = Counter(t for bag in bags for t in bag)
        mean = sum(sum(bag.values()) for bag in bags) / max(1, len(bags))
        postings = defaultdict(list)
        for s, bag in enumerate(bags):
            norm = k1 * (1 - b + b * sum(bag.values()) / mean)
            impact = {
                t: math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * n * (k1 + 1) / (n + norm)
                for t, n in bag.items()
            }
            own = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((s, x / own))
        self.term_no = {t: i + 1 for i, t in enumerate(postings)}
        self.ids = [[], *[[s for s, _ in p] for p in postings.values()]]
        self.impacts = [[], *[[x for _, x in p] for p in postings.values()]]
        self.block_max = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        self.top = np.array([max(x, default=0.0) for x in self.impacts])
        df = np.array([len(x) for x in self.ids])
        self.rare = (df > 0) & (df <= RARE)
        self.first = np.r_[0, np.cumsum(df)]
        self.flat_ids = np.array([s for x in self.ids for s in x], np.int64)
        self.flat_impacts = np.array([v for x in self.impacts for v in x])
        frequent = np.repeat(~self.rare, df)
        #: What the frequent terms can add to the score of each segment.
        self.cap = np.bincount(self.flat_ids[frequent], self.flat_impacts[frequent], minlength=len(bags))

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All (segment, score) with score >= least, by block-max WAND over distinct term numbers."""
        ids, top = self.ids, self.top
        cursors = [[ids[t][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (_, _, t) in enumerate(cursors):
                bound += top[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            head = cursors[: pivot + 1]
            reach, ids_end = 0.0, None
            for _, at, t in head:
                at = bisect_left(ids[t], doc, at)
                if at < len(ids[t]):
                    block = at // BLOCK
                    reach += self.block_max[t][block]
                    end = ids[t][min(len(ids[t]), (block + 1) * BLOCK) - 1]
                    ids_end = end if ids_end is None else min(ids_end, end)
            if reach >= least:
                score = 0.0
                for c in head:
                    c[1] = bisect_left(ids[c[2]], doc, c[1])
                    if c[1] < len(ids[c[2]]) and ids[c[2]][c[1]] == doc:
                        score += self.impacts[c[2]][c[1]]
                        c[1] += 1
                if score >= least:
                    found.append((doc, score))
                goal = doc + 1
            else:  # no segment up to the end of the shortest block, nor before the next list, can reach it
                goal = doc + 1 if ids_end is None else ids_end + 1
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, doc + 1)
            alive = []
            for c in head:
                c[1] = bisect_left(ids[c[2]], goal, c[1])
                if c[1] < len(ids[c[2]]):
                    c[0] = ids[c[2]][c[1]]
                    alive.append(c)
            cursors = alive + cursors[pivot + 1 :]
        return found

    def reachable(self, terms: np.ndarray, step: int, n: int, least: float) -> list[int]:
        """Passages in which some segment's rare terms, with all its frequent terms, could reach ``least``."""
        if (self.cap >= least).any():
            return list(range(n))
        at = np.flatnonzero(self.rare[terms])
        passage = np.concatenate([at // step, at // step - 1])
        term = np.concatenate([terms[at], terms[at]])
        there = (passage >= 0) & (passage < n)
        size = len(self.first)
        pairs = np.unique(passage[there] * size + term[there])
        passage, term = np.divmod(pairs, size)
        counts = self.first[term + 1] - self.first[term]
        ends = np.cumsum(counts)
        posting = np.arange(counts.sum()) + np.repeat(self.first[term] - ends + counts, counts)
        keys, group = np.unique(np.repeat(passage, counts) * len(self.cap) + self.flat_ids[posting], return_inverse=True)
        sums = np.bincount(group, self.flat_impacts[posting], minlength=len(keys))
        ok = sums + self.cap[keys % len(self.cap)] >= least - 1e-9
        return np.unique(keys[ok] // len(self.cap)).tolist()

    def matches(self, text: bytes, window: int, least: float, overlap: float) -> list[tuple]:
        """(item id, best score, passages, question overlap, answer overlap) of verified items."""
        words = words_of(text)
        if not words:
            return []
        get = self.term_no.get
        terms = np.fromiter([get(w, 0) for w in words], np.int32, len(words))
        step = window // 2
        n = max(1, -(-(len(words) - window) // step) + 1)
        best: dict[int, list] = {}
        for p in self.reachable(terms, step, n, least):
            distinct = [t for t in np.unique(terms[p * step : p * step + window]).tolist() if t]
            for s, score in self.search(distinct, least):
                hit = best.setdefault(self.segment_item[s], [0.0, set()])
                hit[0] = max(hit[0], score)
                hit[1].add(int(p))
        if not best:
            return []
        there = shingles(words)
        short = {len(x.split()) for i in best for part in self.items[i][1:] for x in part} - {SHINGLE}
        for size in short:
            there |= {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}
        out = []
        for i, (score, at) in sorted(best.items()):
            item_id, question, answer = self.items[i]
            q, a = len(question & there) / len(question), len(answer & there) / len(answer)
            if q >= overlap and a >= overlap:
                out.append((item_id, score, len(at), q, a))
        return out


def _make(value) -> Index:
    items, segment = value
    return Index(items, segment)


def _search_udf(index: Shared, window: int, least: float, overlap: float):
    keys = ("item_id", "score", "n_passages", "question_overlap", "answer_overlap")

    @F.pandas_udf("array<struct<item_id:long,score:double,n_passages:long,question_overlap:double,answer_overlap:double>>")
    def run(texts: pd.Series) -> pd.Series:
        made = index.get()
        return pd.Series([[dict(zip(keys, m)) for m in made.matches(t, window, least, overlap)] for t in texts])

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 128,
    least: float = 0.7,
    overlap: float = 0.8,
    block_items: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id, score, n_passages, question_overlap, answer_overlap): one row per document and item it leaks."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = items.where(F.length("text") > 0)
    blocks = max(1, math.ceil(items.count() / block_items))
    items = stage(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    passes = []
    for block in range(blocks):
        held = sorted(((r.item_id, bytes(r.text)) for r in items.where(F.col("block") == block).collect()), key=repr)
        # a segment is half a window, so a whole one lies inside some passage
        run = _search_udf(Shared(spark, (held, window // 2), _make), window, least, overlap)
        passes.append(utf8_of(docs).select("doc_id", F.xxhash64("text").alias("row"), F.explode(run("text")).alias("m")))
    found = reduce(DataFrame.union, passes)
    return found.select("doc_id", "m.*", "row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_bid"), F.col("row").alias("_brow"))
    bad = stage(bad.distinct(), "contaminated")
    row = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_id"), row.alias("_row"))
    on = F.col("_id").eqNullSafe(F.col("_bid")) & (F.col("_row") == F.col("_brow"))
    return keyed.join(bad, on, "left_anti").select("doc.*")
