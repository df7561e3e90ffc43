"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of pieces. Every adjacent pair that merges sits in the bucket of its merge rank. A bitmap
with one bit per rank and a summary bitmap with one bit per 256 ranks say which buckets hold something, so
find-first-set on the summary and then on one word yields the next rank. A bucket is a small heap of positions, because
equal ranks merge from the left. Entries are not removed when a neighbour merges: a popped entry counts only if the pair
at its position still has that rank. A pre-token of n bytes costs O(n log n), however long it is.

Texts are encoded in blocks. The short pre-tokens that a block brings for the first time share one queue: they lie in one
linked list, no pair crosses from one to the next, and a pop merges the leftmost pair of its rank in each of them at once.

Rows: a NULL text is the empty text (no ids); NULL ids stay; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.llm.common import Shared, keep_freed, text_of

#: Pre-tokens remembered per Python worker in each of two generations; forgetting changes no result.
REMEMBERED = 450_000
#: Characters of a block (one text at least), most bytes of a short pre-token, more new ones than the last share a queue.
BLOCK, SHORT, MANY = 4_000_000, 256, 2_000


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class RankQueue:
    """Buckets of positions by merge rank, and a bitmap of the ranks whose bucket is not empty (256 to a word).

    The summary bitmap, with one bit per word, is all zero between two pre-tokens and lives in ``Bpe.merge``.
    """

    def __init__(self, n_ranks: int):
        self.words = [0] * (n_ranks // 256 + 1)
        self.buckets: dict[int, list[int]] = {}


class Bpe:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.queue = RankQueue(len(self.pieces))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before; still looked up, and then known again
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)])
        # pairs of pieces that make a piece, as one number, and the rank of that piece
        self.base = len(self.pieces)
        pairs = [(self.base * self.base, -1)]
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left = ranks.get(piece[:cut])
                if left is not None:
                    right = ranks.get(piece[cut:])
                    if right is not None:
                        pairs.append((left * self.base + right, rank))
        self.pairs, self.made = np.array(sorted(pairs)).T.copy()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        n, get, queue = len(word), self.ranks.get, self.queue
        after = list(range(1, n + 1))  # start of the following piece
        before = list(range(-1, n - 1))
        ranks = [get(word[i : i + 2], -1) for i in range(n - 1)]  # of the pair that begins here
        ranks.append(-1)
        # push and pop of the queue are written out here: calls would double the time of a short pre-token
        words, buckets, summary = queue.words, queue.buckets, 0
        for i, rank in enumerate(ranks):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so still a heap
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= 1 << (rank & 255)
                    summary |= 1 << (rank >> 8)
        while summary:
            high = (summary & -summary).bit_length() - 1
            bits = words[high]
            rank = (high << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[high] = bits = bits & (bits - 1)
                if not bits:
                    summary &= summary - 1
            if ranks[i] != rank:
                continue  # stale: the piece or its neighbour has grown or gone
            mid = after[i]
            end = after[mid]
            after[i] = end
            ranks[mid] = -1
            left = before[i]
            new = -1
            if end < n:
                before[end] = i
                new = get(word[i : after[end]], -1)
            ranks[i] = new
            if new >= 0:
                if new in buckets:
                    heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    words[new >> 8] |= 1 << (new & 255)
                    summary |= 1 << (new >> 8)
            if left >= 0:
                ranks[left] = new = get(word[left:end], -1)
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], left)
                    else:
                        buckets[new] = [left]
                        words[new >> 8] |= 1 << (new & 255)
                        summary |= 1 << (new >> 8)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return ids

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of pieces; -1 where a pair makes no piece."""
        pair = left * self.base + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.made[at], -1)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens, none empty, from one queue."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n, sizes = len(data), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        word = np.append(np.repeat(np.arange(len(words)), sizes), -1)
        piece = np.append(self.byte[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # starts of the neighbouring pieces
        before[ends - sizes] = -1
        alive = np.ones(n, bool)
        ranks = np.append(self.rank_of(piece[: n - 1], piece[1:n]), (-1, -1))  # of the pair that begins here
        ranks[ends - 1] = -1
        words_, buckets, summary = self.queue.words, self.queue.buckets, 0

        def push(at: np.ndarray, new: np.ndarray) -> int:
            """The summary bits of what goes into the buckets."""
            order = np.argsort(new, kind="stable")
            at, new = at[order], new[order]
            cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
            bits, start = 0, 0
            for rank, stop in zip(new[np.append(0, cuts)].tolist(), [*cuts.tolist(), len(at)]):
                if rank >= 0:
                    if rank in buckets:
                        buckets[rank].append(at[start:stop])
                    else:
                        buckets[rank] = [at[start:stop]]
                        words_[rank >> 8] |= 1 << (rank & 255)
                        bits |= 1 << (rank >> 8)
                start = stop
            return bits

        summary |= push(np.arange(n), ranks[:n])
        while summary:
            high = (summary & -summary).bit_length() - 1
            bits = words_[high]
            rank = (high << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets.pop(rank)
            i = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
            i = i[ranks[i] == rank]  # the others are stale
            i.sort()
            own = word[i]
            first = np.append(True, own[1:] != own[:-1])[: len(i)]
            if first.all():
                words_[high] = bits = bits & (bits - 1)
                if not bits:
                    summary &= summary - 1
            else:  # the next pair of a pre-token waits: the merge may make one of lower rank
                buckets[rank] = [i[~first]]
                i, own = i[first], own[first]
            if not len(i):
                continue
            mid = after[i]
            end = after[mid]
            after[i] = end
            piece[i] = rank
            ranks[i] = ranks[mid] = -1
            alive[mid] = False
            inside = word[end] == own
            right, end, left = i[inside], end[inside], before[i]
            before[end] = right
            left = left[left >= 0]
            at = np.concatenate((right, left))
            if len(at):
                ranks[at] = new = self.rank_of(piece[at], piece[np.concatenate((end, after[left]))])
                summary |= push(at, new)
        kept = np.cumsum(np.bincount(word[:n][alive], minlength=len(words))) * 4
        ids, at = piece[:n][alive].astype("<u4").tobytes(), [0, *kept.tolist()]
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def learn(self, new: set[str]) -> list[str]:
        """Makes pre-tokens known; those too long to be remembered are returned."""
        known, older, whole = self.known, self.older, self.ranks
        short, long = [], []
        for piece in new:
            ids = older.get(piece)
            if ids is None:
                word = piece.encode()
                rank = whole.get(word)
                if rank is not None:
                    ids = _pack([rank])
                elif len(word) <= SHORT:
                    short.append((piece, word))
                    continue
                else:
                    ids = _pack(self.merge(word))
                    long.append(piece)
            known[piece] = ids
        if len(short) <= MANY:
            known.update((piece, _pack(self.merge(word))) for piece, word in short)
        else:
            known.update(zip((piece for piece, _ in short), self.merge_all([word for _, word in short])))
        return long

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, found, size = [], [], 0

        def done():
            long = self.learn(set().union(*found).difference(self.known))
            out.extend(b"".join(map(self.known.__getitem__, pieces)) for pieces in found)
            for piece in long:
                del self.known[piece]
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known

        for text in texts:
            found.append(self.find(text))
            size += len(text)
            if size >= BLOCK:
                done()
                found, size = [], 0
        done()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, raw.splitlines())}


def _make(value: tuple[bytes, str]) -> Bpe:
    return Bpe(read_ranks(value[0]), value[1])


def _shared(df: DataFrame, ranks_file: str, pattern: str) -> Shared:
    with open(ranks_file, "rb") as f:  # a vocabulary: its size does not depend on the corpus
        return Shared(df.sparkSession, (f.read(), pattern), _make)


def encode(docs: DataFrame, ranks_file: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every document; ``decoded`` adds the bytes that the ids stand for, in the same pass."""
    model = _shared(docs, ranks_file, pattern)

    @F.pandas_udf("ids binary" + ", decoded binary" * decoded)
    def run(texts: pd.Series) -> pd.DataFrame:
        keep_freed()
        bpe = model.get()
        ids = bpe.encode_all(texts)
        return pd.DataFrame({"ids": ids} | ({"decoded": [bpe.decode(x) for x in ids]} if decoded else {}))

    return text_of(docs).select("doc_id", run("text").alias("x")).select("doc_id", "x.*")


def decode(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that are no valid UTF-8 are replaced."""
    model = _shared(encoded, ranks_file, pattern)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        bpe = model.get()
        return pd.Series([bpe.decode(x).decode("utf-8", "replace") for x in ids], dtype=object)

    return encoded.select("doc_id", run(F.coalesce("ids", F.lit(b""))).alias("text"))
