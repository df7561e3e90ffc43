"""BPE by forced boundaries: cut where no vocabulary token can span, encode the fragments, concatenate.

A pair of bytes that occurs inside no token of the vocabulary can never end up inside one token of an encoding, so there
is a token boundary between the two bytes whatever stands around them. One lookup table of 65,536 flags marks these
certain cuts, together with the ends of the pre-tokens. What lies between two cuts is encoded on its own: numpy merges
all fragments of a chunk of texts at once, in each round the lowest-ranked pair of every fragment, and the ids of the
fragments are then put together again.

Merging every occurrence of a fragment's lowest rank in one round equals merging the leftmost one at a time as long as a
merge only uses tokens that earlier merges made; ``ForcedBpe`` checks this and otherwise merges one occurrence a round.
Fragments above ``LONG`` bytes go through a heap, so that a very long one costs O(n log n) and not rounds times length.

The vocabulary is a tokenizer file with a byte-level model (parameter ``vocabulary_file``). Added tokens are matched in
the text before pre-tokens are, longest first, as the tokenizer library does without further settings.

Rows: a NULL text is the empty text (no ids); NULL ids stay; repeated rows give repeated rows; other columns, whatever
their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.llm.common import Shared, text_of

#: Fixed value: the pre-token pattern of byte-level models.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.int32(2**31 - 1)  # the rank of a pair that does not merge
LONG = 512  # bytes of a fragment above which a heap is faster than rounds
CHUNK = 1_000_000  # characters whose pre-tokens are held at a time; a longer text is a chunk of its own
REMEMBERED = 400_000  # pre-tokens a worker remembers, in each of two generations; forgetting changes no result


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ForcedBpe:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()

        def spelt(token: str) -> bytes:
            return bytes(letters[x] for x in token)

        ids = {spelt(token): i for token, i in model["vocab"].items()}
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        sides = [(spelt(a), spelt(b)) for a, b in merges]
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(sides)}
        self.made = np.array([ids[a + b] for a, b in sides] or [0], np.int32)
        made_at = {}
        for r, new in enumerate(self.made.tolist()):
            made_at.setdefault(new, r)
        self.ordered = all(made_at.get(a, -1) < r and made_at.get(b, -1) < r for (a, b), r in self.rank.items())
        self.ordered &= len(made_at) == len(self.rank)
        # pairs by 64-bit key, sorted, for lookups of many pairs at a time; pairs of bytes have a table of their own
        keys = np.array([(a << 32) | b for a, b in self.rank] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([*self.rank.values()] or [NONE], np.int32)[order]
        both = self.byte_id.astype(np.int64)
        self.byte_rank = self.pair_ranks(np.repeat(both, 256), np.tile(both, 256)).reshape(256, 256)
        self.cut = np.ones((256, 256), bool)
        for token in ids:
            inside = np.frombuffer(token, np.uint8)
            self.cut[inside[:-1], inside[1:]] = False
        self.find = regex.compile(PRE_TOKEN).findall
        added = sorted(spec["added_tokens"], key=lambda x: -len(x["content"]))
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("added tokens must match as they are")
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in self.added) + ")").split if added else None
        self.pieces = [b""] * (max([*ids.values(), *(x["id"] for x in added)]) + 1)
        for token, i in ids.items():
            self.pieces[i] = token
        for x in added:
            written = x["content"]
            self.pieces[x["id"]] = spelt(written) if all(c in letters for c in written) else written.encode()
        self.known: dict[str, bytes] = dict(self.added)
        self.older: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def fragments(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Start of every fragment of the bytes of some pre-tokens, which end at ``ends``."""
        certain = self.cut[data[:-1], data[1:]]
        certain[ends[:-1] - 1] = True
        return np.concatenate([[0], np.flatnonzero(certain) + 1])

    def merge_all(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fragment, id) of every token, in order."""
        sizes = np.diff(np.append(starts, len(data)))
        names = np.arange(len(starts))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        long = sizes > LONG
        for i in np.flatnonzero(long):
            tokens = self.merge_long(data[starts[i] : starts[i] + sizes[i]])
            done.append((np.full(len(tokens), i), tokens))
        keep = np.repeat(~long, sizes)
        data, names, sizes = data[keep], names[~long], sizes[~long]
        tokens = self.byte_id[data]
        last = np.cumsum(sizes) - 1
        rank = np.full(len(data), NONE)
        rank[:-1] = self.byte_rank[data[:-1], data[1:]]
        rank[last] = NONE
        while len(names):
            starts = last - sizes + 1
            best = np.minimum.reduceat(rank, starts)
            idle = best == NONE
            if 3 * idle.sum() >= len(names):
                over = np.repeat(idle, sizes)
                done.append((np.repeat(names[idle], sizes[idle]), tokens[over]))
                tokens, rank, names, sizes, best = tokens[~over], rank[~over], names[~idle], sizes[~idle], best[~idle]
                last = np.cumsum(sizes) - 1
                if not len(names):
                    break
            wanted = np.repeat(best, sizes)
            at = np.flatnonzero((rank == wanted) & (wanted != NONE))
            whose = np.searchsorted(last, at)
            if self.ordered:
                # in a run of overlapping pairs (one token repeated) every second pair merges, from the left
                head = np.concatenate([[True], np.diff(at) != 1])
                run = at - at[np.flatnonzero(head)][np.cumsum(head) - 1]
                pick = run % 2 == 0
            else:
                pick = np.concatenate([[True], np.diff(whose) != 0])
            at, whose = at[pick], whose[pick]
            tokens[at] = self.made[rank[at]]
            stay = np.ones(len(tokens), bool)
            stay[at + 1] = False
            tokens, rank = tokens[stay], rank[stay]
            sizes = sizes - np.bincount(whose, minlength=len(names))
            last = np.cumsum(sizes) - 1
            at = at - np.arange(len(at))
            touched = np.concatenate([at, at[at > 0] - 1])
            touched = touched[touched + 1 < len(tokens)]
            rank[touched] = self.pair_ranks(tokens[touched], tokens[touched + 1])
            rank[last] = NONE
        owner = np.concatenate([x for x, _ in done])
        order = np.argsort(owner, kind="stable")
        return owner[order], np.concatenate([x for _, x in done])[order]

    def merge_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one fragment: a heap of (rank, position), stale entries skipped."""
        tokens = self.byte_id[data].tolist()
        n, get = len(tokens), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get((tokens[i], tokens[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j >= n or get((tokens[i], tokens[j])) != r:
                continue
            tokens[i], tokens[j] = int(self.made[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := get((tokens[i], tokens[k]))) is not None:
                    heappush(heap, (s, i))
            h = before[i]
            if h >= 0 and (s := get((tokens[h], tokens[i]))) is not None:
                heappush(heap, (s, h))
        return np.array([t for t in tokens if t >= 0], np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens and remember them."""
        coded = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in coded])
        data = np.frombuffer(b"".join(coded), np.uint8)
        starts = self.fragments(data, ends)
        owner, tokens = self.merge_all(data, starts)
        word = np.searchsorted(ends, starts, side="right")  # of each fragment
        upto = 4 * np.cumsum(np.bincount(word[owner], minlength=len(words)))
        packed, at = tokens.astype("<u4").tobytes(), 0
        for w, to in zip(words, upto.tolist()):
            self.known[w] = packed[at:to]
            at = to

    def pre_tokens(self, text: str) -> list[str]:
        if self.split is None:
            return self.find(text)
        parts = self.split(text)
        if len(parts) == 1:
            return self.find(text)
        # every second part is an added token
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.find(part))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out, held, room = [], [], CHUNK
        for text in texts:
            held.append(self.pre_tokens(text))
            room -= len(text)
            if room <= 0:
                out += self._flush(held)
                held, room = [], CHUNK
        return out + self._flush(held)

    def _flush(self, held: list[list[str]]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = dict(self.added), self.known
        known, older = self.known, self.older
        new = {w for words in held for w in words if w not in known}
        for w in [w for w in new if w in older]:
            known[w] = older[w]
            new.discard(w)
        if new:
            self.learn(list(new))
        return [b"".join(map(known.__getitem__, words)) for words in held]

    def decode(self, ids: bytes) -> str:
        """The text that ids stand for; bytes that are no valid UTF-8 are replaced."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _shared(df: DataFrame, vocabulary_file: str) -> Shared:
    with open(vocabulary_file, "rb") as f:  # a vocabulary: its size does not depend on the corpus
        return Shared(df.sparkSession, f.read(), ForcedBpe)


def encode(docs: DataFrame, vocabulary_file: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every document; ``decoded`` adds the text that the ids stand for, in the same pass."""
    model = _shared(docs, vocabulary_file)

    @F.pandas_udf("ids binary" + ", decoded string" * decoded)
    def run(texts: pd.Series) -> pd.DataFrame:
        bpe = model.get()
        ids = bpe.encode_all(texts.tolist())
        return pd.DataFrame({"ids": ids} | ({"decoded": [bpe.decode(x) for x in ids]} if decoded else {}), dtype=object)

    return text_of(docs).select("doc_id", run("text").alias("x")).select("doc_id", "x.*")


def decode(encoded: DataFrame, vocabulary_file: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); NULL ids are no ids."""
    model = _shared(encoded, vocabulary_file)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        bpe = model.get()
        return pd.Series([bpe.decode(x) for x in ids], dtype=object)

    return encoded.select("doc_id", run(F.coalesce("ids", F.lit(b""))).alias("text"))
