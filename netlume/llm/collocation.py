"""Phrase collocation mining with broadcast double-array tries.

Words become numbers once: a word that is too rare to be part of a frequent phrase is 0, and so is the end of a piece, so
that a staged row is a sequence of numbers in which no phrase reaches across a 0. Then phrases grow by one word a level.

* A trie of the frequent phrases of k-1 words is broadcast as a double array (base, check). numpy holds one state for
  every text position and advances all of them together, word by word.
* Positions whose state is alive after k-1 words see a possible phrase of k words. Each of two hashes puts it in one of
  its sketch's counters; the counters of all shards are summed. A phrase with a counter under the minimum cannot be frequent.
  What is left, each distinct phrase once, must also end in a frequent phrase of k-1 words (a semi join): those are the
  candidates. All tests are safe, no frequent phrase is lost.
* The trie of the candidates is broadcast, all positions advance through it again, and the accepting states are counted
  with one ``bincount`` per batch. The counts of all shards are summed and those under the minimum leave.

Everything that is broadcast has a bound: a vocabulary or trie above ``BLOCK_WORDS`` words or ``BLOCK_PHRASES`` phrases is
dealt out to several, one pass each. The tries of the blocks hold different phrases, so their counts simply add up.

Rows: a NULL text is the empty text; a NULL language is ``und``; repeated rows count each; ids and other columns, whatever
their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlume.llm.common import UPPER, Shared
from netlume.staging import stage

#: Fixed value: the characters that end a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
BREAK = b"\xff"  # no byte of UTF-8

BLOCK_WORDS = 500_000
BLOCK_PHRASES = 500_000
HASHES = 2  # sketches
WORDS_PER_CELL = 40  # of the corpus; a sketch has a power of two of counters
LEAST_BITS, MOST_BITS = 16, 29
CELL_ROW = 1 << 16  # counters in one row of a shard's sketch
COUNT_ROW = 1 << 13  # phrases in one row of a shard's counts
FAN_IN = 256  # shards whose sketches are added by one task
HELD_WORDS = 400_000  # distinct words counted in a task before they are passed on
LEAST_BUCKETS, BUCKET_PHRASES = 16, 20_000  # of the phrases seen, and about how many phrases are in one
HELD_SIGHTINGS = 1_000_000  # phrases seen in a task before repeats among them are removed
BATCH_BYTES = 1_000_000  # of text, or of numbers, that are worked on together
SALTS = 64

_TABLE = bytearray(range(256))
for _x in UPPER.encode():
    _TABLE[_x] += 32
for _x in PIECE_ENDS:
    _TABLE[_x] = BREAK[0]
_TABLE[0x09] = 0x20
_TABLE = bytes(_TABLE)


def words_of(text: bytes) -> list[bytes]:
    """Words in order, with ``BREAK`` where a piece ends. What is left to split at is the blank only."""
    return text.translate(_TABLE).replace(BREAK, b" \xff ").split()


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )


# ---- words ---------------------------------------------------------------------------------------


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, f) of every word; each task adds up what it sees before anything is shuffled."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, counts in seen.items():
                counts.pop(BREAK, None)
                yield pd.DataFrame({"lang": lang, "word": list(counts.keys()), "f": list(counts.values())})
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                seen.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, seen.values())) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    counted = texts.mapInPandas(work, "lang string, word binary, f bigint")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """Number the rows from 1 in the order of ``by``: sorted ranges, and the table of their sizes gives each an offset."""
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stage(ranged.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stage(sizes.select("_part", before.alias("_before")), "offsets")
    at = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    out_of = placed.withColumn("_part", part).join(offsets, "_part")
    return out_of.withColumn(out, F.col("_before") + at + 1).drop("_part", "_before", "_id")


def number_words(texts: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """(seq): per text its words as little-endian 32-bit numbers, 0 for a rare word or the end of a piece.

    Vocabularies above ``BLOCK_WORDS`` words are looked up block by block; the texts are then staged between blocks.
    """
    blocks = max(1, -(-n_words // BLOCK_WORDS))
    empty = F.lit(None).cast("binary")
    now = texts.withColumn("seq", empty)
    for block in range(blocks):
        part = words.where((F.col("id") - 1) % blocks == block) if blocks > 1 else words
        now = _look_up(now, part.select("lang", "word", "id").toArrow(), last=block == blocks - 1)
        if block < blocks - 1:
            now = stage(now, "numbered-texts")
    return now


def _look_up(texts: DataFrame, words: pa.Table, last: bool) -> DataFrame:
    def make(value: tuple[list[str], list[bytes], list[int]]) -> dict[str, dict[bytes, int]]:
        out: dict[str, dict[bytes, int]] = {}
        for lang, word, number in zip(*value):
            out.setdefault(lang, {})[word] = number
        return out

    model = Shared(texts.sparkSession, tuple(words[n].to_pylist() for n in ("lang", "word", "id")), make)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = model.get()
        for batch in batches:
            made = []
            for lang, text, old in zip(batch["lang"], batch["text"], batch["seq"]):
                known, found = vocabulary.get(lang, {}), words_of(text)
                seq = np.fromiter(map(known.get, found, repeat(0)), np.int32, len(found))
                if old is not None:
                    seq = np.maximum(seq, np.frombuffer(old, "<i4"))
                if last:  # two numbers 0 in a row say no more than one
                    seq = seq[(seq > 0) | np.append(False, seq[:-1] > 0)]
                made.append(seq.astype("<i4").tobytes())
            yield pd.DataFrame({"seq": made}) if last else batch.assign(seq=made)

    return texts.mapInPandas(work, "seq binary" if last else texts.schema)


# ---- tries ---------------------------------------------------------------------------------------


def double_array(phrases: np.ndarray) -> tuple[np.ndarray, ...]:
    """(base, check, labels, accept, phrases) of distinct ``phrases`` of equal length (rows of word numbers).

    A word is written as ``digits_of(labels)`` digits below 256, those of its position in ``labels``, so that a node has
    256 children at most. State 0 is dead, state 1 the root; the child of state s by digit c is base[s] + c, if
    check[base[s] + c] is s. ``accept`` holds the accepting state of each phrase.
    """
    n = len(phrases)
    names = np.unique(phrases)
    digits = digits_of(names)
    order = np.lexsort(phrases.T[::-1])
    coded = np.searchsorted(names, phrases[order])
    coded = coded.astype(np.int32)
    room = 1024 + 2 * n
    base, check, taken = np.zeros(room, np.int32), np.zeros(room, np.int32), np.zeros(room, bool)
    taken[:2] = True
    rng, top = np.random.default_rng(n), 2  # places from ``top`` on are free
    state = np.ones(n, np.int32)  # of every phrase, after the steps so far
    for w, d in ((w, d) for w in range(phrases.shape[1]) for d in range(digits)[::-1]):
        step = (coded[:, w] >> (8 * d)) & 255
        edge = np.append(True, (np.diff(state) != 0) | (np.diff(step) != 0))
        heads = np.flatnonzero(edge)  # the first phrase of each edge
        parents, labels = state[heads], step[heads]
        starts = np.flatnonzero(np.append(True, np.diff(parents) != 0))
        counts = np.diff(np.append(starts, len(heads)))
        to = np.zeros(len(heads), np.int64)
        several = np.flatnonzero(counts > 1)
        need = top + 256 * len(several) + len(heads) + 512
        if need > len(taken):
            more = max(need, len(taken) * 2) - len(taken)
            base, check, taken = (np.append(x, np.zeros(more, x.dtype)) for x in (base, check, taken))
        # nodes with several children are placed one by one, the widest first: in a gap that takes all of them if one of
        # a few tries finds it, otherwise behind everything
        for i in several[np.argsort(-counts[several], kind="stable")]:
            span = slice(starts[i], starts[i] + counts[i])
            mine = labels[span]
            tries = rng.integers(2, top + 1, 16)[:, None] + (mine - mine[0])
            fits = ~taken[tries].any(axis=1)
            spots = tries[fits.argmax()] if fits.any() else top + (mine - mine[0])
            taken[spots] = True
            top = max(top, int(spots[-1]) + 1)
            to[span] = spots
        # an only child may go anywhere: the free places in order
        single = starts[counts == 1]
        free = np.flatnonzero(~taken[: top + len(single)])[: len(single)]
        taken[free] = True
        top = max(top, int(free[-1]) + 1) if len(free) else top
        to[single] = free
        base[parents[starts]] = to[starts] - labels[starts]
        check[to] = parents
        state = to[np.cumsum(edge) - 1].astype(np.int32)
    accept = np.empty(n, np.int32)
    accept[order] = state
    return base[:top], check[:top], names.astype(np.int32), accept, phrases


def digits_of(names: np.ndarray) -> int:
    return max(1, -(-(len(names) - 1).bit_length() // 8))


class Trie:
    """The double array in a task."""

    def __init__(self, arrays: tuple[np.ndarray, ...]):
        self.base, self.check, self.labels, self.accept, self.phrases = arrays
        self.depth, self.digits = self.phrases.shape[1], digits_of(self.labels)

    def walk(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, states) of the positions at which a phrase of the trie begins; all advance a digit at a time."""
        label = np.minimum(np.searchsorted(self.labels, seq), len(self.labels) - 1)
        used = self.labels[label] == seq
        at = np.flatnonzero(used[: max(len(seq) - self.depth + 1, 0)])
        state = np.ones(len(at), np.int32)
        for word in range(self.depth):
            keep = used[at + word]
            at, state = at[keep], state[keep]
            for digit in range(self.digits)[::-1]:
                to = self.base[state] + ((label[at + word] >> (8 * digit)) & 255)
                ok = (to > 0) & (to < len(self.check))
                ok[ok] = self.check[to[ok]] == state[ok]
                at, state = at[ok], to[ok]
        return at, state


def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The numbers of many texts in one array, with a 0 between two texts."""
    held, size = [], 0
    for batch in batches:
        for seq in batch["seq"]:
            held.append(seq)
            size += len(seq)
            if size >= BATCH_BYTES:
                yield np.frombuffer(b"\0\0\0\0".join(held), "<i4")
                held, size = [], 0
    if held:
        yield np.frombuffer(b"\0\0\0\0".join(held), "<i4")


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """64 mixed bits of rows of word numbers."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def next_words(trie: Trie, seq: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Every sighting of a phrase one word longer than those of the trie: its word columns, and a number that tells it
    from others (the state of what the trie holds, and the next word)."""
    at, state = trie.walk(seq)
    keep = at + trie.depth < len(seq)
    at, state = at[keep], state[keep]
    keep = seq[at + trie.depth] > 0
    at, state = at[keep], state[keep]
    return [seq[at + i] for i in range(trie.depth + 1)], (state.astype(np.int64) << 32) | seq[at + trie.depth]


def cells_of(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The counter of each phrase in each sketch: separate digits of one 64-bit hash."""
    code = mixed(columns)
    return [((code >> np.uint64(64 - (i + 1) * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(HASHES)]


def sketch_bits(words: int) -> int:
    """Digits of a counter's number: the load of a counter does not grow with the input until the largest sketch."""
    return min(max((words // WORDS_PER_CELL).bit_length(), LEAST_BITS), MOST_BITS)


def _added(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    starts = np.flatnonzero(np.append(True, np.diff(cells) != 0)) if len(cells) else np.zeros(0, int)
    return cells[starts], np.add.reduceat(counts, starts) if len(cells) else counts


def sketch(seqs: DataFrame, tries: list[Broadcast], minimum: int, bits: int) -> list[np.ndarray]:
    """Per hash the packed flags of the counters in which the next longer phrases reach the minimum together.

    A task passes on the counters it has used. A counter stops at the largest value of the smallest type that can hold the
    minimum: a sum of such counters reaches the minimum exactly when the sum of the true counts does.
    """
    kind = np.min_scalar_type(minimum)
    most = int(np.iinfo(kind).max)
    parts = -(-seqs.rdd.getNumPartitions() // FAN_IN)

    def rows_of(cells: np.ndarray, counts: np.ndarray, part: int) -> pd.DataFrame:
        counts = np.minimum(counts, most).astype(kind)
        starts = np.flatnonzero(np.append(True, np.diff(cells // CELL_ROW) != 0))
        ends = np.append(starts[1:], len(cells))
        at = (cells % CELL_ROW).astype(np.uint16)
        return pd.DataFrame(
            {
                "row": cells[starts] // CELL_ROW,
                "part": part,
                "at": [at[i:j].tobytes() for i, j in zip(starts, ends)],
                "n": [counts[i:j].tobytes() for i, j in zip(starts, ends)],
            }
        )

    def count(trie: Broadcast):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, part = Trie(trie.value), TaskContext.get().partitionId() % parts
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for seq in sequences(batches):
                digits = cells_of(next_words(tree, seq)[0], bits)
                # the counters of the second hash are numbered after those of the first
                cells = np.concatenate([c + (i << bits) for i, c in enumerate(digits)])
                held.append(_added(cells, np.ones(len(cells), np.int64)))
                if sum(len(c) for c, _ in held) > HELD_SIGHTINGS:
                    held = [_added(*(np.concatenate(x) for x in zip(*held)))]
                    if len(held[0][0]) > HELD_SIGHTINGS // 2:
                        yield rows_of(*held.pop(), part)
            if held:
                cells, counts = _added(*(np.concatenate(x) for x in zip(*held)))
                if len(cells):
                    yield rows_of(cells, counts, part)

        return seqs.mapInPandas(work, "row int, part int, at binary, n binary")

    def total_of(rows: pd.DataFrame) -> np.ndarray:
        total = np.zeros(CELL_ROW, np.int64)
        for at, n in zip(rows["at"], rows["n"]):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, kind)
        return np.minimum(total, most)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = total_of(rows)
        used = np.flatnonzero(total)
        return rows_of(used + int(rows["row"].iloc[0]) * CELL_ROW, total[used], 0)

    def flag(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": rows["row"].iloc[:1], "full": [np.packbits(total_of(rows) >= minimum).tobytes()]})

    made = reduce(DataFrame.union, map(count, tries))
    if parts > 1:
        made = made.groupBy("row", "part").applyInPandas(add, made.schema)
    # at most HASHES << MOST_BITS bits reach the driver, whatever the input
    found = made.groupBy("row").applyInPandas(flag, "row int, full binary").toArrow()
    out = np.zeros((max(1, (HASHES << bits) // CELL_ROW), CELL_ROW // 8), np.uint8)
    for row, packed in zip(found["row"].to_pylist(), found["full"].to_pylist()):
        out[row] = np.frombuffer(packed, np.uint8)
    return list(out.reshape(HASHES, -1))


def is_full(packed: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (packed[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0


def sightings(seqs: DataFrame, tries: list[Broadcast], full: list[np.ndarray], bits: int) -> DataFrame:
    """(p): the distinct next longer phrases in full cells that begin with a phrase of the tries.

    A shard passes on what it has seen, each phrase once, in one row per bucket; buckets follow the number of full cells,
    and repeats from different shards are removed bucket by bucket, for ``FAN_IN`` shards at first.
    """
    sent = seqs.sparkSession.sparkContext.broadcast(full)
    parts = -(-seqs.rdd.getNumPartitions() // FAN_IN)
    buckets = max(LEAST_BUCKETS, int(np.bitwise_count(full[0]).sum()) // BUCKET_PHRASES)

    def rows_of(phrases: np.ndarray, part: int) -> pd.DataFrame:
        bucket = (mixed(list(phrases.T)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        phrases, bucket = np.ascontiguousarray(phrases[order], "<i4"), bucket[order]
        starts = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(bucket) else np.zeros(0, int)
        ends = np.append(starts[1:], len(bucket))
        packed = [phrases[i:j].tobytes() for i, j in zip(starts, ends)]
        return pd.DataFrame({"bucket": bucket[starts], "part": part, "p": packed})

    def see(trie: Broadcast):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            flags, tree, part = sent.value, Trie(trie.value), TaskContext.get().partitionId() % parts
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def distinct() -> tuple[np.ndarray, np.ndarray]:
                keys = np.concatenate([k for k, _ in held])
                keys, first = np.unique(keys, return_index=True)
                return keys, np.concatenate([p for _, p in held])[first]

            for seq in sequences(batches):
                columns, keys = next_words(tree, seq)
                keep = np.logical_and.reduce([is_full(f, cells) for f, cells in zip(flags, cells_of(columns, bits))])
                keys, first = np.unique(keys[keep], return_index=True)
                held.append((keys, np.stack([c[keep][first] for c in columns], axis=1)))
                if sum(len(k) for k, _ in held) > HELD_SIGHTINGS:
                    held = [distinct()]
                    if len(held[0][0]) > HELD_SIGHTINGS // 2:
                        yield rows_of(held.pop()[1], part)
            if held:
                yield rows_of(distinct()[1], part)

        def phrases_of(rows: pd.DataFrame) -> np.ndarray:
            seen = np.frombuffer(b"".join(rows["p"]), "<i4").reshape(-1, Trie(trie.value).depth + 1)
            return np.unique(seen, axis=0)

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            return rows_of(phrases_of(rows), 0)

        def name(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"p": list(phrases_of(rows))})

        made = seqs.mapInPandas(work, "bucket int, part int, p binary")
        if parts > 1:
            made = made.groupBy("bucket", "part").applyInPandas(merge, made.schema)
        return made.groupBy("bucket").applyInPandas(name, "p array<int>")

    # the tries hold different phrases, so their sightings differ too
    return reduce(DataFrame.union, map(see, tries))


def count_phrases(seqs: DataFrame, tries: list[Broadcast], minimum: int) -> DataFrame:
    """(p, f): how often the phrases of the tries occur, if ``minimum`` times at least.

    Each shard counts the accepting states and passes the counts on in rows of ``COUNT_ROW``, which are added up.
    """
    parts = -(-seqs.rdd.getNumPartitions() // FAN_IN)

    def count(trie: Broadcast):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, part = Trie(trie.value), TaskContext.get().partitionId() % parts
            total = np.zeros(len(tree.check), np.int64)
            for seq in sequences(batches):
                total += np.bincount(tree.walk(seq)[1], minlength=len(total))
            accepted = total[tree.accept]
            rows = [accepted[i : i + COUNT_ROW] for i in range(0, len(accepted), COUNT_ROW)]
            used = [i for i, n in enumerate(rows) if n.any()]
            yield pd.DataFrame({"row": used, "part": part, "n": [rows[i].tobytes() for i in used]})

        def total_of(rows: pd.DataFrame) -> np.ndarray:
            return np.sum([np.frombuffer(n, np.int64) for n in rows["n"]], axis=0)

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"row": rows["row"].iloc[:1], "part": 0, "n": [total_of(rows).tobytes()]})

        def name(rows: pd.DataFrame) -> pd.DataFrame:
            first, total = int(rows["row"].iloc[0]) * COUNT_ROW, total_of(rows)
            kept = np.flatnonzero(total >= minimum)
            return pd.DataFrame({"p": list(Trie(trie.value).phrases[first + kept]), "f": total[kept]})

        made = seqs.mapInPandas(work, "row int, part int, n binary")
        if parts > 1:
            made = made.groupBy("row", "part").applyInPandas(add, made.schema)
        return made.groupBy("row").applyInPandas(name, "p array<int>, f bigint")

    return reduce(DataFrame.union, map(count, tries))


def tries_of(phrases: DataFrame, n: int, length: int) -> list[Broadcast]:
    """Tries of about ``BLOCK_PHRASES`` phrases at most."""
    blocks = -(-n // BLOCK_PHRASES)
    out = []
    for block in range(blocks):
        part = phrases.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == block) if blocks > 1 else phrases
        words = part.select(*[F.col("p")[i].alias(f"w{i}") for i in range(length)]).toArrow()
        rows = np.stack([words.column(i).to_numpy() for i in range(length)], axis=1).astype(np.int32)
        out.append(phrases.sparkSession.sparkContext.broadcast(double_array(rows)))
    return out


# ---- phrases -------------------------------------------------------------------------------------


def frequent_phrases(docs: DataFrame, minimum: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(p, f) of every phrase of up to ``longest`` words that occurs ``minimum`` times in a language; the words behind
    the numbers (id, lang, word); and the word occurrences of each language (lang, n)."""
    texts = texts_of(docs)
    counted = stage(count_words(texts), "word-counts")
    totals = stage(counted.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    words = stage(numbered(counted.where(F.col("f") >= minimum), ["lang", "word"], "id"), "words")
    seqs = stage(number_words(texts, words, words.count()), "sequences")
    bits = sketch_bits(totals.agg(F.sum("n")).first()[0] or 0)
    levels = [words.select(F.array(F.col("id").cast("int")).alias("p"), "f")]
    for length in range(2, longest + 1):
        n = levels[-1].count()
        if not n:
            break
        known = tries_of(levels[-1], n, length - 1)
        seen = stage(sightings(seqs, known, sketch(seqs, known, minimum, bits), bits), "sightings")
        ends = levels[-1].select("p")
        safe = seen.join(ends.withColumnRenamed("p", "_end"), F.slice("p", 2, length - 1) == F.col("_end"), "left_semi")
        candidates = stage(safe, "candidates")
        tries = tries_of(candidates, candidates.count(), length)
        if not tries:
            break
        levels.append(stage(count_phrases(seqs, tries, minimum), "phrases"))
    return reduce(DataFrame.union, levels), words, totals


def inside(phrases: DataFrame, longest: int) -> DataFrame:
    """(p, most): the phrases of two words and more that lie inside a longer one, and how often the commonest such one
    occurs."""
    n = F.size("p")

    def slices(length: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), n - length + 1), lambda i: F.slice("p", i, length))
        return F.when(n > length, found).otherwise(F.array().cast("array<array<int>>"))

    listed = F.flatten(F.array(*map(slices, range(2, longest))))
    return phrases.select(F.explode(listed).alias("p"), "f").groupBy("p").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, minimum: int = 100, top: int = 2000, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language.

    The score of a phrase is that of its weakest cut, floor(1000 * a * n / (l * r)) in exact decimals. A phrase that lies
    inside a longer one which occurs as often is not listed.
    """
    known, words, totals = frequent_phrases(docs, minimum, longest)
    known = stage(known, "frequent")
    longer = known.where(F.size("p") > 1)
    of_word = words.select("id", "lang", "word")
    lang = longer.withColumn("id", F.col("p")[0].cast("long")).join(of_word.drop("word"), "id").drop("id")
    based = lang.join(totals, "lang").withColumnRenamed("f", "a")
    cuts = based.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    left = known.select(F.col("p").alias("_l"), F.col("f").alias("l"))
    right = known.select(F.col("p").alias("_r"), F.col("f").alias("r"))
    parted = cuts.join(left, F.slice("p", 1, F.col("k")) == F.col("_l")).drop("_l")
    rest = F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))
    parted = parted.join(right, rest == F.col("_r")).drop("_r")
    # 1000 * a * n stays below 10^38 for 10^17 words
    big: Column = F.expr("(1000BD * a * n) div (cast(l AS decimal(19,0)) * r)")
    scored = parted.withColumn("score", big.cast("long"))
    worst = scored.groupBy("p", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    kept = worst.join(inside(known, longest), "p", "left").where(F.col("most").isNull() | (F.col("most") < F.col("a")))
    spelt = (
        kept.select("p", F.posexplode("p").alias("at", "id"))
        .join(of_word, "id")
        .groupBy("p")
        .agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("x"))
        .select("p", F.array_join(F.col("x.word"), " ").alias("phrase"))
    )
    rows = kept.join(spelt, "p").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # at most ``top`` rows of a language leave each of the salted groups, so that no task sorts a whole language
    salted = Window.partitionBy("lang", "_salt").orderBy(*order)
    few = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = few.withColumn("_at", F.row_number().over(salted)).where(F.col("_at") <= top).drop("_salt", "_at")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
