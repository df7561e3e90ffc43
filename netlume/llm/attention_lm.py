"""Language-model scoring: a causal self-attention model in numpy on subword ids, beside a smoothed unigram base.

A text is its words in lower case (A-Z) and one end. Each word, with a space before it, is cut into subword ids of a
public vocabulary; a frequent word (``FREQUENT`` words at most, none that occurs only once) goes in whole, as one more id,
so words that occur once stand for unseen ones. The model predicts ids: one layer of masked self-attention gives a state, and

    P(id | context) = sum over topics t of P(kind of id, t | state) * P(id | kind, t).

Both factors see the context: the first is a softmax over kinds (rest or start of a word, common or rare whole word) and
topics, the state thereby weighs the topics' own distributions over all ids of a kind, which are counts over all training
texts, backed off to the counts of the kind. The ``SINGLE`` most frequent ids are a kind each. Topics are ``TOPICS`` groups
of texts by their most frequent words, such as languages. An id is read as the embedding of its kind plus a learned
projection of its shares of the topics. Windows of ``WINDOW`` ids overlap by ``LEAD``, so every id is scored once and sees
at least that many ids before it (unless the text begins there).

Counts of words, ids and topics, topic centres and weights take every training text. Words are counted by word; frequent
ones are cut off by a histogram of counts, never sorted in one task. Texts are encoded once, into a staged table of ids.
Weights: a bounded number of texts (``warm_docs``, by hash) makes a common start, then every shard of about ``shard_docs``
texts streams all its texts from there, and the results are averaged by tokens, in tasks, in groups, then at the driver. Shards
grow with the corpus and are made by hash, so the fit does not depend on the layout of the table.

For the base, the frequent words are sent to the tasks (a fixed bound); the others are joined by word.

Rows: NULL and empty texts are one end. NULL ids are never held out. Repeated rows count and score one by one; other
columns are ignored. Without training texts all kinds are equally likely and the base score is 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlume.llm.common import Shared, crc_mod, keep_freed, utf8_of
from netlume.staging import stage

WINDOW, STEP = 48, 32
LEAD = WINDOW - STEP
WIDTH = 16
SINGLE, KINDS = 96, 4
TOPICS, CUES = 6, 128
#: What the model reads (the beginning and the padding come after it) and what its softmax is over.
READ, WRITE = SINGLE + KINDS, SINGLE + KINDS * TOPICS
FREQUENT = 1 << 18
#: Shards of a task of a training round of many, which it streams one after another, the fewest tasks of such a round and the
#: most of any; groups in which their results are added.
TOGETHER, APART, PARTITIONS, GROUPS = 4, 64, 1 << 14, 64
#: Texts of a task that sums up cues.
CUED = 1 << 14
#: Windows in one step of training, and in one product.
BATCH = 64
#: Bytes of text that are cut into words at a time.
BLOCK = 8 << 20
LN10 = float(np.log(10))


# ---- the model -----------------------------------------------------------------------------------

SHAPES = {
    "emb": (READ + 2, WIDTH),
    "topic": (TOPICS, WIDTH),
    "pos": (WINDOW, WIDTH),
    "wq": (WIDTH, WIDTH),
    "wk": (WIDTH, WIDTH),
    "wv": (WIDTH, WIDTH),
    "wo": (WIDTH, WIDTH),
    "out": (WIDTH, WRITE),
    "bias": (WRITE,),
}
_ENDS = list(accumulate(int(np.prod(s)) for s in SHAPES.values()))


class Tables(NamedTuple):
    """What counts say of each id. The last row of all but ``read`` and ``share`` is a padded target."""

    read: np.ndarray  # embedding of each id, of the beginning and of the padding
    share: np.ndarray  # shares of the topics, less those of all texts
    slot: np.ndarray  # first output of its kind
    within: np.ndarray  # P(id | kind, topic) at that output and the ones after it

    @property
    def begin(self) -> int:
        return len(self.read) - 2


def views(theta: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name, as views of one vector."""
    starts = [0, *_ENDS]
    return {name: theta[a:b].reshape(shape) for (name, shape), a, b in zip(SHAPES.items(), starts, _ENDS)}


def init(prior: np.ndarray, seed: int = 3) -> np.ndarray:
    """Weights before training: they predict the frequencies of the outputs whatever the context."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(_ENDS[-1], np.float32)
    p = views(theta)
    for name, scale in {"emb": 0.3, "topic": 0.5, "pos": 0.1, "wq": 0.25, "wk": 0.25, "wv": 0.25, "wo": 0.25}.items():
        p[name][:] = rng.normal(0, scale, SHAPES[name])
    p["bias"][:] = np.log(prior)
    return theta


#: Which places of a window a target place sees.
_SEEN = np.arange(WINDOW)[None, :] <= np.arange(LEAD, WINDOW)[:, None]
_SEEN_F = _SEEN.astype(np.float32)
_NEXT = np.arange(TOPICS)
_CELLS = np.arange((READ + 2) * WIDTH).reshape(-1, WIDTH)


def _plain(sums: np.ndarray) -> bool:
    """Whether sums of exponentials are far from the ends of a 32-bit float (NaN is not)."""
    return 1e-25 < sums.min() and sums.max() < 1e25


def _attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, pad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(scores) of the places seen, up to a factor per place, and their sums with ``v``, whose last column counts."""
    a = q @ k.transpose(0, 2, 1)
    np.exp(a, out=a)
    a *= _SEEN_F
    o = a @ v
    if not _plain(o[:, :, WIDTH]):
        a = np.where(_SEEN & ~pad[:, None, :], q @ k.transpose(0, 2, 1), -np.inf)
        a -= np.maximum(a.max(axis=2, keepdims=True), -1e30)  # a place may see nothing but padding
        np.exp(a, out=a)
        o = a @ v
    return a, o


def _forward(p: dict, tables: Tables, windows: np.ndarray):
    """exp(logits) at the last STEP places of each window, up to a factor per place, their sums, and what the gradient needs.

    Columns of ones make biases and sums a part of the products; the greatest score is taken off only where it must be.
    """
    b, ids, kind = len(windows), windows.ravel(), p["out"].dtype  # padding is -1, the last row
    pad = windows < 0
    read, share = np.take(tables.read, ids), np.take(tables.share, ids, axis=0)
    x = np.take(p["emb"], read, axis=0)
    x += share @ p["topic"]
    x = x.reshape(b, WINDOW, WIDTH)
    x += p["pos"]
    xs = np.ascontiguousarray(x[:, LEAD:])
    q = (xs.reshape(-1, WIDTH) @ (p["wq"] * WIDTH**-0.5)).reshape(b, STEP, WIDTH)
    wkv = np.hstack([p["wk"], p["wv"]])
    kv = np.empty((b * WINDOW, 2 * WIDTH + 1), kind)
    kv[:, 2 * WIDTH] = 1
    np.matmul(x.reshape(-1, WIDTH), wkv, out=kv[:, : 2 * WIDTH])
    kv[np.flatnonzero(pad), WIDTH:] = 0  # padding is seen, with no weight
    kv = kv.reshape(b, WINDOW, -1)
    k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
    h = np.empty((b * STEP, WIDTH + 1), kind)
    h[:, WIDTH] = 1
    out = np.vstack([p["out"], p["bias"]])
    ones = np.ones(WRITE, kind)
    with np.errstate(over="ignore", invalid="ignore"):
        a, o = _attend(q, k, v, pad)
        s = o[:, :, WIDTH:]
        o = o[:, :, :WIDTH] / s
        np.add(xs.reshape(-1, WIDTH), o.reshape(-1, WIDTH) @ p["wo"], out=h[:, :WIDTH])
        e = h @ out
        np.exp(e, out=e)
        total = e @ ones
        if not _plain(total):
            e = h @ out
            e -= e.max(axis=1, keepdims=True)
            np.exp(e, out=e)
            total = e @ ones
    return e, total, (pad, read, share, x, xs, q, k, v, wkv, a, o, s, h)


def _own(e: np.ndarray, tables: Tables, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the outputs of each target's kind lie in ``e``, what is there, and their parts of its probability."""
    at = (np.arange(0, len(targets) * WRITE, WRITE) + np.take(tables.slot, targets))[:, None] + _NEXT
    found = np.take(e.ravel(), at)
    return at, found, np.maximum(found * np.take(tables.within, targets, axis=0), 1e-37)


def log_probs(p: dict, tables: Tables, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target id (places x STEP); -1 gives 0."""
    e, total, _ = _forward(p, tables, windows)
    flat = targets.ravel()
    own = _own(e, tables, flat)[2].sum(axis=1)
    return np.where(flat >= 0, np.log(own / total), 0).reshape(targets.shape)


def gradient(p: dict, tables: Tables, windows: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood and its gradient."""
    loss, g = _gradient(p, tables, windows, targets)
    return loss, views(g)


def _gradient(p: dict, tables: Tables, windows: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray]:
    e, total, (pad, read, share, x, xs, q, k, v, wkv, a, o, s, h) = _forward(p, tables, windows)
    b, flat, kind = len(windows), targets.ravel(), e.dtype
    real = flat >= 0
    weight = (real / max(1, int(real.sum()))).astype(kind)
    at, found, pick = _own(e, tables, flat)
    own = pick.sum(axis=1)
    loss = float(-(np.log(own / total) * weight).sum())
    made = np.empty(_ENDS[-1], kind)
    g = views(made)
    d = e  # the gradient of the logits, but for a factor per place
    d.ravel()[at] = found - pick * (total / own)[:, None]
    each = (weight / total)[:, None]
    g["out"][:] = (d.T @ (h[:, :WIDTH] * each)).T
    g["bias"][:] = each[:, 0] @ d
    dh = d @ p["out"].T
    dh *= each
    g["wo"][:] = o.reshape(-1, WIDTH).T @ dh
    do = (dh @ p["wo"].T).reshape(b, STEP, WIDTH)
    do /= s
    low = np.empty((b, STEP, WIDTH + 1), kind)
    low[:, :, :WIDTH] = do
    low[:, :, WIDTH] = -np.einsum("bij,bij->bi", do, o)  # the sum over places of a * da
    dkv = np.empty((b, WINDOW, 2 * WIDTH), kind)
    np.matmul(a.transpose(0, 2, 1), do, out=dkv[:, :, WIDTH:])
    ds = low @ v.transpose(0, 2, 1)
    ds *= a
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])  # q holds the scale already
    dq = (ds @ k).reshape(-1, WIDTH)
    dkv = dkv.reshape(-1, 2 * WIDTH)
    dkv[np.flatnonzero(pad), WIDTH:] = 0
    scale = WIDTH**-0.5
    g["wq"][:] = xs.reshape(-1, WIDTH).T @ dq * scale
    both = dkv.T @ x.reshape(-1, WIDTH)
    g["wk"][:], g["wv"][:] = both[:WIDTH].T, both[WIDTH:].T
    dx = (dkv @ wkv.T).reshape(b, WINDOW, WIDTH)
    dh += dq @ (p["wq"].T * scale)
    dx[:, LEAD:] += dh.reshape(b, STEP, WIDTH)
    g["pos"][:] = dx.sum(axis=0)
    dx = dx.reshape(-1, WIDTH)
    g["topic"][:] = share.T @ dx
    cell = np.take(_CELLS, read, axis=0)
    g["emb"][:] = np.bincount(cell.ravel(), dx.ravel(), (READ + 2) * WIDTH).reshape(-1, WIDTH)
    return loss, made


def windows_of(ids: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows of one text (its ids, the end included) and their targets, padded with -1."""
    return _windows([ids], begin)


def _windows(texts: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and targets of each text in turn."""
    size = np.array([len(ids) for ids in texts])
    count, own, ids = -(-size // STEP), np.arange(len(texts)) * LEAD, np.concatenate(texts)
    first, total = np.cumsum(size) - size, int(count.sum())
    place = np.repeat((np.cumsum(count) - count) * STEP - first, size) + np.arange(len(ids))
    targets = np.full(total * STEP, -1, np.int64)
    targets[place] = ids
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[first[size > 0]] = begin
    inputs = np.full(total * STEP + len(texts) * LEAD, -1, np.int64)
    inputs[place + np.repeat(own + LEAD, size)] = before
    at = (np.arange(total) * STEP + np.repeat(own, count))[:, None] + np.arange(WINDOW)
    return np.take(inputs, at), targets.reshape(total, STEP)


def batches(texts: Iterable[np.ndarray], begin: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``size`` windows of one or more texts at a time; the windows of many texts are made in one go."""
    held, n, rest = [], 0, (np.empty((0, WINDOW), np.int64), np.empty((0, STEP), np.int64))
    for ids in chain(texts, [None]):
        if ids is not None:
            held.append(ids)
            n += -(-len(ids) // STEP)
        if held and (ids is None or n >= 8 * size):
            rest = tuple(np.concatenate(x) for x in zip(rest, _windows(held, begin)))
            full = len(rest[0]) - len(rest[0]) % size
            for at in range(0, full, size):
                yield rest[0][at : at + size], rest[1][at : at + size]
            held, n, rest = [], 0, tuple(x[full:] for x in rest)
    if len(rest[0]):
        yield rest


def fit_stream(theta: np.ndarray, tables: Tables, pairs, rate: float) -> tuple[np.ndarray, int]:
    """Weights after one pass of Adam, and how many targets it saw."""
    theta = theta.copy()
    p = views(theta)
    m, u = np.zeros_like(theta), np.zeros_like(theta)
    seen, t = 0, 0
    for windows, targets in pairs:
        t += 1
        seen += int((targets >= 0).sum())
        g = _gradient(p, tables, windows, targets)[1]
        m += 0.1 * (g - m)
        u += 0.01 * (g * g - u)
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.99**t)) + 1e-8)
    return theta, seen


# ---- subwords ------------------------------------------------------------------------------------


class Subwords:
    """Ids of words."""

    def __init__(self, raw: bytes, frequent: list[bytes] = ()):
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, raw.splitlines())}
        self.end = max(ranks.values()) + 1
        self.first = self.end + 1  # id of the first frequent word
        self.size = self.first + len(frequent)
        self.starts = [rank for piece, rank in ranks.items() if piece[:1] == b" "]
        self.whole = pa.array(frequent, pa.binary())
        # a word and the space before it are one piece, so a call takes many words; a piece of a word opens it if it holds the space
        self.code = tiktoken.Encoding("subwords", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(self.end, bool)
        self.opens[self.starts] = True

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Ids of all words and the end; the words that are not frequent."""
        flat, _, whole = self.cut(pa.array(words, pa.binary()))
        return np.r_[flat, np.int32(self.end)], [words[i] for i in np.flatnonzero(whole < 0)]

    def cut(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, how many each one has, and its number among the frequent words (-1: none)."""
        whole = pc.index_in(words, value_set=self.whole).fill_null(-1).to_numpy()
        rare = whole < 0
        length = np.ones(len(words), np.int64)
        flat = whole + np.int32(self.first)
        if rare.any():
            new = words.filter(pa.array(rare)).to_numpy(zero_copy_only=False)
            ids = np.array(self.code.encode_ordinary(" " + b" ".join(new).decode("utf-8", "replace")), "<i4")
            length[rare] = np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))
            common, flat = flat[~rare], np.empty(int(length.sum()), "<i4")
            own = np.repeat(rare, length)
            flat[own], flat[~own] = ids, common
        return flat, length, whole


class Words(NamedTuple):
    """The words of a block of texts."""

    distinct: pa.Array
    number: np.ndarray  # place of each word among the distinct ones
    starts: np.ndarray  # of each text's words, and the last end

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Words in lower case (A-Z), as ``bytes.lower`` and ``bytes.split`` make them."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
        coded = split.flatten().dictionary_encode()
        number, starts = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        blank = pc.index(coded.dictionary, "").as_py()  # what is before the first space, or after the last
        distinct = coded.dictionary.view(pa.binary())
        if blank >= 0:
            real = number != blank
            number, starts = number[real], np.r_[0, np.cumsum(real)][starts]
            number = number - (number > blank)
            distinct = pa.concat_arrays([distinct[:blank], distinct[blank + 1 :]])
        return cls(distinct, number, starts)


def blocks(frames: Iterable[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``most`` bytes of text, which bounds what a task holds at a time."""
    for frame in frames:
        ends = np.cumsum(pc.binary_length(frame["text"]).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(ends // most)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends)]):
            if b > a:
                yield frame.slice(a, b - a)


# ---- counts --------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts, staged; the end of a text is the empty word."""

    def count(frames):
        keep_freed()
        for frame in blocks(frames, 2 * BLOCK):
            words = Words.of(frame["text"])
            c = np.bincount(words.number, minlength=len(words.distinct))
            found = words.distinct.filter(pa.array(c > 0))
            own = [pa.concat_arrays([found, pa.array([b""], pa.binary())]), pa.array(np.r_[c[c > 0], len(frame)], pa.int64())]
            yield pa.RecordBatch.from_arrays(own, ["word", "c"])

    sent = texts.select("text").mapInArrow(count, "word binary, c long")
    return stage(sent.groupBy("word").agg(F.sum("c").alias("c")), "words")


def cue_shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the most frequent words in each text (the last axis)."""
    n = np.sqrt(counts.astype(float))
    return n / np.maximum(1.0, np.linalg.norm(n, axis=-1, keepdims=True))


def topic_centres(cues: DataFrame, rounds: int = 15) -> np.ndarray:
    """Spherical k-means over all rows of ``cues`` (counts as bytes), started from texts far from one another.

    Sums are of whole numbers, so they do not depend on the layout of the table.
    """

    def unpack(frame):
        return np.frombuffer(b"".join(frame["cues"]), "<i4").reshape(-1, CUES)

    def sums(centres):
        def add(frames):
            total = np.zeros((len(centres), CUES), np.int64)
            for frame in frames:
                shares = cue_shares(unpack(frame))
                near = np.argmax(np.round(shares @ centres.T, 9), axis=1)
                own = (near == np.arange(len(centres))[:, None]).astype(float)
                total += (own @ np.rint(shares * (1 << 20))).astype(np.int64)  # whole numbers far below 2 ** 53
            topic, cue = np.nonzero(total)
            yield pd.DataFrame({"topic": topic, "cue": cue, "x": total[topic, cue]})

        rows = cues.mapInPandas(add, "topic int, cue int, x long").groupBy("topic", "cue").agg(F.sum("x").alias("x"))
        total = np.zeros((len(centres), CUES))
        for r in rows.collect():  # at most TOPICS x CUES rows
            total[r["topic"], r["cue"]] = r["x"]
        return total

    def farthest(centres):
        def least(frames):
            best = None
            for frame in frames:
                counts = unpack(frame)
                if len(counts):
                    near = np.round(np.max(cue_shares(counts) @ centres.T, axis=1), 9)
                    at = np.flatnonzero(near == near.min())
                    own = (float(near[at[0]]), min(counts[i].tobytes() for i in at))
                    best = min(best, own) if best else own
            if best:
                yield pd.DataFrame({"near": [best[0]], "cues": [best[1]]})

        r = cues.mapInPandas(least, "near double, cues binary").orderBy("near", "cues").first()
        return cue_shares(np.frombuffer(r["cues"], "<i4"))

    mean = sums(np.zeros((1, CUES)))
    if not mean.any():
        return np.zeros((TOPICS, CUES))
    centres = mean / np.linalg.norm(mean)
    for _ in range(TOPICS):
        centres = np.vstack([centres, farthest(centres)])
    centres = centres[1:]
    for _ in range(rounds):
        total = sums(centres)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        new = np.where(norm > 0, total / np.maximum(norm, 1), centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def frequent_words(words: DataFrame) -> pd.DataFrame:
    """(word, c) of at most FREQUENT words that occur twice or more, the most frequent ones first.

    A histogram of counts in sixteenths of an octave, about a thousand rows at most, tells from which count on words fit.
    """
    often = words.where("word <> X'' AND c > 1").withColumn("step", F.floor(F.log2("c") * 16))
    held, least = 0, None
    for r in often.groupBy("step").count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["step"]
    chosen = often.where(F.col("step") >= least) if least is not None else often.limit(0)
    top = chosen.select("word", "c").toArrow().to_pandas()
    top["word"] = [bytes(w) for w in top["word"]]
    return top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def topic_counts(coded: DataFrame, centres: np.ndarray, size: int) -> np.ndarray:
    """How often each id occurs in the training texts of each topic (size x TOPICS)."""
    shared = Shared(coded.sparkSession, centres, _same)

    def count(frames):
        centres = shared.get()
        total = np.zeros((TOPICS, size), np.int64)
        for frame in frames:
            shares = cue_shares(np.frombuffer(b"".join(x or bytes(4 * CUES) for x in frame["cues"]), "<i4").reshape(-1, CUES))
            topics = np.argmax(np.round(shares @ centres.T, 9), axis=1)  # the first one for a text without cues
            for ids, topic in zip(frame["ids"], topics):
                np.add.at(total[topic], np.frombuffer(ids, "<i4"), 1)
        topic, at = np.nonzero(total)
        yield pd.DataFrame({"id": at, "topic": topic, "c": total[topic, at]})

    rows = coded.select("ids", "cues").mapInPandas(count, "id long, topic int, c long")
    got = rows.groupBy("id", "topic").agg(F.sum("c").alias("c")).toArrow()  # at most one row per id and topic
    counts = np.zeros((size, TOPICS), np.int64)
    counts[got["id"].to_numpy(), got["topic"].to_numpy()] = got["c"].to_numpy()
    return counts


def tables_of(counts: np.ndarray, code: Subwords, back_off: float = 200.0) -> tuple[Tables, np.ndarray]:
    """The tables of all ids from their counts by topic, and the frequencies of the outputs."""
    size, all_ = len(counts), counts.sum(axis=1)
    kind = np.zeros(size, np.int64)
    kind[code.starts] = 1
    kind[code.first :] = 3
    mass = np.cumsum(all_[code.first :])  # frequent words come first
    kind[code.first :][mass * 2 <= (mass[-1] if len(mass) else 0)] = 2
    order = np.lexsort((np.arange(size), -all_, np.arange(size) != code.end))
    single = order[:SINGLE]
    read = SINGLE + kind
    read[single] = np.arange(SINGLE)
    slot = SINGLE + kind * TOPICS
    slot[single] = np.arange(SINGLE)
    within = np.zeros((size + 1, TOPICS))
    prior = np.full(WRITE, 0.5)
    prior[:SINGLE] += all_[single]
    for k in range(KINDS):
        own = np.flatnonzero(read == SINGLE + k)
        smooth = all_[own] + 0.5
        in_topic = counts[own].sum(axis=0)
        prior[SINGLE + k * TOPICS :][:TOPICS] += in_topic
        within[own] = (counts[own] + back_off * (smooth / smooth.sum())[:, None]) / (in_topic + back_off)
    within[single] = np.arange(TOPICS) == 0
    within[-1] = 1
    overall = (counts.sum(axis=0) + 1) / (all_.sum() + TOPICS)
    share = np.zeros((size + 2, TOPICS))
    share[:size] = (counts + overall) / (all_[:, None] + 1) - overall
    made = Tables(np.r_[read, READ, READ + 1], share.astype(np.float32), np.r_[slot, 0], within.astype(np.float32))
    return made, prior / prior.sum()


# ---- jobs ----------------------------------------------------------------------------------------


def encode(rows: DataFrame, parts: tuple, logs: np.ndarray) -> DataFrame:
    """``rows`` with the ids of their texts, the counts of cues, and the base's part of the frequent words."""
    shared = Shared(rows.sparkSession, (*parts, logs), _encode_parts)

    def run(frames):
        keep_freed()
        code, logs = shared.get()
        for frame in blocks(frames):
            own = encode_block(frame["text"], code, logs)
            kept = {name: frame[name] for name in ("uid", "doc_id", "held_out")}
            yield pa.RecordBatch.from_pydict(kept | own)

    made = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text")
    own = "n long, known long, base double, rare array<binary>, times array<long>, ids binary, cues binary"
    return made.mapInArrow(run, f"uid long, doc_id long, held_out boolean, {own}")


def encode_block(texts: pa.Array, code: Subwords, logs: np.ndarray) -> dict[str, pa.Array]:
    """What ``encode`` adds to each text; each distinct word of the block is looked up once."""
    words, n = Words.of(texts), len(texts)
    size, end = np.diff(words.starts), len(words.distinct)
    flat, length, whole = code.cut(words.distinct)
    flat, length, whole = np.r_[flat, np.int32(code.end)], np.r_[length, 1], np.r_[whole, -1]
    first = np.cumsum(length) - length
    rare = whole < 0
    rare[end] = False
    number = np.insert(words.number, words.starts[1:], end)  # every text ends
    starts = words.starts[:-1] + np.arange(n)
    base = np.add.reduceat(np.take(np.r_[logs, 0.0][whole], number), starts)
    # ids: those of each word in turn
    each = np.take(length, number)
    ends = np.cumsum(each)
    place = np.repeat(np.take(first, number) - ends + each, each)
    place += np.arange(len(place))
    ids = np.take(flat, place)
    text = np.repeat(np.arange(n), size + 1)
    cue = np.take(np.where(whole < CUES, whole, -1), number)
    held = cue >= 0
    cues = np.bincount(text[held] * CUES + cue[held], minlength=n * CUES).astype("<i4").reshape(n, CUES)
    held = np.take(rare, number)
    key, times = np.unique(text[held] * (end + 1) + number[held], return_counts=True)
    cuts = pa.array(np.searchsorted(key, np.arange(n + 1) * (end + 1)), pa.int32())
    return {
        "n": pa.array(size + 1, pa.int64()),
        "known": pa.array(size - np.bincount(text[held], minlength=n), pa.int64()),
        "base": pa.array(base, pa.float64()),
        "rare": pa.ListArray.from_arrays(cuts, words.distinct.take(pa.array(key % (end + 1)))),
        "times": pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
        "ids": _binaries(ids, np.r_[0, ends[starts + size]] * 4),
        "cues": pa.array([own.tobytes() if any_ else None for own, any_ in zip(cues, cues.any(axis=1))], pa.binary()),
    }


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of the bytes of ``values``."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype("<i4")), pa.py_buffer(values)])


def fit_round(coded: DataFrame, tables: Tables, theta: np.ndarray, shards: int, rate: float) -> np.ndarray:
    """Mean by tokens of the weights of all shards, each after one pass over its texts from ``theta``."""
    key = F.xxhash64("doc_id", "ids")
    bucket = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(shards)).alias("bucket")
    rows = coded.select("ids", key.alias("key"), bucket)
    tasks = min(max(shards // TOGETHER, min(shards, APART)), PARTITIONS)
    dealt = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key", "ids")
    shared = Shared(coded.sparkSession, (*tables, theta), _model_parts)

    def run(frames):
        keep_freed()
        tables, theta = shared.get()
        total, seen, group = np.zeros(len(theta)), 0, 0
        rows = chain.from_iterable(zip(frame["bucket"], frame["ids"]) for frame in frames)
        for bucket, own in groupby(rows, key=lambda row: row[0]):  # about shard_docs texts
            texts = (np.frombuffer(ids, "<i4") for _, ids in own)
            w, n = fit_stream(theta, tables, batches(texts, tables.begin, BATCH), rate)
            total += w.astype(float) * n
            seen, group = seen + n, bucket % GROUPS
        if seen:
            yield pd.DataFrame({"grp": [group], "seen": [seen], "w": [total.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(w) for w in sorted(frame["w"])], axis=0)
        return pd.DataFrame({"grp": frame["grp"][:1], "seen": [frame["seen"].sum()], "w": [total.tobytes()]})

    schema = "grp long, seen long, w binary"
    sums = dealt.select("bucket", "ids").mapInPandas(run, schema).groupBy("grp").applyInPandas(add, schema)
    got = sorted(sums.collect(), key=lambda r: r["grp"])  # at most GROUPS rows
    seen = sum(r["seen"] for r in got)
    return (np.sum([np.frombuffer(r["w"]) for r in got], axis=0) / seen).astype(np.float32) if seen else theta


def fit(
    coded: DataFrame, tables: Tables, prior: np.ndarray, shard_docs: int, warm_docs: int, rounds: int, rate: float
) -> np.ndarray:
    """Weights fitted on all training texts."""
    theta = init(prior)
    n = coded.count()
    if not n:
        return theta
    share = max(1, round(n / warm_docs))
    warm = coded.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(share)) == 0)
    warm = stage(warm.select("doc_id", "ids"), "lm-warm")
    for k in range(rounds):
        theta = fit_round(warm, tables, theta, 16, rate / (k + 1))
    return fit_round(coded, tables, theta, max(1, round(n / shard_docs)), rate / (rounds + 1))


def _same(value):
    return value


def _model_parts(value):
    *tables, theta = value
    return Tables(*tables), theta


def _encode_parts(value):
    ranks, frequent, logs = value
    return Subwords(ranks, frequent), logs


def score(
    docs: DataFrame, ranks_file: str, shard_docs: int = 512, warm_docs: int = 2048, rounds: int = 2, rate: float = 0.02
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    with open(ranks_file, "rb") as f:  # a vocabulary: its size does not depend on the corpus
        ranks = f.read()
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    rows = utf8_of(docs).withColumn("held_out", held_out)
    words = word_counts(rows.where(~F.col("held_out")))
    n, v = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent_words(words)
    ends = words.where("word = X''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    parts = (ranks, list(top["word"]))
    made = stage(encode(rows, parts, _log10(top["c"].to_numpy(float), n, v)), "lm-ids")
    training = made.where(~F.col("held_out")).select("doc_id", "ids", "cues")
    cues = training.select("cues").where("cues IS NOT NULL").coalesce(max(1, ends // CUED))
    centres = topic_centres(stage(cues, "lm-cues"))  # read in some twenty short jobs
    code = Subwords(*parts)
    tables, prior = tables_of(topic_counts(training, centres, code.size), code)
    theta = fit(training, tables, prior, shard_docs, warm_docs, rounds, rate)
    model = Shared(spark, (*tables, theta), _model_parts)

    @F.pandas_udf("double")
    def total(texts: pd.Series) -> pd.Series:
        keep_freed()
        tables, theta = model.get()
        p = views(theta)
        found, sizes = [np.zeros(0)], []

        def counted():
            for ids in texts:
                ids = np.frombuffer(ids, "<i4")
                sizes.append(-(-len(ids) // STEP))
                yield ids

        for windows, targets in batches(counted(), tables.begin, BATCH):
            found.append(log_probs(p, tables, windows, targets).sum(axis=1, dtype=float))
        return pd.Series(np.add.reduceat(np.concatenate(found), np.r_[0, np.cumsum(sizes)[:-1]].astype(int)) / LN10)

    scored = made.select("uid", "doc_id", "held_out", "n", "known", "base", total("ids").alias("score"))
    rare = made.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rare = rare.select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    unseen = _log10(np.zeros(1), n, v)[0]
    log_c = F.log10((F.col("c") + 0.5) / F.lit(float(n + 0.5 * (v + 1))))
    joined = rare.join(words.hint("shuffle_hash"), "word", "left").select(
        "uid",
        (F.col("k") * F.coalesce(log_c, F.lit(float(unseen)))).alias("rare_base"),
        F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("rare_known"),
    )
    per_doc = joined.groupBy("uid").agg(F.sum("rare_base").alias("rare_base"), F.sum("rare_known").alias("rare_known"))
    end = float(_log10(np.array([float(ends)]), n, v)[0])
    return scored.join(per_doc, "uid", "left").select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(end)).alias("base_score"),
        "score",
    )


def _log10(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
