"""The time that scoring takes: one call for the new words of a text or block, few passes over large arrays."""

import base64
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from netlume.llm import attention_lm

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library(pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def random_words(n):
    rng = np.random.default_rng(5)
    letters = [*"etaoinabab", "th", "ing", "é", "ß", "字", "0", "=="]
    words = {"".join(letters[i] for i in rng.integers(0, len(letters), size)) for size in rng.integers(1, 40, n)}
    return sorted(words) + ["a" * k for k in range(1, 300)] + ["ab" * k for k in range(1, 200)]


def test_rare_words_are_cut_in_one_call(monkeypatch):
    """One call for the new words of a text, with the ids of each word alone."""
    code = attention_lm.Subwords(open(RANKS, "rb").read(), [b"the", b"of"])
    alone, calls = library(r"[\s\S]+"), []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return own.encode_ordinary(text)

    own, code.code = code.code, Counted()
    words = [w.lower().encode() for w in random_words(300)] + [b"\xff\xfe", "a\x85b ".encode(), b"the", b"\xff\xfe", b"x" * 500]
    want = [i for w in words[:-3] for i in alone.encode_ordinary(" " + w.decode("utf-8", "replace"))]
    ids, rare = code.ids(words)
    assert ids[: len(want)].tolist() == want and ids[len(want)] == code.first and ids[-1] == code.end
    assert rare == [w for w in words if w != b"the"] and len(calls) == 1
    assert code.ids(words)[0].tolist() == ids.tolist() and len(calls) == 2  # the long ones are not remembered


def test_words_of_a_block_are_cut_once():
    """Texts of a block, together, get what each one gets alone; a distinct word is cut once, in one call."""
    frequent = [b"the", b"of", *(b"w%d" % i for i in range(attention_lm.CUES + 5))]
    code, calls = attention_lm.Subwords(open(RANKS, "rb").read(), frequent), []
    logs, draw = np.log10(np.arange(1.0, len(frequent) + 1)), random.Random(7)

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return own.encode_ordinary(text)

    odd = [bytes(draw.choices(b" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\xc3\x89\x00@AZ[`az{", k=draw.randrange(20))) for _ in range(300)]
    texts = [b"", b" ", b"\n\n", b" The OF the ", "Ünïcode été".encode(), b"w%d w3 w3" % (attention_lm.CUES + 1), b"rare rare Rare", *odd]
    own, code.code = code.code, Counted()
    got = pa.RecordBatch.from_pydict(attention_lm.encode_block(pa.array([b"before", *texts], pa.binary())[1:], code, logs)).to_pylist()
    assert len(calls) == 1 and calls[0].count(" ") == len({w for text in texts for w in text.lower().split()} - set(frequent))
    for text, row in zip(texts, got, strict=True):
        words = text.lower().split()
        ids, rare = code.ids(words)
        whole = ids[ids >= code.first] - code.first
        cues = np.bincount(whole[whole < attention_lm.CUES], minlength=attention_lm.CUES).astype("<i4")
        assert row["ids"] == ids.tobytes() and (row["n"], row["known"]) == (len(words) + 1, len(words) - len(rare))
        assert dict(zip(row["rare"], row["times"], strict=True)) == Counter(rare) and abs(row["base"] - logs[whole].sum()) < 1e-9
        assert row["cues"] == (cues.tobytes() if cues.any() else None)


def test_blocks_bound_the_text_at_hand():
    sizes = [0, 0, 5, 3, 0, 40, 1, 1, 9, 0]
    frame = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in sizes]), pa.array(range(len(sizes)))], ["text", "at"])
    made = [b["at"].to_pylist() for b in attention_lm.blocks([frame, frame.slice(0, 0), frame], 10)]
    assert sum(made, []) == [*range(len(sizes))] * 2
    assert all(sum(sizes[i] for i in own) - max(sizes[i] for i in own) < 10 for own in made) and len(made) == 6


def test_lm_takes_no_maximum_without_need(monkeypatch):
    """Scores far beyond the exponents of a float give what 64-bit floats give; others take a plain pass."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 30, (400, attention_lm.TOPICS))
    code = type("Code", (), {"starts": list(range(100, 180)), "end": 250, "first": 251})
    tables, prior = attention_lm.tables_of(counts, code)
    theta = attention_lm.init(prior)
    ids = rng.integers(0, 400, 200)
    windows, targets = attention_lm.windows_of(ids, tables.begin)
    for query, out in ((1, 1), (3000, 1), (1, 3000), (3000, 3000)):
        hot = theta + np.float32(0.01) * rng.normal(0, 1, theta.shape).astype(np.float32)
        attention_lm.views(hot)["wq"][:] *= query
        attention_lm.views(hot)["out"][:] *= out
        assert hot.dtype == np.float32
        p, exact = attention_lm.views(hot), attention_lm.views(hot.astype(float))
        got, want = (attention_lm.log_probs(w, tables, windows, targets) for w in (p, exact))
        assert np.isfinite(got).all()
        assert np.median(np.abs(got - want)) < 1e-2 * max(1, np.abs(want).max())
        for w in (p, exact):
            loss, g = attention_lm.gradient(w, tables, windows, targets)
            assert np.isfinite(loss) and all(np.isfinite(x).all() for x in g.values())
