"""The time that tokenizing takes: many new pre-tokens share a queue."""

import base64

import numpy as np
import public_tokenizers
import tiktoken

from netlume.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library(pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def random_words(n):
    rng = np.random.default_rng(5)
    letters = [*"etaoinabab", "th", "ing", "é", "ß", "字", "0", "=="]
    words = {"".join(letters[i] for i in rng.integers(0, len(letters), size)) for size in rng.integers(1, 40, n)}
    return sorted(words) + ["a" * k for k in range(1, 300)] + ["ab" * k for k in range(1, 200)]


def test_new_pretokens_share_a_queue(monkeypatch):
    """Short pre-tokens are not merged one by one, in small blocks and large ones, whatever is forgotten."""
    coder = bpe.Bpe(bpe.read_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    one, calls = coder.merge, []
    monkeypatch.setattr(coder, "merge", lambda word: calls.append(word) or one(word))
    monkeypatch.setattr(bpe, "REMEMBERED", 3000)
    words = random_words(8000)
    texts = ["", *(" ".join(words[k::50]) for k in range(50)), *words[:100], "", " ".join(words)]
    want = [np.array(x, "<u4").tobytes() for x in map(library(public_tokenizers.PATTERN).encode_ordinary, texts)]
    for block in (1, 20_000, 4_000_000):
        monkeypatch.setattr(bpe, "BLOCK", block)
        monkeypatch.setattr(bpe, "MANY", 2000)
        coder.known, coder.older = {}, {}
        assert coder.encode_all(texts) == want
        if block == 4_000_000:
            assert all(len(word) > bpe.SHORT for word in calls)
        calls.clear()
    monkeypatch.setattr(bpe, "MANY", 0)
    coder.known, coder.older = {}, {}
    assert coder.encode_all(texts) == want
    assert coder.encode_all([]) == [] and coder.encode_all([""]) == [b""]
