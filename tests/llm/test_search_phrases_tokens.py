"""Ranked search, forced-boundary BPE and phrase mining against brute force, SQL and the tokenizer library."""

import collections
import math
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as registry
from netlume.llm import collocation, forced_bpe, ranked_search

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
FOLD = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, n long, p string, id int, score string, item string"
ODD_TEXTS = [
    None,
    "",
    "a",
    "é" * 300,
    "x y z " * 3000,
    "one Two\tthree, one two three. ONE two three four five six",
    "one two three four five six" * 3,
    "\n\n \t",
    "1" * 9000,
    "a" * 30000 + "@b.c",
    "\x00\x01\x02 \x00 \x1c\x1f\x85 one two",
    "<|endoftext|>a <|endoftext|><|endoftext|>",
    "日本 日本 日本, 日本 日本 Ab ab",
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and very long texts, repeated rows, and columns named like those that operators use inside."""
    rows = [(i, t, None if i % 3 else "en", 1, "p", 2, "s", "i") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5]] * 4 + [rows[4], (None, "one two three", "und", None, None, None, None, None)]
    rows += [(5, "same id, other text: one two", "en", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def sql_rows(sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con.execute(registry.oracle_sql()[name])


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_collocations"])
def test_sql(spark, sf, name):
    want = sql_rows(sf, name)
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, sf)
    assert got.columns == columns
    rows = ordered(got.collect())
    assert rows == ordered(want.fetchall()) and rows


# ---- forced-boundary BPE -------------------------------------------------------------------------


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_forced_bpe_equals_library(docs, odd, library):
    for table in (docs, odd):
        texts = [r.text or "" for r in table.select("text").collect()]
        coded = library.encode_batch(texts, add_special_tokens=False)
        want = [(x.ids, library.decode(x.ids, skip_special_tokens=False)) for x in coded]
        got = [(ids_of(r.ids), r.decoded) for r in forced_bpe.encode(table, VOCABULARY, decoded=True).collect()]
        assert sorted(got) == sorted(want)
    back = forced_bpe.decode(forced_bpe.encode(odd, VOCABULARY), VOCABULARY)
    assert ordered(back.collect()) == ordered((r.doc_id, r.text or "") for r in odd.collect())


def test_forced_bpe_empty_and_null(spark, odd):
    assert forced_bpe.encode(odd.limit(0), VOCABULARY).collect() == []
    none = spark.createDataFrame([(1, None), (None, b"\xff\xff\x00\x00"[:0])], "doc_id long, ids binary")
    assert ordered(forced_bpe.decode(none, VOCABULARY).collect()) == ordered([(1, ""), (None, "")])


@pytest.mark.parametrize("text", ["ab" * 20000, "thequickbrown" * 3000, "a" * 50001, "é" * 4001, "'s''s  don't\n\n x"])
def test_forced_bpe_long(library, text):
    coder = forced_bpe.ForcedBpe(open(VOCABULARY, "rb").read())
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(coder.encode_all([text])[0]) == want
    assert coder.decode(coder.encode_all([text])[0]) == text
    data = np.frombuffer(text.encode(), np.uint8)
    start = np.zeros(1, np.int64)
    heap = coder.merge_long(data).tolist()
    if len(data) > forced_bpe.LONG:
        assert coder.merge_all(data, start)[1].tolist() == heap


def test_forced_bpe_rounds_one_by_one(library, docs):
    """A file whose merges are not in order merges one occurrence a round; the result is the same."""
    coder = forced_bpe.ForcedBpe(open(VOCABULARY, "rb").read())
    assert coder.ordered
    coder.ordered = False
    texts = [r.text for r in docs.select("text").limit(40).collect()] + ["aaaaaaa bananabanana"]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids_of(x) for x in coder.encode_all(texts)] == want


def test_forced_bpe_cuts_are_certain(library, docs):
    """No token of the library's encoding reaches across a pair of bytes that is marked as a cut."""
    coder = forced_bpe.ForcedBpe(open(VOCABULARY, "rb").read())
    for r in docs.select("text").limit(60).collect():
        for i in set(library.encode(r.text, add_special_tokens=False).ids):
            piece = np.frombuffer(coder.pieces[i], np.uint8)
            assert not coder.cut[piece[:-1], piece[1:]].any()


# ---- phrases -------------------------------------------------------------------------------------


def brute_phrases(rows, minimum, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, seen in f.items():
        chosen = {p: a for p, a in seen.items() if len(p) > 1 and a >= minimum}
        lost = set()
        for p, a in chosen.items():
            for k in range(2, len(p)):
                lost |= {q for i in range(len(p) - k + 1) if a >= seen[q := p[i : i + k]]}
        found = []
        for p, a in chosen.items():
            if p not in lost:
                cuts = [(1000 * a * n[lang] // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("name,minimum,top", [("docs", 8, 2000), ("docs", 8, 7), ("odd", 2, 2000), ("odd", 3, 3)])
def test_phrases(request, name, minimum, top):
    table = request.getfixturevalue(name)
    rows = [(r.text, r.lang) for r in table.select("text", "lang").collect()]
    got = collocation.collocations(table, minimum, top)
    assert ordered(got.collect()) == ordered(brute_phrases(rows, minimum, top))


def test_phrases_in_blocks(docs, monkeypatch):
    """Several vocabulary blocks, several tries a level, and a sketch whose cells are nearly all shared."""
    monkeypatch.setattr(collocation, "BLOCK_WORDS", 300)
    monkeypatch.setattr(collocation, "BLOCK_PHRASES", 500)
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert ordered(collocation.collocations(docs, 12).collect()) == ordered(brute_phrases(rows, 12, 2000))


def test_phrases_empty(docs):
    assert collocation.collocations(docs.limit(0)).collect() == []
    assert collocation.collocations(docs, 10**6).collect() == []


def test_trie_walks_all_positions():
    rng = np.random.default_rng(0)
    for words, length, n in ((1, 1, 1), (300, 2, 4000), (70_000, 3, 3000), (5, 5, 2000), (3, 1, 3)):
        phrases = np.unique(rng.integers(1, words + 1, (n, length)).astype(np.int32), axis=0)
        rng.shuffle(phrases)
        trie = collocation.Trie(collocation.double_array(phrases))
        state = {tuple(p): s for p, s in zip(phrases.tolist(), trie.accept.tolist())}
        assert len(set(state.values())) == len(phrases)
        seq = np.append(phrases.ravel(), rng.integers(0, words + 1, 3000)).astype(np.int32)
        listed = seq.tolist()
        want = [(i, state[p]) for i in range(len(seq)) if (p := tuple(listed[i : i + length])) in state]
        assert want == list(zip(*(x.tolist() for x in trie.walk(seq))))


# ---- ranked search -------------------------------------------------------------------------------


def brute_search(docs, items, top=50):
    find = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall
    seen = [(i, collections.Counter(find((t or "").translate(FOLD)))) for i, t in docs]
    sized = [(i, c, c.total()) for i, c in seen]
    n_docs, n_terms = sum(n > 0 for *_, n in sized), sum(n for *_, n in sized)
    df = collections.Counter(t for _, c in seen for t in c)
    out = []
    for item, text in set(items):
        terms, found = set(find((text or "").translate(FOLD))), []
        for i, c, n in sized:
            if not n:
                continue
            m = 100 - 50 + 50 * n * n_docs // n_terms
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, (i is not None, i or 0), i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:top], 1)]
    return out


def pairs(df, key):
    return [(r[0], r[1]) for r in df.select(key, "text").collect()]


def test_search_odd(spark, odd):
    items = [(1, "One two three"), (1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "日本 ab zzz")]
    items += [(4, "nothing there"), (5, "x " * 4000 + "y"), (6, "a b c")]
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, item int")
    got = ranked_search.search_all(odd, asked)
    assert ordered(got.collect()) == ordered(brute_search(pairs(odd, "doc_id"), items))
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_search_copies_and_small_blocks(spark, docs, sf, monkeypatch):
    """Three hundred copies tie far beyond the list; small blocks, runs of items and steps change nothing."""
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    copies = docs.limit(1).select("text").crossJoin(spark.range(300)).selectExpr("1000 - id AS doc_id", "text")
    table = docs.select("doc_id", "text").union(copies)
    few = benchmark.limit(6)
    want = ordered(brute_search(pairs(table, "doc_id"), pairs(few, "item_id")))
    assert ordered(ranked_search.search_all(table, few).collect()) == want
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 600)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 33)
    monkeypatch.setattr(ranked_search, "STEP", 3)
    assert ordered(ranked_search.search_all(table, few).collect()) == want
    short = ranked_search.search_all(table, few, top=3).collect()
    assert ordered(short) == [r for r in want if r[1] <= 3]


def test_search_empty(spark, docs, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert ranked_search.search_all(docs.limit(0), benchmark).collect() == []
    assert ranked_search.search_all(docs, benchmark.limit(0)).collect() == []


def test_treap_holds_every_point():
    rng = np.random.default_rng(1)
    rows, columns = rng.integers(0, 50, 400), rng.integers(0, 90, 400)
    points = {(int(r), int(c)): int(v) for r, c, v in zip(rows, columns, rng.integers(1, 10**6, 400))}
    rows, columns = (np.array([p[i] for p in points]) for i in (0, 1))
    treap = ranked_search.K2Treap(rows, columns, np.array(list(points.values())), 7)
    assert treap.most[0] == max(points.values())
    for row, column in [*points, (63, 127), (0, 127)]:
        cell = 0
        for level in range(7):
            quarter = 2 * ((row >> (6 - level)) & 1) + ((column >> (6 - level)) & 1)
            if cell < 0 or not (int(treap.bits[cell]) >> quarter) & 1:
                cell = -1
                break
            cell = int(treap.first[cell] + ranked_search._BELOW[treap.bits[cell], quarter])
        assert (int(treap.most[cell]) if cell >= 0 else None) == points.get((row, column))
