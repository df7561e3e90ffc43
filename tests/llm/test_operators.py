"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import collections
import hashlib
import math
import re
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from netlume.llm import ann, attention_lm, bpe, decontam, kn_quality, line_dedup, pii, simhash, suffix_dedup, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, row int, anchor string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that break careless code; the last columns clash with names that operators use inside."""
    line = "This line is long enough to count as a shared line of text."
    texts = [None, "", "a", "é" * 300, "x y z " * 3000, f"{line}\nown", f" {line.upper()}\t\nother", "\n\n", line]
    texts += [f"{i}\n{line}" for i in range(4)] + [line] * 2 + ["1" * 9000, "a" * 30000 + "@b.c", "\x00\x01\x02 \x00"]
    rows = [(i, t, None if i % 3 else "en", None, None, "h", 1, "a") for i, t in enumerate(texts)]
    rows += [rows[-1], (None, line, None, None, None, None, None, None), (3, "same id, other text", "en", "s", 1, "", 0, "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---- line dedup ----------------------------------------------------------------------------------


def test_line_dedup_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(registry.oracle_sql()["op1_line_dedup"]).fetchall()
    got = registry.queries()["op1_line_dedup"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_line_dedup_odd(odd):
    fold = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for i, t in rows_of(odd):
        for x in t.split("\n"):
            holders[fold(x)].add(-1 if i is None else i)
    lost = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    want = []
    for i, t in rows_of(odd):
        lines = t.split("\n")
        kept = [x for x in lines if lost.get(fold(x), i if i is not None else -1) == (i if i is not None else -1)]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = line_dedup.dedup_report(odd).drop("dropped").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    applied = line_dedup.apply_bitmaps(odd, line_dedup.keep_bitmaps(odd))
    assert applied.columns == odd.columns and applied.count() == odd.count()


# ---- BPE -----------------------------------------------------------------------------------------


def test_bpe_equals_library(docs, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table in (docs, odd):
        got = bpe.encode(table, RANKS, public_tokenizers.PATTERN, decoded=True).collect()
        want = [np.array(code.encode_ordinary(t), "<u4").tobytes() for _, t in rows_of(table)]
        assert sorted(bytes(r.ids) for r in got) == sorted(want)
        assert sorted(bytes(r.decoded) for r in got) == sorted(t.encode() for _, t in rows_of(table))
    back = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(rows_of(back), key=repr) == sorted(rows_of(odd), key=repr)


def test_bpe_long_pretoken():
    coder = bpe.Bpe(bpe.read_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    ranks = coder.ranks
    code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("ab" * 20000, "thequickbrown" * 3000, "a" * 50001):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == code.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()


# ---- SimHash -------------------------------------------------------------------------------------


def brute_groups(ids, codes, limit=3):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= limit:
                parent[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(codes))]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_simhash_groups(name, request):
    table = request.getfixturevalue(name)
    rows = rows_of(table)
    codes = [simhash.fingerprint(t.encode()) for _, t in rows]
    want = zip([d for d, _ in rows], codes, brute_groups([d for d, _ in rows], codes))
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_gray_index_and_chunks(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = np.unique([int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 64, (60, 2))])
    codes = codes.astype(np.uint64)
    index = simhash.GrayIndex(codes)
    q, c = index.near(index.codes, 3)
    want = {(i, j) for i, a in enumerate(index.codes) for j, b in enumerate(index.codes) if (int(a) ^ int(b)).bit_count() <= 3}
    assert set(zip(q.tolist(), c.tolist())) == want
    table = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    want_groups = brute_groups(list(range(len(codes))), [int(x) for x in codes])
    for chunk in (4096, 8):  # in one piece, and dealt as pairs of chunks
        links = simhash.near_links(table, chunk=chunk).collect()
        parent = {int(x): int(x) for x in codes.view(np.int64)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        got = [find(int(x)) for x in codes.view(np.int64)]
        assert len({*zip(got, want_groups)}) == len(set(got)) == len(set(want_groups))


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    codes = [simhash.fingerprint(t.encode()) for _, t in rows_of(odd)]
    assert kept.count() == len(set(brute_groups(list(range(len(codes))), codes)))


# ---- decontamination -----------------------------------------------------------------------------


def test_decontamination(spark, docs, benchmark, odd):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    fold = lambda t: f" {' '.join(x.decode() for x in decontam.words_of(t.encode()))} "
    want = {(d, i) for d, t in rows_of(docs) for i, x in items if fold(x) in fold(t)}
    got = decontam.contaminated(docs, benchmark).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want
    small = decontam.contaminated(docs, benchmark, block_items=7).collect()  # several blocks of the index
    assert {(r.doc_id, r.item_id) for r in small} == want
    assert decontam.contaminated(odd, benchmark).count() == 0
    extra = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "x")], "item_id long, text string")
    assert decontam.drop_contaminated(odd, extra).columns == odd.columns


def test_wand_equals_full_scan():
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 60).encode()) for i in range(150)]
    index = decontam.Index(items, 64)
    for _ in range(40):
        terms = sorted({index.term_no[w] for w in (f"w{x}".encode() for x in rng.integers(0, 60, 25)) if w in index.term_no})
        sums = collections.Counter()
        for t in terms:
            for s, x in zip(index.ids[t], index.impacts[t]):
                sums[s] += x
        for least in (0.2, 0.5):
            want = {s for s, x in sums.items() if x >= least}
            assert {s for s, _ in index.search(terms, least)} == want


# ---- quality -------------------------------------------------------------------------------------


def test_quality(docs, labels, odd):
    judged = {r.doc_id: r for r in kn_quality.judge(docs, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect()}
    bad = [judged[d].kept for d, q in marks.items() if q == 0]
    good = [judged[d].kept for d, q in marks.items() if q == 1]
    assert np.mean(bad) < 0.2 and np.mean(good) > 0.95
    assert kn_quality.keep_good(odd, labels).columns == odd.columns
    assert kn_quality.judge(odd, labels.limit(0)).where("NOT kept").count() == 0


def test_quality_learns_from_every_trusted_text(spark):
    docs = spark.range(17_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality").union(docs.selectExpr("doc_id", "1 AS quality"))
    assert kn_quality._trusted(docs, labels).count() == 17_000


def test_kneser_ney_sums_to_one(docs, labels):
    table, logs = kn_quality.train(docs, labels).get()
    p = 10.0 ** logs.astype(float).reshape(-1, kn_quality.SYMBOLS)
    assert np.allclose(p[:: 997].sum(axis=1), 1, atol=1e-3)
    codes, begins = kn_quality.symbol_codes([b"ab", b""], table)
    assert len(codes) == 2 and begins.tolist() == [0, 2, 2]


# ---- toxicity ------------------------------------------------------------------------------------


def test_toxicity(spark, sf, docs, labels, odd):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.classify(docs, labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    marks = [(rows[r.doc_id], r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    yes, no = [x.score for x, t in marks if t], [x.score for x, t in marks if not t]
    assert np.mean([a > b for a in yes for b in no]) > 0.8
    assert toxicity.classify(odd, labels).count() == odd.count()
    assert toxicity.classify(odd, labels.limit(0)).where("score IS NULL").count() == 0


# ---- personal data -------------------------------------------------------------------------------

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(number):
    d = [int(c) for c in reversed(number)]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in rule.finditer(text):
            number = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))}.get(kind)
            ok = ok if ok is not None else (13 <= len(number) <= 19 and luhn(number) if kind == "card" else 9 <= len(number) <= 15)
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_learns_from_all_candidates(spark, monkeypatch):
    seen = []

    class Trees:
        def __init__(self, **options):
            pass

        def fit(self, rows):
            seen.append(rows.count())
            raise InterruptedError

    monkeypatch.setattr(pii, "GBTClassifier", Trees)
    texts = spark.range(24_000).selectExpr("id AS doc_id", "concat('call +49 170 1234567, 0170-1234', id + 100) AS text")
    with pytest.raises(InterruptedError):
        pii.spans(texts)
    assert seen[0] > 20_000  # one half of 48,000


def test_pii(spark, docs, odd):
    cases = ["a@b.com_x@y.z a@b.c@d.e", "+1 (375) 555-4393 1.2.3.4.5.6.7.8 999.1.1.1 0001.02.003.4", "é😀 4111 1111 1111 1111x"]
    cases += ["😀x@y.de\n+49 30 123456789.", "+1 2 (3).", "me (at) site (dot) com", "4111111111111112 4111111111111111"]
    extra = spark.createDataFrame([(900 + i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    for table in (docs, odd, extra):
        found = pii.spans(table).select("doc_id", pii.written(F.col("base")).alias("base")).collect()
        want = [(d, brute_spans(t)) for d, t in rows_of(table)]
        assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    clean = {r.doc_id: r.text for r in pii.redact(extra, pii.spans(extra)).collect()}
    assert clean[900] == "[*]_x@y.z [*]@d.e" or clean[900].startswith("[*]")
    assert clean[904] == "+1 2 (3)."


# ---- suffix arrays -------------------------------------------------------------------------------


def brute_removed(texts, span):
    seen = collections.Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_runs_leave_a_task_in_bounded_batches(monkeypatch):
    """All runs of a batch of texts in order, but never the runs of all its texts at once."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (200, 9000, 4000, 300, 9000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [5, None, 7, 8, 8], "row": [1, 2, 3, 4, 5], "text": pa.array(texts, pa.binary())})
    monkeypatch.setattr(suffix_dedup, "RUN_ROWS", 50)
    made = list(suffix_dedup._find_runs(200, 50)(iter([batch])))
    assert len(made) > 2 and max(b.num_rows for b in made) < 50 + 9000 // 40
    got = pa.Table.from_batches(made).to_pylist()
    want = [(r, s, n, a) for r, t in enumerate(texts, 1) for s, n, _, a in zip(*map(np.ndarray.tolist, suffix_dedup.runs(t, 200, 50)))]
    assert [(g["row"], g["start"], g["n"], g["anchor"]) for g in got] == want
    assert {g["doc_id"] for g in got} == {5, None, 7, 8}


@pytest.mark.parametrize("chunk", [64, 1])
def test_suffix_dedup(spark, docs, odd, chunk):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    made = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    made += [made[i][:350] + " x " + made[i + 1][60:460] for i in range(8)] + [made[0], "ab" * 400, "\x00" * 500]
    extra = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for table in (extra, odd):
        got = suffix_dedup.dedup(table, chunk=chunk, part=500).collect()
        want = brute_removed([t.encode() for _, t in rows_of(table)], 200)
        assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)


# ---- neighbours ----------------------------------------------------------------------------------


def test_neighbours(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet".replace("sf0.001", "sf0.1"))
    got = ann.search(vectors, least=256).toPandas()
    frame = vectors.toPandas()
    x, ids = np.stack(frame["embedding"]).astype(float), frame["vec_id"].to_numpy()
    hits = total = 0
    for q, mine in got.groupby("query_id"):
        score = x @ x[ids == q][0]
        score[ids == q] = -9
        best = np.lexsort((ids, -score))[:20]
        assert mine.sort_values("rank")["score"].is_monotonic_decreasing and len(mine) == 20
        hits, total = hits + len(set(ids[best]) & set(mine["vec_id"])), total + 20
    assert total == 20 * (ids % 20 == 0).sum() and hits / total >= 0.9


def test_neighbours_odd(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 1.0]), (53, [1.0, None])]
    rows += [(60, [0.5, 0.5]), (60, [0.5, 0.4]), (None, [1.0, 1.0]), (61, [1.0, 2.0, 3.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 60}
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 20] == [i for i in range(21) if i != 20]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# ---- language model ------------------------------------------------------------------------------


def test_lm_base_and_score(docs, odd):
    for table in (docs, odd):
        rows = attention_lm.score(table, RANKS).collect()
        words = [(d, t.encode().lower().split()) for d, t in rows_of(table)]
        train = collections.Counter()
        for d, w in words:
            if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
                train.update([*w, b""])
        n, v = sum(train.values()), len(train)
        want = [
            (d, len(w) + 1, sum(train[x] > 0 for x in [*w, b""]), n,
             round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, b""]), 4))
            for d, w in words
        ]
        got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert all(r.score < 0 for r in rows)


def lm_model(rng, size=400):
    """Random weights and the tables of ``size`` ids."""
    counts = rng.integers(0, 30, (size, attention_lm.TOPICS))
    code = SimpleNamespace(starts=list(range(100, 180)), end=250, first=251)
    tables, prior = attention_lm.tables_of(counts, code)
    theta = attention_lm.init(prior)
    return tables, theta + rng.normal(0, 0.1, theta.shape)


def test_lm_gradient_and_windows():
    rng = np.random.default_rng(0)
    tables, theta = lm_model(rng)
    ids = rng.integers(0, 400, 90)
    windows, targets = attention_lm.windows_of(ids, tables.begin)
    assert targets[targets >= 0].tolist() == ids.tolist()
    g = attention_lm.gradient(attention_lm.views(theta), tables, windows, targets)[1]
    for name in attention_lm.SHAPES:
        at = tuple(rng.integers(0, n) for n in g[name].shape)
        loss = []
        for e in (1e-5, -1e-5):
            moved = theta.copy()
            attention_lm.views(moved)[name][at] += e
            loss.append(attention_lm.gradient(attention_lm.views(moved), tables, windows, targets)[0])
        assert abs((loss[0] - loss[1]) / 2e-5 - g[name][at]) < 1e-5
    p = attention_lm.views(theta)
    total = sum(np.exp(attention_lm.log_probs(p, tables, windows[:1], np.full((1, attention_lm.STEP), k))) for k in range(400))
    assert np.allclose(total, 1, atol=1e-4)


def test_lm_one_id_at_a_time():
    """Batched masked windows against a loop over ids that looks back only."""
    rng = np.random.default_rng(1)
    tables, theta = lm_model(rng)
    p = attention_lm.views(theta)
    for n in (1, 31, 32, 33, 200):
        ids = rng.integers(0, 400, n)
        want = []
        for i, own in enumerate(ids):
            first = i // attention_lm.STEP * attention_lm.STEP - attention_lm.LEAD  # where the window of id i begins
            seen = [(j - first, tables.begin if j == 0 else ids[j - 1]) for j in range(max(0, first), i + 1)]
            x = [p["emb"][tables.read[k]] + tables.share[k] @ p["topic"] + p["pos"][at] for at, k in seen]
            weight = np.array([np.exp((x[-1] @ p["wq"]) @ (y @ p["wk"]) / attention_lm.WIDTH**0.5) for y in x])
            state = x[-1] + (weight / weight.sum()) @ np.array([y @ p["wv"] for y in x]) @ p["wo"]
            out = np.exp(state @ p["out"] + p["bias"])
            parts = out[tables.slot[own] :][: attention_lm.TOPICS] / out.sum()
            want.append(np.log(parts @ tables.within[own]))
        windows, targets = attention_lm.windows_of(ids, tables.begin)
        got = attention_lm.log_probs(p, tables, windows, targets).ravel()
        assert np.allclose(got[:n], want, atol=1e-4) and not got[n:].any()


def test_lm_beats_base(spark, sf):
    """Above the base on training texts, and on held-out words that the training texts hold."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet").where("doc_id < 4000")
    rows = attention_lm.score(docs, RANKS).toPandas()
    train = rows[~rows["held_out"]]
    assert train["score"].sum() > train["base_score"].sum()
    known = {w for _, t in rows_of(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")) for w in t.encode().lower().split()}
    keep = F.udf(lambda t: " ".join(w for w in (t or "").split() if w.encode().lower() in known))
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    rows = attention_lm.score(docs.withColumn("text", F.when(held, keep("text")).otherwise(F.col("text"))), RANKS).toPandas()
    held_out = rows[rows["held_out"]]
    assert (held_out["n_known"] == held_out["n_tokens"]).all()
    assert held_out["score"].sum() > held_out["base_score"].sum()


# ---- all -----------------------------------------------------------------------------------------


def test_lm_fits_on_every_text(spark):
    """The order of words changes no count, only what the weights learn; no text may be left out of that."""
    words = "one two three four five six seven eight nine ten".split()
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:12]
    probe = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1)

    def score(turned):
        rows = [(i, " ".join(words[:: -1 if i == turned else 1])) for i in ids] + [(probe, " ".join(words))]
        return {r.doc_id: r.score for r in attention_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), RANKS).collect()}[probe]

    plain = score(None)
    assert all(abs(score(i) - plain) > 1e-6 for i in ids[:3])


def test_lm_topics_from_every_text(spark):
    """One text of its own kind among 3,000 gets a centre, wherever it stands."""
    rows = np.zeros((3000, attention_lm.CUES), "<i4")
    rows[:, 0] = 3
    rows[2345] = 0
    rows[2345, 7] = 5
    cues = spark.createDataFrame([(bytearray(x.tobytes()),) for x in rows], "cues binary").repartition(5)
    centres = attention_lm.topic_centres(cues)
    assert centres.shape == (attention_lm.TOPICS, attention_lm.CUES)
    assert np.isclose(centres[:, 7].max(), 1) and np.isclose(centres[:, 0].max(), 1)


def test_empty_tables(spark, labels, benchmark):
    none = spark.createDataFrame([], SCHEMA)
    assert line_dedup.dedup_report(none).count() == 0
    assert simhash.groups(none).count() == 0
    assert decontam.contaminated(none, benchmark).count() == 0
    assert kn_quality.judge(none, labels).count() == 0
    assert toxicity.classify(none, labels).count() == 0
    assert pii.spans(none).count() == 0
    assert suffix_dedup.dedup(none).count() == 0
    assert attention_lm.score(none, RANKS).count() == 0
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
    now = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = step(spark, now, sf)
        assert now.dtypes == docs.dtypes
    end = {(r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()}
    want = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert end == {(r.doc_id, bytes(r.ids)) for r in want} and 0 < len(end) < docs.count()
