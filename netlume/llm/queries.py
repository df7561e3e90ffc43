"""Registered queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlume.llm import (
    ann,
    attention_lm,
    bpe,
    collocation,
    decontam,
    forced_bpe,
    kn_quality,
    line_dedup,
    pii,
    ranked_search,
    simhash,
    suffix_dedup,
    toxicity,
)
from netlume.llm.common import UPPER

QUERIES: dict = {}
SQL: dict[str, str] = {}

RANKS = "byte_bpe_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"
LOWER_SQL = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
TERMS_SQL = rf"regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    rf"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{UPPER}', '{UPPER.lower()}') AS k FROM line),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INT) >= 5),
marked AS (SELECT doc_id, line, pos, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS lost FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
)
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf, "documents")).drop("dropped")


@query()
def op5_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    coded = bpe.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    made = simhash.groups(table(spark, sf, "documents"))
    return made.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("row")


@query()
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that are kept, with their perplexity and the threshold of their language."""
    judged = kn_quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.where("kept").drop("row")


@query()
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op9_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(table(spark, sf, "embeddings"))


@query()
def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = suffix_dedup.dedup(table(spark, sf, "documents"))
    return done.withColumn("kept", F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")


@query()
def op4_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.spans(table(spark, sf, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)),
        F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


@query()
def op3_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return attention_lm.score(table(spark, sf, "documents"), public_tokenizers.path(RANKS))


@query(
    rf"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, {TERMS_SQL} AS terms FROM documents),
size AS (SELECT d, doc_id, len(terms) AS n FROM doc WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
wanted AS (SELECT DISTINCT item_id, text, unnest({TERMS_SQL}) AS term FROM benchmark),
hit AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM doc)
  WHERE term IN (SELECT term FROM wanted) GROUP BY d, term),
heavy AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM hit, total GROUP BY term, n_docs),
impact AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS x
  FROM hit JOIN size USING (d) JOIN heavy USING (term), total),
scored AS (SELECT item_id, text, d, doc_id, CAST(sum(x) AS BIGINT) AS score FROM wanted JOIN impact USING (term)
  GROUP BY item_id, text, d, doc_id HAVING sum(x) > 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS INT)
  AS rank FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""
)
def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.search_all(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op12_forced_bpe(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = public_tokenizers.path(VOCABULARY)
    coded = forced_bpe.encode(table(spark, sf, "documents"), vocabulary, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(
    unnest(string_split_regex({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang),
place AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM piece WHERE len(w) > 0),
gram AS (SELECT lang, w[i:i + k - 1] AS p, count(*) AS f FROM place, generate_series(1, 5) AS g(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM gram WHERE len(p) > 1),
scored AS (SELECT cut.lang, cut.p, cut.f AS a, k, one.f AS l, two.f AS r, n,
    (1000::HUGEINT * cut.f * n) // (one.f::HUGEINT * two.f) AS score
  FROM cut JOIN total USING (lang) JOIN gram AS one ON one.lang = cut.lang AND one.p = cut.p[1:k]
  JOIN gram AS two ON two.lang = cut.lang AND two.p = cut.p[k + 1:len(cut.p)]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
part AS (SELECT lang, p[i:i + k - 1] AS p, max(f) AS most
  FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM gram WHERE len(p) > 2), generate_series(2, 4) AS g(k)
  WHERE k < len(p) AND i + k - 1 <= len(p) GROUP BY ALL),
kept AS (SELECT worst.*, array_to_string(worst.p, ' ') AS phrase FROM worst LEFT JOIN part USING (lang, p)
  WHERE coalesce(most, 0) < a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000"""
)
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocation.collocations(table(spark, sf, "documents"))
