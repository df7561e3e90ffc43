"""Line deduplication that returns compressed keep bitmaps instead of text.

Long lines become narrow rows (128-bit key hash, document, position). They are range-partitioned by hash and
document, so that a key that many documents share is spread over many partitions, and sorted by position inside. A stream
over each sorted partition passes on the first row of every run of a key and document (the row before it differs), without
another exchange of the lines. These first occurrences are counted by key, and the largest document keeps the line. Shared keys then meet the narrow rows again (a broadcast if
the staged table is under Spark's own limit, else a sort-merge join whose hot keys adaptive execution splits). Each document
that loses lines gets one bitmap, as runs of dropped lines. Texts are read twice and never shuffled by line.

Rows: a NULL or empty text is one empty line. A NULL id counts as one document that comes before all others. Rows with
one id are one document for counting; each keeps its own bitmap, found by id and text hash. Column names of the input
other than ``doc_id`` and ``text`` do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlume.llm.common import SPACES, ascii_lower, hash128, text_of
from netlume.staging import stage

RUN = "array<struct<start:int,n:int>>"


def _lines(docs: DataFrame) -> DataFrame:
    return text_of(docs).select(
        "doc_id", F.xxhash64("text").alias("row"), F.split("text", "\n").alias("lines")
    )


def _runs(at: Column) -> Column:
    """Sorted positions as runs of neighbours."""
    starts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    return F.zip_with(
        starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).cast("int").alias("n"))
    ).cast(RUN)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, n_dropped, dropped): which lines each document loses; documents that lose none have no row.

    A key is a stripped line in lower case (A-Z). Keys of ``min_chars`` or more code points in ``min_docs`` or more
    documents lose all lines except in the largest id that holds them.
    """
    lines = _lines(docs).select("doc_id", "row", F.posexplode("lines").alias("pos", "line"))
    stripped = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).where(
        F.char_length("line") >= min_chars
    )
    keys = stripped.select(*hash128(ascii_lower(F.col("line"))), "doc_id", "row", "pos")
    rows = stage(keys, "line-keys")
    order = ["h1", "h2", "doc_id"]
    ordered = rows.repartitionByRange(*order)  # no run of a key and document crosses a partition
    run = Window.partitionBy(*order).orderBy("pos")
    holders = ordered.withColumn("nth", F.row_number().over(run)).where(F.col("nth") == 1)
    shared = (
        holders.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .drop("n_docs")
    )
    lost = rows.join(stage(shared, "line-shared"), ["h1", "h2"]).where(
        ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    )
    # repeated rows name each position several times
    at = lost.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return at.select(
        "doc_id", "row", F.size("at").cast("long").alias("n_dropped"), _runs(F.col("at")).alias("dropped")
    )


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines outside the dropped runs, as slices between the runs."""
    start = F.transform(F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"))), dropped),
                        lambda r: r["start"] + r["n"])
    end = F.concat(F.transform(dropped, lambda r: r["start"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(start, end, lambda a, b: F.slice(lines, a + 1, b - a)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the kept text in ``text``; all other columns as they were."""
    row = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_id"), row.alias("_row"))
    marks = bitmaps.select(F.col("doc_id").alias("_mid"), F.col("row").alias("_mrow"), "dropped")
    joined = keyed.join(marks, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_row") == F.col("_mrow")), "left")
    lines = F.split("doc.text", "\n")
    kept = F.when(F.col("dropped").isNull(), F.col("doc.text")).otherwise(
        F.array_join(kept_lines(lines, F.col("dropped")), "\n")
    )
    return joined.select(F.col("doc").withField("text", kept).alias("doc")).select("doc.*")


def dedup_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, dropped) of every row."""
    marks = keep_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "_mid", "row": "_mrow"})
    rows = text_of(docs).withColumn("row", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col("_mid")) & (F.col("row") == F.col("_mrow"))
    lines = F.split("text", "\n")
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
        F.array_join(kept_lines(lines, F.col("dropped")), "\n")
    )
    return rows.join(marks, on, "left").select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
        F.coalesce("dropped", F.array().cast(RUN)).alias("dropped"),
    )
