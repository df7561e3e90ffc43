"""Helpers shared by the corpus operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; ``bytes.lower`` and ``bytes.split`` follow exactly that
rule and touch no other byte, so word operators work on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a NULL text as the empty text; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def utf8_of(docs: DataFrame) -> DataFrame:
    return text_of(docs).withColumn("text", F.col("text").cast("binary"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character kept; pure ASCII takes the fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def hash128(*parts: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes; one alone collides at 1e10 values."""
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(0x6E65746C), *parts).alias("h2")]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def keep_freed() -> None:
    """Lets a Python worker keep the memory of arrays that come and go, instead of getting it back from the system each time.

    The C library returns freed blocks as large as the largest one freed so far; after one of 16 MB those of a product stay.
    """
    np.empty(1 << 24, np.uint8)


class Shared:
    """A bounded object that tasks unpack once per Python worker.

    ``make`` turns the broadcast value into what tasks use; the result stays in the worker, keyed by the broadcast.
    """

    _made: dict[int, object] = {}

    def __init__(self, spark: SparkSession, value: object, make: Callable[[object], object]):
        self.sent = spark.sparkContext.broadcast(value)
        self.key = self.sent._jbroadcast.id()
        self.make = make

    def __getstate__(self):
        return {"sent": self.sent, "key": self.key, "make": self.make}

    def get(self):
        if self.key not in Shared._made:
            Shared._made.clear()  # one model at a time bounds the worker
            Shared._made[self.key] = self.make(self.sent.value)
        return Shared._made[self.key]
