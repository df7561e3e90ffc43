"""Column expressions for cleaning, typing and fingerprinting. All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that mean "missing", and the category that replaces a missing one.
MISSING_TEXTS = ["", "nan", "None", "<NA>"]
MISSING_CATEGORY = "__missing__"

FP = ("_fp_hi", "_fp_lo")


def c(name: str) -> Column:
    """Column by literal name; names may hold dots, blanks and brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def to_number(column: Column) -> Column:
    """Text to double; anything that is not a number becomes NULL.

    Java also reads ``1d`` and ``1f`` as numbers; those texts are rejected here.
    """
    text = F.trim(column.cast("string"))
    last = F.lower(F.right(text, F.lit(1)))
    java_suffix = (last == "d") | ((last == "f") & (F.lower(F.right(text, F.lit(3))) != "inf"))
    return F.when(~java_suffix, text.try_cast("double"))


def finite_or_null(column: Column) -> Column:
    """NaN and both infinities become NULL, so that NULL alone means missing."""
    return F.when(F.abs(column) < float("inf"), column)  # NaN compares as larger than infinity


def finite_number(column: Column) -> Column:
    """``finite_or_null(to_number(column))`` in a form that parses the text at most twice.

    Filters on the result are pushed down to the scan, where repeated sub-expressions are evaluated
    again and again. Letters other than the exponent spoil a number, whatever they spell.
    """
    text = F.translate(F.trim(column.cast("string")), "dDfFnNxXpP", "##########")
    return finite_or_null(text.try_cast("double"))


def text_or_null(column: Column) -> Column:
    trimmed = F.trim(column)
    return F.when(~trimmed.isin(MISSING_TEXTS), trimmed)


def canonical_category(column: Column) -> Column:
    """Trim a categorical text; the float rendering of zero equals zero."""
    trimmed = F.trim(column)
    return F.when(trimmed == "0.0", F.lit("0")).otherwise(trimmed)


def fill_category(column: Column) -> Column:
    return F.coalesce(column, F.lit(MISSING_CATEGORY))


def is_attack(label: Column, benign: str) -> Column:
    """1 unless the label equals ``benign``; a NULL label counts as an attack."""
    return (~label.eqNullSafe(F.lit(benign))).cast("int")


def binary_from_text(label: Column) -> Column:
    """0/1 target from numeric text; a label that is not a number fails the job."""
    number = to_number(label)
    return F.when(number.isNull(), F.raise_error(F.lit("binary label is not a number"))).otherwise(
        number.cast("int")
    )


def normal_label(label: Column) -> Column:
    return F.lower(F.trim(label))


def event_time(date: Column, time: Column) -> Column:
    """``25-Apr-19`` and ``19:19:45`` with stray blanks to a timestamp; bad text becomes NULL."""
    text = F.concat_ws(
        " ",
        F.trim(F.regexp_replace(F.coalesce(date, F.lit("")), r"\s+", " ")),
        F.trim(F.regexp_replace(F.coalesce(time, F.lit("")), r"\s+", " ")),
    )
    return F.try_to_timestamp(text, F.lit("d-MMM-yy H:m:s"))


def time_parts(moment: Column) -> dict[str, Column]:
    return {
        "month": F.month(moment),
        "day": F.dayofmonth(moment),
        "hour": F.hour(moment),
        "minute": F.minute(moment),
        "second": F.second(moment),
    }


def _fingerprint_args(df: DataFrame, names: Iterable[str]) -> list[Column]:
    types = dict(df.dtypes)
    args: list[Column] = []
    for name in names:
        column = c(name)
        if types[name] in ("double", "float"):
            column = column + F.lit(0.0).cast(types[name])  # -0.0 and 0.0 are one value
        # xxhash64 skips NULLs, so the NULL flag keeps (NULL, 1) apart from (1, NULL)
        args += [column, column.isNull()]
    return args


def with_fingerprint(df: DataFrame, names: Iterable[str], out: tuple[str, str] = FP) -> DataFrame:
    """Add a 128-bit row fingerprint over ``names`` as two BIGINT columns.

    128 bits, because at 1e12 rows a single 64-bit hash is expected to collide tens of thousands of
    times, and every collision would wrongly delete a row.
    """
    args = _fingerprint_args(df, names)
    return df.withColumns({out[0]: F.xxhash64(F.lit(1), *args), out[1]: F.xxhash64(F.lit(2), *args)})


def row_hash(df: DataFrame, keys: list[str] | None = None, seed: int = 42) -> Column:
    """Seeded pseudo-random hex position of a row: md5 over its key, or over the whole row."""
    if keys:
        parts = [F.coalesce(c(k).cast("string"), F.lit("<null>")) for k in keys]
        return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    args = _fingerprint_args(df, df.columns)
    hi, lo = F.xxhash64(F.lit(1), *args), F.xxhash64(F.lit(2), *args)
    return F.md5(F.concat_ws("|", hi.cast("string"), lo.cast("string"), F.lit(str(seed))))


def drop_missing(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any of the columns, all columns by default."""
    return df.dropna(subset=["`" + n.replace("`", "``") + "`" for n in (names or df.columns)])


def sanitize_name(name: str) -> str:
    for bad in "[]<>":
        name = name.replace(bad, "_")
    return name


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[sanitize_name(n) for n in df.columns])


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Same columns in the same order: missing ones are 0, extra ones are dropped."""
    have = set(df.columns)
    return df.select(*[c(n) if n in have else F.lit(0).alias(n) for n in columns])
