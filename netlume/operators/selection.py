"""Exact quantiles by bracketing: narrow scans instead of a sort or a shuffle of the values.

A mergeable sketch per group and column gives a bracket of two values around each wanted position. The next scan counts
what lies below, at and between its ends, and narrows it again while more than ``FEW`` rows are between them. Only the
values between the ends of the last bracket are shuffled, counted per distinct value; copies at its ends are just counted,
however many there are. Every scan is one aggregate over all groups and columns, rows are neither multiplied nor moved.
A bracket that fails its count is opened and taken wider, so the result does not rest on the error bound of the sketch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlume.staging import stage

GRID = 256  # quantiles of a sketch
ACCURACY = 8 * GRID  # ranks in the sketch are off by at most one in so many rows
FEW = 50_000  # rows between the ends of a bracket that are counted value by value
LOWEST, HIGHEST = float("-inf"), float("nan")  # NaN sorts above every number


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], by: list[str] = (), few: int = FEW
) -> DataFrame:
    """Linear-interpolation quantiles per group: (by..., prob, quantile). NULLs are ignored."""
    return quantiles_of(df, [F.col(value)], probs, by, few).select(*by, "prob", "quantile")


def quantiles_of(
    df: DataFrame, values: list[Column], probs: list[float], by: list[str] = (), few: int = FEW
) -> DataFrame:
    """(by..., column, prob, quantile) of several columns at once; a column without a value has no row.

    A group is a row of the bracket table, so rows of a NULL group have no result.
    """
    keys = [f"_k{i}" for i in range(len(by))] or ["_all"]
    named = [F.col(n).alias(k) for n, k in zip(by, keys)] or [F.lit(0).alias("_all")]
    rows = df.select(*named, *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values)]).dropna(subset=keys)
    spots = [(i, float(p)) for i in range(len(values)) for p in probs]
    state = stage(_measure(rows, keys, spots, lambda _: F.lit(LOWEST), lambda _: F.lit(HIGHEST), True), "brackets")
    margin = 1  # cells of the sketch on either side of a position
    while True:
        between = F.max(F.array_max(F.transform("_spots", lambda b: b["between"])))
        missed = F.max(F.exists("_spots", _missed))
        found = state.agg(between.alias("between"), missed.alias("missed")).first()
        largest = found["between"] or 0
        if largest <= few and not found["missed"]:
            break
        if found["missed"]:
            margin *= 2
        brackets = stage(_narrowed(state, keys, few, margin), "brackets")
        joined = rows.join(brackets, keys)
        ends = (lambda s: F.get("_lo", F.lit(s))), (lambda s: F.get("_hi", F.lit(s)))
        again = (2 * margin + 3) * largest > few * GRID  # more than a few may still lie between the new ends
        state = stage(_measure(joined, keys, spots, *ends, again or found["missed"]), "bracket-counts")
        if not again and (state.agg(between).first()[0] or 0) > few:
            state = stage(_measure(joined, keys, spots, *ends, True), "bracket-counts")
    picked = _pick(rows, state, keys, spots)
    return picked.select(*[F.col(k).alias(n) for n, k in zip(by, keys)], "column", "prob", "quantile")


def _measure(
    rows: DataFrame,
    keys: list[str],
    spots: list[tuple],
    lo: Callable[[int], Column],
    hi: Callable[[int], Column],
    sketch: bool,
) -> DataFrame:
    """One row per group: for every spot its positions, its bracket, the rows below, at and between the ends, and a
    sketch of what is between."""
    aggs = []
    for s, (i, p) in enumerate(spots):
        v = F.col(f"_v{i}")
        middle = (v > lo(s)) & (v < hi(s))
        cells = [g / GRID for g in range(GRID + 1)]
        aggs += [
            F.count(v).alias(f"n{s}"),
            F.first(lo(s)).alias(f"lo{s}"),
            F.first(hi(s)).alias(f"hi{s}"),
            F.count_if(v < lo(s)).alias(f"below{s}"),
            F.count_if(v == lo(s)).alias(f"at_lo{s}"),
            F.count_if((v == hi(s)) & (lo(s) < hi(s))).alias(f"at_hi{s}"),
            F.count_if(middle).alias(f"between{s}"),
            *([F.percentile_approx(F.when(middle, v), cells, ACCURACY).alias(f"grid{s}")] if sketch else []),
        ]
    made = rows.groupBy(*keys).agg(*aggs)
    listed = []
    for s, (_, p) in enumerate(spots):
        place = F.round((F.col(f"n{s}") - 1) * F.lit(p), 9)
        fields = {
            "place": place,
            "low": F.floor(place),
            "high": F.ceil(place),
            "grid": F.col(f"grid{s}") if sketch else F.lit(None).cast("array<double>"),
            **{n: F.col(f"{n}{s}") for n in ("n", "lo", "hi", "below", "at_lo", "at_hi", "between")},
        }
        listed.append(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return made.select(*keys, F.array(*listed).alias("_spots"))


def _missed(b: Column) -> Column:
    """Whether a wanted position lies outside the bracket."""
    upto = b["below"] + b["at_lo"] + b["between"] + b["at_hi"]
    return (b["n"] > 0) & ((b["low"] < b["below"]) | (b["high"] >= upto))


def _narrowed(state: DataFrame, keys: list[str], few: int, margin: int) -> DataFrame:
    """(keys..., _lo, _hi): new brackets from the sketch of what is between the ends of the old ones."""

    def ends(b: Column) -> Column:
        before = b["below"] + b["at_lo"]
        low, high = b["low"] - before, b["high"] - before  # positions between the ends
        wide, grid = b["between"] > few, b["grid"]
        first = F.floor(low * F.lit(GRID) / b["between"]) - margin
        last = F.floor(high * F.lit(GRID) / b["between"]) + 1 + margin
        lo = F.when(wide & (low >= 0) & (first >= 0), F.get(grid, first)).otherwise(b["lo"])
        hi = F.when(wide & (high < b["between"]) & (last <= GRID), F.get(grid, last)).otherwise(b["hi"])
        return F.struct(
            F.when(_missed(b), F.lit(LOWEST)).when(low >= b["between"], b["hi"]).otherwise(lo).alias("lo"),
            F.when(_missed(b), F.lit(HIGHEST)).when(high < 0, b["lo"]).otherwise(hi).alias("hi"),
        )

    new = state.select(*keys, F.transform("_spots", ends).alias("_ends"))
    return new.select(*keys, F.col("_ends.lo").alias("_lo"), F.col("_ends.hi").alias("_hi"))


def _pick(rows: DataFrame, state: DataFrame, keys: list[str], spots: list[tuple]) -> DataFrame:
    """Values at the wanted positions. What lies between the ends is counted per distinct value and cumulated."""
    entries = F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"_v{i}").alias("v")) for s, (i, _) in enumerate(spots)])

    def middle(e: Column) -> Column:
        ends = F.get("_spots", e["s"])
        return (e["v"] > ends["lo"]) & (e["v"] < ends["hi"])

    brackets = F.transform("_spots", lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"))).alias("_spots")
    joined = rows.join(state.select(*keys, brackets), keys)
    inside = joined.select(*keys, F.explode(F.filter(entries, middle)).alias("e")).groupBy(*keys, "e.s", "e.v").count()
    upto = Window.partitionBy(*keys, "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    summed = inside.withColumn("_upto", F.sum("count").over(upto))
    wanted = state.select(*keys, F.posexplode("_spots").alias("s", "b")).where("b.n > 0")
    wanted = wanted.select(*keys, "s", *[f"b.{n}" for n in ("place", "low", "high", "lo", "hi", "below", "at_lo", "between")])
    before = F.col("below") + F.col("at_lo")
    # 0-based position p lies in the value with upto - count <= p < upto
    after, first = before + F.col("_upto"), before + F.col("_upto") - F.col("count")
    found = summed.join(wanted.select(*keys, "s", "low", "high", "below", "at_lo"), [*keys, "s"])
    found = found.groupBy(*keys, "s").agg(
        F.max(F.when((F.col("low") >= first) & (F.col("low") < after), F.col("v"))).alias("_at_low"),
        F.max(F.when((F.col("high") >= first) & (F.col("high") < after), F.col("v"))).alias("_at_high"),
    )
    out = wanted.join(found, [*keys, "s"], "left")

    def value(position: str, picked: str) -> Column:
        at = F.col(position)
        return F.when(at < before, F.col("lo")).when(at >= before + F.col("between"), F.col("hi")).otherwise(F.col(picked))

    low, high = value("low", "_at_low"), value("high", "_at_high")
    share = F.col("place") - F.col("low")
    listed = F.array(*[F.struct(F.lit(i).alias("column"), F.lit(p).alias("prob")) for i, p in spots])
    return out.select(
        *keys,
        F.get(listed, F.col("s"))["column"].alias("column"),
        F.get(listed, F.col("s"))["prob"].alias("prob"),
        (low + F.when(share > 0, (high - low) * share).otherwise(0.0)).alias("quantile"),
    )
