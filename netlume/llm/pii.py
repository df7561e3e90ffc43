"""Personal data by boosted trees over candidate spans, in DataFrame operations only.

Rules find well-formed e-mail and IP addresses, cards and phone numbers; these spans always stay. Wider generators
propose more: addresses with spelled-out or spaced signs, and digit groups with loose separators. A gradient-boosted tree
model rates each candidate by its format and the text before and after it. It learns from one half of all candidates, by
hash, where a candidate that a rule confirms is positive. The sign that makes a rule (a leading plus) is no feature, so
the trees must judge by the rest. On the other half the threshold of each kind is the lowest whose accepted candidates
are confirmed to ``precision``. Candidates above it that meet no span of a rule are added.

Matching is linear in the text: repeated groups are possessive, and an address or digit run is tried at its start only,
or where the match before it ended. Offsets count code points; no row is shuffled with its text.

Rows: a NULL text is empty; it has no spans. Repeated rows give repeated results, NULL ids stay, other columns are
ignored. Without confirmed or without unconfirmed candidates there is no model and nothing is added.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlume.llm.common import text_of
from netlume.staging import stage

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
RULES = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
ADDRESS = (
    r"(?i)(?<![^\s])[^\s@()\[\]]{1,64}+\s?(?:@|\(at\)|\[at\])\s?[a-z0-9-]++"
    r"(?:\s?(?:\.|\(dot\)|\[dot\])\s?[a-z0-9-]++)++"
)
NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().:_/-]{0,2}[0-9]){6,}+"
CUES = r"(?i)(mail|phone|tel|call|mobile|fax|contact|card|visa|account|host|server|addr|ip)[^0-9]{0,12}$"
SPAN = "array<struct<kind:int,s:int,e:int>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches as (s, e, m, before): code points, end exclusive; a last element without m ends the text."""
    parts = F.zip_with(
        F.split(text, pattern),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")),
    )

    def step(state: Column, x: Column) -> Column:
        s = state["at"] + F.char_length(x["gap"])
        e = (s + F.coalesce(F.char_length(x["m"]), F.lit(0))).cast("int")
        row = F.struct(s.cast("int").alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["gap"], F.lit(24)).alias("before"), F.left(x["gap"], F.lit(1)).alias("head"))
        return F.struct(e.alias("at"), F.concat(state["out"], F.array(row)).alias("out"))

    empty = F.array().cast("array<struct<s:int,e:int,m:string,before:string,head:string>>")
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def octets_ok(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def luhn_ok(number: Column) -> Column:
    n = F.char_length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).try_cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return (total + twice).cast("int")

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    n = F.char_length(digits(m))
    if kind == "ip":
        return octets_ok(m)
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn_ok(digits(m))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    all_ = F.filter(matches(text, RULES[kind]), lambda x: F.when(x["m"].isNull(), False).otherwise(valid(kind, x["m"])))
    number = KINDS.index(kind)
    spans = F.transform(all_, lambda x: F.struct(F.lit(number).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    there = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    return F.when(there, spans).otherwise(F.array()).cast(SPAN)


def annotate(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, base, proposed), staged: the spans of the rules by kind and start, and the wider candidates."""
    text = F.col("text")
    rows = text_of(docs)
    digit = F.regexp_like(text, F.lit("[0-9]"))
    none = F.array().cast(SPAN)
    found = {k: F.when(digit, _found(text, k)).otherwise(none) if k != "email" else _found(text, k) for k in KINDS}
    spelled = F.regexp_like(text, F.lit(r"@|(?i:\(at\)|\[at\])"))
    no_match = F.array().cast("array<struct<s:int,e:int,m:string,before:string,head:string>>")
    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        F.concat(*found.values()).alias("base"),
        F.when(spelled, matches(text, ADDRESS)).otherwise(no_match).alias("addresses"),
        F.when(digit, matches(text, NUMBER)).otherwise(no_match).alias("numbers"),
    )

    def proposed(name: str, address: bool) -> Column:
        out = F.transform(
            F.col(name),
            lambda x, i: F.struct(
                F.lit(address).alias("address"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"),
                x["before"].alias("before"), F.get(F.col(name), i + 1)["head"].alias("after"),
            ),
        )
        return F.filter(out, lambda x: x["m"].isNotNull())

    both = F.concat(proposed("addresses", True), proposed("numbers", False))
    return stage(rows.select("uid", "doc_id", "base", both.alias("proposed")), "pii")


FEATURES = [
    "n_digits", "n_chars", "n_letters", "spaces", "dashes", "dots", "brackets", "others", "groups", "longest", "octets",
    "luhn", "at", "spelled", "cue", "before_space", "after_space", "after_letter",
]


def candidates(marked: DataFrame) -> DataFrame:
    """One row per proposed span: uid, kind, s, e, features, whether it meets a span of a rule and whether it is one."""
    rows = marked.select("uid", "base", F.explode("proposed").alias("x")).select("uid", "base", "x.*")
    m, number = F.col("m"), digits(F.col("m"))
    count = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    n = F.char_length(number)
    dotted = F.size(groups) == 4
    kind = F.when(F.col("address"), 0).when((count("[.]") == 3) & dotted, 1).when(n >= 13, 2).otherwise(3)
    rows = rows.withColumns(
        {
            "n_digits": n.cast("double"),
            "n_chars": F.char_length(m).cast("double"),
            "n_letters": count("[A-Za-z]"),
            "spaces": count("[ ]"),
            "dashes": count("-"),
            "dots": count("[.]"),
            "brackets": count("[()]"),
            "others": count("[:_/]"),
            "groups": F.size(groups).cast("double"),
            "longest": F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)).cast("double"),
            "octets": F.forall(groups, lambda g: F.char_length(g) <= 3).cast("double"),
            "luhn": F.when((n >= 13) & (n <= 19), luhn_ok(number)).otherwise(False).cast("double"),
            "at": count("@"),
            "spelled": count(r"(?i)\((at|dot)\)|\[(at|dot)\]"),
            "cue": F.regexp_like("before", F.lit(CUES)).cast("double"),
            "before_space": F.regexp_like("before", F.lit(r"(^|\s)$")).cast("double"),
            "after_space": F.coalesce(F.regexp_like("after", F.lit(r"^(\s|[.,;!?]|$)")), F.lit(True)).cast("double"),
            "after_letter": F.coalesce(F.regexp_like("after", F.lit(r"^\w")), F.lit(False)).cast("double"),
            "kind": kind.cast("int"),
        }
    )
    meets = F.exists("base", lambda b: (b["s"] < F.col("e")) & (F.col("s") < b["e"]))
    same = F.exists("base", lambda b: (b["s"] >= F.col("s")) & (b["e"] == F.col("e")) & (b["kind"] == F.col("kind")))
    return rows.select("uid", "kind", "s", "e", *FEATURES, meets.alias("meets"), same.cast("double").alias("label"))


def _chosen(rows: DataFrame, precision: float, trees: int) -> DataFrame:
    """The candidates above the calibrated threshold of their kind that meet no span of a rule."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    half = F.pmod(F.xxhash64("uid", "s", "kind"), F.lit(2)).alias("half")
    known = vectors.select("features", "label", "kind", half)
    sides = {r.label for r in known.where("half = 0").select("label").distinct().collect()}
    if len(sides) < 2:
        return rows.limit(0).select("uid", "kind", "s", "e")
    model = GBTClassifier(maxIter=trees, maxDepth=4, seed=5, labelCol="label").fit(known.where("half = 0"))

    def rated(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("p", F.round(vector_to_array("probability")[1], 2))

    bins = rated(known.where("half = 1")).groupBy("kind", "p").agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n"))
    cut: dict[int, float] = {}
    yes: dict[int, list] = {}
    for r in bins.orderBy("kind", F.desc("p")).collect():  # at most 4 x 101 rows
        total = yes.setdefault(r.kind, [0.0, 0])
        total[0] += r.yes
        total[1] += r.n
        if total[0] >= precision * total[1] and r.p > 0.5:
            cut[r.kind] = r.p
    threshold = F.lit(2.0)
    for kind, p in cut.items():
        threshold = F.when(F.col("kind") == kind, p).otherwise(threshold)
    free = rated(vectors.where(~F.col("meets")))
    return free.where(F.col("p") >= threshold).select("uid", "kind", "s", "e")


def spans(docs: DataFrame, precision: float = 0.99, trees: int = 12) -> DataFrame:
    """(doc_id, base, added) of every row, both as arrays of (kind number, start, end) by kind and start."""
    marked = annotate(docs)
    rows = stage(candidates(marked), "pii-candidates")
    extra = _chosen(rows, precision, trees)
    extra = extra.groupBy("uid").agg(F.collect_list(F.struct("kind", "s", "e")).alias("added"))
    out = marked.select("uid", "doc_id", "base").join(extra, "uid", "left")
    return out.select(
        "doc_id",
        F.array_sort("base").alias("base"),
        F.array_sort(F.coalesce("added", F.array().cast(SPAN))).alias("added"),
    )


def written(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def redact(docs: DataFrame, found: DataFrame, mark: str = "[*]") -> DataFrame:
    """(doc_id, text) with every span replaced; ids must be unique here."""
    all_ = found.select("doc_id", F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))).alias("x"))
    text = F.col("text")

    def step(state: Column, x: Column) -> Column:
        new = x["s"] >= state["at"]
        piece = F.concat(F.substring(text, state["at"] + 1, x["s"] - state["at"]), F.lit(mark))
        return F.struct(
            F.greatest(state["at"], x["e"]).alias("at"),
            F.when(new, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate("x", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rows = text_of(docs).join(all_, "doc_id", "left").withColumn("d", done)
    rest = F.substring(text, F.col("d.at") + 1, F.char_length(text))
    return rows.select("doc_id", F.coalesce(F.concat("d.out", rest), text).alias("text"))
