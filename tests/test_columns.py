import pytest
from pyspark.sql import functions as F

from netlume.functions import columns as C
from netlume.functions.taxonomy import EDGE, FAMILIES, FLOW, TELEMETRY


def values(df):
    return [r[0] for r in df.collect()]


def test_to_number_rejects_text_that_only_java_reads(spark):
    texts = ["1", " 2.5 ", "1e3", "1d", "2F", "inf", "-inf", "NaN", "x", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = values(rows.select(C.to_number(F.col("t"))))
    assert got[:3] == [1.0, 2.5, 1000.0]
    assert got[3:5] == [None, None]
    assert got[5:7] == [float("inf"), float("-inf")] and got[7] != got[7]
    assert got[8:] == [None, None, None]


def test_finite_number_equals_the_two_steps(spark):
    texts = ["1", " -2.5 ", "1e3", "1E-2", "1d", "2F", "inf", "Infinity", "NaN", "1e999", "0x1p3", "x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    one = values(rows.select(C.finite_number(F.col("t"))))
    two = values(rows.select(C.finite_or_null(C.to_number(F.col("t")))))
    assert one[:4] == [1.0, -2.5, 1000.0, 0.01] and one[4:] == [None] * 10
    assert [v for v in two if v is not None and v != 8.0] == one[:4]


def test_text_cleaning(spark):
    rows = spark.createDataFrame([(" a ",), ("nan",), (" None",), ("<NA>",), ("",), ("0.0",), (None,)], "t string")
    assert values(rows.select(C.text_or_null(F.col("t")))) == ["a", None, None, None, None, "0.0", None]
    assert values(rows.select(C.canonical_category(F.col("t"))))[5] == "0"
    assert values(rows.select(C.fill_category(C.text_or_null(F.col("t")))))[1] == C.MISSING_CATEGORY


def test_targets(spark):
    rows = spark.createDataFrame([("BENIGN",), ("XSS",), (None,)], "t string")
    assert values(rows.select(C.is_attack(F.col("t"), "BENIGN"))) == [0, 1, 1]
    flags = spark.createDataFrame([("1",), ("x",)], "t string").select(C.binary_from_text(F.col("t")))
    with pytest.raises(Exception, match="not a number"):
        flags.collect()


def test_event_time(spark):
    rows = spark.createDataFrame(
        [("25-Apr-19", " 19:19:45 "), ("1-may-19", "9:05:07"), ("bad", "1:1:1"), (None, "1:1:1")], "d string, t string"
    )
    parts = C.time_parts(C.event_time(F.col("d"), F.col("t")))
    got = [tuple(r) for r in rows.select(*parts.values()).collect()]
    assert got == [(4, 25, 19, 19, 45), (5, 1, 9, 5, 7), (None,) * 5, (None,) * 5]


def test_fingerprint_keeps_null_positions_and_joins_zeros(spark):
    rows = spark.createDataFrame([(None, 1.0), (1.0, None), (0.0, 1.0), (-0.0, 1.0)], "a double, b double")
    fp = [tuple(r) for r in C.with_fingerprint(rows, ["a", "b"]).select(*C.FP).collect()]
    assert fp[0] != fp[1] and fp[2] == fp[3] and len(set(fp)) == 3


def test_names(spark):
    rows = spark.createDataFrame([(1, 2)], ["a[x]", "b<y>"])
    assert C.sanitize_columns(rows).columns == ["a_x_", "b_y_"]
    aligned = C.align_columns(spark.createDataFrame([(1, 2)], ["b.c", "z"]), ["a", "b.c"])
    assert aligned.columns == ["a", "b.c"] and tuple(aligned.first()) == (0, 1)


# Labels of the flow dataset.
FLOW_LABELS = """BACKDOOR_MALWARE BENIGN BROWSERHIJACKING COMMANDINJECTION DDOS-ACK_FRAGMENTATION DDOS-HTTP_FLOOD
DDOS-ICMP_FLOOD DDOS-SLOWLORIS DICTIONARYBRUTEFORCE DNS_SPOOFING DOS-HTTP_FLOOD DOS-SYN_FLOOD MIRAI-GREETH_FLOOD
MIRAI-UDPPLAIN MITM-ARPSPOOFING RECON-HOSTDISCOVERY RECON-PORTSCAN SQLINJECTION UPLOADING_ATTACK VULNERABILITYSCAN
XSS""".split()


def test_taxonomies(spark):
    rows = spark.createDataFrame([(v,) for v in FLOW_LABELS], "t string")
    families = dict(zip(FLOW_LABELS, values(rows.select(FLOW.family(F.col("t"))))))
    assert set(families.values()) == set(FAMILIES)
    assert families["MIRAI-UDPPLAIN"] == "ddos_dos" and families["VULNERABILITYSCAN"] == "recon"
    one = spark.createDataFrame([(" ddos ", "DDoS_UDP")], "a string, b string")
    assert tuple(one.select(TELEMETRY.family(F.col("a")), EDGE.family(F.col("b"))).first()) == ("ddos_dos",) * 2
    for taxonomy, bad in ((FLOW, "NEW"), (EDGE, "normal"), (TELEMETRY, None)):
        unknown = spark.createDataFrame([(bad,)], "t string").select(taxonomy.family(F.col("t")))
        with pytest.raises(Exception, match="Unknown"):
            unknown.collect()
