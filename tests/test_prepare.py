import csv
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from netlume.operators.leakage import count_overlaps
from netlume.plans.prepare import prepare_files
from netlume.plans.specs import EDGE_SPEC, FLOW_SPEC, TELEMETRY_SPEC
from netlume.sources import artifact as A
from netlume.sources.csv import scan_devices


def write(path, header, rows, bom=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        csv.writer(f).writerows([header, *rows])


def check(spark, base, rows):
    read, meta = A.load_artifact(spark, base)
    assert sum(meta["split_rows"].values()) == read.count() == rows
    assert tuple(count_overlaps(read, meta["feature_columns"]).first()) == (0, 0, 0)
    train = read.where("split = 'train'")
    for name in meta["feature_columns"][:3]:
        mean, dev = train.agg(F.avg(f"`{name}`"), F.stddev_pop(f"`{name}`")).first()
        assert abs(mean) < 1e-9 and (abs(dev - 1) < 1e-9 or dev == 0)
    return read, meta


@pytest.mark.parametrize("sample", [None, 150])
def test_flow(spark, tmp_path, sample):
    labels = ["BENIGN", "DDOS-ICMP_FLOOD", "XSS"]
    header = ["Label", "Rate", "Protocol Type", "Tot sum"]
    rows = [[labels[i % 3], i, i % 5, f"{i}.5"] for i in range(200)]
    rows += rows[:20]  # duplicates
    rows += [["XSS", "inf", 1, 1], ["XSS", "bad", 1, 1], ["XSS", "", 1, 1]]  # incomplete
    rows += [["XSS", 999, 1, 1], ["BENIGN", 999, 1, 1]]  # a contradiction
    for i in range(2):
        write(tmp_path / "raw" / f"Merged{i}.csv", header, rows[i::2])
    base = str(tmp_path / "out")
    spec = replace(FLOW_SPEC, sample_n=sample)
    meta = prepare_files(spark, spec, str(tmp_path / "raw" / "Merged*.csv"), base)
    assert meta["feature_columns"] == ["Protocol Type", "Rate", "Tot sum"]
    if sample is None:
        read, meta = check(spark, base, 200)
        assert meta["multiclass_classes"] == sorted(labels)
        assert {r[0] for r in read.select("label_family").distinct().collect()} == {"benign", "ddos_dos", "web_injection"}
        benign = {r.split: r["count"] for r in read.where("label_binary = 0").groupBy("split").count().collect()}
        assert benign == {"train": 47, "val": 10, "test": 10}
    else:
        assert 100 < sum(meta["split_rows"].values()) <= 150 and meta["sample_target"] == "150"


@pytest.mark.parametrize("rate", [2, "inf"])
def test_flow_with_unknown_label_fails(spark, tmp_path, rate):
    """An unknown label is found on incomplete rows too."""
    write(tmp_path / "raw" / "Merged1.csv", ["Label", "Rate"], [["BENIGN", 1], ["NEW", rate]])
    spec = replace(FLOW_SPEC, sample_n=None)
    with pytest.raises(Exception, match="Unknown CICIoT2023 attack label: NEW"):
        prepare_files(spark, spec, str(tmp_path / "raw" / "Merged*.csv"), str(tmp_path / "out"))


@pytest.mark.parametrize("encoding", ["onehot", "label"])
def test_edge(spark, tmp_path, encoding):
    kinds = ["Normal", "DDoS_UDP", "MITM", "Password"]
    header = ["frame.time", "tcp.len", "mqtt.topic", "udp.stream", "Attack_label", "Attack_type"]
    rows = [["t", i, f" top{i % 3} ", i * 0.5, int(i % 4 > 0), kinds[i % 4]] for i in range(200)]
    rows += [["u", 1, " top1 ", 0.5, 1, "DDoS_UDP"]]  # the same row but for the dropped column
    rows += [["t", 900, "0.0", 1, 0, "Normal"], ["t", 901, "0", 1, 0, "Normal"], ["t", "", "0", 1, 0, "Normal"]]
    write(tmp_path / "edge.csv", header, rows)
    base = str(tmp_path / "out")
    spec = replace(EDGE_SPEC, sample_n=None, encoding=encoding)
    prepare_files(spark, spec, str(tmp_path / "edge.csv"), base)
    read, meta = check(spark, base, 202)
    assert "frame.time" not in read.columns and meta["n_rows_before_cleaning"] == 204
    if encoding == "onehot":
        assert set(meta["onehot_columns"]) >= {"mqtt.topic_top0", "mqtt.topic_top1", "mqtt.topic_top2"}
        assert meta["feature_columns"][:2] == ["tcp.len", "udp.stream"]
    else:
        assert meta["categorical_encoders"]["mqtt.topic"][-3:] == ["top0", "top1", "top2"]
        table = A.read_categories(spark, base).orderBy("code").collect()
        assert [r.value for r in table] == meta["categorical_encoders"]["mqtt.topic"]
        assert meta["feature_columns"] == ["tcp.len", "mqtt.topic", "udp.stream"]


def test_telemetry(spark, tmp_path):
    def rows(device):
        out = []
        for i in range(100):
            kind = [" Normal", "DDoS ", "xss"][i % 3]
            out.append(["25-Apr-19", f" 19:{i % 60:02d}:{device:02d} ", i + device * 0.25, f" s{i % 2} ", int(i % 3 > 0), kind])
        out[3][2], out[4][3], out[5][0] = "inf", "None", "bad"
        return out

    write(tmp_path / "raw" / "IoT_Fridge.csv", ["date", "time ", "temp", "state", "label", "type"], rows(1), bom=True)
    write(tmp_path / "raw" / "IoT_Door.csv", ["date", "time", "gap", "state", "label", "type"], rows(2) + [rows(2)[9]])
    base = str(tmp_path / "out")
    spec = replace(TELEMETRY_SPEC, sample_n=None)
    prepare_files(spark, spec, str(tmp_path / "raw" / "IoT_*.csv"), base)
    read, meta = check(spark, base, 200)
    assert sorted(meta["categorical_columns"]) == ["device", "state"]
    assert meta["source_files"] == ["IoT_Door.csv", "IoT_Fridge.csv"]
    assert "device_fridge" in meta["feature_columns"] and "state___missing__" in meta["feature_columns"]
    assert meta["multiclass_classes"] == ["ddos", "normal", "xss"] and meta["n_rows_before_cleaning"] == 201
    sampled = prepare_files(spark, replace(spec, sample_n=90), str(tmp_path / "raw" / "IoT_*.csv"), str(tmp_path / "few"))
    # each label gets the floor of its share, 88 rows in all; a pair of copies may be among them
    assert 86 <= sum(sampled["split_rows"].values()) <= 88


def test_devices_are_scanned_by_header(spark, tmp_path):
    """Many files of two headers make two branches of the plan; the device is the name of the file."""
    for i in range(60):
        header, row = (["a", "b"], [i, "x"]) if i % 3 else (["b", "c"], ["y", i])
        write(tmp_path / f"IoT_Dev {i}.csv", header, [row])
    (tmp_path / "IoT_Parts.csv").mkdir()
    write(tmp_path / "IoT_Parts.csv" / "part-0.csv", ["a", "b"], [[99, "z"]])
    found = scan_devices(spark, str(tmp_path / "IoT_*.csv"))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    rows = {r.device: (r.a, r.b, r.c) for r in found.collect()}
    assert len(rows) == 61 and rows["dev 1"] == ("1", "x", None) and rows["dev 3"] == (None, "y", "3")
    assert rows["parts"] == ("99", "z", None)
