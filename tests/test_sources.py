"""Readers, normalizers and writers on small files."""

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alertloom.operators.labeling import align, expected_name, label
from alertloom.sources.jsonl import once, read_json_array, read_json_lines, read_label_archives, reject_labels, write_json_lines
from alertloom.sources.normalize import extract_vendor_rows, normalize, normalize_vendor

WAZUH = {
    "@timestamp": "2024-01-02T03:04:05.000+02:00",
    "location": "/var/log/auth.log",
    "rule": {"id": "5710", "description": "sshd: invalid user", "level": 5, "groups": ["a", "b"]},
    "agent": {"ip": "10.0.0.9"},
    "decoder": {"name": "sshd"},
    "full_log": "Jan 2 sshd: Invalid user x",
    "label": "benign",
    "data": {"srcip": "1.2.3.4", "dstport": "22", "protocol": "tcp"},
}
EVE = {
    "@timestamp": "2024-01-02T03:04:05Z",
    "location": "/var/log/suricata/eve.json",
    "rule": {"id": "1", "description": "Suricata: x", "level": 3},
    "agent": {"ip": "10.0.0.9"},
    "data": {"src_ip": "1.1.1.1", "dest_ip": "2.2.2.2", "dest_port": "80", "app_proto": "http", "alert": {"signature": "ET SCAN", "severity": "2"}, "http": {"url": "/a"}},
}
AMINER = {
    "AMiner": {"ID": "10.0.0.7"},
    "LogData": {"Timestamps": [1700000000.1234565], "LogResources": ["file:///a.log"], "RawLogData": ["1.2.3.4 - GET"]},
    "AnalysisComponent": {"AnalysisComponentName": "New event type", "AnalysisComponentType": "T", "Message": "m"},
}


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_lines_are_numbered_and_normalized(spark, tmp_path):
    path = write(tmp_path / "w.json", [WAZUH, "", EVE, AMINER])
    rows = {r.source_line: r for r in normalize(read_json_lines(spark, path)).collect()}
    assert sorted(rows) == [1, 3, 4]
    w, e, a = rows[1], rows[3], rows[4]
    assert (w.alert_source, w.alert_semantics, w.source_entity, w.target_entity, w.service) == ("wazuh", "sshd: invalid user", "1.2.3.4", "10.0.0.9", "tcp/22")
    assert w.ts == datetime(2024, 1, 2, 1, 4, 5) and w.label == "benign"
    attributes = json.loads(w.attributes)
    assert attributes["payload_fields"] == {"full_log": WAZUH["full_log"]} and "label" not in attributes
    assert attributes["rule_groups"] == ["a", "b"] and attributes["severity"] == 5
    assert (e.alert_source, e.alert_semantics, e.service, e.target_entity) == ("suricata", "ET SCAN", "http/80", "2.2.2.2")
    assert json.loads(e.attributes)["payload_fields"] == {"http": {"url": "/a"}}
    assert (a.alert_source, a.target_entity, a.service, a.source_entity) == ("aminer", "10.0.0.7", "file:///a.log", None)
    assert w.alert_id.startswith("ait-wazuh-") and len(w.alert_id) == 34 and w.raw_reference == "w.json:1"


@pytest.mark.parametrize("bad", ["{broken", "[1]", '"text"', "7"])
def test_a_bad_line_ends_the_job(spark, tmp_path, bad):
    with pytest.raises(PySparkException):
        read_json_lines(spark, write(tmp_path / "b.json", [WAZUH, bad])).select("raw").collect()


def test_labels_in_the_input_are_rejected(spark, tmp_path):
    with pytest.raises(PySparkException):
        reject_labels(read_json_lines(spark, write(tmp_path / "l.json", [WAZUH]))).collect()


def test_a_time_without_zone_ends_the_job(spark, tmp_path):
    with pytest.raises(PySparkException):
        normalize(read_json_lines(spark, write(tmp_path / "t.json", [WAZUH | {"@timestamp": "2024-01-02T03:04:05"}]))).collect()


VENDOR = {"log_type": "webids-ids_dolog", "@timestamp": "2024-01-02 08:00:00", "uuid": "u", "is_attack": 1, "rule_name": "SSH 暴力破解", "sip": "1.1.1.1", "dip": "2.2.2.2", "dport": 22, "proto": "tcp", "packet_size": 0, "attack_type": ""}


def test_vendor_export(spark, tmp_path):
    items = [VENDOR, VENDOR | {"log_type": "other"}, VENDOR | {"log_type": "webids-webattack_dolog", "uri": "/x" * 4000, "is_attack": "0", "@timestamp": "2024-01-02T08:00:00Z"}]
    (tmp_path / "v.json").write_text(json.dumps(items), encoding="utf-8")
    rows = normalize_vendor(extract_vendor_rows(read_json_array(spark, str(tmp_path / "v.json")))).orderBy("source_line").collect()
    assert [r.is_attack for r in rows] == [True, False]
    assert rows[0].ts == datetime(2024, 1, 2, 0, 0) and rows[1].ts == datetime(2024, 1, 2, 8, 0)
    first, second = (json.loads(r.attributes) for r in rows)
    assert first["behavior_hint"] == "brute force password guessing" and first["payload_fields"] == {"packet_size": 0}
    assert len(second["payload_fields"]["uri"]) == 4096 and rows[0].service == "tcp/22"
    assert rows[0].alert_id.startswith("vendor-network_ids-")


def test_label_archive_aligns_with_alerts(spark, tmp_path):
    columns = ("time", "name", "ip", "host", "short", "time_label", "event_label")
    line = "1,Wazuh: sshd: invalid user,10.0.0.9,h,s,{},{}"
    text = "\n".join([",".join(columns), line.format("a", "-"), line.format("false_positive", "-"), line.format("a", "ssh")])
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("x.csv", text + "\n")
    official = read_label_archives(spark, str(tmp_path / "l.zip"), columns).withColumnRenamed("row", "position")
    records = read_json_lines(spark, write(tmp_path / "w.json", [WAZUH] * 3))
    _, name, ip = expected_name(records.raw, "wazuh")
    alerts = records.select(records.source_line.alias("position"), name.alias("name"), ip.alias("ip"))
    got = label(align(alerts, official, {"name": "name", "ip": "ip"})).orderBy("position").collect()
    assert [r.label for r in got] == ["false_positive", "benign", "ssh"]
    with pytest.raises(PySparkException):
        align(alerts.filter("position < 3"), official, {"name": "name"}).collect()
    with pytest.raises(PySparkException):
        align(alerts.replace("10.0.0.9", "10.0.0.8", "ip"), official, {"ip": "ip"}).collect()
    with pytest.raises(PySparkException):
        read_label_archives(spark, str(tmp_path / "l.zip"), columns[:6]).collect()


def test_written_lines_have_sorted_keys(spark, tmp_path):
    rows = spark.createDataFrame([(2, None, "ü")], "b int, c string, a string")
    write_json_lines(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":"ü","b":2,"c":null}'
    with pytest.raises(PySparkException):
        write_json_lines(rows, str(tmp_path / "out"))


def test_once_keeps_its_readers_from_copying(spark):
    """The optimizer must not see through it, or every reader computes the text again."""
    rows = once(spark.range(3).withColumn("x", F.concat(F.lit("a"), F.col("id").cast("string"))), "x")
    plan = rows.filter(F.length("x") > 1).select(F.concat("x", "x", "x").alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(a") == 1
