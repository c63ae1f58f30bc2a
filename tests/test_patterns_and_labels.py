"""Pattern generation, the stored knowledge base and the labeling job."""

import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alertloom.operators import knowledge, patterns
from alertloom.plans.labels import COLUMNS, label_scenario, write_labelled
from alertloom.sources.versions import current


def clusters(spark):
    rows = spark.createDataFrame(
        [("a1", 1, "k", "get /x"), ("a2", 2, "k", "get /x"), ("a3", 3, "k", "get /y z"), ("a4", 4, "m", "other")],
        "alert_id string, ts int, k string, template string",
    )
    found = knowledge.leader_clusters(rows, ["k"], ["ts"], "alert_id", "template", 0.1)
    return patterns.cluster_summaries(found, "s", ["k"])


def test_patterns_are_generated_cached_and_stored(spark, tmp_path):
    found = clusters(spark)
    got = {r.k: r for r in found.collect()}
    assert (got["k"].support, got["k"].representative, got["k"].templates) == (3, "a1", ["get /x", "get /y z"])
    assert got["k"].cluster_id.startswith("fp-cluster-") and len(got["k"].cluster_id) == 35

    def provider(prompt):
        data = json.loads(prompt)
        return f"pattern of {data['k']}" if data["k"] == "k" else " "

    made = patterns.generate_patterns(found, provider, retries=0)
    assert {(r.pattern_text, r.error_code) for r in made.collect()} == {("pattern of k", None), (None, "empty_pattern")}
    patterns.append_cache(made, str(tmp_path / "cache"))
    left = patterns.not_cached(found, spark.read.parquet(str(tmp_path / "cache")))
    assert [r.k for r in left.collect()] == ["m"]
    docs = knowledge.embed(patterns.cluster_documents(found, made), "index_text", knowledge.hashing_provider(8))
    patterns.save_knowledge(docs, str(tmp_path / "kb"))
    assert patterns.load_knowledge(spark, str(tmp_path / "kb"), 8).collect()[0].pattern_text == "pattern of k"
    with pytest.raises(PySparkException):
        patterns.load_knowledge(spark, str(tmp_path / "kb"), 9).collect()
    with pytest.raises(PySparkException):
        patterns.save_knowledge(docs, str(tmp_path / "kb"))
    with pytest.raises(ValueError, match="other settings"):
        patterns.load_knowledge(spark, str(tmp_path / "kb"), 8, {"dims": 8})
    docs.limit(1).write.mode("append").parquet(current(spark, str(tmp_path / "kb")) + "/documents")
    with pytest.raises(ValueError, match="differ from their signature"):
        patterns.load_knowledge(spark, str(tmp_path / "kb"), 8)
    assert patterns.same_ids(found, found, "cluster_id") and not patterns.same_ids(found, left, "cluster_id")


def test_summaries_and_prompts_are_bounded(spark):
    rows = spark.createDataFrame([(f"a{i:04}", i, "k", f"t{i % 20} " + "x" * 30) for i in range(700)], "alert_id string, ts int, k string, template string")
    found = patterns.cluster_summaries(rows.withColumn("leader", F.lit("a0000")), "s", ["k"], 3, 5).first()
    assert (found.support, found.representative, found.provenance) == (700, "a0000", [f"a{i:04}" for i in range(5)])
    assert found.templates == sorted(f"t{i} " + "x" * 30 for i in range(20))[:3]
    same = patterns.cluster_summaries(rows.withColumn("leader", F.lit("a0000")).repartition(5), "s", ["k"]).first()
    fewer = patterns.cluster_summaries(rows.withColumn("leader", F.lit("a0000")).limit(699), "s", ["k"]).first()
    assert same.cluster_id == found.cluster_id != fewer.cluster_id

    def provider(prompt):
        assert len(prompt) <= 150
        return str(len(json.loads(prompt)["templates"][0]))

    long = spark.createDataFrame([("c", ["y" * 900, "z"])], "cluster_id string, templates array<string>")
    told = patterns.generate_patterns(long, provider, retries=0, prompt_chars=150).first()
    assert 0 < int(told.pattern_text) <= 150
    most = knowledge.template_frequency(rows, "k", "template", 2).first()
    assert most.templates == sorted(f"t{i} " + "x" * 30 for i in range(20))[:2]


def test_a_failing_pattern_provider_is_told(spark):
    def provider(prompt):
        raise OSError("down")

    got = patterns.generate_patterns(clusters(spark), provider, retries=1, backoff=0).collect()
    assert {(r.pattern_text, r.error_code) for r in got} == {(None, "provider_failed")}


def test_labeling_job(spark, tmp_path):
    wazuh = [{"rule": {"description": d}, "agent": {"ip": "1.1.1.1"}, "location": "x"} for d in ("a", "Suricata: b")]
    aminer = [{"AMiner": {"ID": "2.2.2.2"}, "LogData": {}, "AnalysisComponent": {"AnalysisComponentName": "n"}}]
    (tmp_path / "w.json").write_text(json.dumps(wazuh[0]) + "\n\n" + json.dumps(wazuh[1]) + "\n")
    (tmp_path / "m.json").write_text(json.dumps(aminer[0]) + "\n")
    rows = [("1", "Wazuh: a", "1.1.1.1", "h", "s", "false_positive", "-"), ("2", "Suricata: b", "1.1.1.1", "h", "s", "win", "scan"), ("3", "n", "2.2.2.2", "h", "s", "win", "-")]
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("s10_labels.csv", "\n".join(",".join(r) for r in [COLUMNS, *rows[:1]]) + "\n")
        z.writestr("s1_labels.csv", "\n".join(",".join(r) for r in [COLUMNS, *rows]) + "\n")
    paths = [str(tmp_path / n) for n in ("w.json", "m.json", "l.zip")]
    labelled = label_scenario(spark, "s1", *paths)
    assert [(r.source_line, r.label) for r in labelled.orderBy("source_file", "source_line").collect()] == [(1, "false_positive"), (1, "benign"), (3, "scan")]
    told = write_labelled(labelled, str(tmp_path / "out"))
    every = {"records": 3, "labels": {"benign": 1, "false_positive": 1, "scan": 1}}
    files = {"m.json": {"records": 1, "labels": {"false_positive": 1}}, "w.json": {"records": 2, "labels": {"benign": 1, "scan": 1}}}
    assert told == every | {"scenarios": {"s1": every | {"files": files}}}
    assert json.loads(spark.read.text(str(tmp_path / "out" / "_labeling_summary" / "part-*")).first().value) == told
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).select(F.col("value")).collect()]
    assert sorted(x["label"] for x in lines) == ["benign", "false_positive", "scan"] and all(len(x) == 4 for x in lines)
