"""The labeling job: official labels, by position, onto the alerts of each scenario."""

from __future__ import annotations

import argparse
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators.labeling import align, expected_name, gapless, label
from alertloom.session import build_session
from alertloom.sources.jsonl import read_json_lines, read_label_archives, reject_labels

#: The header of the official label files.
COLUMNS = ("time", "name", "ip", "host", "short", "time_label", "event_label")


def _part(spark: SparkSession, path: str, kind: str, offset: int) -> tuple[DataFrame, int]:
    """Alerts of one file with their positions, which count lines that aren't blank and go on from offset."""
    rows = reject_labels(read_json_lines(spark, path))
    detector, name, ip = expected_name(F.col("raw"), kind)
    ordered = rows.select("source_file", "source_line", "raw", detector.alias("detector"), name.alias("name"), ip.alias("ip"))
    numbered = gapless(ordered, "source_line").withColumn("position", F.col("position") + offset)
    return numbered, rows.count()


def label_scenario(spark: SparkSession, scenario: str, wazuh: str, aminer: str, archive: str) -> DataFrame:
    """scenario, source_file, source_line, detector, raw, label. The label file's rows follow the first file, then the second."""
    first, n = _part(spark, wazuh, "wazuh", 0)
    second, _ = _part(spark, aminer, "aminer", n)
    official = read_label_archives(spark, archive, COLUMNS).filter(F.col("member").rlike(rf"(?:^|/){re.escape(scenario)}(?=[_.])")).withColumnRenamed("row", "position")
    aligned = align(first.unionByName(second), official, {"name": "name", "ip": "ip"})
    return label(aligned).select(F.lit(scenario).alias("scenario"), "source_file", "source_line", "detector", "raw", "label")


def write_labelled(labelled: DataFrame, path: str) -> dict:
    """Writes each object with its label as a JSON line, and _labeling_summary (which readers of the lines pass over): records and labels of each file and scenario, and of all."""
    text = F.regexp_replace(F.to_json("raw"), r"\}$", "")
    body = F.concat(text, F.when(text == "{", "").otherwise(","), F.lit('"label":'), F.to_json(F.struct("label")).substr(F.lit(10), F.length("label") + 2), F.lit("}"))
    labelled.select("scenario", "source_file", body.alias("value")).write.partitionBy("scenario", "source_file").text(path)
    told: dict = {"records": 0, "labels": {}, "scenarios": {}}
    # one row for each label of a file
    for r in labelled.groupBy("scenario", "source_file", "label").count().orderBy("scenario", "source_file", "label").collect():
        scenario = told["scenarios"].setdefault(r["scenario"], {"records": 0, "labels": {}, "files": {}})
        for at in (told, scenario, scenario["files"].setdefault(r["source_file"], {"records": 0, "labels": {}})):
            at["records"] += r["count"]
            at["labels"][r["label"]] = at["labels"].get(r["label"], 0) + r["count"]
    spark = labelled.sparkSession
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_labeling_summary")
    return told


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="alertloom-labels")
    for name in ("scenario", "wazuh", "aminer", "archive", "output"):
        parser.add_argument(f"--{name}", required=True)
    told = parser.parse_args(args)
    labelled = label_scenario(build_session(), told.scenario, told.wazuh, told.aminer, told.archive)
    print(json.dumps(write_labelled(labelled, told.output), indent=2, sort_keys=True))


if __name__ == "__main__":
    main()
