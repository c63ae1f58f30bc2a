"""Memories that are merged equal one that is learnt at once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alertloom.operators import memory
from alertloom.sources import versions

SCHEMA = "object_type string, object_id string, start_ts timestamp, alert_source string, alert_semantics string, sources array<string>, targets array<string>, services array<string>, attributes string"


def objects(spark, seed, n, start):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["login", "job", "odd"])
        command = {"login": f"login of {rng.randrange(10**6, 10**7)}", "job": f"job {rng.choice(['fast', 'slow'])}", "odd": rng.choice(["x", "y 1234567", "z"])}[kind]
        rows.append(("alert", f"o{start + i:05}", datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(9999)), "s", kind,
                     [f"10.0.{rng.randrange(2)}.{rng.randrange(200)}"], ["t"], rng.choice([[], ["tcp/1"]]), f'{{"payload_fields":{{"command":"{command}"}}}}'))
    return spark.createDataFrame(rows, SCHEMA)


def told(known):
    flat = memory.fingerprints(known, lives=timedelta(days=1))
    return sorted(map(str, flat.select(*sorted(flat.columns)).collect()))


def test_merged_memories_equal_one_learnt_at_once(spark):
    parts = [objects(spark, k, n, 1000 * k) for k, n in enumerate((60, 40, 1, 90))]
    whole = parts[0]
    known = memory.remember(parts[0], provenance_limit=3)
    for part in parts[1:]:
        whole = whole.unionByName(part)
        known = memory.merge(known, memory.remember(part, provenance_limit=3))
        assert told(known) == told(memory.remember(whole, provenance_limit=3))
    memory.validate_memory(memory.fingerprints(known))
    assert known.general.count() > 3


def test_flags_stay_and_limits_must_agree(spark):
    first, second = objects(spark, 1, 40, 0), objects(spark, 1, 40, 500)
    known = memory.remember(first)
    off = memory.Memory(known.exact.withColumn("active", F.lit(False)), known.groups, known.general.withColumn("verified", F.lit(False)), known.provenance_limit)
    merged = memory.merge(off, memory.remember(second))
    assert merged.exact.filter("active").count() == 0
    kept = merged.general.join(known.general.select("generalization_key"), "generalization_key", "left_semi")
    assert kept.count() == known.general.count() and kept.filter("verified").count() == 0
    with pytest.raises(ValueError):
        memory.merge(known, memory.remember(second, provenance_limit=2))


def test_an_empty_batch_changes_nothing(spark):
    known = memory.remember(objects(spark, 2, 30, 0))
    assert told(memory.merge(known, memory.remember(objects(spark, 2, 1, 0).limit(0)))) == told(known)


def test_a_state_is_replaced_by_its_own_merge(spark, tmp_path):
    where, parts = str(tmp_path / "m"), [objects(spark, k, 30, 1000 * k) for k in range(4)]
    memory.save_state(memory.remember(parts[0]), where, settings={"v4": 24})
    with pytest.raises(ValueError):
        memory.save_state(memory.remember(parts[1]), where)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
        memory.save_state(memory.merge(memory.load_state(spark, where, {"v4": 24}), memory.remember(part)), where, True, {"v4": 24})
    assert told(memory.load_state(spark, where, {"v4": 24})) == told(memory.remember(whole))
    assert len([f for f in (tmp_path / "m").iterdir() if f.name != "versions"]) == 2  # the current one and the one before
    with pytest.raises(ValueError):
        memory.load_state(spark, where, {"v4": 16})
    with pytest.raises(ValueError):
        memory.load_state(spark, str(tmp_path / "none"))


def test_a_failed_writer_leaves_the_store(spark, tmp_path):
    where = str(tmp_path / "s")
    versions.publish({"a": spark.range(3), "b": spark.range(2)}, where)
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(PySparkException):
        versions.publish({"a": spark.range(9), "b": bad}, where, replace=True)

    def check(tables):
        raise ValueError("not valid")

    with pytest.raises(ValueError, match="not valid"):
        versions.publish({"a": spark.range(9)}, where, replace=True, check=check)
    assert [versions.read_table(spark, where, t).count() for t in "ab"] == [3, 2]
    assert len(list((tmp_path / "s").iterdir())) == 2


def test_equal_paths_are_looked_up_and_shuffled_once(spark, monkeypatch):
    """Fails if every object walks the tree, or if ids are ranked in rows that carry their paths."""
    rows = spark.range(60).select(
        F.lit("alert").alias("object_type"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("object_id"), F.timestamp_seconds("id").alias("start_ts"), F.lit("s").alias("alert_source"),
        F.lit("login").alias("alert_semantics"), F.array(F.concat(F.lit("10.0.0."), (F.col("id") % 3).cast("string"))).alias("sources"), F.array(F.lit("t")).alias("targets"),
        F.array().cast("array<string>").alias("services"), F.lit("{}").alias("attributes"),
    )
    plans, walked = {}, []
    write, match = memory.materialize, memory.match_tree
    monkeypatch.setattr(memory, "materialize", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and write(df, name))
    monkeypatch.setattr(memory, "match_tree", lambda paths, *rest: walked.append(paths.count()) or match(paths, *rest))
    known = write(memory.learn(rows, provenance_limit=2), "known")
    assert {tuple(r.provenance) for r in known.filter("kind = 'exact'").collect()} == {("o54", "o57"), ("o55", "o58"), ("o56", "o59")}
    windows = [line for line in plans["exact-paths"].splitlines() if "Window [" in line]
    assert windows and "keyed-paths" in plans
    decided = memory.decide(rows, known).collect()
    assert len(decided) == 60 and {(r.decision, r.support) for r in decided} == {("filter", 20)}
    assert walked == [3]
