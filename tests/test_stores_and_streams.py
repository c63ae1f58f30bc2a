"""Stores with their checks, arrays read by splits, providers that fail, and streams that close days."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alertloom.operators import knowledge, memory, scoring, sessions
from alertloom.sources.jsonl import read_json_array
from alertloom.streaming.windows import first_member_windows, score_closed_days

T0 = datetime(2024, 1, 1)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_json_array_is_read_by_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    odd = ["}", "{", '"', "\\", "\\\"}", "a\nb", "é", "[{", "},{", ""]
    items = [{"i": i, "t": "".join(rng.choice(odd) for _ in range(rng.randint(0, 9))), "d": {"e": [{"f": {}}, "}"]}} for i in range(120)]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=1, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(items[:3]))
    (tmp_path / "c.json").write_text(" [ ]\n")
    got = read_json_array(spark, [str(tmp_path / f"{n}.json") for n in "abc"]).select("source_file", "source_line", F.to_json("raw").alias("j")).collect()
    found = {}
    for r in sorted(got):
        found.setdefault(r.source_file, []).append((r.source_line, json.loads(r.j)))
    assert found == {"a.json": list(enumerate(items, 1)), "b.json": list(enumerate(items[:3], 1))}


@pytest.mark.parametrize("text", ['[{"a":1} {"a":2}]', '[{"a":1},2]', '{"a":1}', '[{"a":1}', '[{"a":}]', "[1]"])
def test_json_array_that_is_malformed(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(PySparkException, match="not an object|malformed array"):
        read_json_array(spark, str(tmp_path / "x.json")).select(F.to_json("raw")).collect()


def objects(spark, rows):
    made = [("alert", i, T0 + timedelta(seconds=s), T0 + timedelta(seconds=s), "d", "sem", ["s"], [t], ["tcp/1"], [i], "{}") for i, s, t in rows]
    return spark.createDataFrame(
        made,
        "object_type string, object_id string, start_ts timestamp, end_ts timestamp, alert_source string, alert_semantics string, "
        "sources array<string>, targets array<string>, services array<string>, member_ids array<string>, attributes string",
    )


def test_memory_store_is_checked(spark, tmp_path):
    rows = [(f"a{i}", i, f"10.0.0.{i % 3}") for i in range(9)]
    prints = memory.learn(objects(spark, rows), lives=timedelta(days=1), provenance_limit=2)
    kept = {(r.kind, tuple(r.provenance or ())) for r in prints.collect()}
    assert ("exact", ("a5", "a8")) in kept
    ends = {r.kind: r.expires_at for r in prints.filter("path.target_entity IN ('10.0.0.2', '10.0.0.0/24')").collect()}
    assert ends == {k: T0 + timedelta(days=1, seconds=8) for k in ("exact", "generalized")}
    memory.save_memory(prints, str(tmp_path / "m"), settings={"v4": 24})
    assert memory.load_memory(spark, str(tmp_path / "m"), {"v4": 24}).count() == 4
    with pytest.raises(ValueError, match="other settings"):
        memory.load_memory(spark, str(tmp_path / "m"), {"v4": 16})
    for change, message in (
        (prints.withColumn("digest", F.lit("x")), "digest"),
        (prints.unionByName(prints.limit(1)), "repeated"),
        (prints.withColumn("support", F.lit(0).cast("long")), "positive"),
        (prints.filter("kind = 'generalized' OR path.target_entity <> '10.0.0.1'"), "differs"),
    ):
        with pytest.raises(ValueError, match=message):
            memory.validate_memory(change)


def test_graph_store_is_checked(spark, tmp_path):
    rows = objects(spark, [("a", 0, "t"), ("b", 1, "u")])
    tables = scoring.graph_tables(rows, rows.select(F.col("object_id").alias("alert_id")), scoring.score(scoring.with_pattern(rows)))
    scoring.save_graph(tables, str(tmp_path / "g"))
    assert set(scoring.load_graph(spark, str(tmp_path / "g"))) == set(tables)
    for name, change in (
        ("graph_entity_nodes", tables["graph_entity_nodes"].limit(1)),
        ("graph_scores", tables["graph_scores"].unionByName(tables["graph_scores"])),
        ("graph_original_alerts", tables["graph_original_alerts"].limit(1)),
        ("graph_metadata", tables["graph_metadata"].withColumn("n_objects", F.lit(5))),
        ("graph_alert_nodes", tables["graph_alert_nodes"].withColumn("end_ts", F.lit(T0 - timedelta(days=1)))),
    ):
        with pytest.raises(ValueError):
            scoring.validate_graph(tables | {name: change})


def test_graph_ids_of_one_kind_are_counted_together(spark, monkeypatch):
    """Each table's ids are compared in one pass, and every rule still tells what breaks it."""
    rows = objects(spark, [("a", 0, "t"), ("b", 1, "u")])
    tables = {n: t.localCheckpoint() for n, t in scoring.graph_tables(rows, rows.select(F.col("object_id").alias("alert_id")), scoring.score(scoring.with_pattern(rows))).items()}
    for table, column, change, message in (
        ("graph_alert_nodes", "object_id", "again", "graph_alert_nodes: repeated or missing object_id a"),
        ("graph_entity_nodes", "entity", "again", "graph_entity_nodes: repeated or missing entity"),
        ("graph_alert_nodes", "object_id", "null", "graph_alert_nodes: repeated or missing object_id None"),
        ("graph_entity_nodes", "entity", "gone", "graph_alert_entity_edges: entity .* is not in graph_entity_nodes"),
        ("graph_member_edges", "object_id", "other", "graph_member_edges: object_id z is not in graph_alert_nodes"),
        ("graph_alert_services", "object_id", "null", "graph_alert_services: object_id None is not in graph_alert_nodes"),
        ("graph_original_alerts", "alert_id", "gone", "graph_member_edges: member_id .* is not in graph_original_alerts"),
        ("graph_member_edges", "member_id", "gone", "graph_original_alerts: alert_id .* is not in graph_member_edges"),
        ("graph_alert_entity_edges", "entity", "again", "repeated edge"),
    ):
        good = tables[table]
        first = good.orderBy(column).limit(1)
        put = {"again": first, "null": first.withColumn(column, F.lit(None).cast("string")), "other": first.withColumn(column, F.lit("z"))}
        bad = good.exceptAll(first) if change == "gone" else good.unionByName(put[change])
        with pytest.raises(ValueError, match=message):
            scoring.validate_graph(tables | {table: bad})
    passes = []
    one = scoring._one_pass
    monkeypatch.setattr(scoring, "_one_pass", lambda t, ids: passes.append(ids) or one(t, ids))
    scoring.validate_graph(tables)
    assert sorted(map(len, passes)) == [2, 2, 5]


def test_embedding_provider_is_asked_again(spark):
    def flaky(texts):
        import os

        mark = f"/tmp/flaky-{os.getpid()}-{len(texts)}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        os.remove(mark)
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]

    rows = spark.createDataFrame([("a",), ("bbb",)], "t string").coalesce(1)
    got = {r.t: r.embedding for r in knowledge.embed(rows, "t", flaky, backoff=0.0).collect()}
    assert got["bbb"][0] > got["a"][0] and abs(sum(x * x for x in got["a"]) - 1) < 1e-9
    with pytest.raises(PySparkException, match="other indices"):
        knowledge.embed(rows, "t", lambda texts: [(7, [1.0]) for _ in texts], retries=0).collect()


def test_a_key_with_most_rows_is_sessionized(spark):
    rng = random.Random(2)
    times = sorted(rng.sample(range(400_000), 1500))
    rows = [(f"h{i}", "hot", T0 + timedelta(seconds=t)) for i, t in enumerate(times)] + [(f"c{i}", f"k{i % 50}", T0 + timedelta(seconds=i * 100)) for i in range(300)]
    df = spark.createDataFrame(rows, "alert_id string, key string, ts timestamp")
    for gap, cap in ((900, 3600), (None, 3600)):
        got = {r.alert_id: r.session_start for r in sessions.session_starts(df, ["key"], "ts", "alert_id", gap, cap, fold_times=20).collect()}
        start = last = None
        expected = {}
        for i, t in enumerate(times):
            if start is None or t - start > cap or (gap is not None and t - last > gap):
                start = t
            last = t
            expected[f"h{i}"] = int((T0 + timedelta(seconds=start) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        assert {k: v for k, v in got.items() if k[0] == "h"} == expected


def test_streamed_windows_and_closed_days(spark, tmp_path):
    for i, s in enumerate((0, 30, 61, 119, 4000)):
        spark.createDataFrame([(f"a{i}", "k", T0 + timedelta(seconds=s))], "alert_id string, key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", "k", T0 + timedelta(days=3))], "alert_id string, key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("alert_id string, key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = first_member_windows(source, "key", 60).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    found = {((r.first_ts - T0).total_seconds(), r.members) for r in spark.table("firsts").collect()}
    assert found == {(0.0, 2), (61.0, 2), (4000.0, 1)}

    first = scoring.with_pattern(objects(spark, [("a", 0, "t"), ("b", 60, "t"), ("c", 86400 + 5, "u")]))
    first.coalesce(1).write.parquet(str(tmp_path / "o"))
    stream = lambda: spark.readStream.schema(first.schema).parquet(str(tmp_path / "o"))
    run = lambda: score_closed_days(stream(), str(tmp_path / "d"), str(tmp_path / "e"), late_seconds=10)
    q = run()
    q.processAllAvailable()
    q.stop()
    scoring.with_pattern(objects(spark, [("d", 86400 + 9, "t"), ("e", 2 * 86400 + 11, "t")])).coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    q = run()
    q.processAllAvailable()
    q.stop()
    scored = {r.object_id: r.total for r in spark.read.parquet(str(tmp_path / "d" / "scores")).collect()}
    batch = {r.object_id: r.total for r in scoring.score(scoring.with_pattern(objects(spark, [("a", 0, "t"), ("b", 60, "t"), ("c", 86405, "u"), ("d", 86409, "t")]))).collect()}
    assert scored == batch
