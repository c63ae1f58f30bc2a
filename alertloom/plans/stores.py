"""Queries that write with the library and read back what they wrote, and that call models and providers.

Stores go to a folder of their own under the shared one, which `session.drop_tables` removes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators import adjudicate, context, knowledge, labeling, memory, patterns, scoring
from alertloom.plans.catalog import ALERTS, GAP, _PAIRS, alerts, objects, query
from alertloom.plans.detectors import _DIGEST, _EVENTS, _FLOWS, _events, _flows, _json, _lines
from alertloom.session import new_folder
from alertloom.sources import jsonl


@query("SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us FROM events")
def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and read again as numbered records."""
    where = new_folder(spark, "lines")
    jsonl.write_json_lines(_events(spark, sf_dir).select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("ts_us")), where)
    raw = lambda field, kind: F.try_variant_get("raw", f"$.{field}", kind).alias(field)
    return jsonl.read_json_lines(spark, where).select(raw("event_id", "long"), raw("user_id", "long"), raw("event_type", "string"), raw("ts_us", "long"))


@query("SELECT count(*) AS n, count(*) AS numbered, 1::BIGINT AS first_line FROM events")
def physical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every file has a number of its own, from one without a gap."""
    where = new_folder(spark, "numbered")
    jsonl.write_json_lines(_events(spark, sf_dir).select("event_id"), where)
    files = jsonl.numbered_lines(spark, where).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source_line").alias("distinct"), F.max("source_line").alias("last"), F.min("source_line").alias("first")
    )
    whole = F.when((F.col("distinct") == F.col("n")) & (F.col("last") == F.col("n")), F.col("n")).otherwise(0)
    return files.agg(F.sum("n").alias("n"), F.sum(whole).alias("numbered"), F.min("first").alias("first_line"))


@query(f"WITH {_FLOWS}, p AS (SELECT l1, l2, l3, l4, l5, l6, count(*) AS support, max(object_id) AS last_id FROM f GROUP BY ALL) SELECT {_DIGEST} AS digest, support, support > 2 AS truncated FROM p")
def stored_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact fingerprints from a store that was checked when it was written and when it was loaded."""
    where, settings = new_folder(spark, "memory"), {"v4": 24, "v6": 64}
    memory.save_memory(memory.learn(_flows(spark, sf_dir), provenance_limit=2), where, settings=settings)
    found = memory.load_memory(spark, where, settings).filter("kind = 'exact'")
    return found.select("digest", "support", F.col("provenance_truncated").alias("truncated"))


@query(f"""WITH {_FLOWS}, p AS (SELECT l1, l2, l3, l4, l5, l6, list(object_id ORDER BY ts, object_id) AS ids FROM f GROUP BY ALL)
SELECT {_DIGEST} AS digest, array_to_string(ids[-2:], ',') AS provenance FROM p""")
def last_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each path that came last."""
    found = memory.learn(_flows(spark, sf_dir), provenance_limit=2).filter("kind = 'exact'")
    return found.select("digest", F.array_join("provenance", ",").alias("provenance"))


@query(f"WITH {_FLOWS}, n AS (SELECT object_id, l3 AS entity FROM f UNION SELECT object_id, unnest(CASE WHEN l4 = '<MULTIPLE>' THEN ['a', 'b'] ELSE [l4] END) FROM f) SELECT object_id, count(*) AS entities FROM n GROUP BY 1")
def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every node in a graph store that was checked on both ways."""
    where = new_folder(spark, "graph")
    rows = _flows(spark, sf_dir).withColumn("member_ids", F.array("object_id"))
    scored = scoring.score(scoring.with_pattern(rows))
    scoring.save_graph(scoring.graph_tables(rows, rows.select(F.col("object_id").alias("alert_id")), scored), where)
    tables = scoring.load_graph(spark, where)
    links = tables["graph_alert_entity_edges"].select("object_id", "entity").distinct()
    return tables["graph_alert_nodes"].join(links, "object_id").groupBy("object_id").agg(F.count(F.lit(1)).alias("entities"))


@query(f"WITH {ALERTS} SELECT alert_semantics, service, count(*) AS support, CASE WHEN alert_semantics IN ('error', 'click') THEN 'access' ELSE alert_semantics END AS bucket FROM a GROUP BY ALL")
def stored_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with vectors and retrieval buckets, stored and loaded with their signatures."""
    where, settings = new_folder(spark, "knowledge"), {"dims": 16}
    rows = alerts(spark, sf_dir).withColumn("template", F.lit("fixed"))
    documents = knowledge.with_alias_group(knowledge.knowledge_documents(rows), {"access": ["Error", "click"]})
    documents = knowledge.embed(documents, "index_text", knowledge.hashing_provider(16))
    patterns.save_knowledge(documents, where, settings)
    return patterns.load_knowledge(spark, where, 16, settings).select("alert_semantics", "service", "support", "bucket")


def _describe(prompt: str) -> str:
    number = int(json.loads(prompt)["k"])
    if number % 3 == 1:
        raise OSError("down")
    return " " if number % 3 == 2 else f"pattern {number}"


@query(f"WITH {_EVENTS}, c AS (SELECT DISTINCT k FROM e WHERE k IS NOT NULL) SELECT 'c' || k AS cluster_id, CASE WHEN k % 3 = 0 THEN 'pattern ' || k END AS pattern_text, CASE k % 3 WHEN 1 THEN 'provider_failed' WHEN 2 THEN 'empty_pattern' END AS error_code, k % 3 <> 0 AS asked_again FROM c")
def pattern_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of a model that fails at times; those without error are cached and not asked for again."""
    where = new_folder(spark, "cache")
    number = F.col("k").cast("string")
    clusters = _events(spark, sf_dir).filter("k IS NOT NULL").select(F.concat(F.lit("c"), number).alias("cluster_id"), "k", F.array(number).alias("templates")).distinct()
    made = patterns.generate_patterns(clusters, _describe, retries=1, backoff=0.0)
    patterns.append_cache(made, where)
    left = patterns.not_cached(clusters, spark.read.parquet(where)).select("cluster_id", F.lit(True).alias("again"))
    return made.join(left, "cluster_id", "left").select("cluster_id", "pattern_text", "error_code", F.coalesce("again", F.lit(False)).alias("asked_again"))


#: A model's answers and what must be read from them: label, code, confidence.
ANSWERS = (
    ('{"label":"true_attack","supporting":["x"],"confidence":0.5}', "true_attack", None, 0.5),
    ('```json\n{"label":"false_positive","contradicting":["y"]}\n```', "false_positive", None, None),
    ("no json", "needs_review", "invalid_json", None),
    ('{"label":"maybe"}', "needs_review", "invalid_label", None),
    ('{"label":"true_attack","confidence":2}', "needs_review", "invalid_confidence", None),
    ('{"label":"true_attack","supporting":[1]}', "needs_review", "invalid_ids", None),
    ('{"label":"true_attack","supporting":["z"]}', "needs_review", "unknown_ids", None),
    ('{"label":"true_attack","supporting":["x"],"contradicting":["x"]}', "needs_review", "overlapping_ids", None),
    ('{"label":"needs_review","confidence":1}', "needs_review", None, 1.0),
    ("fails", "needs_review", "provider_failed", None),
)


def _answer(prompt: str) -> str:
    answer = ANSWERS[int(prompt)][0]
    if answer == "fails":
        raise OSError("down")
    return answer


def _answered(at: int) -> str:
    texts = ["NULL" if a[at] is None else repr(a[at]) for a in ANSWERS]
    return f"CASE event_id % {len(ANSWERS)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


@query(f"SELECT event_id::VARCHAR AS object_id, {_answered(1)} AS label, {_answered(2)} AS error_code, {_answered(3)}::DOUBLE AS confidence FROM events")
def model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model, read strictly."""
    asked = _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("object_id"),
        (F.col("event_id") % len(ANSWERS)).cast("string").alias("prompt"),
        F.array(F.lit("x"), F.lit("y")).alias("allowed"),
    )
    return adjudicate.adjudicate(asked, _answer, retries=1, backoff=0.0).select("object_id", "label", "error_code", "confidence")


_FORWARD = _PAIRS.format(forward="true", cond="n.ts > c.ts AND n.ts <= c.ts + INTERVAL 6 HOUR")


@query(f"SELECT object_id, cand_id, 'ev-' || substr(sha256(object_id || ':forward:' || cand_id), 1, 20) AS evidence_id, relationship FROM ({_FORWARD})")
def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of evidence with ids of their own."""
    rows = objects(spark, sf_dir)
    listed = context.evidence_items(context.context(rows, rows, "forward", GAP, 5, 1, tell=("c0", "c1", "alert_semantics"), shared=False), rows)
    return listed.select("object_id", F.inline("evidence")).select("object_id", "cand_id", "evidence_id", "relationship")


@query(f"""WITH {_EVENTS} SELECT event_id, CASE WHEN event_type = 'view' THEN 'suricata' ELSE 'wazuh' END AS detector,
CASE WHEN k % 3 = 0 THEN 'benign' WHEN k % 3 = 1 THEN event_type ELSE 'false_positive' END AS label FROM e""")
def aligned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official labels joined by position to detector records that must carry their name and address."""
    rows = _events(spark, sf_dir)
    view = F.col("event_type") == "view"
    record = _json(
        event_id=F.col("event_id"),
        rule=F.struct(F.when(view, F.concat(F.lit("Suricata: "), F.col("event_type"))).otherwise(F.col("event_type")).alias("description")),
        agent=F.struct(F.concat(F.lit("10.0.0."), (F.col("k") % 50).cast("string")).alias("ip")),
        location=F.when(view, "/var/log/suricata/eve.json").otherwise("/var/log/syslog"),
    )
    detector, name, ip = labeling.expected_name(F.col("raw"), "wazuh")
    records = jsonl.parse_objects(_lines(rows, record)).select("source_line", "raw", detector.alias("detector"), name.alias("name"), ip.alias("ip"))
    official = rows.select(
        (F.col("event_id") + 1).alias("row"),
        F.concat(F.when(view, "Suricata: ").otherwise("Wazuh: "), "event_type").alias("name"),
        F.concat(F.lit("10.0.0."), (F.col("k") % 50).cast("string")).alias("ip"),
        F.when(F.col("k") % 3 == 0, "false_positive").otherwise("attack").alias("time_label"),
        F.when(F.col("k") % 3 == 1, F.col("event_type")).otherwise("-").alias("event_label"),
    )
    numbered = labeling.gapless(official, "row").drop("row")
    aligned = labeling.align(labeling.gapless(records, "source_line"), numbered, {"name": "name", "ip": "ip"})
    return labeling.label(aligned).select(F.try_variant_get("raw", "$.event_id", "long").alias("event_id"), "detector", "label")


@query("SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us FROM events")
def array_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON arrays, some hundred to a file, and read again item by item."""
    where = new_folder(spark, "arrays")
    rows = _events(spark, sf_dir).select((F.col("event_id") % 64).alias("part"), F.struct("event_id", "user_id", "event_type", F.unix_micros("ts").alias("ts_us")).alias("item"))
    # a folder for each array, so that a file holds one
    rows.groupBy("part").agg(F.to_json(F.collect_list("item")).alias("value")).write.partitionBy("part").text(where)
    raw = lambda field, kind: F.try_variant_get("raw", f"$.{field}", kind).alias(field)
    return jsonl.read_json_array(spark, f"{where}/*").select(raw("event_id", "long"), raw("user_id", "long"), raw("event_type", "string"), raw("ts_us", "long"))


@query("WITH u AS (SELECT user_id, list('ev-' || lpad(event_id::VARCHAR, 12, '0') ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id) "
       "SELECT 'user-' || user_id AS object_id, array_to_string(ids[1:20], ',') AS members, least(len(ids), 20)::INTEGER AS n, 'click' AS semantics FROM u")
def prompt_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is told of an alert of many members: the first twenty."""
    member = F.struct("ts", "event_id", F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"))
    rows = _events(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(member)), lambda m: m["id"]).alias("member_ids"))
    candidates = rows.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("object_id"), "member_ids", F.lit("events").alias("alert_source"), F.lit("click").alias("alert_semantics"),
        *[F.array(F.lit(c)).alias(c) for c in ("sources", "targets", "services")], F.lit(1.0).alias("total"),
    )
    evidence = spark.createDataFrame([], "object_id string, evidence array<struct<evidence_id:string>>")
    known = spark.createDataFrame([], "query_id string, rank int, entry_id string, similarity double")
    told = adjudicate.prompts(candidates, evidence, known)
    members = F.from_json(F.get_json_object("prompt", "$.alert.members"), "array<string>")
    return told.select("object_id", F.array_join(members, ",").alias("members"), F.size(members).alias("n"), F.get_json_object("prompt", "$.alert.alert_semantics").alias("semantics"))
