"""Every operator as a query over the shared test tables, with its SQL oracle where SQL can express it.

The alerts of these queries are the rows of `events`: users are sources, hosts and services come from the props.
Events are sparse, so sessions use a gap of 6 hours and a cap of 24.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import text as T
from alertloom.functions.templates import masked, masked_native, payload_template
from alertloom.operators import asof, classify, context, knowledge, labeling, memory, scoring, sessions
from alertloom.plans import triage
from alertloom.session import materialize

HOUR = 3600
GAP, CAP = 6 * HOUR, 24 * HOUR


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("alert_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("events").alias("alert_source"),
        F.col("event_type").alias("alert_semantics"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_entity"),
        F.concat(F.lit("host-"), (k % 20).cast("string")).alias("target_entity"),
        F.concat(F.lit("tcp/"), (1000 + k % 5).cast("string")).alias("service"),
        F.to_json(F.struct(F.struct(F.col("props").alias("command"), F.col("value").alias("count")).alias("payload_fields"))).alias("attributes"),
    )


ALERTS = """a AS (SELECT 'ev-' || lpad(event_id::VARCHAR, 12, '0') AS alert_id, ts, event_type AS alert_semantics, props, value,
  'user-' || user_id AS source_entity, 'host-' || (regexp_extract(props, '([0-9]+)', 1)::INT % 20) AS target_entity,
  'tcp/' || (1000 + regexp_extract(props, '([0-9]+)', 1)::INT % 5) AS service FROM events)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(spark, sf_dir).select(
        F.lit("alert").alias("object_type"),
        F.col("alert_id").alias("object_id"),
        F.col("ts").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        "alert_source",
        "alert_semantics",
        F.array("source_entity").alias("sources"),
        F.array("target_entity").alias("targets"),
        F.array("service").alias("services"),
        F.array("alert_id").alias("member_ids"),
        "attributes",
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(scoring.with_pattern(objects(spark, sf_dir)))


SCORED = f"""{ALERTS},
w AS (SELECT *, date_trunc('day', ts) AS w, alert_semantics || service || props AS p, source_entity || alert_semantics || service || target_entity || props AS r FROM a),
e AS (SELECT w, alert_id, source_entity AS entity FROM w UNION SELECT w, alert_id, target_entity FROM w),
ec AS (SELECT w, entity, count(*) AS n FROM e GROUP BY ALL),
ef AS (SELECT e.w, e.alert_id, avg(n) AS ef FROM e JOIN ec USING (w, entity) GROUP BY ALL),
f AS (SELECT w.*, ef.ef, count(*) OVER (PARTITION BY w.w, p) AS pf, count(*) OVER (PARTITION BY w.w, r) AS rf FROM w JOIN ef USING (w, alert_id)),
b AS (SELECT *, min(pf) OVER d AS pl, max(pf) OVER d AS ph, min(ef) OVER d AS el, max(ef) OVER d AS eh, min(rf) OVER d AS rl, max(rf) OVER d AS rh FROM f WINDOW d AS (PARTITION BY w)),
s AS (SELECT alert_id AS object_id, w AS window_start,
  CASE WHEN ph = pl THEN 1.0 ELSE 1.0 - (pf - pl)::DOUBLE / (ph - pl) END AS pattern_score,
  CASE WHEN eh = el THEN 1.0 ELSE 1.0 - (ef - el) / (eh - el) END AS entity_score,
  CASE WHEN rh = rl THEN 1.0 ELSE 1.0 - (rf - rl)::DOUBLE / (rh - rl) END AS relation_score FROM b),
t AS (SELECT *, (1.0::DOUBLE / 3) * pattern_score + (1.0::DOUBLE / 3) * entity_score + (1.0::DOUBLE / 3) * relation_score AS total FROM s)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"WITH {SCORED} SELECT object_id, round(pattern_score, 6) AS pattern_score, round(entity_score, 6) AS entity_score, round(relation_score, 6) AS relation_score, round(total, 6) AS total FROM t")
def daily_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "object_id", *[F.round(c, 6).alias(c) for c in ("pattern_score", "entity_score", "relation_score", "total")]
    )


@query(f"WITH {SCORED} SELECT object_id, row_number() OVER (ORDER BY round(total, 9) DESC, object_id) AS rank, round(total, 9) >= 0.7 AS forwarded FROM t")
def ranked_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("total", F.round("total", 9))
    return scoring.ranked(scored, 0.7).select("object_id", "rank", "forwarded")


@query(f"WITH {SCORED}, k AS (SELECT object_id, row_number() OVER (ORDER BY round(total, 9) DESC, object_id) AS rank, round(total, 9) AS total FROM t) SELECT CASE WHEN rank <= 100 THEN 'investigated' ELSE 'deferred' END AS fate, count(*) AS n, max(rank) AS last_rank FROM k WHERE total >= 0.7 GROUP BY 1")
def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = scoring.ranked(_scored(spark, sf_dir).withColumn("total", F.round("total", 9)), 0.7)
    fate = F.when(F.col("rank") <= 100, "investigated").otherwise("deferred").alias("fate")
    return scoring.candidates(ranking).groupBy(fate).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last_rank"))


_FOLD = """WITH RECURSIVE {alerts},
o AS (SELECT alert_id, source_entity, alert_semantics, epoch_us(ts) AS t, row_number() OVER (PARTITION BY source_entity, alert_semantics ORDER BY ts, alert_id) AS k FROM a),
r AS (SELECT alert_id, source_entity, alert_semantics, t, k, t AS session_start FROM o WHERE k = 1
  UNION ALL SELECT o.alert_id, o.source_entity, o.alert_semantics, o.t, o.k, CASE WHEN {keep} THEN r.session_start ELSE o.t END
  FROM r JOIN o ON o.source_entity = r.source_entity AND o.alert_semantics = r.alert_semantics AND o.k = r.k + 1)"""
SESSIONS = _FOLD.format(alerts=ALERTS, keep="o.t - r.t <= 21600000000 AND o.t - r.session_start <= 86400000000")
WINDOWS = _FOLD.format(alerts=ALERTS, keep="o.t - r.session_start <= 21600000000")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_starts(alerts(spark, sf_dir), ["source_entity", "alert_semantics"], "ts", "alert_id", GAP, CAP)


@query(f"{SESSIONS} SELECT alert_id, session_start FROM r")
def capped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select("alert_id", "session_start")


@query(f"{WINDOWS} SELECT alert_id, session_start FROM r")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir)
    return sessions.session_starts(rows, ["source_entity", "alert_semantics"], "ts", "alert_id", None, GAP).select("alert_id", "session_start")


@query(f"{SESSIONS}, g AS (SELECT r.source_entity, r.alert_semantics, session_start, string_agg(r.alert_id, chr(10) ORDER BY r.t, r.alert_id) || chr(10) AS ids, count(*) AS n, max(r.t) AS last_t, count(DISTINCT a.target_entity) AS n_targets, array_to_string(list_sort(list_distinct(list(a.service))), ',') AS services FROM r JOIN a USING (alert_id) GROUP BY ALL) "
       "SELECT 'm1-' || substr(sha256(ids), 1, 24) AS object_id, source_entity, n, n_targets, services, last_t - session_start AS span_us, "
       "CASE WHEN n < 10 THEN '2-9' WHEN n < 100 THEN '10-99' WHEN n < 1000 THEN '100-999' ELSE '1000+' END AS n_bucket FROM g WHERE n >= 2")
def session_meta_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "alert_id"))), lambda s: s["alert_id"])
    grouped = _sessions(spark, sf_dir).groupBy("source_entity", "alert_semantics", "session_start").agg(
        ids.alias("ids"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("target_entity").alias("n_targets"),
        F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"),
        F.max(F.unix_micros("ts")).alias("last_t"),
    )
    return grouped.filter("n >= 2").select(
        T.stable_id("m1-", F.concat(F.array_join("ids", "\n"), F.lit("\n")), 24).alias("object_id"),
        "source_entity",
        "n",
        "n_targets",
        "services",
        (F.col("last_t") - F.col("session_start")).alias("span_us"),
        T.count_bucket(F.col("n")).alias("n_bucket"),
    )


_PHRASES = {"click": "Port scan probe detected", "error": "sshd: authentication fail, invalid user", "view": "SYN flood suspected"}


@query(f"WITH {ALERTS} SELECT alert_id, CASE alert_semantics WHEN 'click' THEN 'scan' WHEN 'error' THEN 'brute_force' WHEN 'view' THEN 'denial_of_service' END AS category, CASE alert_semantics WHEN 'click' THEN 'service_scan' WHEN 'error' THEN 'ssh_authentication' WHEN 'view' THEN 'syn_flood' END AS family FROM a")
def classified_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).replace(_PHRASES, subset="alert_semantics").drop("attributes").withColumn("attributes", F.lit("{}"))
    return classify.behaviours(rows, correlate=False).select("alert_id", "category", "family")


@query(f"""WITH {ALERTS}, p AS (SELECT *, date_trunc('day', ts) AS d FROM a WHERE alert_semantics = 'error'),
s AS (SELECT *, date_trunc('day', ts) AS d FROM a WHERE alert_semantics = 'click'),
j AS (SELECT p.alert_id, s.alert_id AS seed, row_number() OVER (PARTITION BY p.alert_id ORDER BY abs(epoch_us(p.d) - epoch_us(s.d)), s.d, CASE WHEN s.d < p.d THEN NULL ELSE s.alert_id END, s.alert_id DESC) AS k
 FROM p JOIN s ON p.source_entity = s.source_entity AND abs(epoch_us(p.d) - epoch_us(s.d)) <= 432000000000)
SELECT alert_id, seed FROM j WHERE k = 1""")
def nearest_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    probe, seed = F.col("alert_semantics") == "error", F.col("alert_semantics") == "click"
    found = asof.nearest_seed(rows, ["source_entity"], "day", "alert_id", "alert_id", seed, probe, 5 * 24 * HOUR)
    return found.filter("_near IS NOT NULL").select("alert_id", F.col("_near").alias("seed"))


_PAIRS = f"""WITH {ALERTS}, e AS (SELECT alert_id, ts, source_entity AS entity FROM a UNION ALL SELECT alert_id, ts, target_entity FROM a),
seed AS (SELECT alert_id, ts, source_entity AS entity FROM a WHERE NOT {{forward}} UNION ALL SELECT alert_id, ts, target_entity FROM a),
j AS (SELECT DISTINCT c.alert_id AS object_id, n.alert_id AS cand_id FROM seed c JOIN e n ON c.entity = n.entity AND {{cond}}),
r AS (SELECT j.*, c.source_entity = n.source_entity AS ss, c.target_entity = n.target_entity AS tt, abs(epoch_us(c.ts) - epoch_us(n.ts)) / 1e6 AS distance
 FROM j JOIN a c ON c.alert_id = j.object_id JOIN a n ON n.alert_id = j.cand_id),
k AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY CASE WHEN ss AND tt THEN 5 ELSE 3 END DESC, distance, cand_id) AS relevance_rank FROM r)
SELECT object_id, cand_id, round(distance, 6) AS distance, relevance_rank::INTEGER AS relevance_rank, CASE WHEN ss AND tt THEN 'same_source_target_pair' WHEN tt THEN 'shared_target' ELSE 'shared_source' END AS relationship
FROM k WHERE relevance_rank <= 5"""


def _context(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    rows = objects(spark, sf_dir)
    found = context.context(rows, rows, direction, GAP, 5, 1, shared=False)
    return found.select("object_id", "cand_id", F.round("distance", 6).alias("distance"), "relevance_rank", "relationship")


@query(_PAIRS.format(forward="false", cond="n.ts < c.ts AND n.ts >= c.ts - INTERVAL 6 HOUR"))
def context_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, "backward")


@query(_PAIRS.format(forward="true", cond="n.ts > c.ts AND n.ts <= c.ts + INTERVAL 6 HOUR"))
def context_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, "forward")


@query("""WITH o AS (SELECT 'ev-' || lpad(event_id::VARCHAR, 12, '0') AS id, ts, user_id % 12 AS s, regexp_extract(props, '([0-9]+)', 1)::INT % 12 AS t FROM events),
j AS (SELECT c.id AS object_id, n.id AS cand_id, 'backward' AS temporal_role, c.s = n.s AS ss, c.t = n.t AS tt, n.t = c.s AS moves, epoch_us(c.ts) - epoch_us(n.ts) AS d
  FROM o c JOIN o n ON n.ts < c.ts AND n.ts >= c.ts - INTERVAL 1 HOUR AND (n.s IN (c.s, c.t) OR n.t IN (c.s, c.t))
  UNION ALL SELECT c.id, n.id, 'forward', c.s = n.s, c.t = n.t, n.s = c.t, epoch_us(n.ts) - epoch_us(c.ts)
  FROM o c JOIN o n ON n.ts > c.ts AND n.ts <= c.ts + INTERVAL 1 HOUR AND c.t IN (n.s, n.t)),
r AS (SELECT *, CASE WHEN ss AND tt THEN 5 WHEN moves THEN 4 WHEN tt OR ss THEN 3 ELSE 2 END AS priority,
  CASE WHEN ss AND tt THEN 'same_source_target_pair' WHEN moves THEN CASE temporal_role WHEN 'forward' THEN 'target_to_source_progression' ELSE 'predecessor_to_source_progression' END
    WHEN tt THEN 'shared_target' WHEN ss THEN 'shared_source' ELSE 'shared_seed_entity' END AS relationship FROM j),
k AS (SELECT *, row_number() OVER (PARTITION BY object_id, temporal_role ORDER BY priority DESC, d, cand_id) AS relevance_rank FROM r)
SELECT object_id, cand_id, temporal_role, relationship, priority, relevance_rank::INTEGER AS relevance_rank FROM k WHERE relevance_rank <= 5""")
def context_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions between nodes that are sources as well as targets, so that every relation of one hop occurs."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    nodes = _table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("object_id"),
        F.col("ts").cast("timestamp").alias("start_ts"),
        F.col("ts").cast("timestamp").alias("end_ts"),
        F.array((F.col("user_id") % 12).cast("string")).alias("sources"),
        F.array((k % 12).cast("string")).alias("targets"),
    )
    return context.both_directions(nodes, nodes, HOUR, 5, 1, shared=False).select("object_id", "cand_id", "temporal_role", "relationship", "priority", "relevance_rank")


@query()
def context_three_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir)
    found = context.context(rows, rows, "backward", HOUR, 5, 3)
    return found.select("object_id", "cand_id", "hop", "relevance_rank", "relationship", "parent_id")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_id, list_cosine_similarity(q.v, c.v) AS similarity FROM e q JOIN e c ON q.label = c.label WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 6) DESC, entry_id) AS rank FROM s WHERE similarity >= 0.1)
SELECT query_id, entry_id, round(similarity, 4) AS similarity, rank::INTEGER AS rank FROM k WHERE rank <= 5""")
def bucket_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("v", T.normalized_vector(F.col("embedding")))
    found = knowledge.retrieve(rows.filter("vec_id % 20 = 0"), rows, "label", "vec_id", "vec_id", "v", 5, 0.1, digits=6)
    return found.select("query_id", "entry_id", F.round("similarity", 4).alias("similarity"), "rank")


_LAYERS = ("l_returnflag", "l_linestatus", "l_linenumber", "l_shipmonth", "l_suppmod", "l_qty")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        "l_shipdate",
        "l_returnflag",
        "l_linestatus",
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
        F.month("l_shipdate").cast("string").alias("l_shipmonth"),
        (F.col("l_suppkey") % 5).cast("string").alias("l_suppmod"),
        F.col("l_quantity").cast("int").cast("string").alias("l_qty"),
    )


_PATHS = """p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate, [l_returnflag, l_linestatus, l_linenumber::VARCHAR, month(l_shipdate)::VARCHAR, (l_suppkey % 5)::VARCHAR, l_quantity::INT::VARCHAR] AS v FROM lineitem),
x AS (SELECT id, l_shipdate, unnest(range(1, 7)) AS depth, v FROM p),
t AS (SELECT depth, v[1:depth] AS prefix, count(*) AS support FROM x WHERE {where} GROUP BY ALL)"""


@query(f"WITH {_PATHS.format(where='true')} SELECT depth::INTEGER AS depth, array_to_string(prefix, '/') AS prefix, support FROM t")
def prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = memory.prefix_tree(_paths(spark, sf_dir), _LAYERS)
    return tree.select("depth", F.array_join("prefix", "/").alias("prefix"), "support")


@query(f"WITH {_PATHS.format(where='true')} SELECT count(*) + 1 AS node_count, count(*) FILTER (WHERE depth = 6) AS path_count, sum(support) FILTER (WHERE depth = 6)::BIGINT AS total_support FROM t")
def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.tree_summary(memory.prefix_tree(_paths(spark, sf_dir), _LAYERS))


@query(f"WITH {_PATHS.format(where="l_shipdate < DATE '1995-01-01'")}, h AS (SELECT x.id, coalesce(max(CASE WHEN t.support IS NOT NULL THEN x.depth END), 0) AS d, coalesce(max(CASE WHEN x.depth = 6 THEN t.support END), 0) AS s FROM x LEFT JOIN t ON t.depth = x.depth AND t.prefix = x.v[1:x.depth] WHERE x.l_shipdate >= DATE '1995-01-01' GROUP BY 1) "
       "SELECT id, d::INTEGER AS matched_depth, s AS terminal_support, ['l_returnflag', 'l_linestatus', 'l_linenumber', 'l_shipmonth', 'l_suppmod', 'l_qty'][d + 1] AS missing_layer FROM h")
def tree_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir)
    old = F.col("l_shipdate") < F.lit("1995-01-01").cast("date")
    tree = memory.prefix_tree(rows.filter(old), _LAYERS)
    return memory.match_tree(rows.filter(~old), tree, "id", _LAYERS)


@query("WITH e AS (SELECT l_orderkey || '-' || l_linenumber AS object_id, 'supp-' || l_suppkey AS entity FROM lineitem UNION SELECT l_orderkey || '-' || l_linenumber, 'cust-' || o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT entity, count(DISTINCT object_id) AS degree FROM e GROUP BY 1")
def entity_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = items.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("object_id"),
        F.array(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))).alias("sources"),
        F.array(F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string"))).alias("targets"),
    )
    return scoring.entity_degrees(scoring.edges(rows))


_STRATA = """d AS (SELECT quality, lang, source, doc_id FROM documents JOIN labels USING (doc_id)),
s AS (SELECT quality, lang, source, count(*) AS n, floor(count(*) * 0.2) AS f, round(count(*) * 0.2 - floor(count(*) * 0.2), 9) AS rest FROM d GROUP BY ALL),
k AS (SELECT *, greatest(1, floor(sum(n) OVER () * 0.2)) - sum(f) OVER () AS left_over, row_number() OVER (ORDER BY rest DESC, quality NULLS FIRST, lang NULLS FIRST, source NULLS FIRST) AS k FROM s),
t AS (SELECT quality, lang, source, n, (f + CASE WHEN k <= left_over THEN 1 ELSE 0 END)::BIGINT AS take FROM k)"""
_BY = ["quality", "lang", "source"]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").drop("text").join(_table(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {_STRATA} SELECT quality, lang, source, n, take FROM t")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.stratified_allocation(_labelled(spark, sf_dir), _BY, 0.2)


@query(f"WITH {_STRATA}, o AS (SELECT *, row_number() OVER (PARTITION BY quality, lang, source ORDER BY md5('20260817:' || doc_id), doc_id) AS i FROM d) "
       "SELECT doc_id FROM o JOIN t ON o.quality IS NOT DISTINCT FROM t.quality AND o.lang IS NOT DISTINCT FROM t.lang AND o.source IS NOT DISTINCT FROM t.source WHERE i <= take")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.stratified_sample(_labelled(spark, sf_dir), _BY, 0.2, "doc_id").select("doc_id")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations) SELECT conv_id, position::INTEGER AS position, role, CASE WHEN turn % 3 = 0 THEN 'benign' WHEN turn % 3 = 1 THEN role ELSE 'false_positive' END AS label FROM n")
def positional_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labeling.numbered(_table(spark, sf_dir, "conversations"), ["turn"], sections="conv_id")
    official = rows.select(
        "conv_id",
        "position",
        F.col("role").alias("name"),
        F.when(F.col("turn") % 3 == 0, "false_positive").otherwise("attack").alias("time_label"),
        F.when(F.col("turn") % 3 == 1, F.col("role")).otherwise("-").alias("event_label"),
    )
    aligned = labeling.align(rows, official, {"role": "name"}, ("conv_id", "position"))
    return labeling.label(aligned).select("conv_id", "position", "role", "label")


@query("SELECT lang, source, count(*) AS records FROM documents GROUP BY ROLLUP (lang, source)")
def label_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.label_statistics(_table(spark, sf_dir, "documents"), "lang", "source")


@query(f"WITH {ALERTS}, k AS (SELECT alert_id, row_number() OVER (ORDER BY ts, alert_id) AS k, count(*) OVER () AS n FROM a WHERE alert_semantics = 'click'), f AS (SELECT alert_id FROM k WHERE k <= greatest(1, floor(n * 0.2))) SELECT CASE WHEN alert_id IN (SELECT alert_id FROM f) THEN 'fit' ELSE 'test' END AS part, alert_semantics, count(*) AS n, max(ts) AS last_ts FROM a GROUP BY ALL")
def fit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).withColumn("label", F.when(F.col("alert_semantics") == "click", "benign").otherwise("other"))
    learnt, rest = triage.split_fit(rows, 0.2)
    both = learnt.withColumn("part", F.lit("fit")).unionByName(rest.withColumn("part", F.lit("test")))
    return both.groupBy("part", "alert_semantics").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").cast("timestamp_ntz").alias("last_ts")
    )


@query(f"WITH {ALERTS}, u AS (SELECT source_entity, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS sec FROM a GROUP BY 1) SELECT source_entity, CASE WHEN n < 2 THEN '0-1' WHEN n < 10 THEN '2-9' WHEN n < 100 THEN '10-99' WHEN n < 1000 THEN '100-999' ELSE '1000+' END AS n_bucket, CASE WHEN sec < 60 THEN '<1m' WHEN sec < 300 THEN '1-5m' WHEN sec < 3600 THEN '5-60m' ELSE '60m+' END AS span_bucket, CASE WHEN n * 60.0 / greatest(sec, 1.0) < 1 THEN '<1/min' WHEN n * 60.0 / greatest(sec, 1.0) < 10 THEN '1-10/min' WHEN n * 60.0 / greatest(sec, 1.0) < 100 THEN '10-100/min' ELSE '100+/min' END AS rate_bucket FROM u")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = alerts(spark, sf_dir).groupBy("source_entity").agg(
        F.count(F.lit(1)).alias("n"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("sec")
    )
    return users.select(
        "source_entity",
        T.count_bucket(F.col("n")).alias("n_bucket"),
        T.duration_bucket(F.col("sec")).alias("span_bucket"),
        T.rate_bucket(F.col("n"), F.col("sec")).alias("rate_bucket"),
    )


_HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query(f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), c AS (SELECT page_id, host, unnest(string_split(lower(host), '')) AS ch FROM h), p AS (SELECT page_id, count(*) / length(host) AS p FROM c GROUP BY page_id, host, ch), e AS (SELECT page_id, -sum(p * log2(p)) AS bits FROM p GROUP BY 1), l AS (SELECT page_id, list_filter(string_split(lower(host), '.'), lambda x: x <> '') AS l, host FROM h) SELECT page_id, round(bits, 6) AS bits, CASE WHEN len(l) < 2 THEN lower(host) ELSE array_to_string(l[-2:], '.') END AS domain FROM l JOIN e USING (page_id)")
def host_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    rows = _table(spark, sf_dir, "pages").select("page_id", host.alias("host")).filter("host <> ''")
    return rows.select("page_id", F.round(T.entropy(F.col("host")), 6).alias("bits"), T.base_domain(F.col("host")).alias("domain"))


_IP = "'10.' || (user_id % 4) || '.' || (event_id % 200) || '.' || (event_id % 250)"


@query(f"WITH i AS (SELECT event_id, {_IP} AS ip, user_id % 4 AS b, event_id % 200 AS c, event_id % 250 AS d FROM events) SELECT event_id, ip, '10.' || b || '.' || c || '.0/24' AS net24, '10.' || b || '.' || (c - c % 16) || '.0/20' AS net20, b = 1 AS inside, uuid5 FROM (SELECT *, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS uuid5 FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ip::BLOB) AS h FROM i))")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    ip = F.concat(F.lit("10."), text(F.col("user_id") % 4), F.lit("."), text(F.col("event_id") % 200), F.lit("."), text(F.col("event_id") % 250))
    rows = _table(spark, sf_dir, "events").select("event_id", ip.alias("ip"))
    return rows.select(
        "event_id",
        "ip",
        T.ipv4_subnet(F.col("ip"), 24).alias("net24"),
        T.ipv4_subnet(F.col("ip"), 20).alias("net20"),
        T.cidr_contains(F.lit("10.1.0.0/16"), F.col("ip")).alias("inside"),
        T.uuid5(F.col("ip")).alias("uuid5"),
    )


@query("SELECT c_custkey, 'ait-wazuh-' || substr(sha256('file:' || c_custkey || ':wazuh'), 1, 24) AS alert_id, CASE WHEN regexp_matches(c_name, '[a-z]') THEN 'l' ELSE '' END || CASE WHEN regexp_matches(c_name, '[A-Z]') THEN 'u' ELSE '' END || CASE WHEN regexp_matches(c_name, '[0-9]') THEN 'd' ELSE '' END || CASE WHEN regexp_matches(c_name, '[^A-Za-z0-9]') THEN 'p' ELSE '' END AS shape FROM customer")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    material = F.concat_ws(":", F.lit("file"), F.col("c_custkey").cast("string"), F.lit("wazuh"))
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", T.stable_id("ait-wazuh-", material, 24).alias("alert_id"), T.character_shape(F.col("c_name")).alias("shape")
    )


_TEMPLATE = """'{"command":"' || replace(props, '"', chr(92) || '"') || '"' || CASE WHEN value IS NULL THEN '' ELSE ',"count":"<NUMBER>"' END || '}'"""


@query(f"WITH {ALERTS}, t AS (SELECT a.*, {_TEMPLATE} AS index_text FROM a) SELECT alert_semantics, service, index_text, min_by(alert_id, (ts, alert_id)) AS representative, count(*) AS support, array_to_string(list(alert_id ORDER BY ts, alert_id)[1:20], ',') AS provenance, "
       "'kp-' || substr(sha256('{\"alert_semantics\":\"' || alert_semantics || '\",\"alert_source\":\"events\",\"index_text\":\"' || replace(replace(index_text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\",\"service\":\"' || service || '\"}'), 1, 24) AS pattern_id FROM t GROUP BY alert_semantics, service, index_text")
def knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).withColumn("template", payload_template(F.col("attributes"), True, 3))
    return knowledge.knowledge_documents(rows).select(
        "alert_semantics", "service", "index_text", "representative", "support", F.array_join("provenance", ",").alias("provenance"), "pattern_id"
    )


@query(f"WITH {ALERTS}, n AS (SELECT source_entity, target_entity, count(*) AS n FROM a GROUP BY ALL) SELECT source_entity, string_agg(target_entity, ',' ORDER BY n DESC, target_entity) AS templates FROM n GROUP BY 1")
def template_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knowledge.template_frequency(alerts(spark, sf_dir), "source_entity", "target_entity")
    return found.select("source_entity", F.array_join("templates", ",").alias("templates"))


@query("""WITH t AS (SELECT page_id, list_transform(regexp_extract_all(lower(url), '[a-z0-9_]+'), lambda x: x) AS t FROM pages),
s AS (SELECT page_id, list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '::' || t[i + 1]))) AS s FROM t)
SELECT a.page_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity FROM s a JOIN s b ON b.page_id = a.page_id + 1""")
def signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages").select("page_id", "url")
    after = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    return rows.join(after, "page_id").select(
        "page_id", F.round(knowledge.signature_similarity(F.col("url"), F.col("next")), 6).alias("similarity")
    )


@query(f"""WITH RECURSIVE {ALERTS}, b AS (SELECT alert_id, ts, service, source_entity || ' ' || target_entity || ' ' || service AS template FROM a),
t AS (SELECT service, template, min(ts) AS ts, arg_min(alert_id, (ts, alert_id)) AS ident FROM b GROUP BY ALL),
k AS (SELECT *, regexp_extract_all(lower(template), '[a-z0-9_]+') AS w, row_number() OVER (PARTITION BY service ORDER BY ts, ident) AS k FROM t),
n AS (SELECT service, template, ident, k, list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '::' || w[i + 1]))) AS s FROM k),
r AS (SELECT service, k, [struct_pack(k := k, ident := ident, s := s)] AS leaders FROM n WHERE k = 1
  UNION ALL SELECT n.service, n.k, CASE WHEN len(list_filter(r.leaders, lambda x: len(list_intersect(x.s, n.s)) / len(list_distinct(list_concat(x.s, n.s))) >= 0.5)) > 0 THEN r.leaders
    ELSE list_append(r.leaders, struct_pack(k := n.k, ident := n.ident, s := n.s)) END
  FROM r JOIN n ON n.service = r.service AND n.k = r.k + 1),
l AS (SELECT service, unnest(arg_max(leaders, k)) AS l FROM r GROUP BY service),
m AS (SELECT n.service, n.template, l.l.ident AS leader, l.l.k AS place, len(list_intersect(l.l.s, n.s)) / len(list_distinct(list_concat(l.l.s, n.s))) AS similarity FROM n JOIN l ON l.service = n.service AND l.l.k <= n.k),
c AS (SELECT service, template, arg_max(leader, (similarity, -place)) AS leader, max(similarity) AS similarity FROM m GROUP BY ALL)
SELECT alert_id, leader, similarity FROM b JOIN c USING (service, template)""")
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).withColumn("template", F.concat_ws(" ", "source_entity", "target_entity", "service"))
    return knowledge.leader_clusters(rows, ["service"], ["ts"], "alert_id", "template", 0.5).select("alert_id", "leader", "similarity")


@query(f"WITH {ALERTS}, f AS (SELECT sha256(source_entity || '|' || alert_semantics) AS digest, count(*) AS support FROM a WHERE target_entity = 'host-3' GROUP BY 1) SELECT alert_id, support FROM a LEFT JOIN f ON f.digest = sha256(source_entity || '|' || alert_semantics)")
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).withColumn("digest", F.sha2(F.concat_ws("|", "source_entity", "alert_semantics"), 256))
    known = rows.filter("target_entity = 'host-3'").groupBy("digest").agg(F.count(F.lit(1)).alias("support"))
    return rows.join(known, "digest", "left").select("alert_id", "support")


@query(f"WITH {ALERTS}, k AS (SELECT alert_id FROM a WHERE target_entity = 'host-3') SELECT alert_semantics, count(*) FILTER (WHERE alert_id IN (SELECT alert_id FROM k)) AS filtered, count(*) FILTER (WHERE alert_id NOT IN (SELECT alert_id FROM k)) AS forwarded FROM a GROUP BY 1")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir)
    decisions = rows.select(
        "object_id", F.when(F.element_at("targets", 1) == "host-3", "filter").otherwise("forward").alias("decision")
    )
    both = memory.route(rows, decisions, "filter").withColumn("f", F.lit(1)).unionByName(
        memory.route(rows, decisions, "forward").withColumn("f", F.lit(0))
    )
    return both.groupBy("alert_semantics").agg(
        F.count(F.when(F.col("f") == 1, 1)).alias("filtered"), F.count(F.when(F.col("f") == 0, 1)).alias("forwarded")
    )


@query("""WITH s AS (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O'), []) AS a, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []) AS b FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both_have, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS any_has, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_first FROM s""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    rows = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of("O").alias("a"), of("F").alias("b"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select(
        "o_custkey",
        text(F.array_intersect("a", "b")).alias("both_have"),
        text(F.array_union("a", "b")).alias("any_has"),
        text(F.array_except("a", "b")).alias("only_first"),
    )


@query("WITH k AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'X-Auth-Token' WHEN 'view' THEN 'start_time' WHEN 'error' THEN 'user_id' WHEN 'purchase' THEN 'Content-Length' ELSE event_type END AS k FROM events) SELECT event_id, CASE k WHEN 'X-Auth-Token' THEN '<TOKEN>' WHEN 'start_time' THEN '<TIMESTAMP>' WHEN 'user_id' THEN '<ID>' WHEN 'Content-Length' THEN '<NUMBER>' END AS mask FROM k")
def key_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"click": "X-Auth-Token", "view": "start_time", "error": "user_id", "purchase": "Content-Length"}
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type").replace(names, subset="event_type")
    return rows.select("event_id", T.key_placeholder(F.col("event_type")).alias("mask"))


@query()
def masked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", masked(F.col("url")).alias("masked"), masked_native(F.col("url")).alias("native"))


@query(f"WITH {ALERTS} SELECT 'events' AS origin, count(*) AS n FROM a UNION ALL SELECT 'again', count(*) FROM a WHERE alert_semantics = 'error'")
def unioned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).withColumn("origin", F.lit("events"))
    again = rows.filter("alert_semantics = 'error'").withColumn("origin", F.lit("again"))
    return rows.unionByName(again).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query()
def triage_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole triage on events: fit on the earliest clicks, then process all other alerts."""
    config = triage.TriageConfig(gap_seconds=GAP, cap_seconds=CAP, context_seconds=GAP, similarity=0.1)
    rows = alerts(spark, sf_dir).replace(_PHRASES, subset="alert_semantics")
    rows = rows.withColumn("label", F.when(F.col("alert_semantics").startswith("Port"), "benign").otherwise("other"))
    learnt, rest = triage.split_fit(rows, config.fit_fraction)
    fingerprints, known = triage.fit(learnt, config)
    return triage.process(rest, fingerprints, known, config).verdicts.select("object_id", "label", "confidence", "error_code")


@query()
def memory_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir)
    fingerprints = materialize(memory.learn(rows.filter("start_ts < timestamp'2024-01-15'")), "fingerprints")
    return memory.decide(rows.filter("start_ts >= timestamp'2024-01-15'"), fingerprints)
