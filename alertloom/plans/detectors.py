"""Queries that run the detector side of the library, from raw records to objects, over records made of `events`.

The records of these queries are JSON texts as detectors write them; their values come from the rows of `events`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators import classify, knowledge, memory, scoring, sessions
from alertloom.plans.catalog import CAP, GAP, ORACLES, query
from alertloom.session import materialize
from alertloom.sources import jsonl, normalize


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"k": k, "ts": F.col("ts").cast("timestamp")})


_EVENTS = "e AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events)"


def _lines(rows: DataFrame, line: Column) -> DataFrame:
    """Records as the reader gives them: file, line number, text. The texts are far longer than the rows they are made of, so rows are dealt to all tasks first."""
    rows = rows.repartition("event_id")
    made = rows.select(F.lit("made.json").alias("source_file"), (F.col("event_id") + 1).alias("source_line"), line.alias("line"))
    return jsonl.once(made, "line")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

_IDENT = "'ait-' || {d} || '-' || substr(sha256('made.json:' || (event_id + 1) || ':' || {d}), 1, 24)"


@query(f"""WITH {_EVENTS}, d AS (SELECT *, CASE WHEN event_type = 'error' THEN 'aminer' WHEN event_type = 'view' THEN 'suricata' ELSE 'wazuh' END AS d FROM e)
SELECT {_IDENT.format(d="d")} AS alert_id, d AS alert_source,
 epoch_us(ts) AS ts_us,
 CASE WHEN d = 'aminer' THEN 'New value ' || event_type WHEN d = 'suricata' THEN 'ET ' || event_type ELSE coalesce(nullif(CASE WHEN k % 7 = 0 THEN '' ELSE 'rule ' || event_type END, ''), 'unknown alert') END AS alert_semantics,
 CASE WHEN d = 'aminer' THEN NULL ELSE '10.0.0.' || (user_id % 200) END AS source_entity,
 CASE WHEN d = 'aminer' THEN 'host-' || (k % 20) WHEN k % 5 = 0 THEN '10.9.9.9' ELSE '10.1.0.' || (k % 50) END AS target_entity,
 CASE WHEN d = 'aminer' THEN CASE WHEN k % 2 = 0 THEN '/var/log/' || (k % 4) ELSE 'NewValue' END WHEN k % 3 = 0 THEN 'tcp' ELSE 'tcp/' || (1000 + k % 5) END AS service,
 'made.json:' || (event_id + 1) AS raw_reference,
 CASE WHEN d = 'aminer' THEN NULL ELSE 'benign' END AS label,
 CASE WHEN d = 'aminer' THEN NULL ELSE 'r' || (k % 10) END AS rule_id,
 CASE WHEN d = 'aminer' THEN 'raw ' || k WHEN d = 'wazuh' THEN 'log line ' || k END AS payload,
 CASE WHEN d = 'suricata' THEN 3 WHEN d = 'wazuh' THEN 5 END AS severity
FROM d""")
def normalized_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three detectors' records, told apart and normalised."""
    rows = _events(spark, sf_dir)
    stamp = F.date_format("ts", _STAMP)
    port = F.when(F.col("k") % 3 != 0, 1000 + F.col("k") % 5)
    source = F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 200).cast("string"))
    target = F.when(F.col("k") % 5 != 0, F.concat(F.lit("10.1.0."), (F.col("k") % 50).cast("string")))
    agent = F.struct(F.lit("10.9.9.9").alias("ip"))
    aminer = F.to_json(
        F.struct(
            F.struct(F.concat(F.lit("host-"), (F.col("k") % 20).cast("string")).alias("ID")).alias("AMiner"),
            F.struct(
                F.array((F.unix_micros("ts") / 1e6).cast("double")).alias("Timestamps"),
                F.array(F.concat(F.lit("raw "), F.col("k").cast("string"))).alias("RawLogData"),
                F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("/var/log/"), (F.col("k") % 4).cast("string")))).alias("LogResources"),
            ).alias("LogData"),
            F.struct(
                F.lit("NewValue").alias("AnalysisComponentType"), F.concat(F.lit("New value "), F.col("event_type")).alias("AnalysisComponentName")
            ).alias("AnalysisComponent"),
        )
    )
    rule = F.struct(
        F.concat(F.lit("r"), (F.col("k") % 10).cast("string")).alias("id"),
        F.when(F.col("k") % 7 == 0, "  ").otherwise(F.concat(F.lit("rule "), F.col("event_type"))).alias("description"),
        F.lit(5).alias("level"),
    )
    wazuh = _json(
        **{"@timestamp": stamp, "rule": rule, "agent": agent, "label": F.lit("benign"), "location": F.lit("/var/log/syslog")},
        data=F.struct(source.alias("srcip"), target.alias("dstip"), F.lit("tcp").alias("protocol"), port.alias("dstport"), F.lit("").alias("proto")),
        full_log=F.concat(F.lit("log line "), F.col("k").cast("string")),
    )
    suricata = _json(
        rule=rule,
        agent=agent,
        label=F.lit("benign"),
        location=F.lit("/var/log/suricata/eve.json"),
        data=F.struct(
            stamp.alias("timestamp"),
            source.alias("src_ip"),
            target.alias("dest_ip"),
            F.lit("tcp").alias("proto"),
            port.cast("string").alias("dest_port"),
            F.struct(F.concat(F.lit("ET "), F.col("event_type")).alias("signature"), F.lit(3).alias("severity")).alias("alert"),
        ),
    )
    line = F.when(F.col("event_type") == "error", aminer).when(F.col("event_type") == "view", suricata).otherwise(wazuh)
    found = normalize.normalize(jsonl.parse_objects(_lines(rows, line)))
    attribute = lambda f: F.get_json_object("attributes", f"$.{f}")
    return found.select(
        "alert_id", "alert_source", F.unix_micros("ts").alias("ts_us"), "alert_semantics", "source_entity", "target_entity", "service", "raw_reference",
        "label", attribute("rule_id").alias("rule_id"), attribute("payload").alias("payload"), attribute("severity").cast("int").alias("severity"),
    )


@query(f"""WITH {_EVENTS}, d AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'network_ids' ELSE 'web_ids' END AS kind FROM e)
SELECT 'acme-' || kind || '-' || substr(sha256('made.json:' || (event_id + 1) || ':' || kind || ':' || CASE WHEN k % 3 = 0 THEN '' ELSE 'u' || event_id END), 1, 32) AS alert_id,
 epoch_us(CASE WHEN k % 4 = 0 THEN ts ELSE ts - INTERVAL 8 HOUR END) AS ts_us, 'acme_' || kind AS alert_source,
 CASE WHEN k % 5 = 0 THEN event_type ELSE 'rule ' || event_type END AS alert_semantics, 'user-' || user_id AS source_entity, 'host-' || (k % 20) AS target_entity,
 'tcp/' || k AS service, user_id % 2 = 1 AS is_attack,
 CASE k % 4 WHEN 0 THEN 'brute force password guessing' WHEN 1 THEN 'scan' WHEN 2 THEN 'dns tunnel' END AS hint,
 CASE WHEN kind = 'network_ids' THEN '{{"attack_type":"' || event_type || '"}}' ELSE '{{"host":"h' || k || '","uri":"/' || repeat('x', 4095) || '"}}' END AS payload
FROM d""")
def vendor_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor's IDS rows: zones, truth, hints, bounded texts and payload fields by log type."""
    network, number = F.col("k") % 2 == 0, F.col("k").cast("string")
    details = F.when(F.col("k") % 4 == 0, "账号爆破").when(F.col("k") % 4 == 1, "端口探测").when(F.col("k") % 4 == 2, "DNS隧道")
    line = _json(
        **{"@timestamp": F.when(F.col("k") % 4 == 0, F.date_format("ts", _STAMP)).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))},
        log_type=F.when(network, "webids-ids_dolog").otherwise("webids-webattack_dolog"),
        uuid=F.when(F.col("k") % 3 != 0, F.concat(F.lit("u"), F.col("event_id").cast("string"))),
        rule_name=F.when(F.col("k") % 5 != 0, F.concat(F.lit("rule "), F.col("event_type"))),
        attack_type=F.col("event_type"),
        detail_info=details,
        sip=F.concat(F.lit("user-"), F.col("user_id").cast("string")),
        dip=F.concat(F.lit("host-"), (F.col("k") % 20).cast("string")),
        proto=F.lit("tcp"),
        dport=number,
        host=F.concat(F.lit("h"), number),
        uri=F.concat(F.lit("/"), F.repeat(F.lit("x"), 5000)),
        is_attack=(F.col("user_id") % 2).cast("string"),
    )
    records = jsonl.reject_labels(jsonl.parse_objects(_lines(_events(spark, sf_dir), line)))
    found = normalize.normalize_vendor(normalize.extract_vendor_rows(records), vendor="acme")
    return found.select(
        "alert_id", F.unix_micros("ts").alias("ts_us"), "alert_source", "alert_semantics", "source_entity", "target_entity", "service", "is_attack",
        F.get_json_object("attributes", "$.behavior_hint").alias("hint"), F.get_json_object("attributes", "$.payload_fields").alias("payload"),
    )


#: semantics, attributes, service, and what the rules must make of them: category, family, signal, grouping service, ports.
_LONG = "aGVsbG8gd29ybGQgdGhpcyBpcyBh" + "x9Kq2Lm7Zp4Wd1Rt8Vb3Nc6Yf5Hg0Js" * 2 + ".t.evil.example.org"
RULES = (
    ("Port scan probe detected", "{}", "tcp/22", "scan", "service_scan", "scan_marker", "tcp", "22"),
    ("WPScan agent", '{"destination_port":"8080"}', "tcp/80", "scan", "web_scan:wpscan", "scan_marker", "web/http", "8080"),
    ("gobuster run", "{}", "tcp/80", "scan", "web_scan:enumeration", "scan_marker", "web/http", "80"),
    ("Web server 404 error code", "{}", "tcp/81", "scan", "web_scan:enumeration", "scan_marker", "web/http", "81"),
    ("noise", '{"web_scan":"yes"}', "tcp/82", "scan", "web_scan:enumeration", "scan_marker", "web/http", "82"),
    ("log", '{"payload_fields":{"full_log":"1.2.3.4 - - \\"GET /a HTTP/1.1\\" 404 12"}}', "tcp/83", "scan", "web_scan:enumeration", "scan_marker", "web/http", "83"),
    ("dns sweep", "{}", "udp/53", "scan", "dns_scan", "scan_marker", "udp", "53"),
    ("host sweep", '{"protocol":"ICMP"}', "", "scan", "network_scan", "scan_marker", "icmp", ""),
    ("SURICATA invalid handshake", "{}", "tcp/443", "scan", "protocol_scan", "scan_marker", "tcp", "443"),
    ("sshd: authentication failure", "{}", "tcp/22", "brute_force", "ssh_authentication", "credential_failure_marker", "tcp/22", "22"),
    ("rdp login failed", "{}", "tcp/3389", "brute_force", "rdp_authentication", "credential_failure_marker", "tcp/3389", "3389"),
    ("wp-admin brute force", "{}", "tcp/80", "brute_force", "web_authentication", "credential_failure_marker", "tcp/80", "80"),
    ("imap login failed", "{}", "tcp/143", "brute_force", "mail_authentication", "credential_failure_marker", "tcp/143", "143"),
    ("multiple failed logons", "{}", "tcp/9", "brute_force", "authentication", "credential_failure_marker", "tcp/9", "9"),
    ("dns tunnel found", "{}", "udp/53", "dns_tunnel", "explicit_tunnel", "dns_payload_heuristic", "udp/53", "53"),
    ("dns answer", f'{{"dns":{{"rrname":"{_LONG}."}}}}', "dns", "dns_tunnel", "encoded_subdomain:example.org", "dns_payload_heuristic", "dns", ""),
    ("dns query", '{"dns":[{"qname":"12x34-.56-.tun.example.net"}]}', "dns", "dns_tunnel", "encoded_subdomain:example.net", "dns_payload_heuristic", "dns", ""),
    ("SYN flood suspected", "{}", "tcp/1", "denial_of_service", "syn_flood", "flood_marker", "tcp/1", "1"),
    ("http request flood", "{}", "tcp/2", "denial_of_service", "request_flood", "flood_marker", "tcp/2", "2"),
    ("ddos", '{"source_port":"443","destination_port":"50001","protocol":"tcp"}', "tcp/50001", "denial_of_service", "traffic_flood", "flood_marker", "tcp/443", "50001"),
    ("plain event", '{"dest_port":["9","80","9","x"]}', "tcp/7", None, None, None, "tcp/7", "9,80,x"),
)
_RESOURCES = {15: _LONG, 16: "12x34-.56-.tun.example.net"}


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _case(values: list[str | None]) -> str:
    return f"CASE event_id % {len(values)} " + " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(values)) + " END"


def _pick(values: list[str | None]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))


def _made_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("alert_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("events").alias("alert_source"),
        _pick([r[0] for r in RULES]).alias("alert_semantics"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_entity"),
        F.concat(F.lit("host-"), (F.col("k") % 20).cast("string")).alias("target_entity"),
        _pick([r[2] for r in RULES]).alias("service"),
        _pick([r[1] for r in RULES]).alias("attributes"),
    )


@query("SELECT 'ev-' || lpad(event_id::VARCHAR, 12, '0') AS alert_id, "
       + ", ".join(f"{_case([r[i] for r in RULES])} AS {n}" for i, n in ((3, "category"), (4, "family"), (5, "signal"), (6, "service"), (7, "ports")))
       + f", {_case([_RESOURCES.get(i, '') for i in range(len(RULES))])} AS resources FROM events")
def behaviour_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of the behaviour rules, with grouping service, ports and resources."""
    found = classify.behaviours(_made_alerts(spark, sf_dir), correlate=False)
    return found.select(
        "alert_id", "category", "family", "signal", classify.aggregation_service().alias("service"),
        F.array_join(classify.destination_ports(), ",").alias("ports"), F.array_join(classify.resources(), ",").alias("resources"),
    )


_WEB = """w AS (SELECT 'ev-' || lpad(event_id::VARCHAR, 12, '0') AS alert_id, ts, user_id AS s, 'host-' || (k % 20) AS t, event_type FROM e),
p AS (SELECT * FROM w WHERE event_type = 'error'), q AS (SELECT * FROM w WHERE event_type = 'click'),
j AS (SELECT p.alert_id, row_number() OVER (PARTITION BY p.alert_id ORDER BY abs(epoch_us(p.ts) - epoch_us(q.ts)), q.ts) AS n
 FROM p JOIN q ON p.s = q.s AND p.t = q.t AND abs(epoch_us(p.ts) - epoch_us(q.ts)) <= 43200000000)"""


@query(f"""WITH {_EVENTS}, {_WEB} SELECT w.alert_id, CASE WHEN event_type = 'click' OR j.alert_id IS NOT NULL THEN 'scan' END AS category,
CASE WHEN event_type = 'click' OR j.alert_id IS NOT NULL THEN 'web_scan:wpscan' END AS family,
CASE WHEN event_type = 'click' THEN 'scan_marker' WHEN j.alert_id IS NOT NULL THEN 'correlated_web_scan_session' END AS signal
FROM w LEFT JOIN j ON j.alert_id = w.alert_id AND n = 1""")
def correlated_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak web evidence joins the nearest confirmed web scan of its source and target within twelve hours."""
    said = F.when(F.col("event_type") == "click", "WPScan agent").when(F.col("event_type") == "error", "suspicious URL access").otherwise("plain")
    rows = _events(spark, sf_dir).select(
        F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("alert_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("events").alias("alert_source"),
        said.alias("alert_semantics"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_entity"),
        F.concat(F.lit("host-"), (F.col("k") % 20).cast("string")).alias("target_entity"),
        F.lit("tcp/80").alias("service"),
        F.lit("{}").alias("attributes"),
    )
    return classify.behaviours(rows, 12 * 3600).select("alert_id", "category", "family", "signal")


_SAID = {"click": "Port scan probe detected", "error": "sshd: authentication fail", "view": "SYN flood suspected"}
_META = f"""WITH RECURSIVE {_EVENTS},
a AS (SELECT 'ev-' || lpad(event_id::VARCHAR, 12, '0') AS alert_id, ts, event_type, 'user-' || user_id AS s, 'host-' || (k % 20) AS t, 'tcp/' || (1000 + k % 5) AS svc,
  CASE event_type WHEN 'click' THEN 'scan' WHEN 'error' THEN 'brute_force' WHEN 'view' THEN 'denial_of_service' END AS category,
  CASE event_type WHEN 'click' THEN 'service_scan' WHEN 'error' THEN 'ssh_authentication' WHEN 'view' THEN 'syn_flood' END AS family FROM e),
g AS (SELECT *, CASE WHEN category = 'scan' THEN '<ANY>' ELSE t END AS kt, CASE WHEN category = 'scan' THEN 'tcp' ELSE svc END AS ks FROM a WHERE category IS NOT NULL),
o AS (SELECT *, epoch_us(ts) AS u, row_number() OVER (PARTITION BY category, s, kt, ks ORDER BY ts, alert_id) AS i FROM g),
r AS (SELECT alert_id, category, s, kt, ks, u, i, u AS start FROM o WHERE i = 1 UNION ALL
  SELECT o.alert_id, o.category, o.s, o.kt, o.ks, o.u, o.i, CASE WHEN o.u - r.u <= {GAP * 1_000_000} AND o.u - r.start <= {CAP * 1_000_000} THEN r.start ELSE o.u END
  FROM r JOIN o ON o.category = r.category AND o.s = r.s AND o.kt = r.kt AND o.ks = r.ks AND o.i = r.i + 1),
m AS (SELECT r.category, any_value(o.family) AS family, r.s, r.kt, r.ks, start, count(*) AS n, string_agg(r.alert_id, chr(10) ORDER BY r.u, r.alert_id) || chr(10) AS ids,
  max(r.u) - min(r.u) AS span, array_to_string(list_sort(list_distinct(list(o.t))), ',') AS targets, count(DISTINCT o.t) AS n_targets,
  array_to_string(list_sort(list_distinct(list(split_part(o.svc, '/', 2)))), ',') AS ports
  FROM r JOIN o ON o.alert_id = r.alert_id GROUP BY ALL),
b AS (SELECT *, span / 1e6 AS sec FROM m WHERE n >= 2),
x AS (SELECT 'meta_alert' AS object_type, 'm1-' || replace(category, '_', '-') || '-' || substr(sha256(ids), 1, 24) AS object_id, category || ':' || family AS alert_semantics,
  n AS members, s AS sources, targets, ks AS services, ports, start AS start_us, start + span AS end_us,
  CASE WHEN n < 10 THEN '2-9' WHEN n < 100 THEN '10-99' WHEN n < 1000 THEN '100-999' ELSE '1000+' END AS size_bucket,
  CASE WHEN sec < 60 THEN '<1m' WHEN sec < 300 THEN '1-5m' WHEN sec < 3600 THEN '5-60m' ELSE '60m+' END AS span_bucket, n_targets FROM b),
y AS (SELECT 'alert' AS object_type, a.alert_id AS object_id, CASE event_type WHEN 'click' THEN 'Port scan probe detected' WHEN 'error' THEN 'sshd: authentication fail' WHEN 'view' THEN 'SYN flood suspected' ELSE event_type END AS alert_semantics,
  1 AS members, a.s AS sources, t AS targets, svc AS services, NULL AS ports, epoch_us(ts) AS start_us, epoch_us(ts) AS end_us, NULL AS size_bucket, NULL AS span_bucket, NULL AS n_targets
  FROM a LEFT JOIN r ON r.alert_id = a.alert_id LEFT JOIN m ON m.category = r.category AND m.s = r.s AND m.kt = r.kt AND m.ks = r.ks AND m.start = r.start
  WHERE a.category IS NULL OR m.n < 2),
z AS (SELECT * FROM x UNION ALL SELECT * FROM y)"""


def _session_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    rows = _events(spark, sf_dir).select(
        F.concat(F.lit("ev-"), F.lpad(text(F.col("event_id")), 12, "0")).alias("alert_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("events").alias("alert_source"),
        F.col("event_type").alias("alert_semantics"),
        F.concat(F.lit("user-"), text(F.col("user_id"))).alias("source_entity"),
        F.concat(F.lit("host-"), text(F.col("k") % 20)).alias("target_entity"),
        F.concat(F.lit("tcp/"), text(1000 + F.col("k") % 5)).alias("service"),
        F.lit("{}").alias("attributes"),
    )
    return sessions.aggregate_sessions(rows.replace(_SAID, subset="alert_semantics"), GAP, CAP)


@query(f"{_META} SELECT object_type, object_id, alert_semantics, members::INTEGER AS members, sources, targets, services, ports, start_us, end_us, size_bucket, span_bucket, n_targets::INTEGER AS n_targets FROM z")
def session_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta-alerts of sessions and the alerts left over."""
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return _session_objects(spark, sf_dir).select(
        "object_type", "object_id", "alert_semantics", F.size("member_ids").alias("members"), joined("sources").alias("sources"),
        joined("targets").alias("targets"), joined("services").alias("services"), F.array_join("statistics.destination_ports", ",").alias("ports"),
        F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), F.col("statistics.member_count_bucket").alias("size_bucket"),
        F.col("statistics.duration_bucket").alias("span_bucket"), F.col("statistics.distinct_target_count").alias("n_targets"),
    )


@query(f"{_META} SELECT category, count(*) AS objects, sum(n)::BIGINT AS members FROM m WHERE n >= 2 GROUP BY 1")
def behaviour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.behaviour_counts(_session_objects(spark, sf_dir))


@query(f"{_META} SELECT a.alert_id AS member_id, coalesce('m1-' || replace(m.category, '_', '-') || '-' || substr(sha256(m.ids), 1, 24), a.alert_id) AS object_id FROM a "
       "LEFT JOIN r ON r.alert_id = a.alert_id LEFT JOIN m ON m.category = r.category AND m.s = r.s AND m.kt = r.kt AND m.ks = r.ks AND m.start = r.start AND m.n >= 2")
def session_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.members(_session_objects(spark, sf_dir))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as objects between addresses, with a command whose numbers are masked from six digits on."""
    text = lambda c: c.cast("string")
    return _events(spark, sf_dir).select(
        F.lit("alert").alias("object_type"),
        F.concat(F.lit("ev-"), F.lpad(text(F.col("event_id")), 12, "0")).alias("object_id"),
        F.col("ts").cast("timestamp").alias("start_ts"),
        F.col("ts").cast("timestamp").alias("end_ts"),
        F.lit("events").alias("alert_source"),
        F.concat(F.lit(" "), F.col("event_type"), F.lit("  seen")).alias("alert_semantics"),
        F.array(F.concat(F.lit("10.0."), text(F.col("user_id") % 3), F.lit("."), text(F.col("user_id") % 50))).alias("sources"),
        F.when(F.col("k") % 10 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.concat(F.lit("host-"), text(F.col("k") % 4)))).alias("targets"),
        F.when(F.col("k") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("tcp/80"))).alias("services"),
        F.array(F.lit("x")).alias("member_ids"),
        F.concat(F.lit('{"payload_fields":{"command":"job '), text(1_000_000 + F.col("k")), F.lit(" done\"}}")).alias("attributes"),
    )


_FLOWS = f"""{_EVENTS}, f AS (SELECT event_id, ts, 'ev-' || lpad(event_id::VARCHAR, 12, '0') AS object_id, 'events' AS l1, event_type || ' seen' AS l2,
 '10.0.' || (user_id % 3) || '.' || (user_id % 50) AS l3, CASE WHEN k % 10 = 0 THEN '<MULTIPLE>' ELSE 'host-' || (k % 4) END AS l4, CASE WHEN k % 9 = 0 THEN '<NULL>' ELSE 'tcp/80' END AS l5,
 '{{"command":"job ' || (1000000 + k) || ' done"}}' AS l6, '10.0.' || (user_id % 3) || '.0/24' AS net FROM e)"""
_DIGEST = "sha256('{\"layers\":[' || list_aggregate(list_transform(list_zip(['alert_source','alert_semantics','source_entity','target_entity','service_information','attribute_template'], [l1, l2, l3, l4, l5, l6]), lambda x: '{\"name\":\"' || x[1] || '\",\"value\":\"' || replace(x[2], '\"', '\\\"') || '\"}'), 'string_agg', ',') || '],\"version\":1}')"


@query(f"WITH {_FLOWS}, p AS (SELECT l1, l2, l3, l4, l5, l6, count(*) AS support FROM f GROUP BY ALL) SELECT {_DIGEST} AS digest, support FROM p")
def exact_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests and support of all distinct six-layer paths."""
    return memory.learn(_flows(spark, sf_dir)).filter("kind = 'exact'").select("digest", "support")


@query(f"""WITH {_FLOWS}, p AS (SELECT l1, l2, l3, l4, l5, l6, net, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT l2, net, l4, l5, sum(n)::BIGINT AS support, count(*) AS paths, count(DISTINCT l3) AS n3, count(DISTINCT l6) AS n6, min(l3) AS l3, min(l6) AS l6 FROM p GROUP BY ALL)
SELECT l2 AS semantics, CASE WHEN n3 > 1 THEN net ELSE l3 END AS source, l4 AS target, l5 AS service, CASE WHEN n6 > 1 THEN '{{"command":"job <NUMBER> done"}}' ELSE l6 END AS template,
 support, paths::INTEGER AS paths, CASE WHEN n3 > 1 AND n6 > 1 THEN 'source_entity,attribute_template' WHEN n3 > 1 THEN 'source_entity' ELSE 'attribute_template' END AS fields,
 CASE WHEN n6 > 1 THEN 'attribute_template:0:<NUMBER>:number:digits' ELSE '' END AS rules
FROM g WHERE paths > 1""")
def generalized_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths of one masked form have in common: subnets and typed placeholders, with their rules."""
    return _told_patterns(memory.learn(_flows(spark, sf_dir)))


def _told_patterns(fingerprints: DataFrame) -> DataFrame:
    found = fingerprints.filter("kind = 'generalized'")
    rule = F.transform("constraints", lambda c: F.concat_ws(":", c["layer"], c["occurrence"].cast("string"), c["placeholder"], F.array_join(c["accepted_shapes"], "|")))
    return found.select(
        F.col("path.alert_semantics").alias("semantics"), F.col("path.source_entity").alias("source"), F.col("path.target_entity").alias("target"),
        F.col("path.service_information").alias("service"), F.col("path.attribute_template").alias("template"), "support",
        F.col("distinct_exact_paths").alias("paths"), F.array_join("generalized_fields", ",").alias("fields"), F.array_join(rule, ",").alias("rules"),
    )


#: Days of the month up to which a memory is learnt; the later ones are decided.
_KNOWN_DAYS = 15


@query(f"""WITH {_FLOWS}, s AS (SELECT *, day(ts) <= {_KNOWN_DAYS} AS old FROM f),
p AS (SELECT l1, l2, l3, l4, l5, l6, net, count(*) AS n FROM s WHERE old GROUP BY ALL),
g AS (SELECT l2, net, l4, l5, sum(n)::BIGINT AS support, count(*) AS paths, count(DISTINCT l3) AS n3, count(DISTINCT l6) AS n6, min(l3) AS o3, min(l6) AS o6 FROM p GROUP BY ALL),
h AS (SELECT s.object_id, p.n AS exact, g.support AS general,
  (SELECT max(1) FROM p q WHERE q.l2 = s.l2) AS d2, (SELECT max(1) FROM p q WHERE q.l2 = s.l2 AND q.l3 = s.l3) AS d3,
  (SELECT max(1) FROM p q WHERE q.l2 = s.l2 AND q.l3 = s.l3 AND q.l4 = s.l4) AS d4, (SELECT max(1) FROM p q WHERE q.l2 = s.l2 AND q.l3 = s.l3 AND q.l4 = s.l4 AND q.l5 = s.l5) AS d5
  FROM s LEFT JOIN p ON p.l2 = s.l2 AND p.l3 = s.l3 AND p.l4 = s.l4 AND p.l5 = s.l5 AND p.l6 = s.l6
  LEFT JOIN g ON g.l2 = s.l2 AND g.net = s.net AND g.l4 = s.l4 AND g.l5 = s.l5 AND g.paths > 1 AND (n3 > 1 OR s.l3 = o3) AND (n6 > 1 OR s.l6 = o6) WHERE NOT old)
SELECT object_id, CASE WHEN exact IS NOT NULL OR general IS NOT NULL THEN 'filter' ELSE 'forward' END AS decision, coalesce(exact, general, 0) AS support,
 CASE WHEN exact IS NOT NULL THEN 'verified_benign_exact_match' WHEN general IS NOT NULL THEN 'verified_benign_generalized_match'
  ELSE 'hat_path_not_found:' || CASE WHEN d2 IS NULL THEN 'alert_semantics' WHEN d3 IS NULL THEN 'source_entity' WHEN d4 IS NULL THEN 'target_entity' WHEN d5 IS NULL THEN 'service_information' ELSE 'attribute_template' END END AS reason FROM h""")
def memory_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later objects against a memory of earlier ones: exact, generalised or forwarded with the first layer that is new."""
    rows = _flows(spark, sf_dir)
    old = F.dayofmonth("start_ts") <= _KNOWN_DAYS
    known = materialize(memory.learn(rows.filter(old)), "fingerprints")
    return memory.decide(rows.filter(~old), known).select("object_id", "decision", "support", "reason")


@query(f"WITH {_FLOWS} SELECT object_id, l2 AS semantics, 'tcp' AS protocols, CASE WHEN l5 = '<NULL>' THEN '' ELSE l5 END AS services, '{{\"command\":\"job <NUMBER> done\"}}' AS template FROM f WHERE l5 <> '<NULL>'")
def graph_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.with_pattern(_flows(spark, sf_dir).filter(F.size("services") > 0))
    join = lambda c: F.array_join(f"pattern.{c}", ",").alias(c)
    return found.select("object_id", "pattern.semantics", join("protocols"), join("services"), "pattern.template")


@query(f"""WITH {_FLOWS} SELECT f.object_id, l2 AS semantics, CASE WHEN e.k % 7 = 0 THEN 'udp' WHEN l5 = '<NULL>' THEN '' ELSE 'tcp' END AS protocols, CASE WHEN l5 = '<NULL>' THEN '' ELSE l5 END AS services,
 CASE WHEN e.k % 5 = 0 THEN '<NULL>' ELSE '{{"command":"job <NUMBER> done"}}' END AS template FROM f JOIN e USING (event_id)""")
def whole_graph_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of all objects: without services, with a protocol of their own, and without a payload."""
    k = F.regexp_extract("attributes", "job ([0-9]+)", 1).cast("int") - 1_000_000
    own = F.when(k % 7 == 0, F.lit(',"protocol":"UDP"')).otherwise("")
    payload = F.when(k % 5 == 0, F.lit('{"payload_fields":{}')).otherwise(F.concat(F.lit('{"payload_fields":{"command":"job '), (1_000_000 + k).cast("string"), F.lit(' done"}')))
    found = scoring.with_pattern(_flows(spark, sf_dir).withColumn("attributes", F.concat(payload, own, F.lit("}"))))
    join = lambda c: F.array_join(f"pattern.{c}", ",").alias(c)
    return found.select("object_id", "pattern.semantics", join("protocols"), join("services"), "pattern.template")


@query(f"WITH {_FLOWS} SELECT l2 || '/' || l3 || '/' || l4 || '/' || l5 || '/' || l6 AS path, count(*) AS support FROM f GROUP BY 1")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory.with_path(_flows(spark, sf_dir)).select("path.*")
    found = memory.tree_paths(memory.prefix_tree(rows))
    return found.select(F.array_join(F.slice("path", 2, 5), "/").alias("path"), "support")


@query(f"SELECT 'ev-' || lpad(event_id::VARCHAR, 12, '0') AS object_id, {_case(['' if '"source_port"' not in r[1] else '443' for r in RULES])} AS source, "
       + _case(["50001" if '"destination_port":"50001"' in r[1] else "80,9,x" if "dest_port" in r[1] else r[7] for r in RULES]) + f" AS destination, CASE WHEN {_case([r[3] for r in RULES])} = 'brute_force' THEN 'brute_force' END AS category FROM events")
def node_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports of graph nodes on both sides, and the category that only tells brute force."""
    rows = classify.with_evidence(_made_alerts(spark, sf_dir)).withColumns(
        {"object_type": F.lit("alert"), "object_id": F.col("alert_id"), "services": F.array("service"), "category": classify.brute_force_category()}
    )
    text = lambda role: F.array_join(scoring.ports(role), ",").alias(role)
    return rows.select("object_id", text("source"), text("destination"), "category")


@query(f"WITH {_FLOWS} SELECT l2 AS semantics, CASE WHEN l5 = '<NULL>' THEN '' ELSE 'tcp/80' END AS services, count(*) AS n FROM f GROUP BY ALL")
def coarse_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knowledge.with_coarse_key(scoring.with_pattern(_flows(spark, sf_dir)))
    keys = rows.groupBy("coarse_key").agg(F.count(F.lit(1)).alias("n"))
    return keys.select("coarse_key.semantics", F.array_join("coarse_key.services", ",").alias("services"), "n")


@query(f"WITH {_EVENTS} SELECT CASE WHEN k % 2 = 0 THEN 'webids-ids_dolog' ELSE 'webids-webattack_dolog' END AS log_type, count(*) AS n FROM e WHERE k % 3 <> 0 GROUP BY 1")
def vendor_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("k") % 3 == 0, "other_log").when(F.col("k") % 2 == 0, "webids-ids_dolog").otherwise("webids-webattack_dolog")
    rows = normalize.extract_vendor_rows(jsonl.parse_objects(_lines(_events(spark, sf_dir), _json(log_type=kind))))
    return rows.groupBy(F.try_variant_get("raw", "$.log_type", "string").alias("log_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FLOWS}, n AS (SELECT object_id, l3 AS entity, 'source' AS role FROM f UNION SELECT object_id, unnest(CASE WHEN l4 = '<MULTIPLE>' THEN ['a', 'b'] ELSE [l4] END), 'target' FROM f)
SELECT 'graph_alert_nodes' AS name, count(*) AS rows FROM f UNION ALL SELECT 'graph_alert_entity_edges', count(*) FROM n UNION ALL SELECT 'graph_entity_nodes', count(DISTINCT entity) FROM n
UNION ALL SELECT 'graph_alert_services', count(*) FROM f WHERE l5 <> '<NULL>' UNION ALL SELECT 'graph_member_edges', count(*) FROM f UNION ALL SELECT 'graph_original_alerts', count(*) FROM f
UNION ALL SELECT 'graph_metadata', 1 UNION ALL SELECT 'graph_scores', count(*) FROM f""")
def graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every table of the graph store, checked for their references."""
    rows = _flows(spark, sf_dir).withColumn("member_ids", F.array("object_id"))
    scored = scoring.score(scoring.with_pattern(rows))
    tables = scoring.graph_tables(rows, rows.select(F.col("object_id").alias("alert_id")), scored)
    # what is made by joins is read by the check and by the counts
    tables |= {name: materialize(tables[name], name) for name in ("graph_original_alerts", "graph_scores")}
    scoring.validate_graph(tables)
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects between addresses and stores, with a command that holds a number and a level."""
    text = lambda c: F.expr(c).cast("string")
    command = F.concat(F.lit('{"payload_fields":{"command":"run '), text("1000000 + o_orderkey"), F.lit(' fast","level":"'), F.substring("o_orderpriority", 1, 1), F.lit('"}}'))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.lit("alert").alias("object_type"),
        F.col("o_orderkey").cast("string").alias("object_id"),
        F.lit("orders").alias("alert_source"),
        F.col("o_orderstatus").alias("alert_semantics"),
        F.array(F.concat(F.lit("10."), text("o_custkey % 4"), F.lit("."), text("o_custkey % 7"), F.lit("."), text("o_custkey % 250"))).alias("sources"),
        F.array(F.concat(F.lit("store-"), text("o_custkey % 5"))).alias("targets"),
        F.array(F.concat(F.lit("tcp/"), text("o_orderkey % 3"))).alias("services"),
        command.alias("attributes"),
    )


_SHIPMENTS = """o AS (SELECT o_orderkey::VARCHAR AS object_id, o_orderstatus AS l2, o_custkey AS c, o_orderkey % 3 AS service, left(o_orderpriority, 1)::INT AS level FROM orders)"""


@query(f"""WITH {_SHIPMENTS},
g AS (SELECT s_suppkey AS k, (['O', 'F', 'P'])[s_suppkey % 3 + 1] AS l2, CASE WHEN s_suppkey % 2 = 0 THEN '10.' || (s_suppkey % 4) || '.0.0/16' ELSE '10.' || (s_suppkey % 4) || '.' || (s_suppkey % 7) || '.0/24' END AS net,
  CASE WHEN s_suppkey % 5 < 3 THEN '{{"command":"run  fast","level":"' || (s_suppkey % 5 + 1) || '"}}' ELSE '{{"command":"run  fast","level":""}}' END AS literal FROM supplier),
m AS (SELECT o.object_id, g.k, length('orders' || g.l2 || net || 'store-0' || 'tcp/0' || literal) AS score FROM o JOIN g ON g.l2 = o.l2 AND o.c % 5 = g.k % 5 AND o.service = g.k % 3
  AND o.c % 4 = g.k % 4 AND (g.k % 2 = 0 OR o.c % 7 = g.k % 7) AND (g.k % 5 >= 3 OR o.level = g.k % 5 + 1)),
b AS (SELECT object_id, max(score) AS score FROM m GROUP BY object_id),
n AS (SELECT m.object_id, count(*) AS n, min(m.k) AS k FROM m JOIN b USING (object_id, score) GROUP BY m.object_id)
SELECT o.object_id, CASE WHEN n.n = 1 THEN 'filter' ELSE 'forward' END AS decision, CASE WHEN n.n = 1 THEN 'pattern-' || n.k END AS fingerprint_id, CASE WHEN n.n = 1 THEN n.k + 2 ELSE 0 END::BIGINT AS support,
  CASE WHEN n.n = 1 THEN 'verified_benign_generalized_match' WHEN n.n > 1 THEN 'ambiguous_generalized_match' ELSE 'hat_path_not_found:alert_source' END AS reason
FROM o LEFT JOIN n USING (object_id)""")
def competing_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern for each supplier, over networks of two widths and with one or two numbers: the single most specific one decides,
    two of equal rank none."""
    k = F.col("s_suppkey")
    text = lambda c: F.expr(c).cast("string")
    wide = F.concat(F.lit("10."), text("s_suppkey % 4"), F.lit(".0.0/16"))
    net = F.when(k % 2 == 0, wide).otherwise(F.concat(F.lit("10."), text("s_suppkey % 4"), F.lit("."), text("s_suppkey % 7"), F.lit(".0/24")))
    level = F.when(k % 5 < 3, text("s_suppkey % 5 + 1")).otherwise("<NUMBER>")
    rule = lambda i: F.struct(F.lit("attribute_template").alias("layer"), F.lit(i).alias("occurrence"), F.lit("<NUMBER>").alias("placeholder"), F.array(F.lit("number:digits")).alias("accepted_shapes"))
    layers = (
        F.lit("orders"), F.element_at(F.array(F.lit("O"), F.lit("F"), F.lit("P")), (k % 3 + 1).cast("int")), net, F.concat(F.lit("store-"), text("s_suppkey % 5")),
        F.concat(F.lit("tcp/"), text("s_suppkey % 3")), F.concat(F.lit('{"command":"run <NUMBER> fast","level":"'), level, F.lit('"}')),
    )
    patterns = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("pattern-"), k.cast("string")).alias("fingerprint_id"),
        F.struct(*[c.alias(n) for c, n in zip(layers, memory.LAYERS, strict=True)]).alias("path"),
        F.lit("generalized").alias("kind"), (k + 2).cast("long").alias("support"), F.lit(2).alias("distinct_exact_paths"), F.lit(True).alias("active"), F.lit(True).alias("verified"),
        F.lit(None).cast("timestamp").alias("expires_at"), F.array(F.lit("source_entity"), F.lit("attribute_template")).alias("generalized_fields"),
        F.when(k % 5 < 3, F.array(rule(0))).otherwise(F.array(rule(0), rule(1))).alias("constraints"), F.lit("").alias("digest"),
    )
    return memory.decide(_shipments(spark, sf_dir), patterns)


@query(f"""WITH {_FLOWS}, p AS (SELECT l2, l3, l4, l5, l6, count(*) AS n, length(l3 || l6) % 4 AS state FROM f GROUP BY ALL)
SELECT f.object_id, CASE WHEN p.state > 0 AND f.k % 5 > 0 AND p.n >= 2 AND p.state > 2 THEN 'filter' ELSE 'forward' END AS decision,
 CASE WHEN f.k % 5 = 0 THEN 'protected_high_frequency_behavior:brute_force' WHEN p.state = 0 THEN 'inactive_fingerprint' WHEN p.state = 1 THEN 'unverified_fingerprint' WHEN p.state = 2 THEN 'expired_fingerprint'
  WHEN p.n < 2 THEN 'insufficient_support' ELSE 'verified_benign_exact_match' END AS reason
FROM (SELECT f.*, e.k FROM f JOIN e USING (event_id)) f JOIN p ON p.l2 = f.l2 AND p.l3 = f.l3 AND p.l4 = f.l4 AND p.l5 = f.l5 AND p.l6 = f.l6""")
def fingerprint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known paths whose fingerprints are inactive, unverified, expired or seen too seldom, and behaviour that is never filtered."""
    rows = _flows(spark, sf_dir)
    k = F.regexp_extract("attributes", "job ([0-9]+)", 1).cast("int") - 1_000_000
    rows = rows.withColumn("statistics", F.struct(F.when(k % 5 == 0, "brute_force").alias("behavior_category")))
    known = materialize(memory.learn(rows), "fingerprints").filter("kind = 'exact'")
    state = F.length(F.concat("path.source_entity", "path.attribute_template")) % 4
    known = known.withColumns({"active": state != 0, "verified": state != 1, "expires_at": F.when(state == 2, F.lit("2020-01-01").cast("timestamp"))})
    return memory.decide(rows, known, least_support=2).select("object_id", "decision", "reason")


def _merged(spark: SparkSession, sf_dir: str, provenance_limit: int = 1000) -> memory.Memory:
    """Three memories of parts of the flows, merged one by one: the first days, later days, and what is left of all days."""
    rows = _flows(spark, sf_dir)
    part = F.when(F.xxhash64("object_id") % 5 == 0, 2).otherwise((F.dayofmonth("start_ts") > _KNOWN_DAYS).cast("int"))
    known = [memory.remember(rows.filter(part == k), provenance_limit=provenance_limit) for k in range(3)]
    return memory.merge(memory.merge(known[0], known[1]), known[2])


@query(ORACLES["generalized_patterns"])
def merged_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of memories that were learnt apart and merged."""
    return _told_patterns(memory.fingerprints(_merged(spark, sf_dir)))


@query(f"""WITH {_FLOWS}, p AS (SELECT l1, l2, l3, l4, l5, l6, count(*) AS support, list(object_id ORDER BY ts, object_id) AS ids FROM f GROUP BY ALL)
SELECT {_DIGEST} AS digest, support, array_to_string(ids[-2:], ',') AS provenance, support > 2 AS truncated FROM p""")
def merged_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact fingerprints of merged memories: supports add up and the last ids stay."""
    found = memory.fingerprints(_merged(spark, sf_dir, 2)).filter("kind = 'exact'")
    return found.select("digest", "support", F.array_join("provenance", ",").alias("provenance"), F.col("provenance_truncated").alias("truncated"))


_TUNNELS = f"""WITH RECURSIVE {_EVENTS}, d AS (SELECT 'user-' || user_id % 10 AS s, epoch_us(ts) AS t, k % 3 = 0 AS enc, CASE WHEN k % 3 = 0 THEN k % 2 ELSE k % 4 END AS d,
  row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM e),
r AS (SELECT s, n, t, enc, d, CASE WHEN enc AND d = 0 THEN t END AS f0, CASE WHEN enc AND d = 0 THEN t END AS l0, CASE WHEN enc AND d = 1 THEN t END AS f1, CASE WHEN enc AND d = 1 THEN t END AS l1, enc AS joined FROM d WHERE n = 1
  UNION ALL SELECT x.s, x.n, x.t, x.enc, x.d,
    CASE WHEN x.d = 0 AND x.enc AND NOT x.go THEN x.t ELSE x.f0 END, CASE WHEN x.d = 0 AND (x.enc OR x.go) THEN x.t ELSE x.l0 END,
    CASE WHEN x.d = 1 AND x.enc AND NOT x.go THEN x.t ELSE x.f1 END, CASE WHEN x.d = 1 AND (x.enc OR x.go) THEN x.t ELSE x.l1 END, x.enc OR x.go
  FROM (SELECT d.s, d.n, d.t, d.enc, d.d, r.f0, r.l0, r.f1, r.l1, coalesce(CASE d.d WHEN 0 THEN d.t - r.l0 <= {GAP}000000 AND d.t - r.f0 <= {CAP}000000
    WHEN 1 THEN d.t - r.l1 <= {GAP}000000 AND d.t - r.f1 <= {CAP}000000 END, false) AS go FROM r JOIN d ON d.s = r.s AND d.n = r.n + 1) x)
SELECT s AS source, 'encoded_subdomain:evil' || d || '.com' AS family, CASE d WHEN 0 THEN f0 ELSE f1 END AS start_us, max(t) AS end_us, count(*)::INTEGER AS members FROM r WHERE joined GROUP BY s, d, 3 HAVING count(*) > 1"""


@query(_TUNNELS)
def tunnel_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of encoded DNS names and of the plain names of the same domain that continue them."""
    text = lambda c: c.cast("string")
    k = F.col("k")
    name = F.when(k % 3 == 0, F.concat(F.lit("12x3-.4-.data.evil"), text(k % 2), F.lit(".com"))).otherwise(F.concat(F.lit("x.evil"), text(k % 4), F.lit(".com")))
    rows = _events(spark, sf_dir).select(
        F.concat(F.lit("ev-"), F.lpad(text(F.col("event_id")), 12, "0")).alias("alert_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("events").alias("alert_source"),
        F.lit("odd dns").alias("alert_semantics"),
        F.concat(F.lit("user-"), text(F.col("user_id") % 10)).alias("source_entity"),
        F.lit("resolver").alias("target_entity"),
        F.lit("dns/53").alias("service"),
        F.concat(F.lit('{"payload_fields":{"dns":{"rrname":"'), name, F.lit('"}},"protocol":"dns"}')).alias("attributes"),
    )
    metas = sessions.aggregate_sessions(rows, GAP, CAP).filter("object_type = 'meta_alert'")
    return metas.select(
        F.element_at("sources", 1).alias("source"), F.col("statistics.behavior_family").alias("family"), F.unix_micros("start_ts").alias("start_us"),
        F.unix_micros("end_ts").alias("end_us"), F.col("statistics.member_count").alias("members"),
    )


@query(f"""WITH {_EVENTS} SELECT event_id, CASE k % 5 WHEN 0 THEN '10.0.0.' || user_id % 250 WHEN 1 THEN '10.1.0.' || user_id % 250 WHEN 2 THEN 'user-' || user_id WHEN 3 THEN '<NULL>' ELSE '2001:db8::' || user_id % 100 END AS source FROM e""")
def log_line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of alerts that name none themselves: the first address that a raw line begins with or tells as its client."""
    text = lambda c: F.expr(c).cast("string")
    k = F.col("k") % 5
    lines = (
        F.when(k == 0, F.concat(F.lit('"raw_log_data":["no address","10.0.0.'), text("user_id % 250"), F.lit(' - - GET /","10.9.9.9 - - GET /"]')))
        .when(k == 1, F.concat(F.lit('"full_log":"denied [client 10.1.0.'), text("user_id % 250"), F.lit(':443] AH01630"')))
        .when(k == 3, F.lit('"raw_log_data":["999.1.1.1 - - GET /","plain text 10.2.0.1"]'))
        .when(k == 4, F.concat(F.lit('"raw_log_data":["2001:db8::'), text("user_id % 100"), F.lit(' - - GET /"]')))
        .otherwise(F.lit('"raw_log_data":["10.3.0.1 - - GET /"]'))
    )
    rows = _events(spark, sf_dir).select(
        "event_id", F.col("event_type").alias("alert_semantics"), F.lit("tcp/80").alias("service"), F.concat(F.lit('{"payload_fields":{'), lines, F.lit("}}")).alias("attributes"),
        F.when(k == 2, F.concat(F.lit("user-"), text("user_id"))).when(k == 1, "").alias("source_entity"),
    )
    return classify.with_evidence(rows).select("event_id", F.col("_source").alias("source"))
