"""Detector records to the alert schema, label-free.

alerts: alert_id, ts, alert_source, alert_semantics, source_entity, target_entity, service, attributes
(JSON text, keys sorted), raw_reference. The evaluation label stays beside them in `label`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions import markers as M
from alertloom.functions.text import clean, contains_any, stable_id
from alertloom.session import materialize
from alertloom.sources.jsonl import first_value, once

_EVE = "/var/log/suricata/eve.json"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def iso_timestamp(text: Column) -> Column:
    """ISO time with an offset; one without ends the job."""
    good = F.coalesce(text.rlike(_OFFSET), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("timestamp without a zone: "), F.coalesce(text, F.lit("null")))).cast("timestamp")
    return F.when(good, F.to_timestamp(text)).otherwise(bad)


def zoned_timestamp(text: Column, zone: str) -> Column:
    """ISO time; without an offset it is of the given zone."""
    local = F.to_utc_timestamp(F.to_timestamp_ntz(text).cast("timestamp"), zone)
    return F.when(text.rlike(_OFFSET), F.to_timestamp(text)).otherwise(local)


def epoch_timestamp(seconds: Column) -> Column:
    """Seconds with a fraction, rounded half to even at microseconds."""
    whole = F.floor(seconds)
    return F.timestamp_micros((whole * 1_000_000 + F.rint((seconds - whole) * 1_000_000)).cast("long"))


def _object(**fields: Column) -> Column:
    """A variant of the fields that aren't null, named and sorted."""
    return F.parse_json(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))


def _without_empty(**fields: Column) -> Column:
    """As _object, without empty texts, arrays and objects."""
    empty = ('""', "[]", "{}")
    return _object(**{k: F.when(~F.coalesce(F.to_json(v).isin(*empty) if k in _NESTED else v == "", F.lit(False)), v) for k, v in fields.items()})


#: Fields that hold any JSON value.
_NESTED = ("appid", "packet_size", "response_status", "severity", "confidence", "payload_fields")


def _part(raw: Column, path: str) -> Column:
    """A nested value; JSON null is null."""
    v = F.try_variant_get(raw, path, "variant")
    return F.when(~F.is_variant_null(v), v)


def _text(raw: Column, path: str) -> Column:
    return clean(F.try_variant_get(raw, path, "string"))


def _port_service(protocol: Column, port: Column) -> Column:
    return F.when(port.isNotNull(), F.concat(F.coalesce(protocol, F.lit("unknown")), F.lit("/"), port)).otherwise(protocol)


def _record(records: DataFrame, detector: Column, cols: dict[str, Column], attributes: Column) -> DataFrame:
    where = F.concat_ws(":", "source_file", F.col("source_line").cast("string"))
    ident = F.concat(
        F.lit("ait-"), detector, F.lit("-"), F.substring(F.sha2(F.concat_ws(":", where, detector), 256), 1, 24)
    )
    return records.select(
        ident.alias("alert_id"),
        cols["ts"].alias("ts"),
        detector.alias("alert_source"),
        cols["semantics"].alias("alert_semantics"),
        cols["source"].alias("source_entity"),
        cols["target"].alias("target_entity"),
        cols["service"].alias("service"),
        F.to_json(attributes).alias("attributes"),
        where.alias("raw_reference"),
        _text(F.col("raw"), "$.label").alias("label"),
        "source_file",
        "source_line",
    )


def normalize_wazuh(records: DataFrame) -> DataFrame:
    raw = F.col("raw")
    t = lambda path: _text(raw, path)
    eve = F.coalesce(t("$.location") == _EVE, F.lit(False))
    detector = F.when(eve, "suricata").otherwise("wazuh")
    description = t("$.rule.description")
    protocol = clean(first_value(raw, "$.data.app_proto", "$.data.proto", "$.data.protocol"))
    port = clean(first_value(raw, "$.data.dest_port", "$.data.dstport"))
    eve_payload = _object(
        **{k: _part(raw, f"$.data.{k}") for k in ("http", "dns", "tls", "files", "smtp", "ssh")},
        raw_payload=_part(raw, "$.data.payload"),
        packet=_part(raw, "$.data.packet"),
    )
    log_payload = _object(
        full_log=_part(raw, "$.full_log"),
        previous_output=_part(raw, "$.previous_output"),
        url=_part(raw, "$.data.url"),
        command=F.coalesce(first_value(raw, "$.data.command"), F.try_variant_get(raw, "$.data.audit.command", "string")),
        audit_executable=_part(raw, "$.data.audit.exe"),
        source_user=_part(raw, "$.data.srcuser"),
        target_user=_part(raw, "$.data.dstuser"),
    )
    attributes = _object(
        rule_id=t("$.rule.id"),
        severity=F.coalesce(
            F.when(first_value(raw, "$.data.alert.severity").isNotNull(), _part(raw, "$.data.alert.severity")), _part(raw, "$.rule.level")
        ),
        rule_groups=_part(raw, "$.rule.groups"),
        location=t("$.location"),
        decoder=t("$.decoder.name"),
        protocol=protocol,
        source_port=clean(first_value(raw, "$.data.src_port", "$.data.srcport")),
        destination_port=port,
        signature_id=t("$.data.alert.signature_id"),
        alert_category=t("$.data.alert.category"),
        http_method=F.coalesce(t("$.data.http.http_method"), t("$.data.protocol")),
        url=F.coalesce(t("$.data.http.url"), t("$.data.url")),
        user_agent=t("$.data.http.http_user_agent"),
        payload=t("$.full_log"),
        payload_fields=F.when(eve, eve_payload).otherwise(log_payload),
    )
    cols = {
        "ts": iso_timestamp(clean(first_value(raw, "$['@timestamp']", "$.data.timestamp"))),
        "semantics": F.coalesce(F.when(eve, t("$.data.alert.signature")), description, F.lit("unknown alert")),
        "source": clean(first_value(raw, "$.data.src_ip", "$.data.srcip", "$.data.src_ip_addr")),
        "target": F.coalesce(clean(first_value(raw, "$.data.dest_ip", "$.data.dstip", "$.data.dst_ip")), t("$.agent.ip")),
        "service": _port_service(protocol, port),
    }
    return _record(records, detector, cols, attributes)


def normalize_aminer(records: DataFrame) -> DataFrame:
    raw = F.col("raw")
    t = lambda path: _text(raw, path)
    seconds = F.try_variant_get(raw, "$.LogData.Timestamps[0]", "double")
    ts = F.when(seconds.isNotNull(), epoch_timestamp(seconds)).otherwise(
        F.raise_error(F.lit("record has no LogData.Timestamps[0]")).cast("timestamp")
    )
    has_resource = F.try_variant_get(raw, "$.LogData.LogResources[0]", "variant").isNotNull()
    service = F.when(has_resource, t("$.LogData.LogResources[0]")).otherwise(t("$.AnalysisComponent.AnalysisComponentType"))
    part = lambda name: _part(raw, f"$.AnalysisComponent.{name}")
    attributes = _object(
        component_type=t("$.AnalysisComponent.AnalysisComponentType"),
        component_id=part("AnalysisComponentIdentifier"),
        message=t("$.AnalysisComponent.Message"),
        affected_paths=part("AffectedLogAtomPaths"),
        affected_values=part("AffectedLogAtomValues"),
        training_mode=part("TrainingMode"),
        log_resource=service,
        payload=t("$.LogData.RawLogData[0]"),
        payload_fields=_object(
            raw_log_data=_part(raw, "$.LogData.RawLogData"),
            message=part("Message"),
            affected_paths=part("AffectedLogAtomPaths"),
            affected_values=part("AffectedLogAtomValues"),
        ),
    )
    cols = {
        "ts": ts,
        "semantics": F.coalesce(t("$.AnalysisComponent.AnalysisComponentName"), F.lit("unknown AMiner alert")),
        "source": F.lit(None).cast("string"),
        "target": t("$.AMiner.ID"),
        "service": service,
    }
    return _record(records, F.lit("aminer"), cols, attributes)


def normalize(records: DataFrame) -> DataFrame:
    """Dispatch by detector: records with AMiner and LogData, and the rest."""
    has = lambda path: F.try_variant_get("raw", path, "variant").isNotNull()
    aminer = has("$.AMiner") & has("$.LogData")
    return normalize_aminer(records.filter(aminer)).unionByName(normalize_wazuh(records.filter(~aminer)))


#: Fields of a vendor's row that are read as texts.
_VENDOR_TEXTS = (
    "log_type", "attack_type", "vuln_type", "attack_method", "method", "host", "uri", "parameter", "req_body", "rsp_content_type", "proto", "dport", "sport",
    "rule_id", "rule_name", "detail_info", "@timestamp", "uuid", "sip", "dip",
)


def behaviour_hint(text: Callable[[str], Column]) -> Column:
    """English hint for the vendor's Chinese texts; text gives a field's."""
    fields = ("rule_name", "attack_type", "vuln_type", "detail_info")
    evidence = F.lower(F.concat_ws(" ", *map(text, fields)))
    out = F.when(F.lit(False), "")
    for hint, marks in M.VENDOR_HINTS:
        out = out.when(contains_any(evidence, marks), hint)
    return out


def normalize_vendor(records: DataFrame, zone: str = "Asia/Shanghai", vendor: str = "vendor") -> DataFrame:
    """Vendor IDS rows, ids and sources under the vendor's name; the truth stays in is_attack. Other log types, missing times and labels end the job."""
    raw = F.col("raw")
    # every text is read once a row; as plain expressions the many readers would copy its reading
    texts = F.struct(*[_text(raw, f"$['{f}']").alias(f) for f in _VENDOR_TEXTS])
    records = once(records.withColumn("_texts", texts), "_texts")
    t = lambda path: F.col("_texts")[path.removeprefix("$.")]
    kind = F.when(F.lit(False), "")
    for log_type, category in M.VENDOR_LOG_TYPES:
        kind = kind.when(t("$.log_type") == log_type, category)
    records = once(records.withColumn("_kind", F.coalesce(kind, F.raise_error(F.lit("unsupported log_type")).cast("string"))), "_kind")
    kind = F.col("_kind")
    cut = lambda f, n: F.nullif(F.substring(t(f"$.{f}"), 1, n), F.lit(""))
    network = _without_empty(
        attack_type=cut("attack_type", 512),
        vuln_type=cut("vuln_type", 512),
        attack_method=cut("attack_method", 512),
        appid=_part(raw, "$.appid"),
        packet_size=_part(raw, "$.packet_size"),
    )
    web = _without_empty(
        method=cut("method", 32),
        host=cut("host", 1024),
        uri=cut("uri", 4096),
        parameter=cut("parameter", 4096),
        request_body=cut("req_body", 4096),
        response_status=_part(raw, "$.rsp_status"),
        content_type=cut("rsp_content_type", 512),
    )
    records = once(records.withColumn("_payload", F.when(kind == "network_ids", network).otherwise(web)), "_payload")
    records = once(records.withColumn("_hint", behaviour_hint(t)), "_hint")
    payload = F.col("_payload")
    protocol, port = t("$.proto"), t("$.dport")
    attributes = _without_empty(
        rule_id=t("$.rule_id"),
        severity=_part(raw, "$.severity"),
        confidence=_part(raw, "$.confidence"),
        protocol=protocol,
        source_port=t("$.sport"),
        destination_port=port,
        attack_type=t("$.attack_type"),
        vuln_type=t("$.vuln_type"),
        attack_method=t("$.attack_method"),
        behavior_hint=F.col("_hint"),
        payload_fields=F.when(F.to_json(payload) != "{}", payload),
    )
    truth = F.try_variant_get(raw, "$.is_attack", "string")
    label = (
        F.when(truth.isin("1", "true"), True)
        .when(truth.isin("0", "false"), False)
        .otherwise(F.raise_error(F.lit("is_attack must be 0 or 1")).cast("boolean"))
    )
    stamp = F.coalesce(t("@timestamp"), F.raise_error(F.lit("alert has no @timestamp")).cast("string"))
    where = F.concat_ws(":", "source_file", F.col("source_line").cast("string"))
    material = F.concat_ws(":", where, kind, F.coalesce(t("$.uuid"), F.lit("")))
    found = records.select(
        F.concat(F.lit(f"{vendor}-"), kind, F.lit("-"), F.substring(F.sha2(material, 256), 1, 32)).alias("alert_id"),
        zoned_timestamp(stamp, zone).alias("ts"),
        F.concat(F.lit(f"{vendor}_"), kind).alias("alert_source"),
        F.coalesce(t("$.rule_name"), t("$.attack_type"), F.lit(f"unknown {vendor} alert")).alias("alert_semantics"),
        t("$.sip").alias("source_entity"),
        t("$.dip").alias("target_entity"),
        _port_service(protocol, port).alias("service"),
        F.to_json(attributes).alias("attributes"),
        where.alias("raw_reference"),
        label.alias("is_attack"),
        "source_file",
        "source_line",
    )
    return once(found, "attributes")


def extract_vendor_rows(items: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of a vendor export whose log type is an IDS one."""
    kept = items.filter(F.try_variant_get("raw", "$.log_type", "string").isin(*[x for x, _ in M.VENDOR_LOG_TYPES]))
    return kept if most is None else kept.orderBy("source_line").limit(most)


def write_vendor_rows(items: DataFrame, path: str, most: int | None = None) -> dict[str, int]:
    """Writes the IDS rows of an export as JSON lines in their order, all or none, and returns their number by log type."""
    rows = materialize(extract_vendor_rows(items, most), "vendor-rows")
    rows.sort("source_file", "source_line").select(F.to_json("raw").alias("value")).write.mode("overwrite").text(path)
    counts = rows.groupBy(F.try_variant_get("raw", "$.log_type", "string").alias("log_type")).count().collect()
    return {r["log_type"]: r["count"] for r in counts}
