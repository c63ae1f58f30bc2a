"""Benign memory: six-layer paths, prefix tree, exact and generalised fingerprints, decisions."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.functions import shapes
from alertloom.functions.templates import payload_template
from alertloom.functions.text import uuid5
from alertloom.operators.pattern_index import candidate_pairs
from alertloom.session import materialize
from alertloom.sources.versions import current, publish

VERSION = 1
LAYERS = ("alert_source", "alert_semantics", "source_entity", "target_entity", "service_information", "attribute_template")
NULL, MULTIPLE = "<NULL>", "<MULTIPLE>"
PROTECTED = ("brute_force", "dns_tunnel", "denial_of_service")
_RULE = "array<struct<layer:string,occurrence:int,placeholder:string,accepted_shapes:array<string>>>"


def _layer(value: Column) -> Column:
    """NFKC, white space squeezed, blank as <NULL>. Plain ASCII stays on built-in expressions."""

    @F.pandas_udf("string")
    def unicode_form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) or NULL)

    text = value.cast("string")
    ascii_form = F.coalesce(F.nullif(F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " ")), F.lit("")), F.lit(NULL))
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, unicode_form(F.when(odd, text))).otherwise(ascii_form)


def _subnet(value: Column, v4: int | None, v6: int | None) -> Column:
    """Entity with IP addresses as subnets of the asked lengths. Equal texts of a batch are read once."""
    if v4 is None and v6 is None:
        return value

    @F.pandas_udf("string")
    def network(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                ip = ipaddress.ip_address(t)
            except ValueError:
                return t
            bits = v4 if ip.version == 4 else v6
            return t if bits is None else str(ipaddress.ip_network((ip, bits), strict=False))

        made = {t: one(t) for t in set(texts)}
        return texts.map(made.get)

    return network(value)


def with_path(objects: DataFrame, name: str = "path", generalize: bool = False, v4: int | None = None, v6: int | None = None) -> DataFrame:
    """Adds a struct of the six layers. Sets of several entities or services are <MULTIPLE>."""
    one = lambda c: F.when(F.size(c) == 0, NULL).when(F.size(c) == 1, F.element_at(c, 1)).otherwise(MULTIPLE)
    raw = payload_template(F.col("attributes"), generalize)
    if "statistics" in objects.columns:
        stable = F.to_json(
            F.struct(
                *[
                    F.col(f"statistics.{f}").alias(f)
                    for f in sorted(
                        f for f in objects.schema["statistics"].dataType.names
                        if f.endswith("_bucket") or f.startswith(("member_alert", "behavior", "normalized", "aggregation", "detection", "scan"))
                    )
                ]
            )
        )
        raw = F.when(F.col("object_type") == "meta_alert", stable).otherwise(raw)
    values = (
        _layer(F.col("alert_source")),
        _layer(F.col("alert_semantics")),
        _subnet(_layer(one("sources")), v4, v6),
        _subnet(_layer(one("targets")), v4, v6),
        _layer(one("services")),
        F.coalesce(raw, F.lit("")),
    )
    return objects.withColumn(name, F.struct(*[v.alias(n) for n, v in zip(LAYERS, values, strict=True)]))


def canonical(path: str) -> Column:
    """Canonical JSON of a path; its SHA-256 is the fingerprint's digest."""
    layers = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{path}.{n}").alias("value")) for n in LAYERS])
    return F.to_json(F.struct(layers.alias("layers"), F.lit(1).alias("version")))


def prefix_tree(paths: DataFrame, layers: tuple[str, ...] = LAYERS, count: Column | None = None) -> DataFrame:
    """depth, prefix, support, terminal_support: the nodes of a prefix tree below its root."""
    n = F.lit(1) if count is None else count
    values = F.array(*[F.col(c) for c in layers])
    exploded = paths.select(values.alias("v"), n.alias("n"), F.explode(F.sequence(F.lit(1), F.lit(len(layers)))).alias("depth"))
    return exploded.groupBy("depth", F.slice("v", F.lit(1), F.col("depth")).alias("prefix")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("depth") == len(layers), F.col("n")).otherwise(0)).alias("terminal_support")
    )


def tree_paths(tree: DataFrame, depth: int = len(LAYERS)) -> DataFrame:
    """path, support: the whole paths of a tree in order (a range sort, no single task)."""
    whole = tree.filter((F.col("depth") == depth) & (F.col("terminal_support") > 0))
    return whole.select(F.col("prefix").alias("path"), F.col("terminal_support").alias("support")).orderBy("path")


def tree_summary(tree: DataFrame, depth: int = len(LAYERS)) -> DataFrame:
    """node_count (with the root), path_count, total_support."""
    return tree.agg(
        (F.count(F.lit(1)) + 1).alias("node_count"),
        F.count(F.when(F.col("depth") == depth, 1)).alias("path_count"),
        F.coalesce(F.sum(F.when(F.col("depth") == depth, F.col("support"))), F.lit(0)).alias("total_support"),
    )


def match_tree(paths: DataFrame, tree: DataFrame, ident: str, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """ident, matched_depth, missing_layer, terminal_support: the deepest node each path reaches.

    One join on (depth, prefix); a tree holds every prefix of its paths, so the depths found are contiguous."""
    values = F.array(*[F.col(c) for c in layers])
    probes = paths.select(ident, values.alias("v"), F.explode(F.sequence(F.lit(1), F.lit(len(layers)))).alias("depth")).select(
        ident, "depth", F.slice("v", F.lit(1), F.col("depth")).alias("prefix")
    )
    hits = probes.join(tree, ["depth", "prefix"], "left").groupBy(ident).agg(
        F.coalesce(F.max(F.when(F.col("support").isNotNull(), F.col("depth"))), F.lit(0)).alias("matched_depth"),
        F.coalesce(F.max("terminal_support"), F.lit(0)).alias("terminal_support"),
    )
    names = F.array(*map(F.lit, layers))
    return hits.withColumn("missing_layer", F.try_element_at(names, F.col("matched_depth") + 1))


@dataclass(frozen=True)
class Memory:
    """What is learnt, as tables that can be merged.

    exact: a row for each distinct path and key with support, the last ids that came with their times, and flags;
    groups: what stands at each place of a key's layers, as counts, least and greatest content (see shapes.Group), for keys with several paths;
    general: the pattern of each such key that has one."""

    exact: DataFrame
    groups: DataFrame
    general: DataFrame
    provenance_limit: int

    def tables(self) -> dict[str, DataFrame]:
        return {"exact": self.exact, "groups": self.groups, "general": self.general}


def remember(objects: DataFrame, v4: int = 24, v6: int = 64, provenance_limit: int = 1000) -> Memory:
    """The memory of a batch of objects.

    Paths are grouped before anything is inferred, so the inference sees each distinct path once. Provenance is the
    ids that came last; each of 64 salts of a path offers its last ones, so none gathers all."""
    both = with_path(with_path(objects, "path"), "wide", True, v4, v6)
    wide = F.struct(
        F.col("path.alert_source").alias("alert_source"),
        F.col("path.alert_semantics").alias("alert_semantics"),
        *[F.col(f"wide.{n}").alias(n) for n in LAYERS[2:]],
    )
    came = F.col("start_ts") if "start_ts" in objects.columns else F.lit(None)
    keyed = both.withColumn("wide", wide).select(
        F.sha2(canonical("path"), 256).alias("digest"),
        F.sha2(canonical("wide"), 256).alias("generalization_key"),
        "path",
        "wide",
        F.struct(came.cast("timestamp").alias("ts"), F.col("object_id").alias("id")).alias("of"),
    )
    keyed = materialize(keyed, "keyed-paths")
    own = ["digest", "generalization_key"]
    # whole paths are combined before the shuffle; only ids with their times are ranked
    paths = keyed.groupBy(*own, "path", "wide").agg(F.count(F.lit(1)).alias("support"))
    salted = Window.partitionBy(*own, F.pmod(F.xxhash64("of"), F.lit(64))).orderBy(F.desc("of"))
    ranked = keyed.select(*own, "of").withColumn("_k", F.row_number().over(salted)).filter(F.col("_k") <= provenance_limit)
    ids = ranked.groupBy(*own).agg(_last(F.collect_list("of"), provenance_limit).alias("last"))
    exact = paths.join(ids, own).select(*own, "path", "wide", "support", "last").withColumns({"verified": F.lit(True), "active": F.lit(True)})
    exact = materialize(exact, "exact-paths")
    keys = _keys(exact)
    several = keys.filter("distinct_exact_paths > 1").select("generalization_key")
    groups = materialize(_groups(_values(exact.join(several, "generalization_key", "left_semi"))), "memory-groups")
    return Memory(exact, groups, materialize(_generalized(groups, keys), "memory-general"), provenance_limit)


def merge(old: Memory, new: Memory) -> Memory:
    """The memory of both batches, the same as if they had been learnt at once.

    Only keys that the new batch touches are looked at again, and of those only values that the old one hasn't seen: their groups are
    added to the old ones. Supports add up, the last ids stay by time, and what was made inactive or unverified stays so."""
    if old.provenance_limit != new.provenance_limit:
        raise ValueError("memories of different provenance limits")
    path = ["digest", "generalization_key"]
    exact = (
        old.exact.unionByName(new.exact)
        .groupBy(*path)
        .agg(
            F.first("path").alias("path"), F.first("wide").alias("wide"), F.sum("support").alias("support"), _last(F.flatten(F.collect_list("last")), old.provenance_limit).alias("last"),
            F.bool_and("verified").alias("verified"), F.bool_and("active").alias("active"),
        )
    )
    exact = materialize(exact, "exact-paths")
    touched = materialize(new.exact.select("generalization_key").distinct(), "touched-keys")
    among = lambda df, keys, how="left_semi": df.join(keys, "generalization_key", how)
    keys = materialize(_keys(among(exact, touched)), "memory-keys")
    # a key that had one path so far has no groups yet: all its values are new
    counted = old.groups.select("generalization_key").distinct()
    seen = _values(among(among(old.exact, touched), counted)).select("generalization_key", "layer", "value")
    several = keys.filter("distinct_exact_paths > 1").select("generalization_key")
    fresh = _values(among(exact, several)).join(seen, ["generalization_key", "layer", "value"], "left_anti")
    own = ["generalization_key", "layer", "candidate", "form", "path", "slot"]
    added = among(old.groups, touched).unionByName(_groups(fresh)).groupBy(*own).agg(
        F.sum("n").cast("int").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("fits").alias("fits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("shapes")))).alias("shapes"),
    )
    groups = materialize(among(old.groups, touched, "left_anti").unionByName(added), "memory-groups")
    general = _generalized(among(groups, touched), keys).drop("verified", "active")
    flags = old.general.select("generalization_key", "verified", "active")
    general = general.join(flags, "generalization_key", "left").withColumns({c: F.coalesce(c, F.lit(True)) for c in ("verified", "active")})
    kept = among(old.general, touched, "left_anti")
    return Memory(exact, groups, materialize(kept.unionByName(general), "memory-general"), old.provenance_limit)


def _last(of: Column, most: int) -> Column:
    """The last `most` of the ids with their times, in order."""
    ordered = F.array_sort(of)
    return F.slice(ordered, F.greatest(F.size(ordered) - most + 1, F.lit(1)), most)


def learn(
    objects: DataFrame,
    v4: int = 24,
    v6: int = 64,
    provenance_limit: int = 1000,
    expires_at: datetime | None = None,
    lives: timedelta | None = None,
) -> DataFrame:
    """fingerprints: one exact row for each distinct path, and one generalised row for each group of paths
    whose differences the masked path explains. Fingerprints expire at a time (expires_at) or a span after their last alert (lives)."""
    if lives is not None and "start_ts" not in objects.columns:
        raise ValueError("a span of life needs start_ts")
    return fingerprints(remember(objects, v4, v6, provenance_limit), expires_at, lives)


def fingerprints(memory: Memory, expires_at: datetime | None = None, lives: timedelta | None = None) -> DataFrame:
    """The fingerprints of a memory: what decisions are made from."""
    ends = F.lit(expires_at).cast("timestamp") if lives is None else F.timestamp_micros(F.unix_micros("last_ts") + int(lives.total_seconds() * 1e6))
    exact = memory.exact.select(
        "digest", "path", F.lit("exact").alias("kind"), "support", "generalization_key", F.transform("last", lambda x: x["id"]).alias("provenance"),
        (F.col("support") > memory.provenance_limit).alias("provenance_truncated"), F.element_at("last", -1)["ts"].alias("last_ts"), F.lit(1).alias("distinct_exact_paths"),
        F.array().cast("array<string>").alias("generalized_fields"), F.array().cast(_RULE).alias("constraints"), "verified", "active",
    )
    general = memory.general.withColumns({"kind": F.lit("generalized"), "digest": F.sha2(canonical("path"), 256)})
    ident = F.when(F.col("kind") == "exact", F.concat(F.lit("exact:"), F.col("digest"))).otherwise(
        F.concat(F.lit("generalized:"), F.col("generalization_key"))
    )
    both = exact.unionByName(general, allowMissingColumns=True)
    return both.withColumns({"fingerprint_id": uuid5(ident), "expires_at": ends}).drop("last_ts")


def _keys(exact: DataFrame) -> DataFrame:
    return exact.groupBy("generalization_key").agg(
        F.sum("support").alias("support"),
        F.count(F.lit(1)).cast("int").alias("distinct_exact_paths"),
        F.max(F.element_at("last", -1)["ts"]).alias("last_ts"),
    )


def _values(exact: DataFrame) -> DataFrame:
    """generalization_key, layer, value, candidate: the distinct values of each layer of a key and its masked form."""
    layers = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(f"path.{n}").alias("value"), F.col(f"wide.{n}").alias("candidate")) for n in LAYERS])
    return exact.select("generalization_key", F.inline(layers)).groupBy("generalization_key", "layer", "value").agg(F.first("candidate").alias("candidate"))


def _groups(values: DataFrame) -> DataFrame:
    """What stands at each place of the values of a key's layer. Values are flattened to places and captured texts, which are grouped as rows: a key
    with very many paths is combined before the shuffle. A row of form `all` counts the values."""

    @F.udf("array<struct<form:string,path:string,slot:int,kind:string,text:string,fits:boolean,shape:string>>", useArrow=True)
    def observed(layer: str, candidate: str, value: str) -> list:
        return [tuple(x) for x in shapes.observed(layer, candidate, value)] + [("all", "", -1, "", "", True, "")]

    content = F.struct("kind", "text")
    return (
        values.select("generalization_key", "layer", "candidate", F.inline(observed("layer", "candidate", "value")))
        .groupBy("generalization_key", "layer", "candidate", "form", "path", "slot")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n"),
            F.min(content).alias("low"),
            F.max(content).alias("high"),
            F.bool_and("fits").alias("fits"),
            F.array_sort(F.collect_set("shape")).alias("shapes"),
        )
    )


def _generalized(groups: DataFrame, keys: DataFrame) -> DataFrame:
    """generalization_key, path, support, distinct_exact_paths, last_ts, generalized_fields, constraints and flags: the patterns of keys with
    several paths, where every layer is the same or its differences stand under placeholders.

    Only the groups of one layer, as many as one of its values has places, meet in a row."""
    learnt_type = "struct<text:string,generalized:boolean,rules:array<struct<placeholder:string,accepted_shapes:array<string>>>>"

    @F.udf(learnt_type, useArrow=True)
    def assembled(layer: str, candidate: str, n: int, groups: list) -> tuple | None:
        own = [shapes.Group(g.form, g.path, g.slot, g.n, tuple(g.low), tuple(g.high), g.fits, list(g.shapes)) for g in groups]
        found = shapes.assembled(layer, candidate, n, own)
        return found and (found[0], found[2], found[1])

    own = ["generalization_key", "layer"]
    sizes = groups.filter("form = 'all'").select(*own, F.col("n").alias("values"))
    sized = groups.filter("form <> 'all'").join(sizes, own)
    broken = sized.filter("slot < 0 AND n < values").select(*own, "form").distinct()
    learnt = (
        sized.join(broken, [*own, "form"], "left_anti")
        .groupBy(*own, "candidate", "values")
        .agg(F.collect_list(F.struct("form", "path", "slot", "n", "low", "high", "fits", "shapes")).alias("groups"))
        .select(*own, assembled("layer", "candidate", "values", "groups").alias("learnt"))
    )
    by_key = learnt.groupBy("generalization_key").agg(
        F.bool_and(F.col("learnt").isNotNull()).alias("explained"), F.map_from_entries(F.collect_list(F.struct("layer", "learnt"))).alias("of")
    )
    of = {n: F.col("of")[n] for n in LAYERS}

    def rules(layer: str) -> Column:
        return F.transform(
            of[layer]["rules"],
            lambda r, i: F.struct(
                F.lit(layer).alias("layer"), i.alias("occurrence"), r["placeholder"].alias("placeholder"), r["accepted_shapes"].alias("accepted_shapes")
            ),
        )

    constraints = F.concat(*map(rules, LAYERS))
    fields = F.filter(F.array(*map(F.lit, LAYERS)), lambda n: F.col("of")[n]["generalized"])
    return (
        by_key.filter("explained")
        .join(keys, "generalization_key")
        .select(
            "generalization_key",
            F.struct(*[of[n]["text"].alias(n) for n in LAYERS]).alias("path"),
            "support",
            "distinct_exact_paths",
            "last_ts",
            fields.alias("generalized_fields"),
            constraints.cast(_RULE).alias("constraints"),
            F.lit(True).alias("verified"),
            F.lit(True).alias("active"),
        )
        .filter(F.size("generalized_fields") > 0)
    )


def _fits(path: Column, pattern: Column, rules: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(paths: pd.DataFrame, patterns: pd.DataFrame, rules: pd.Series) -> pd.Series:
        def one(p: dict, g: dict, r: list) -> bool:
            by = {n: [(x["occurrence"], x["placeholder"], list(x["accepted_shapes"])) for x in r if x["layer"] == n] for n in LAYERS}
            return all(shapes.layer_matches(n, g[n], p[n], by[n]) for n in LAYERS)

        return pd.Series([one(*x) for x in zip(paths.to_dict("records"), patterns.to_dict("records"), rules, strict=True)], dtype=bool)

    return run(path, pattern, rules)


def _specificity(path: str) -> Column:
    mark = shapes.PLACEHOLDER
    parts = [F.length(F.regexp_replace(F.col(f"{path}.{n}"), mark, "")) for n in LAYERS]
    return sum(parts[1:], parts[0])


def decide(
    objects: DataFrame,
    fingerprints: DataFrame,
    now: datetime | None = None,
    least_support: int = 1,
    least_general_support: int = 2,
    least_paths: int = 2,
    protected: tuple[str, ...] = PROTECTED,
) -> DataFrame:
    """object_id, decision, fingerprint_id, support, reason for each object.

    Order: protected behaviour, exact path, the single most specific generalised pattern that fits, else forward with the reason why.
    A layer that a pattern doesn't generalise must be equal; patterns are looked up by those layers and a literal fragment of the template.
    """
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    rows = with_path(objects)
    category = F.coalesce(F.col("statistics.behavior_category"), F.lit("")) if "statistics" in objects.columns else F.lit("")
    rows = rows.select("object_id", "path", category.alias("category"), F.sha2(canonical("path"), 256).alias("digest"))
    rows = materialize(rows, "decide-paths")
    flat = [F.col(f"path.{n}").alias(n) for n in LAYERS]
    exact = fingerprints.filter("kind = 'exact'")
    tree = prefix_tree(exact.select(*flat, "support"), count=F.col("support"))
    # equal paths are looked up as one
    reached = match_tree(rows.select("digest", "path").distinct().select("digest", *flat), tree, "digest")
    rejected = (
        F.when(~F.col("active"), "inactive_fingerprint")
        .when(~F.col("verified"), "unverified_fingerprint")
        .when(F.col("expires_at") <= clock, "expired_fingerprint")
    )
    own = exact.select(
        "digest", F.col("fingerprint_id").alias("exact_id"), F.col("support").alias("exact_support"), rejected.alias("rejected")
    )
    base = rows.join(reached.join(own, "digest", "left"), "digest")
    whole = F.col("matched_depth") == len(LAYERS)
    is_exact = whole & F.col("exact_id").isNotNull()
    exact_ok = is_exact & F.col("rejected").isNull() & (F.col("terminal_support") >= least_support)
    shielded = F.col("category").isin(*protected)
    general = fingerprints.filter(
        (F.col("kind") == "generalized")
        & (F.col("support") >= least_general_support)
        & (F.col("distinct_exact_paths") >= least_paths)
        & rejected.isNull()
    ).select(
        F.col("path").alias("pattern"), F.col("fingerprint_id").alias("general_id"), F.col("support").alias("general_support"), "constraints", "generalized_fields"
    )
    # equal patterns fit the same paths, so they are tested as one
    alike = ["pattern", "constraints", "generalized_fields"]
    general = general.groupBy(*alike).agg(F.min("general_id").alias("general_id"), F.min("general_support").alias("general_support"), F.count(F.lit(1)).alias("equal"))
    general = materialize(general, "distinct-patterns")
    # protected behaviour and exact paths are settled; equal paths are tested once
    base = materialize(base, "decide-base")
    settled = F.coalesce(shielded, F.lit(False)) | F.coalesce(exact_ok, F.lit(False)) | F.coalesce(is_exact & F.col("rejected").isNotNull(), F.lit(False))
    open_paths = materialize(base.filter(~settled).groupBy("digest").agg(F.first("path").alias("path")), "open-paths")
    met = candidate_pairs(open_paths, general, LAYERS, LAYERS[-1])
    pairs = (
        met.join(open_paths, "digest")
        .join(general, "general_id")
        .filter(_fits(F.col("path"), F.col("pattern"), F.col("constraints")))
        .groupBy("digest", _specificity("pattern").alias("score"))
        .agg(F.sum("equal").alias("n"), F.min("general_id").alias("general_id"), F.min("general_support").alias("general_support"))
        .groupBy("digest")
        .agg(F.max(F.struct("score", "n", "general_id", "general_support")).alias("best"))
    )
    found = base.join(pairs, "digest", "left")
    fallback = (
        F.when(whole & (F.col("terminal_support") < least_support), "insufficient_support")
        .when(~whole, F.concat(F.lit("hat_path_not_found:"), F.col("missing_layer")))
        .otherwise("fingerprint_record_not_found")
    )
    one, many = F.col("best.n") == 1, F.col("best.n") > 1
    case = lambda p, rej, ok, gen, amb, rest: (
        F.when(shielded, p).when(is_exact & F.col("rejected").isNotNull(), rej).when(exact_ok, ok).when(one, gen).when(many, amb).otherwise(rest)
    )
    none = F.lit(None)
    return found.select(
        "object_id",
        case("forward", "forward", "filter", "filter", "forward", "forward").alias("decision"),
        case(none, F.col("exact_id"), F.col("exact_id"), F.col("best.general_id"), none, F.col("exact_id")).alias("fingerprint_id"),
        case(F.lit(0), F.col("exact_support"), F.col("terminal_support"), F.col("best.general_support"), F.lit(0), F.col("terminal_support"))
        .cast("long")
        .alias("support"),
        case(
            F.concat(F.lit("protected_high_frequency_behavior:"), "category"),
            F.col("rejected"),
            F.lit("verified_benign_exact_match"),
            F.lit("verified_benign_generalized_match"),
            F.lit("ambiguous_generalized_match"),
            fallback,
        ).alias("reason"),
    )


def route(objects: DataFrame, decisions: DataFrame, decision: str) -> DataFrame:
    """Objects with one decision."""
    return objects.join(decisions.filter(F.col("decision") == decision).select("object_id"), "object_id", "left_semi")


def signature(settings: dict) -> str:
    """Digest of the settings under which a store was learnt."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def validate_memory(fingerprints: DataFrame) -> None:
    """Raises ValueError where a digest doesn't fit its path, an id or exact path is repeated, supports aren't positive, or a
    generalised row doesn't count the exact paths of its key."""
    checks = {
        "digest does not fit its path": fingerprints.filter(~F.sha2(canonical("path"), 256).eqNullSafe(F.col("digest"))).select("fingerprint_id"),
        "repeated fingerprint": fingerprints.groupBy("fingerprint_id").count().filter("count > 1"),
        "repeated exact path": fingerprints.filter("kind = 'exact'").groupBy("digest").count().filter("count > 1"),
        "support is not positive": fingerprints.filter("support IS NULL OR support < 1").select("fingerprint_id"),
    }
    exact = fingerprints.filter("kind = 'exact'").groupBy("generalization_key").agg(F.sum("support").alias("s"), F.count(F.lit(1)).alias("n"))
    general = fingerprints.filter("kind = 'generalized'").join(exact, "generalization_key", "left")
    checks["generalised support differs from its exact paths"] = general.filter(
        ~(F.col("support").eqNullSafe(F.col("s")) & F.col("distinct_exact_paths").cast("long").eqNullSafe(F.col("n")))
    ).select("fingerprint_id")
    for what, bad in checks.items():
        row = bad.first()
        if row is not None:
            raise ValueError(f"{what}: {row[0]}")


def save_memory(fingerprints: DataFrame, path: str, overwrite: bool = False, settings: dict | None = None) -> None:
    """Stores valid fingerprints and the signature of their settings as a whole; refuses to replace a store unless told to. What was stored before
    stays current until the new store is whole and valid, so fingerprints may be read from the store that they replace."""
    about = fingerprints.sparkSession.createDataFrame([(VERSION, signature(settings or {}))], "version int, signature string").coalesce(1)
    publish({"fingerprints": fingerprints, "about": about}, path, overwrite, lambda stored: validate_memory(stored["fingerprints"]))


def load_memory(spark: SparkSession, path: str, settings: dict | None = None) -> DataFrame:
    """The stored fingerprints. Another version, other settings than the store was learnt with (where they are given) or a store that isn't valid
    raises ValueError."""
    return _checked(spark, path, settings, "fingerprints", validate_memory)


def _checked(spark: SparkSession, path: str, settings: dict | None, table: str, check: Callable[[DataFrame], None]) -> DataFrame:
    folder = current(spark, path)
    about = spark.read.parquet(f"{folder}/about").first()
    if about["version"] != VERSION:
        raise ValueError(f"memory of version {about['version']}, not {VERSION}")
    if settings is not None and about["signature"] != signature(settings):
        raise ValueError("memory was learnt under other settings")
    stored = spark.read.parquet(f"{folder}/{table}")
    check(stored)
    return stored


def save_state(memory: Memory, path: str, overwrite: bool = False, settings: dict | None = None) -> None:
    """Stores a memory so that later batches can be merged into it. It may be the merge of the state that it replaces."""
    about = memory.exact.sparkSession.createDataFrame([(VERSION, signature(settings or {}), memory.provenance_limit)], "version int, signature string, provenance_limit int")
    publish(memory.tables() | {"about": about.coalesce(1)}, path, overwrite)


def load_state(spark: SparkSession, path: str, settings: dict | None = None) -> Memory:
    """A stored memory; another version or other settings raise ValueError, as do fingerprints that aren't valid."""
    exact = _checked(spark, path, settings, "exact", lambda _: None)
    folder = current(spark, path)
    limit = spark.read.parquet(f"{folder}/about").first()["provenance_limit"]
    found = Memory(exact, spark.read.parquet(f"{folder}/groups"), spark.read.parquet(f"{folder}/general"), limit)
    validate_memory(fingerprints(found))
    return found
