"""False-positive patterns from clusters, their cache, and the stored knowledge base."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.functions.text import stable_id
from alertloom.operators.memory import signature
from alertloom.session import materialize
from alertloom.sources.versions import current, publish

VERSION = 1


#: Distinct templates and member ids that a cluster's summary keeps, and characters of a prompt.
EXAMPLES, PROVENANCE, PROMPT_CHARS = 8, 100, 24_000


def _first(rows: DataFrame, keys: list[str], value: Column, order: list[Column], most: int, name: str) -> DataFrame:
    """keys, name: the first values of each group as an array; each of 64 salts of a group offers its first ones."""
    salted = Window.partitionBy(*keys, F.pmod(F.xxhash64(value), F.lit(64))).orderBy(*order, value)
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))
    kept = rows.withColumn("_k", F.row_number().over(salted)).filter(F.col("_k") <= most)
    listed = F.slice(F.array_sort(F.collect_list(place)), 1, most)
    return kept.groupBy(*keys).agg(F.transform(listed, lambda s: s["v"]).alias(name))


def cluster_summaries(
    clustered: DataFrame, scenario: str, keys: list[str], templates: int = EXAMPLES, provenance: int = PROVENANCE
) -> DataFrame:
    """One row for each cluster of leader_clusters: cluster_id, the keys, support, representative (the member that came first), the most frequent
    templates, most frequent first, and the ids that came first. The cluster id is a digest of the scenario, the keys and the members: their number and
    the sum of their hashes stand for them, so no row gathers a cluster."""
    own = ["leader", *keys]
    ids = _first(clustered, own, F.col("alert_id"), [F.col("ts")], provenance, "provenance")
    counts = clustered.groupBy(*own, "template").agg(F.count(F.lit(1)).alias("n"))
    texts = _first(counts, own, F.col("template"), [-F.col("n")], templates, "templates")
    groups = clustered.groupBy(*own).agg(
        F.count(F.lit(1)).alias("support"), F.sum(F.xxhash64("alert_id").cast("decimal(38,0)")).cast("string").alias("_members")
    )
    named = groups.withColumn(
        "cluster_id",
        stable_id("fp-cluster-", F.to_json(F.struct(F.lit(scenario).alias("scenario"), "_members", "support", *keys)), 24),
    )
    joined = named
    for other in (ids, texts):
        same = [F.col(f"g.{k}").eqNullSafe(F.col(f"o.{k}")) for k in own]
        joined = joined.alias("g").join(other.alias("o"), same).select("g.*", f"o.{other.columns[-1]}")
    return joined.select(
        "cluster_id", *keys, "support", F.element_at("provenance", 1).alias("representative"), "templates", "provenance"
    )


def generate_patterns(
    clusters: DataFrame, provider: Callable[[str], str], retries: int = 2, backoff: float = 1.0, prompt_chars: int = PROMPT_CHARS
) -> DataFrame:
    """cluster_id, pattern_text, error_code: a provider's description of each cluster, asked on the executors.

    A prompt that is too long loses its last templates first, and the one left is halved until the prompt fits. An empty answer is an error; a provider that keeps
    failing leaves pattern_text null."""

    @F.pandas_udf("struct<pattern_text:string,error_code:string>")
    def run(rows: pd.Series) -> pd.DataFrame:
        def prompt(row: str) -> str:
            data = json.loads(row)
            while len(text := json.dumps(data, ensure_ascii=False, sort_keys=True)) > prompt_chars and any(data["templates"]):
                last = data["templates"].pop()
                if not data["templates"]:
                    data["templates"].append(last[: len(last) // 2])
            return text

        def one(row: str) -> tuple[str | None, str | None]:
            for attempt in range(retries + 1):
                try:
                    text = provider(prompt(row)).strip()
                    return (text, None) if text else (None, "empty_pattern")
                except Exception:  # noqa: BLE001  any failure of a remote model
                    if attempt < retries:
                        time.sleep(backoff * 2**attempt)
            return None, "provider_failed"

        return pd.DataFrame([one(r) for r in rows], columns=["pattern_text", "error_code"])

    told = F.to_json(F.struct(*sorted(c for c in clusters.columns if c not in ("provenance", "representative"))))
    return clusters.withColumn("_p", run(told)).select("cluster_id", "_p.*")


def not_cached(clusters: DataFrame, cache: DataFrame) -> DataFrame:
    """Clusters that have no pattern of this version in the cache."""
    return clusters.join(cache.filter(F.col("version") == VERSION).select("cluster_id"), "cluster_id", "left_anti")


def append_cache(patterns: DataFrame, path: str) -> None:
    """Adds the patterns that were generated without error."""
    good = patterns.filter("error_code IS NULL").select("cluster_id", "pattern_text", F.lit(VERSION).alias("version"))
    good.write.mode("append").parquet(path)


def cluster_documents(clusters: DataFrame, patterns: DataFrame) -> DataFrame:
    """Knowledge documents of clusters with a pattern."""
    known = patterns.filter("pattern_text IS NOT NULL").select("cluster_id", "pattern_text")
    return clusters.join(known, "cluster_id").select(
        F.col("cluster_id").alias("pattern_id"),
        *[c for c in clusters.columns if c not in ("cluster_id", "templates")],
        F.element_at("templates", 1).alias("index_text"),
        "pattern_text",
    )


def corpus_signature(documents: DataFrame) -> str:
    """A digest of the documents that does not depend on their order: their number and the sum of their hashes."""
    row = documents.select(F.xxhash64(*sorted(documents.columns)).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
    return hashlib.sha256(f"{row[0]}:{row[1]}".encode()).hexdigest()


def save_knowledge(documents: DataFrame, path: str, settings: dict | None = None, overwrite: bool = False) -> None:
    """Stores documents with their vectors and the signatures of their settings and of themselves, as a whole; refuses to replace a store
    unless told to."""
    documents = materialize(documents, "knowledge")
    about = [(VERSION, signature(settings or {}), corpus_signature(documents))]
    about = documents.sparkSession.createDataFrame(about, "version int, settings string, corpus string").coalesce(1)
    publish({"documents": documents, "about": about}, path, overwrite)


def load_knowledge(spark: SparkSession, path: str, dims: int | None = None, settings: dict | None = None) -> DataFrame:
    """Stored documents. Another version, other settings (where they are given) or other documents than were stored raise ValueError; a vector that
    is null, of another size or not of length one ends the job."""
    folder = current(spark, path)
    about = spark.read.parquet(f"{folder}/about").first()
    stored = spark.read.parquet(f"{folder}/documents")
    if about["version"] != VERSION:
        raise ValueError(f"knowledge of version {about['version']}, not {VERSION}")
    if settings is not None and about["settings"] != signature(settings):
        raise ValueError("knowledge was built under other settings")
    if about["corpus"] != corpus_signature(stored):
        raise ValueError("stored documents differ from their signature")
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    good = F.col("embedding").isNotNull() & (F.abs(length - 1) < 1e-5)
    if dims is not None:
        good = good & (F.size("embedding") == dims)
    bad = F.raise_error(F.concat(F.lit("bad vector of "), "pattern_id")).cast(stored.schema["embedding"].dataType)
    return stored.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(bad))


def same_ids(a: DataFrame, b: DataFrame, ident: str) -> bool:
    """Whether two tables hold the same ids, as often."""
    left, right = a.select(ident), b.select(ident)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
