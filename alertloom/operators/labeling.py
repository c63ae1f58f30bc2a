"""Alignment of official labels with alerts by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.text import final_label


def numbered(rows: DataFrame, order: list[str], name: str = "position", sections: str | None = None) -> DataFrame:
    """Adds position from 1 in the given order; with sections, inside each of them."""
    window = Window.partitionBy(sections) if sections else Window.partitionBy()
    return rows.withColumn(name, F.row_number().over(window.orderBy(*order)))


def gapless(rows: DataFrame, by: str, name: str = "position", width: int = 100_000) -> DataFrame:
    """Adds the place, from 1, of each row in the order of a whole-number column without repeats.

    Rows are numbered inside sections of `width` numbers, which start where the counts of earlier sections
    end; so no task sorts the whole table."""
    cut = rows.withColumn("_s", F.floor(F.col(by) / width))
    counts = cut.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.row_number().over(Window.partitionBy("_s").orderBy(by))
    return cut.withColumn("_at", at).join(starts, "_s").withColumn(name, F.col("_start") + F.col("_at")).drop("_s", "_at", "_start")


def expected_name(raw: Column, kind: str) -> tuple[Column, Column, Column]:
    """Detector, name and address that the label of a record must carry."""
    get = lambda p: F.try_variant_get(raw, p, "string")
    if kind == "aminer":
        return F.lit("aminer"), get("$.AnalysisComponent.AnalysisComponentName"), get("$.AMiner.ID")
    if kind != "wazuh":
        raise ValueError(f"unknown kind {kind}")
    description = get("$.rule.description")
    detector = F.when(get("$.location") == "/var/log/suricata/eve.json", "suricata").otherwise("wazuh")
    name = F.when(description.startswith("Suricata: "), description).otherwise(F.concat(F.lit("Wazuh: "), description))
    return detector, name, get("$.agent.ip")


def align(alerts: DataFrame, labels: DataFrame, checks: dict[str, str], keys: tuple[str, ...] = ("position",)) -> DataFrame:
    """Alerts with the labels of the same position. Every position must be on both sides, and each pair of
    columns in checks must agree; otherwise the job ends and nothing is published."""
    both = alerts.alias("a").join(labels.alias("l"), [F.col(f"a.{k}") == F.col(f"l.{k}") for k in keys], "full_outer")
    place = F.coalesce(*[c for k in keys for c in (F.col(f"a.{k}"), F.col(f"l.{k}"))]).cast("string")
    missing = F.col(f"a.{keys[-1]}").isNull() | F.col(f"l.{keys[-1]}").isNull()
    differs = F.lit(False)
    for a, b in checks.items():
        differs = differs | ~F.col(f"a.{a}").eqNullSafe(F.col(f"l.{b}"))
    state = (
        F.when(missing, F.raise_error(F.concat(F.lit("label without partner at "), place)).cast("boolean"))
        .when(differs, F.raise_error(F.concat(F.lit("label alignment failed at "), place)).cast("boolean"))
        .otherwise(True)
    )
    own = [c for c in labels.columns if c not in (*keys, *checks.values())]
    return both.filter(state).select("a.*", *[F.col(f"l.{c}") for c in own])


def label(aligned: DataFrame) -> DataFrame:
    return aligned.withColumn("label", final_label(F.col("time_label"), F.col("event_label")))


def label_statistics(labelled: DataFrame, *keys: str) -> DataFrame:
    """Counts by the keys with subtotals, as a rollup."""
    return labelled.rollup(*keys).agg(F.count(F.lit(1)).alias("records"))
