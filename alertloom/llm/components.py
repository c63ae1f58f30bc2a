"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.session import discard, materialize


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Links each neighbour of a node to the least of them, and the table of minima that the result reads.
    Only minima are gathered, so a node with very many neighbours is combined before the shuffle and its join can be split."""
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # as a table of its own, so that both sides of the join are plain exchanges, which can be split
    least = materialize(pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    joined = pairs.join(least, "a")
    kept = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(
        F.col("b").alias("a"), F.col("m").alias("b")
    ).unionByName(joined.select("a", F.col("m").alias("b")))
    return kept.filter("a <> b").distinct(), least


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): root is the least node reachable. Nodes without links are absent.

    Ends when a round changes no link; rounds grow with the logarithm of the longest chain."""
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(ordered, "links")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = mark(now)
    while seen[0]:
        wide, one = _star(now, True)
        close, two = _star(wide, False)
        after_round = materialize(close, "links")
        discard(now, one, two)
        now, after = after_round, mark(after_round)
        if after == seen:
            break
        seen = after
    # each node is now linked to its root alone
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def extended_components(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, root) once more links are there, as a table. Only the links between the
    components known before are worked on."""
    if roots is None:
        return materialize(connected_components(links), "roots")
    for end in ("a", "b"):
        known = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        links = links.join(known, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    moved = connected_components(links).select(F.col("root").alias("_to"), F.col("node").alias("root"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    new = moved.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("_to").alias("root"))
    return materialize(old.unionByName(new), "roots")
