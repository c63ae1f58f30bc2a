"""Operator 2: benchmark decontamination by size-partitioned MinHash containment search (native).

Items are short and documents long, so the similarity of the two sets says little; what counts is
the share of the item's shingles that the document holds. Items are partitioned by the power of two
above their number of shingles; each partition has one sketch length, the number of least hashes
(bottom-k MinHash) of which a document with the asked containment must hold at least one:
floor((1 - t) * upper size) + 1. So the search misses nothing at the threshold, at any length of document.
Candidates are then verified by the exact containment of their shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.common import SHINGLE, SIMILARITY, ascii_lower, unused, words
from alertloom.session import materialize


def _grams(tokens: Column, n: int) -> Column:
    """Distinct n-word shingles; none where there are fewer words."""
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " ")
    )
    return F.when(F.size(tokens) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _all_grams(tokens: Column, widths: list[int]) -> Column:
    return F.concat(*[_grams(tokens, n) for n in widths])


def _gram_hashes(word_hashes: Column, n: int) -> Column:
    """Hashes of the n-word shingles, from the hashes of the words in order, repeats included; none where there are fewer words. The words' hashes
    must be a column of their own: an expression would be evaluated for every shingle."""
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(word_hashes) - n + 1, F.lit(1))),
        lambda i: F.xxhash64(*[F.try_element_at(word_hashes, i + k) for k in range(n)]),
    )
    return F.when(F.size(word_hashes) >= n, every).otherwise(F.array().cast("array<bigint>"))


def _row_key(key: str, text: str) -> Column:
    """Names a row even where keys are null or repeated."""
    return F.xxhash64(F.col(key), F.col(text))


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every document that holds an item; options as
    in find_items.

    Words are lower-cased in A-Z. An item of fewer than n words is one shingle as long as itself.
    Items without words are held by nothing; null and empty texts hold nothing; repeated rows of
    documents or items give a row each; null keys stay null; empty tables give no rows; other columns
    are ignored.
    """
    return find_items(docs, items, key, text, **options).drop("row_key")


def find_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    threshold: float = SIMILARITY,
    n: int = SHINGLE,
) -> DataFrame:
    """The rows of contained_items with row_key, the hash of a document's key and text."""
    prepared = items.select(
        F.col(item_key).alias("item_id"), words(ascii_lower(F.col(item_text))).alias("w")
    ).filter(F.size("w") > 0)
    hashed_words = F.transform("w", lambda x: F.xxhash64(x))
    prepared = materialize(prepared.withColumn("h", hashed_words), "leak-items")
    width = F.least(F.size("w"), F.lit(n))
    # at most n numbers
    widths = sorted({n, *(r[0] for r in prepared.select(width).distinct().collect())})
    sets = prepared.select(
        "item_id",
        F.coalesce(*[F.when(width == k, _grams(F.col("w"), k)) for k in widths]).alias("grams"),
        F.coalesce(*[F.when(width == k, _gram_hashes(F.col("h"), k)) for k in widths]).alias("hashes"),
    ).withColumn("n_item", F.size("grams"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_item")))
    sets = sets.withColumn("k", (F.floor((1 - threshold) * upper + 1e-9) + 1).cast("int")).withColumn(
        "item_key", F.xxhash64("item_id", "grams")
    )
    sketches = sets.select(
        "item_key",
        F.explode(F.slice(F.array_sort(F.array_distinct("hashes")), F.lit(1), F.col("k"))).alias("h"),
    ).distinct()
    rows = docs.select(
        _row_key(key, text).alias("row_key"),
        F.col(key).alias("doc_id"),
        words(ascii_lower(F.col(text))).alias("w"),
    )
    hashes = F.concat(*[_gram_hashes(F.col("h"), n) for n in widths])
    hashed = rows.select("row_key", hashed_words.alias("h")).select("row_key", F.explode(hashes).alias("h"))
    candidates = materialize(hashed.join(sketches, "h").select("row_key", "item_key").distinct(), "leak-candidates")
    shared = F.size(F.array_intersect("grams", "doc_grams"))
    found = rows.join(candidates, "row_key").select("row_key", "doc_id", "item_key", _all_grams(F.col("w"), widths).alias("doc_grams"))
    return (
        found.join(sets.select("item_id", "item_key", "grams", "n_item"), "item_key")
        .select("row_key", "doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .filter(F.col("containment") >= threshold)
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, all columns kept; cases as in contained_items."""
    (leak,) = unused(docs, "_leak")
    leaks = find_items(docs, items, key, text, **options).select(F.col("row_key").alias(leak)).distinct()
    return docs.join(leaks, _row_key(key, text) == F.col(leak), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ig AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' '))) AS g FROM i WHERE len(w) > 0),
ie AS (SELECT item_id, len(g) AS n_item, unnest(g) AS g FROM ig),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
j AS (SELECT doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared FROM dg JOIN ie USING (g) GROUP BY doc_id, item_id, n_item)
SELECT *, n_shared / n_item AS containment FROM j WHERE n_shared / n_item >= 0.75
"""
