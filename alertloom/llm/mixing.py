"""Operator 3: mixing sources to target weights with hash-threshold histograms (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.llm.common import word_count
from alertloom.session import materialize

#: Hash digits (hex) of each histogram level: 4,096 buckets a source and level.
LEVELS = (3, 3, 3)
MOST = 3
#: Sources whose thresholds are broadcast at most; more are joined.
MOST_BROADCAST = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """source, source_size -> adds target.

    Sources by code point, null last, weigh `weights`, repeating. The level of filling is the
    one at which the capped sources' caps and the others' shares use up the total: sources
    are ordered by cap per weight and the first count of capped ones that holds is taken. One
    row per source stands here, never rows of documents.
    """
    everything = Window.partitionBy()
    order = everything.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    base = sizes.withColumn("_w", weight.cast("double")).withColumn("_cap", F.col("source_size") * float(most))
    by_ratio = everything.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = base.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("_total"),
        F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)).alias("_caps"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))).alias("_rest"),
    )
    level = (F.col("_total") - F.col("_caps")) / F.col("_rest")
    holds = F.when(level * F.col("_w") <= F.col("_cap"), level)
    filled = ranked.withColumn("_level", F.first(holds, ignorenulls=True).over(everything.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return filled.select(
        "source",
        "source_size",
        F.round(F.least("_cap", F.col("_level") * F.col("_w")), 6).alias("target"),
    )


def mix_thresholds(narrow: DataFrame, targets: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """source, copies, below: documents whose hash prefix is under `below` are taken once more.

    Level by level, tokens are summed by source and hash bucket, running sums find the bucket in
    which the budget ends, and only the rows of that bucket reach the next histogram.
    """
    bounds = targets.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("copies"),
    ).select("*", (F.col("target") - F.col("copies") * F.col("source_size")).alias("_left"), F.lit("").alias("below"))
    depth = 0
    for digits in levels:
        inside = narrow.alias("d").join(
            F.broadcast(bounds.select(F.col("source").alias("_s"), F.col("below").alias("_b"))),
            F.col("source").eqNullSafe(F.col("_s")) & (F.substring("h", 1, depth) == F.col("_b")) if depth else F.col("source").eqNullSafe(F.col("_s")),
        )
        depth += digits
        histogram = inside.groupBy("source", F.substring("h", 1, depth).alias("bucket")).agg(F.sum("size").alias("tokens"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = histogram.withColumn("_upto", F.sum("tokens").over(running))
        crossing = (
            sums.join(
                F.broadcast(bounds.select(F.col("source").alias("_s"), "_left")),
                F.col("source").eqNullSafe(F.col("_s")) & (F.col("_upto") > F.col("_left")),
            )
            .groupBy("source", "_left")
            .agg(F.min(F.struct("bucket", "_upto", "tokens")).alias("_c"))
        )
        bounds = materialize(
            bounds.select("source", "source_size", "target", "copies", F.col("_left").alias("_had"), F.col("below").alias("_old"))
            .join(crossing.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
            .select(
                "source",
                "source_size",
                "target",
                "copies",
                # no bucket crosses: all of the last bucket fits, which only an empty rest gives
                F.coalesce(F.col("_had") - (F.col("_c._upto") - F.col("_c.tokens")), F.lit(0.0)).alias("_left"),
                F.coalesce(F.col("_c.bucket"), F.rpad(F.col("_old"), depth, "g")).alias("below"),
                F.coalesce(F.col("_c.tokens"), F.lit(0)).alias("_last"),
            ),
            "mix-bounds",
        )
    # the last bucket joins if that ends nearer to the target
    return bounds.select(
        "source", "source_size", "target", "copies", "below", (F.col("_last") <= 2 * F.col("_left")).alias("_with")
    )


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds h to rows that have key, th (text hash), source and part (a number of the task that read the row).

    A row's hash is that of its key. Of rows with one key, one stands under that hash, and the others under the hash of
    key, text, source and an occurrence number, so that the threshold can part them. Equal rows are numbered in every
    part by itself, behind the counts of the parts before, so no key's rows need to meet in one task."""
    content = ["key", "th", "source"]
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("th", "source")).alias("least")).filter("n > 1")
    several = materialize(several.select(F.col("key").alias("_key"), "least"), "mix-repeated")
    plain = F.coalesce(F.md5(F.col("key").cast("string")), F.md5(F.col("th").cast("string")))
    if several.isEmpty():
        return rows.withColumn("h", plain)
    same = F.col("key").eqNullSafe(F.col("_key"))
    single = rows.join(several, same, "left_anti").withColumn("h", plain)
    repeated = materialize(rows.join(several, same).drop("_key"), "mix-repeats")
    counts = repeated.groupBy(*content, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*content).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in (*content, "part")], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = repeated.withColumn("at", F.row_number().over(Window.partitionBy(*content, "part").orderBy(F.lit(0))))
    matched = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in content] + [F.col("part") == F.col("_part")]
    number = F.col("start") + F.col("at") - 1
    first = F.col("least").eqNullSafe(F.struct("th", "source")) & (number == 0)
    other = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in content], number.cast("string")))
    joined = numbered.join(starts, matched).withColumn("h", F.when(first, plain).otherwise(other))
    return single.unionByName(joined.select(*single.columns))


def _narrow(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return materialize(
        docs.select(
            F.col(key).alias("key"),
            F.xxhash64(F.col(text)).alias("th"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.spark_partition_id().alias("part"),
        ),
        "mix-sizes",
    )


def mix_bounds(narrow: DataFrame, weights: tuple[int, ...], levels: tuple[int, ...]) -> DataFrame:
    """One row for each source of narrow (source, size, h): size, target, whole copies and hash threshold."""
    targets = materialize(
        source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-targets"
    )
    return mix_thresholds(narrow, targets, levels)


def with_copies(rows: DataFrame, bounds: DataFrame, source: str, h: Column, levels: tuple[int, ...]) -> DataFrame:
    """Adds source_size, target and copies: how often each row is taken."""
    prefix = F.substring(h, 1, sum(levels))
    more = (prefix < F.col("_below")) | ((prefix == F.col("_below")) & F.col("_with"))
    told = bounds.select(
        F.col("source").alias("_s"), "source_size", "target", F.col("copies").alias("_copies"), F.col("below").alias("_below"), "_with"
    )
    few = told.count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(told) if few else told, F.col(source).eqNullSafe(F.col("_s")))
    return joined.withColumn("copies", F.col("_copies") + more.cast("long")).drop("_s", "_copies", "_below", "_with")


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document.

    A document is taken `copies` times; whole rounds of a source first, then one more copy where
    its hash is under the source's threshold. No sort of documents, one pass over the
    texts. Null texts have no words; null sources are one source; rows with one key have hashes of their own and are
    taken or left one by one; null keys are one key; very long texts are counted whole; an empty table gives no rows;
    other columns are ignored. Sources are ordered in one task, a row for each of them.
    """
    narrow = materialize(_hashed(_narrow(docs, key, text, source)), "mix-hashes")
    mixed = with_copies(narrow, mix_bounds(narrow, weights, levels), "source", F.col("h"), levels)
    return mixed.select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns.

    Two passes over the texts; only rows whose key is repeated are shuffled with their texts. Cases as in mix_sources."""
    narrow = materialize(_hashed(_narrow(docs, key, text, source)), "mix-hashes")
    bounds = mix_bounds(narrow, weights, levels)
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(key).alias("key"),
        F.xxhash64(F.col(text)).alias("th"),
        F.col(source).alias("source"),
        F.spark_partition_id().alias("part"),
    )
    mixed = with_copies(_hashed(own), bounds, "source", F.col("h"), levels).filter("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE n AS (
  SELECT doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY source),
w AS (SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1]::DOUBLE AS w,
             3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
lv AS (SELECT max(lvl) AS lvl FROM (
  SELECT (a.total - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap / b.w < a.cap / a.w), 0))
         / (SELECT sum(b.w) FROM w b WHERE b.cap / b.w >= a.cap / a.w) AS lvl, a.cap / a.w AS r FROM w a) WHERE lvl <= r),
t AS (SELECT source, source_size, round(least(cap, lvl * w), 6) AS target FROM w, lv),
c AS (SELECT n.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(target / t.source_size) ELSE 0 END::BIGINT AS k,
             sum(size) OVER (PARTITION BY n.source ORDER BY substr(h, 1, 9) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY n.source, substr(h, 1, 9)) AS last
      FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (k + CASE WHEN upto <= target - k * source_size OR (upto - last <= target - k * source_size AND last <= 2 * (target - k * source_size - (upto - last))) THEN 1 ELSE 0 END) AS taken,
       k + CASE WHEN upto <= target - k * source_size OR (upto - last <= target - k * source_size AND last <= 2 * (target - k * source_size - (upto - last))) THEN 1 ELSE 0 END AS copies
FROM c
"""
