"""Operator 5: sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.session import materialize

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. A key leaves its shard only for a newly appended one."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.int64).view(np.uint64).copy()
    now = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        now[live] = ahead[live]
        state[live] = state[live] * _STEP + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((now[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return now


def shard_of(key: Column, shards: int) -> Column:
    """Column of shard numbers for a bigint key."""

    @F.pandas_udf("int")
    def assign(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards), dtype="int32")

    return assign(key)


def shard_documents(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", sections: int = 1024
) -> DataFrame:
    """Adds shard, slot and grown_shard (with one shard more) under the law `key`.

    Shards never need a ring table. Slots are gapless within a shard, without a shard-wide sort:
    rows are numbered inside `sections` hashed sections of a shard, and each section starts
    where the counts of the earlier ones end. Only narrow columns are shuffled.

    Null keys go where key 0 goes, as nothing but key and number of shards decides. Repeated keys share a shard and get slots of
    their own; a section also takes the number of the partition that a row was read in, so many repeats of one row
    are numbered by many tasks. Null texts have size 1 and CRC 0, very long texts are only measured, an empty table
    gives no rows, and other columns are left out, so names can't clash.
    """
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(key).cast("long"), F.lit(0)).cast("long").alias("_key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = narrow.withColumns(
        {
            "shard": shard_of(F.col("_key"), shards),
            "grown_shard": shard_of(F.col("_key"), shards + 1),
            "_section": F.pmod(F.xxhash64("_key", "text_crc32", F.spark_partition_id()), F.lit(sections)).cast("int"),
        }
    )
    dealt = materialize(dealt, "dealt")  # counts and numbers must see the same sections
    inside = Window.partitionBy("shard", "_section").orderBy("_key", "doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    counts = dealt.groupBy("shard", "_section").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "_section", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    # at most shards * sections rows, whatever the input
    return numbered.join(F.broadcast(starts), ["shard", "_section"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_start") + F.col("_at")).cast("long").alias("slot"),
        "grown_shard",
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
