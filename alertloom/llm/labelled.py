"""Labelled training rows, held-out folds and the scoring column of the two classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from alertloom.session import discard, materialize


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """order, y, text of at most `bound` labelled documents outside the held-out fold, one for each key.

    Rows are chosen by the hash of their key, so the choice is the same in every run and ignores
    the order of the tables. A document with several labels has the greatest; null labels are none. Where a key
    has several texts, the one with the least hash is learnt.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_k"), F.col(label).alias("y"))
        .filter(F.col("y").isNotNull() & F.col("_k").isNotNull() & (fold(F.col("_k"), folds) != held_out))
        .groupBy("_k")
        .agg(F.max("y").cast("int").alias("y"))
        .withColumn("order", F.xxhash64("_k"))
        .orderBy("order", "_k")
        .limit(bound)
    )
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text"))
    # at most `bound` small rows
    found = texts.join(F.broadcast(chosen), "_k").groupBy("_k", "order", "y")
    return found.agg(F.min_by("_text", F.xxhash64("_text")).alias("text")).select("order", "y", "text")


def collected(rows: DataFrame, encode: Callable[[pa.Array], Iterator[bytes]], most: int) -> list[Row]:
    """order, y and the encoded text f of the training rows on the driver, in order: at most `most` bytes in all.

    A row with more than a sixteenth of that is left out, and the rows end before their sum passes `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = pa.array(list(encode(part.column(2))), pa.binary())
                yield pa.record_batch([part.column(0), part.column(1), found], names=["order", "y", "f"])

    table = materialize(rows.mapInArrow(run, "order long, y int, f binary").filter(F.length("f") <= most // 16), "training")
    sizes = sorted(tuple(r) for r in table.select("order", F.length("f")).collect())
    total, last = 0, None
    for order, size in sizes:
        total += size
        if total > most:
            break
        last = order
    told = [] if last is None else table.filter(F.col("order") <= last).collect()
    discard(table)
    return sorted(told, key=lambda r: (r["order"], r["y"], r["f"]))


def score_column(text: Column, scorer: Callable[[pa.Array], np.ndarray], rows: int = 256) -> Column:
    """A double from `scorer`, which sees `rows` texts at a time. Only texts go to Python and only scores come back."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [scorer(batch.slice(at, rows)) for at in range(0, len(batch), rows)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return score(text)
