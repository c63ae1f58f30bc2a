"""Operator 7: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted on a bounded sample of labelled rows (SAMPLE, SAMPLE_BYTES), whose hashed features, not
texts, come to the driver; per-coordinate rates and L1 leave few weights, which are broadcast as sorted
pairs. Every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.hashing import mix, text_buffers, word_hashes
from alertloom.llm.labelled import collected, fold, score_column, training_rows

BITS = 20
SAMPLE = 8000
#: Bytes of training features (four each) that come to the driver at most.
SAMPLE_BYTES = 1 << 27
FOLDS, HELD_OUT = 5, 0
#: Every ASCII character but letters and digits parts words.
_PARTS = np.ones(128, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_TO_BLANK = np.arange(256, dtype=np.uint8)
_TO_BLANK[:128][_PARTS] = 0x20
_SKIP = 2
#: Beginnings of words, in bytes, that count beside whole words, so that inflected forms share a feature.
_STEMS = (4, 5, 6, 7, 8)


def features(column: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """Distinct hashed words, stems, word pairs and pairs that skip up to _SKIP - 1 words, of each text."""
    mask = np.uint64((1 << bits) - 1)
    for at in range(0, len(column), 256):
        part = column.slice(at, 256)
        data, offsets = text_buffers(part)
        words, docs, stems = word_hashes(_TO_BLANK[data], offsets, stems=_STEMS)
        cuts = np.searchsorted(docs, np.arange(len(part) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            w = words[a:b]
            stem = stems[:, a:b].ravel()
            grams = [w, stem[stem != 0]] + [mix(w[:-k] * np.uint64(2 * k + 1) + w[k:]) for k in range(1, _SKIP + 1) if len(w) > k]
            yield np.unique(np.concatenate(grams) & mask).astype(np.int64)


class Ftrl:
    """FTRL-proximal for log loss on binary features, with a bias that is not regularised."""

    def __init__(self, size: int, alpha: float = 0.6, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        l2 = np.where(at == len(self.z) - 1, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = 3, **rates: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and weights that aren't zero, and the bias."""
    model = Ftrl(1 << bits, **rates)
    for _ in range(epochs):
        for y, at in rows:
            model.learn(at, y)
    every = model.weights(np.arange((1 << bits) + 1))
    at = np.flatnonzero(every[:-1])
    return at, every[at], float(every[-1])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
    bits: int = BITS,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts have no features and score by the bias alone. Null keys are never held out and
    never train. Repeated rows and equal texts score alike; of a key's texts one is learnt. Very long texts are scored whole;
    one with more than SAMPLE_BYTES / 64 distinct features is not learnt from. Without any labels all scores are 0. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession

    def packed(texts: pa.Array) -> Iterator[bytes]:
        return (x.astype("<i4").tobytes() for x in features(texts, bits))

    told = collected(training_rows(docs, labels, label, folds, held_out, sample, key, text), packed, SAMPLE_BYTES)
    at, weights, bias = fit([(r["y"], np.frombuffer(r["f"], "<i4")) for r in told], bits)
    model = spark.sparkContext.broadcast((at, weights, bias, bool(told)))

    def score(texts: pa.Array) -> np.ndarray:
        at, weights, bias, any_label = model.value
        if not any_label:
            return np.zeros(len(texts))
        margin = np.full(len(texts), bias)
        for i, found in enumerate(features(texts, bits)):
            place = np.minimum(np.searchsorted(at, found), len(at) - 1)
            margin[i] += weights[place[at[place] == found]].sum() if len(at) else 0.0
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))

    fold_of = F.coalesce(fold(F.col(key), folds) == held_out, F.lit(False))
    scored = docs.select(F.col(key).alias("doc_id"), fold_of.alias("held_out"), score_column(F.col(text), score).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
