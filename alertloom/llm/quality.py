"""Operator 9: quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed words, word pairs and, as case and marks tell much of quality, word shapes with their pairs. Each of the
three families is weighted by tf-idf. A bounded sample of labelled rows (SAMPLE) gives document frequencies, the
latent space (the leading right singular vectors of the document-by-term matrix) and the labelled vectors. All three are
broadcast at a fixed size. Every document's vector meets all labelled vectors in blocks of exact cosine
products, and the nearest vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.hashing import mix, text_buffers, word_hashes
from alertloom.llm.labelled import collected, fold, score_column, training_rows

#: Hashed terms and weight of each family: words, word pairs, word shapes.
FAMILIES = ((2048, 1.0), (1024, 0.5), (1024, 1.0))
TERMS = sum(size for size, _ in FAMILIES)
DIMENSIONS = 48
#: Bytes of training terms that come to the driver at most.
SAMPLE_BYTES = 1 << 26
SAMPLE = 4096
NEIGHBOURS = 15
FOLDS, HELD_OUT = 3, 1
#: Texts of a block.
_ROWS = 128

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[48:58] = ord("0")
_SHAPE[128:] = ord("a")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("A"), ord("a"), ord("0")]] = True


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with letters and digits as classes, runs of one class cut to one."""
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    if len(shape) > 1:
        keep[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]
    keep[offsets[offsets < len(shape)]] = True
    return shape[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def _pairs(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = docs[1:] == docs[:-1]
    return mix(words[:-1] * np.uint64(3) + words[1:])[same], docs[1:][same]


def term_counts(column: pa.Array) -> np.ndarray:
    """Square roots of hashed term counts, a row of float32 for each text, the families side by side."""
    data, offsets = text_buffers(column)
    raw, docs = word_hashes(data, offsets)
    shape, _ = word_hashes(*_shapes(data, offsets), lower=False)
    again = np.zeros(len(raw), bool)
    again[1:] = (raw[1:] == raw[:-1]) & (docs[1:] == docs[:-1])
    token = mix(shape + again.astype(np.uint64))
    found = []
    for (size, _), groups in zip(FAMILIES, ([(raw, docs)], [_pairs(raw, docs)], [(token, docs), _pairs(token, docs)]), strict=True):
        cells = [of * size + (h % np.uint64(size)).astype(np.int64) for h, of in groups]
        counts = np.bincount(np.concatenate(cells), minlength=len(column) * size).reshape(len(column), size)
        found.append(np.sqrt(counts).astype(np.float32))
    return np.concatenate(found, axis=1)


_SPARSE = np.dtype([("term", "<u2"), ("count", "<f4")])


def _packed(column: pa.Array) -> Iterator[bytes]:
    """Terms that occur and their counts."""
    for row in term_counts(column):
        at = np.flatnonzero(row)
        out = np.empty(len(at), _SPARSE)
        out["term"], out["count"] = at, row[at]
        yield out.tobytes()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _latent_space(x: np.ndarray, dimensions: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    start = np.random.default_rng(5).standard_normal((x.shape[1], min(dimensions + 16, x.shape[1])))
    base = np.linalg.qr(start)[0].astype(np.float32)
    for _ in range(rounds):
        base = np.linalg.qr(x.T @ (x @ base))[0]
    turn = np.linalg.svd(x @ base, full_matrices=False)[2]
    return (base @ turn.T[:, :dimensions]).astype(np.float32)


class LatentNeighbours:
    """The latent space of the labelled rows and their vote; counts are rows as term_counts makes them."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int, neighbours: int):
        self.neighbours, self.prior = min(neighbours, len(labels)), float(labels.mean()) if len(labels) else 0.0
        self.labels = labels.astype(np.float32)
        seen = np.count_nonzero(counts, axis=0)
        self.idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 1
        weighted = self.weighted(counts)
        self.space = _latent_space(weighted, dimensions)
        self.points = _unit(weighted @ self.space).astype(np.float32)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """tf-idf, each family of unit length times its weight, and the whole of unit length."""
        out, at = counts * self.idf, 0
        for size, weight in FAMILIES:
            own = out[:, at : at + size]
            own *= weight / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
            at += size
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not self.neighbours:
            return np.zeros(len(counts))
        own = _unit(self.weighted(counts) @ self.space)
        near = own @ self.points.T
        best = np.argpartition(-near, self.neighbours - 1, axis=1)[:, : self.neighbours]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0.0).astype(np.float64) ** 2
        total = weight.sum(axis=1)
        votes = (weight * self.labels[best]).sum(axis=1)
        out = np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.prior)
        out[counts.sum(axis=1) == 0] = self.prior
        return np.clip(out, 0.0, 1.0)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
    dimensions: int = DIMENSIONS,
    neighbours: int = NEIGHBOURS,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
    keep: bool = False,
    score_name: str = "score",
    predicted_name: str = "predicted",
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; with keep, all its columns instead of
    doc_id and held_out.

    Null and empty texts have no terms and score the share of good labels. Null keys are never held
    out and never train. Repeated rows and equal texts score alike; of a key's texts one is learnt. Very long texts are scored
    whole, and learnt whole: their terms are a row of fixed size. Without any labels all scores are 0.
    An empty table gives no rows. With keep, the two new columns replace columns of their names.
    """
    told = collected(training_rows(docs, labels, label, folds, held_out, sample, key, text), _packed, SAMPLE_BYTES)
    counts = np.zeros((len(told), TERMS), np.float32)
    for row, r in zip(counts, told, strict=True):
        terms = np.frombuffer(r["f"], _SPARSE)
        row[terms["term"]] = terms["count"]
    fitted = LatentNeighbours(counts, np.array([r["y"] for r in told]), dimensions, neighbours)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    score = score_column(F.col(text), lambda texts: model.value.score(term_counts(texts)), _ROWS)
    predicted = (F.col(score_name) >= 0.5).cast("int")
    if keep:
        return docs.withColumn(score_name, score).withColumn(predicted_name, predicted)
    fold_of = F.coalesce(fold(F.col(key), folds) == held_out, F.lit(False))
    return docs.select(F.col(key).alias("doc_id"), fold_of.alias("held_out"), score.alias(score_name)).withColumn(predicted_name, predicted)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
