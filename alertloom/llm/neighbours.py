"""Operator 8: nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is turned by one random rotation and kept as its signs (packed bits), its length and the
inner product of its direction with its code (the correction). The inner product with a query is estimated
from the packed bits: for each byte of the codes a table of 256 entries holds the query's share for every pattern of signs. The
correction gives the estimate's error bound. In each block the best
estimates are scored exactly, which gives a floor, and every vector whose estimate plus bound reaches
the floor is scored exactly, too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block; a task holds one block and streams the queries by. Smaller blocks use more cores, down to LEAST_BLOCK.
BLOCK = 32768
LEAST_BLOCK = 1024
#: Standard errors of the bound.
EPSILON = 3.5
_QUERIES = 64
#: Signs of the eight bits of every byte, a column for each byte.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).T.astype(np.float32) * 2 - 1


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _lengths(v: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares of components are out of range."""
    most = np.abs(v).max(axis=1, keepdims=True)
    return (most * np.linalg.norm(v / most, axis=1, keepdims=True))[:, 0]


def _turned(v: np.ndarray, norm: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rotated directions."""
    return (v / norm[:, None]).astype(np.float32) @ turn.T


def _encode(dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for batch in batches:
            v = _vectors(batch.column("vector"), dims)
            norm = _lengths(v)
            turned = _turned(v, norm, turn)
            codes = np.packbits(turned > 0, axis=1)
            agree = np.abs(turned).sum(axis=1) / math.sqrt(dims)
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("db", "is_query", "vec_id", "vector")),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(norm, pa.float64()),
                    pa.array(agree, pa.float32()),
                ],
                names=["db", "is_query", "vec_id", "vector", "code", "norm", "agree"],
            )

    return run


def _share_tables(turned: np.ndarray) -> np.ndarray:
    """(byte, query, pattern): what the eight components at a byte add to the inner product for each pattern of signs."""
    padded = np.pad(turned, ((0, 0), (0, -turned.shape[1] % 8)))
    return np.stack([padded[:, at : at + 8] @ _SIGNS for at in range(0, padded.shape[1], 8)])


class _Block:
    def __init__(self, parts: list[pa.RecordBatch], dims: int):
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.ids = table.column("vec_id").to_numpy(zero_copy_only=False)
        self.v = _vectors(table.column("vector"), dims)
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.codes = np.ascontiguousarray(codes.T)
        self.norm, agree = table.column("norm").to_numpy(), table.column("agree").to_numpy()
        self.correction = (1 / (agree * math.sqrt(dims))).astype(np.float32)
        spread = np.sqrt(np.maximum(1 - agree.astype(np.float64) ** 2, 0)) / agree
        self.bound = spread * EPSILON / math.sqrt(max(dims - 1, 1)) + 1e-6

    def estimates(self, turned: np.ndarray) -> np.ndarray:
        """Estimated cosines of the queries with all vectors, from the packed bits."""
        total = np.zeros((len(turned), len(self.ids)), np.float32)
        for shares, code in zip(_share_tables(turned), self.codes, strict=True):
            total += shares.take(code, axis=1)
        return total * self.correction

    def search(self, q: np.ndarray, length: float, own: int | None, cosine: np.ndarray, k: int):
        """Ids and exact scores of the k nearest of this block."""
        few = min(len(cosine), 4 * k + 1)
        best = np.argpartition(-cosine * self.norm, few - 1)[:few]
        exact = self.v[best] @ q
        exact = exact[self.ids[best] != own]
        floor = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) > k else -np.inf
        reach = np.flatnonzero((cosine + self.bound) * self.norm >= floor / length)
        reach = reach[self.ids[reach] != own]
        if not len(reach):
            return reach, np.zeros(0)
        near = self.v[reach] @ q
        if len(reach) > k:
            last = np.partition(near, len(near) - k)[len(near) - k]
            reach = reach[near >= last - 1e-9 * max(1.0, abs(last))]
        # summed from the first component to the last, so the same vectors always score the same
        score = np.cumsum(self.v[reach] * q, axis=1)[:, -1]
        order = np.lexsort((self.ids[reach], -score))[:k]
        return self.ids[reach][order], score[order]


def _search(dims: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        now, parts, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column("db").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if keys[0, a] != now:
                    now, parts, block = keys[0, a], [], None
                if not keys[1, a]:
                    parts.append(piece)
                    continue
                if not parts:
                    continue
                block = block or _Block(parts, dims)
                for at in range(0, piece.num_rows, _QUERIES):
                    part = piece.slice(at, _QUERIES)
                    q = _vectors(part.column("vector"), dims)
                    length = _lengths(q)
                    cosines = block.estimates(_turned(q, length, turn))
                    out_q, out_v, out_s = [], [], []
                    for i, own in enumerate(part.column("vec_id").to_pylist()):
                        ids, score = block.search(q[i], length[i], own, cosines[i], k)
                        out_q.append(np.full(len(ids), own))
                        out_v.append(ids)
                        out_s.append(score)
                    yield pa.record_batch(
                        [
                            pa.array(np.concatenate(out_q), pa.int64()),
                            pa.array(np.concatenate(out_v), pa.int64()),
                            pa.array(np.concatenate(out_s), pa.float64()),
                        ],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query but its own.

    Rows are dealt to blocks by the hash of their id, so many copies of a vector spread; each block
    meets all queries in one streaming task of its own, and only k rows per query and block are merged. Ties go
    to the smaller id. Unusable vectors (null, zero, null or non-finite components, null id) take no part on either side;
    usable ones of different lengths are an error. Of query rows with one id, the one with the
    least vector asks. Empty tables give no rows; other columns are ignored.
    """
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    base = base.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    asked = queries.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = asked.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    sizes = base.select(F.size("vector").alias("d")).unionByName(asked.select(F.size("vector").alias("d"))).groupBy("d").count()
    dims, fewest, n = sizes.agg(F.max("d"), F.min("d"), F.sum("count")).first()
    if dims != fewest:
        raise ValueError(f"vectors have from {fewest} to {dims} components")
    dims, n = dims or 1, n or 0
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / block), min(cores, n // LEAST_BLOCK))
    asked = asked.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = base.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("db"), F.lit(False).alias("is_query"), "vec_id", "vector"
    )
    asks = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("db"), F.lit(True).alias("is_query"), "vec_id", "vector"
    )
    shape = "db int, is_query boolean, vec_id long, vector array<double>, code binary, norm double, agree float"
    coded = rows.mapInArrow(_encode(dims), shape)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("code", "binary"), ("norm", "double"), ("agree", "float"))]
    together = coded.unionByName(asks.select("*", *none))
    found = (
        together.repartitionById(blocks, "db")
        .sortWithinPartitions("db", "is_query")
        .mapInArrow(_search(dims, k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda x, y: x + y) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
