"""Operator 1: n-gram Jaccard join with rare-first prefix filtering.

1. One pass over the texts gives each document's class (hash of its shingle set; equal sets are one
   class) and adds its shingles to a count sketch of fixed size. The sketch never counts
   too few, so "rare first" by its counts is one order for all documents.
2. A second pass emits the prefix of each class: its n - ceil(t n) + 1 rarest shingles. Two sets with
   Jaccard >= t share a prefix shingle, whatever the order.
3. Candidates that share a prefix shingle must pass the length filter, the positional filter and
   the suffix filter, and are verified once per pair on the whole sets.
   Each posting list pairs its members with one leader, the member that holds the shingle earliest in
   its prefix and so passes the positional filter with most others (linear). Links make components. A list
   whose members are in one component is done; in the others the next leader is taken among the members outside
   the largest component, round by round, until the pairs between components that are left are at most twice the postings,
   or a round removes less than a tenth of them, or after twelve rounds; what is left is tested.
   Of two members of a list the smaller must stand in the shorter prefix by which larger partners find it, so documents
   that share a template but are not similar meet in no list, and a group of near copies never becomes all pairs.
   No link between components is lost.
4. Components are labelled with the least doc_id in them.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.common import SHINGLE, SIMILARITY, unused
from alertloom.llm.components import extended_components
from alertloom.llm.hashing import mix, shingle_sets
from alertloom.session import discard, materialize

#: log2 of the sketch's counters; the broadcast ranks are this many bytes.
SKETCH_BITS = 22
_CHUNK = 1 << 16
#: Words of 64 bits in the parity sketch that the suffix filter compares before a join of texts.
_PARITY_WORDS = 8
_PARITY = [f"o{i}" for i in range(_PARITY_WORDS)]
#: Parts of the hash range that the suffix filter compares once texts are there.
_SUFFIX_PARTS = 64
#: Rounds with one leader a list go on until the pairs left are at most so many times the postings.
_REST = 2
_ROUNDS = 12


def _percent(threshold: float) -> int:
    return round(threshold * 100)


def _prefix(n: np.ndarray | int, percent: int):
    return n - (-(-percent * n // 100)) + 1


def _class_of(hashes: np.ndarray) -> int:
    at = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    return int(mix(np.sum(mix(hashes + at * np.uint64(0x9E3779B97F4A7C15)), keepdims=True)).view(np.int64)[0])


def _parity(hashes: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the number of hashes that fall on i. Where the bits of two sets differ,
    the sets differ in a shingle that falls there."""
    at = (hashes >> np.uint64(40)).astype(np.int64) % (64 * _PARITY_WORDS)
    odd = (np.bincount(at, minlength=64 * _PARITY_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows, which bounds what a task holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _classes_and_counts(n_gram: int, bits: int) -> Callable:
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in _parts(batches):
            size, cls, odd = [], [], []
            waiting: list[np.ndarray] = []
            for hashes in shingle_sets(batch.column(1), n_gram):
                size.append(len(hashes))
                cls.append(_class_of(hashes) if len(hashes) else None)
                odd.append(_parity(hashes))
                waiting.append((hashes & mask).astype(np.int64))
                if len(waiting) == 1024:
                    np.add.at(counts, np.concatenate(waiting), 1)
                    waiting = []
            if waiting:
                np.add.at(counts, np.concatenate(waiting), 1)
            none = pa.nulls(len(size), pa.int32())
            words = np.array(odd, np.int64).reshape(-1, _PARITY_WORDS)
            yield pa.record_batch(
                [
                    *(batch.column(0), batch.column(2), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), none, pa.nulls(len(size), pa.binary())),
                    *(pa.array(words[:, i]) for i in range(_PARITY_WORDS)),
                ],
                names=["doc_id", "th", "cls", "n", "chunk", "counts", *_PARITY],
            )
        width = min(_CHUNK, len(counts))
        parts = [(i, counts[at : at + width]) for i, at in enumerate(range(0, len(counts), width))]
        parts = [(i, zlib.compress(p.tobytes(), 1)) for i, p in parts if p.any()]
        none = pa.nulls(len(parts), pa.int64())
        yield pa.record_batch(
            [none, none, none, none, pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())]
            + [none] * _PARITY_WORDS,
            names=["doc_id", "th", "cls", "n", "chunk", "counts", *_PARITY],
        )

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the chunks of the sketch as they stream by; a task holds few chunks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(data), np.uint32)
            total[chunk] = total[chunk] + part if chunk in total else part.astype(np.uint64)
            np.minimum(total[chunk], np.uint64(2**32 - 1), out=total[chunk])
    yield pa.record_batch(
        [
            pa.array(list(total), pa.int32()),
            pa.array([zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in total.values()], pa.binary()),
        ],
        names=["chunk", "counts"],
    )


def _frequency_ranks(parts: DataFrame, bits: int) -> np.ndarray:
    """Eight ranks for each doubling of a counter, one byte each: fixed size on the driver."""
    few = parts.repartition("chunk", F.pmod(F.xxhash64("counts"), F.lit(16))).mapInArrow(_add_counts, parts.schema)
    few = few.repartition("chunk").mapInArrow(_add_counts, parts.schema)
    ranks = np.zeros(1 << bits, np.uint8)
    width = min(_CHUNK, 1 << bits)
    for row in few.toLocalIterator():
        counts = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
        ranks[row["chunk"] * width :][:width] = np.minimum(np.log2(np.maximum(counts, 1)) * 8, 255).astype(np.uint8)
    return ranks


def _order(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places of the hashes, rare first; ties by the hash."""
    return np.lexsort((hashes, ranks[(hashes & np.uint64(len(ranks) - 1)).astype(np.int64)]))


def _postings(n_gram: int, percent: int, ranks_of: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(ranks_of(), np.uint8)
        for batch in _parts(batches):
            out: list[tuple] = []
            seen: set[int] = set()  # of this part
            for hashes in shingle_sets(batch.column(1), n_gram):
                n = len(hashes)
                if not n or (cls := _class_of(hashes)) in seen:
                    continue
                seen.add(cls)
                top = hashes[_order(hashes, ranks)[: _prefix(n, percent)]]
                out.append((top.view(np.int64), np.full(len(top), cls), np.full(len(top), n), np.arange(len(top))))
            if out:
                h, c, n, p = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch(
                    [pa.array(h), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(p, pa.int32())],
                    names=["h", "cls", "n", "pos"],
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts, each behind its length in bytes."""
    codec = pa.Codec("zstd", 3)
    for batch in _parts(batches):
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        texts = [len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in raw]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(texts, pa.binary())], names=["doc_id", "th", "packed"])


def _verify(n_gram: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")

        def sets(column: pa.Array) -> Iterator[np.ndarray]:
            part = column.dictionary_encode()  # a leader's text comes once
            raw = (codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in part.dictionary.to_pylist())
            own = list(shingle_sets(pa.array([x.decode() for x in raw], pa.large_string()), n_gram))
            yield from (own[i] for i in part.indices.to_pylist())

        for batch in _parts(batches, 128):
            keep = [_similar(a, b, percent) for a, b in zip(sets(batch.column("pa")), sets(batch.column("pb")), strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Suffix filter, then the exact test. The filter parts the hash range: no more can be shared
    than the smaller of the two counts in every part."""
    both = len(a) + len(b)
    need = -(-percent * both // (100 + percent))
    shift = np.uint64(64 - _SUFFIX_PARTS.bit_length() + 1)
    ca = np.bincount((a >> shift).astype(np.int64), minlength=_SUFFIX_PARTS)
    cb = np.bincount((b >> shift).astype(np.int64), minlength=_SUFFIX_PARTS)
    if np.minimum(ca, cb).sum() < need:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (both - shared)


def _need(n_a: Column, n_b: Column, percent: int) -> Column:
    """Shingles that two sets of these sizes must share."""
    return F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100 + percent) - 1e-9)


def _differences() -> Column:
    """Suffix filter: at least so many shingles are in one of the two sets only."""
    return reduce(operator.add, (F.bit_count(F.col(o).bitwiseXOR(F.col(f"{o}_m"))) for o in _PARITY))


def _indexed(percent: int) -> Column:
    """Whether a member of a list can be found there by partners of its size or more. They share 2t / (1 + t) of its shingles, more than the t that
    smaller partners do, so it stands early enough only in the lists of a shorter prefix."""
    n = F.col("n")
    return F.col("pos") <= n - F.ceil(F.lit(2 * percent) * n / F.lit(100 + percent) - 1e-9)


def _may_link(n_a: Column, n_b: Column, pos_a: Column, pos_b: Column, percent: int) -> Column:
    """Length and positional filters, in whole numbers."""
    need = _need(n_a, n_b, percent)
    length = (100 * F.least(n_a, n_b)) >= (percent * F.greatest(n_a, n_b))
    return length & (F.least(n_a - pos_a, n_b - pos_b) >= need)


def ngram_links(docs: DataFrame, key: str, text: str, threshold: float, n_gram: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """members (doc_id, th, cls, n) and the component of each linked class (node, root)."""
    spark = docs.sparkSession
    percent = _percent(threshold)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    both = materialize(
        source.mapInArrow(
            _classes_and_counts(n_gram, bits), "doc_id long, th long, cls long, n long, chunk int, counts binary, " + ", ".join(f"{o} long" for o in _PARITY)
        ),
        "classes",
    )
    members = both.filter("chunk IS NULL").select("doc_id", "th", "cls", "n", *_PARITY)
    ranks = spark.sparkContext.broadcast(
        _frequency_ranks(both.filter("chunk IS NOT NULL").select("chunk", "counts"), bits).tobytes()
    )
    rows = materialize(source.mapInArrow(_postings(n_gram, percent, lambda: ranks.value), "h long, cls long, n int, pos int"), "prefixes")
    several = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.bool_or(_indexed(percent)).alias("some")).filter("c > 1 AND some").select("h")
    found = materialize(rows.join(several, "h", "left_semi").distinct(), "postings")
    discard(rows)
    classes = materialize(_classes(members, found), "class-rows")
    texts = _class_texts(source, classes)
    postings, before = found.count(), None
    lists, roots, tested = _with_first_leaders(found), None, []
    discard(found)
    while True:
        final = before is not None and (before[0] <= _REST * postings or before[0] > 0.9 * before[1] or len(tested) >= _ROUNDS)
        pairs = _rest_of_pairs(lists, percent) if final else _leader_pairs(lists, percent)
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")  # once per pair
        pairs = materialize(_near(pairs, classes, percent), "pairs")
        tested.append(pairs)
        links = _verified(pairs, texts, n_gram, percent)
        old_roots, roots = roots, extended_components(roots, links)
        discard(links, *([old_roots] if old_roots is not None else []))
        if final:
            break
        old_lists, lists = lists, _with_next_leaders(lists, roots, percent)
        discard(old_lists)
        left = lists.select("h", "many").distinct().agg(F.sum("many")).first()[0]
        if left is None:
            break
        before = (left, before[0] if before else float("inf"))
    discard(lists, texts, classes, *tested)
    return members, roots


_LEADER = "place", "cls", "n", "pos", "part"


def _with_first_leaders(found: DataFrame) -> DataFrame:
    """Lists of several classes, each member with its list's leader."""
    rows = found.withColumns({"place": _place(), "part": F.col("cls")})
    leaders = rows.groupBy("h").agg(F.min(F.struct(*_LEADER)).alias("leader"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    leaders = leaders.filter("low < high").select("h", "leader", F.lit(None).cast("long").alias("main"), F.lit(None).cast("double").alias("many"))
    return materialize(rows.drop("place").join(leaders, "h"), "lists")


def _with_next_leaders(lists: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """What is left of the lists, without the leaders that have been compared with all: those with members of several
    components, some of them indexed. The next leader is outside the largest component (main); many is the number of pairs left at most."""
    rows = lists.filter("cls <> leader.cls").select("h", "cls", "n", "pos").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    rows = materialize(rows.withColumns({"part": F.coalesce("root", "cls"), "place": _place()}).drop("root"), "rows")
    sizes = rows.groupBy("h", "part").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct(*_LEADER)).alias("first"), F.sum(_indexed(percent).cast("double")).alias("i")
    )
    largest = F.struct("c", "part")
    mains = (
        sizes.groupBy("h")
        .agg(
            F.max_by("part", largest).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("all"), F.max("c").alias("most"),
            F.sum("i").alias("indexed"), F.max_by("i", largest).alias("in_main"),
        )
        .filter("parts > 1 AND indexed > 0")
        .select("h", "main", ((F.col("indexed") - F.col("in_main")) * F.col("all") + F.col("in_main") * (F.col("all") - F.col("most"))).alias("many"), (F.col("indexed") - F.col("in_main")).alias("outside"))
    )
    leaders = sizes.join(mains, "h").filter("part <> main").groupBy("h", "main", "many", "outside").agg(F.min("first").alias("leader"))
    out = materialize(rows.drop("place").join(leaders, "h").select("h", "cls", "n", "pos", "part", "leader", "main", "many", "outside"), "lists")
    discard(rows)
    return out


def _place() -> Column:
    """Place of a member in its list: by the part of its set that stands before the shingle, ties by a hash."""
    return F.floor(F.lit(4096) * F.col("pos") / F.col("n")) * F.lit(1 << 32) + F.xxhash64("cls", "h").bitwiseAND(F.lit((1 << 32) - 1))


def _leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    may = _may_link(F.col("n"), F.col("leader.n"), F.col("pos"), F.col("leader.pos"), percent)
    found = lists.filter((F.col("part") != F.col("leader.part")) & may)
    return found.select(F.least("cls", "leader.cls").alias("a"), F.greatest("cls", "leader.cls").alias("b")).distinct()


def _rest_of_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs between components that the lists still hold: of an indexed member with one of its size or more, at least one of the two
    outside the largest component. Members that aren't indexed in a list are not paired with each other."""
    inner = F.col("part") == F.col("main")
    # members of the largest component are met in lists with an indexed member outside it only, and not by each other
    sides = lists.filter(~inner | (F.col("outside") > 0)).select("h", "cls", "n", "pos", "part", inner.alias("inner"))
    both = F.when(inner, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    small = lists.filter(_indexed(percent)).select("h", *[F.col(c).alias(f"{c}_m") for c in ("cls", "n", "pos", "part")], F.explode(both).alias("inner"))
    pairs = small.join(sides, ["h", "inner"])
    return (
        pairs.filter(
            (F.col("part") != F.col("part_m")) & (F.col("n") >= F.col("n_m")) & _may_link(F.col("n"), F.col("n_m"), F.col("pos"), F.col("pos_m"), percent)
        )
        .select(F.least("cls", "cls_m").alias("a"), F.greatest("cls", "cls_m").alias("b"))
        .distinct()
    )


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the suffix filter on their parity sketches."""
    one = classes.select(F.col("cls").alias("a"), "n", *_PARITY)
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_m"), *[F.col(o).alias(f"{o}_m") for o in _PARITY])
    most = F.col("n") + F.col("n_m") - 2 * _need(F.col("n"), F.col("n_m"), percent)
    return pairs.join(one, "a").join(two, "b").filter(_differences() <= most).select("a", "b")


def _classes(members: DataFrame, found: DataFrame) -> DataFrame:
    """cls, its size, the first document that has it and its parity sketch, for each class in a shared list."""
    wanted = found.select("cls").distinct()
    # aggregated before the join: many copies of one text are combined where they are read
    first = members.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min(F.struct("doc_id", "th")).alias("of"), F.max("n").alias("n"), *[F.max(o).alias(o) for o in _PARITY]
    )
    return first.join(wanted, "cls", "left_semi")


def _class_texts(source: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, packed: the text of one document for each class that stands in a shared list."""
    packed = source.mapInArrow(_pack, "doc_id long, th long, packed binary")
    of = classes.select("cls", F.col("of.doc_id").alias("_d"), F.col("of.th").alias("_t"))
    chosen = packed.join(of, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    return materialize(chosen.groupBy("cls").agg(F.first("packed").alias("packed")), "class-texts")


def _verified(pairs: DataFrame, texts: DataFrame, n_gram: int, percent: int) -> DataFrame:
    one = texts.withColumnsRenamed({"cls": "a", "packed": "pa"})
    two = texts.withColumnsRenamed({"cls": "b", "packed": "pb"})
    tested = pairs.join(one, "a").join(two, "b").select("a", "b", "pa", "pb").mapInArrow(
        _verify(n_gram, percent), "a long, b long, linked boolean"
    )
    return materialize(tested.filter("linked").select("a", "b"), "links-verified")


def ngram_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = SIMILARITY,
    n_gram: int = SHINGLE,
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, text_hash, group_id for every document.

    group_id names the component even where keys are null or repeated. Documents without words (null,
    empty, blank) have no shingles and link with nothing, not even each other; their class_id and
    group_id are null. Repeated rows and equal texts share a class. Rows whose key is null take part,
    but a component's id is the least key that isn't null (null if there is none). The key must be a
    whole number. An empty table gives no rows, and other columns are ignored. Sets are kept as
    64-bit hashes.
    """
    members, roots = ngram_links(docs, key, text, threshold, n_gram, sketch_bits)
    ids = members.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("low"))
    parts = ids.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = parts.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = parts.join(least, "root").select("cls", "component_id", "root")
    return members.join(labels, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("cls").alias("class_id"),
        F.col("th").alias("text_hash"),
        F.col("root").alias("group_id"),
    )


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, all its columns kept: the one with the least key, nulls last,
    then the least text hash. Documents without words all stay."""
    found = ngram_components(docs, key, text, **options)
    k, h, one, token = unused(docs, "_k", "_h", "_one", "_token")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    first = (
        found.filter("group_id IS NOT NULL")
        .groupBy("group_id")
        .agg(F.min(rank).alias("f"))
        .select(F.col("f.doc_id").alias(k), F.col("f.text_hash").alias(h), F.lit(True).alias(one))
    )
    wordless = found.filter("group_id IS NULL").select(F.col("doc_id").alias(k), F.col("text_hash").alias(h)).distinct()
    stay = first.unionByName(wordless.withColumn(one, F.lit(False)))
    kept = docs.join(stay, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.col(text)) == F.col(h)))
    # rows that repeat key and text are one document; rows without words keep their number
    number = F.when(F.col(one), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())
    return kept.withColumn(token, number).dropDuplicates([k, h, token]).select(*docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle, so for small tables only.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
x AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT x.b, r.root FROM r JOIN x ON x.a = r.node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.root) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.g)
"""
