"""Operator 12: the trie of conversation prefixes.

Conversations go to tasks by the digest of their first turn; inside a task (applyInPandas) a trie of dictionaries is built and
summed up by an iterative postorder. A first turn whose conversations have too many turns for one task is dealt out again by its
next turns, and those again, until every subtrie fits; how deep that goes follows from the number of turns below each
prefix, counted once. The prefixes above the subtries are summed by Spark. Equal conversations are counted before
they are shuffled, so a trie holds each distinct one once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators.blocks import BLOCK, in_blocks
from alertloom.session import materialize

#: Turns of one subtrie; with more it is dealt out by its next turn.
SUBTRIE = 50_000
NOBODY = hashlib.sha256(b"").hexdigest()
_PREFIX = ["depth", "f1", "f2"]
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, pos (from 1), the two hashes h1 and h2 of role and text, n_bytes of the text, in the order of turn (null
    first), role, text. Null roles and texts are empty; rows without a conversation id belong to none and are left out."""
    turns = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    hashed = turns.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.length("role"), "role"), "n_bytes": F.octet_length("text").cast("long")})
    numbered = in_blocks(hashed, ["conv_id"], ["turn", "role", "text"], block, "turns").number("pos").result()
    return numbered.select("conv_id", "pos", "h1", "h2", "n_bytes")


def graft(turns: DataFrame, heads: Column, step: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (as in ordered_turns) and the conversations (conv_id, n): each one takes the first `heads` turns, `most`
    at most, of the conversation conv_id - conv_id % step (all if it has fewer, none if it is absent) and its own turns after as many."""
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    convs = own.withColumns({"h": heads, "base": F.col("conv_id") - F.col("conv_id") % step})
    there = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_n"))
    convs = materialize(
        convs.join(there, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))),
        "grafted",
    )
    first = turns.filter((F.col("pos") <= most) & (F.col("conv_id") % step == 0)).withColumnRenamed("conv_id", "base")
    head = first.join(convs.select("conv_id", "base", "h"), "base").filter("pos <= h").select("conv_id", "pos", "h1", "h2", "n_bytes")
    tail = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    tail = tail.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "h1", "h2", "n_bytes")
    return head.unionByName(tail), convs.select("conv_id", "n")


def _digests(ends: DataFrame) -> DataFrame:
    """f1, f2, n, ends_sha256 of the ids that end there, read in order one by one, so no list of ids is held."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, told, out = None, None, []
        for part in parts:
            for f1, f2, n, conv in zip(*(part[c].tolist() for c in ("f1", "f2", "n", "conv_id")), strict=True):
                if (f1, f2, n) != now:
                    if now is not None:
                        out.append((*now, told.hexdigest()))
                    now, told = (f1, f2, n), hashlib.sha256(b"%d" % conv)
                else:
                    told.update(b",%d" % conv)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["f1", "f2", "n", "ends_sha256"])
                out = []
        if now is not None:
            out.append((*now, told.hexdigest()))
        yield pd.DataFrame(out, columns=["f1", "f2", "n", "ends_sha256"])

    dealt = ends.repartition("f1", "f2", "n").sortWithinPartitions("f1", "f2", "n", "conv_id")
    return dealt.mapInPandas(run, "f1 long, f2 long, n long, ends_sha256 string")


def _subtries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries of a bucket. A row is a prefix of one conversation: its depth, its hashes, the bytes of its last
    text, how many conversations it stands for and, at a conversation's end, the digest of those."""
    pdf = pdf.sort_values(["conv_id", "depth"])
    columns = ("conv_id", "depth", "f1", "f2", "n_bytes", "weight", "ends_sha256")
    children: list[dict[tuple[int, int], int]] = []
    info: list[list] = []  # conv_id, depth, parent, n_convs, bytes, digest
    roots: dict[tuple[int, int, int], int] = {}
    last, node = None, -1
    for conv, depth, f1, f2, n_bytes, weight, digest in zip(*(pdf[c].tolist() for c in columns), strict=True):
        held = roots if conv != last else children[node]
        key = (depth, f1, f2) if conv != last else (f1, f2)
        parent = -1 if conv != last else node
        last = conv
        node = held.setdefault(key, len(info))
        if node == len(info):
            children.append({})
            info.append([conv, depth, parent, 0, n_bytes, NOBODY])
        row = info[node]
        row[3] += weight
        if digest is not None:
            row[5] = digest
    leaves, saved = [0] * len(info), [0] * len(info)
    stack = [(root, False) for root in roots.values()]
    while stack:
        at, done = stack.pop()
        if not done and children[at]:
            stack.append((at, True))
            stack.extend((child, False) for child in children[at].values())
            continue
        leaves[at] = sum(leaves[c] for c in children[at].values()) or 1
        saved[at] = sum(saved[c] for c in children[at].values()) + (info[at][3] - 1) * info[at][4]
    out = [
        (conv, depth, info[parent][0] if parent >= 0 else None, n, len(children[at]), leaves[at], saved[at], digest)
        for at, (conv, depth, parent, n, _, digest) in enumerate(info)
    ]
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])
    return frame.astype({"parent_conv_id": "Int64"})


def prefix_trie(turns: DataFrame, convs: DataFrame, most: int = SUBTRIE, block: int = BLOCK) -> DataFrame:
    """One row a node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns has conv_id, pos (from 1, without holes), h1, h2, n_bytes; convs has conv_id and n, its number of turns, which may be 0. Each distinct
    sequence of first turns is a node, the root has depth 0. No conversations give no nodes, not even a root. Equal hashes of different
    prefixes (2 x 64 bits) are taken for equal."""
    # the hash of a prefix: that of each turn and its place, put together along the conversation
    at = turns.select("conv_id", "pos", "n_bytes", F.xxhash64("pos", "h1").alias("t1"), F.xxhash64("h2", "pos").alias("t2"))
    hashed = in_blocks(at, ["conv_id"], ["pos"], block, "prefixes").scan(
        {"f1": ("xor", F.col("t1")), "f2": ("xor", F.col("t2")), "first": ("max", F.when(F.col("pos") == 1, F.xxhash64("t1", "t2")))}
    )
    hashed = hashed.result().select("conv_id", F.col("pos").alias("depth"), "f1", "f2", "first", "n_bytes")
    zero = F.lit(0).cast("long")
    ends = hashed.join(convs.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"]).select("conv_id", "f1", "f2", F.col("depth").alias("n"))
    ends = materialize(ends.unionByName(convs.filter("n = 0").select("conv_id", zero.alias("f1"), zero.alias("f2"), zero.alias("n"))), "prefix-ends")
    same = ["f1", "f2", "n"]
    sizes = ends.groupBy(*same).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"))
    distinct = materialize(sizes.join(_digests(ends), same), "conversations")
    least, n_convs, at_root = distinct.agg(F.min("conv_id"), F.sum("weight"), F.max(F.when(F.col("n") == 0, F.col("ends_sha256")))).first()
    chosen = distinct.filter("n > 0").select("conv_id", "n", "weight", "ends_sha256")
    rows = hashed.join(chosen, "conv_id").withColumn("ends_sha256", F.when(F.col("depth") == F.col("n"), F.col("ends_sha256")))
    rows = materialize(rows, "prefix-rows")

    # at most one first turn for each `most` turns has too many turns below it, which bounds the broadcast
    sizes = rows.filter("depth = 1").groupBy("first").agg(_turns_below().alias("_size"))
    wide_first = materialize(sizes.filter(F.col("_size") > most).select("first"), "wide-turns")
    narrow, wide = rows.withColumn("_unit", F.col("first")), None
    if not wide_first.isEmpty():
        deep = rows.join(F.broadcast(wide_first), "first", "left_semi")
        wide, below = _wide(deep, most)
        narrow = narrow.join(F.broadcast(wide_first), "first", "left_anti").unionByName(below)
    buckets = max(1, ceil(2 * (distinct.agg(F.sum("n")).first()[0] or 0) / most))
    dealt = narrow.select("conv_id", "depth", "f1", "f2", "n_bytes", "weight", "ends_sha256", F.pmod("_unit", F.lit(buckets)).alias("_bucket"))
    every = materialize(dealt.groupBy("_bucket").applyInPandas(_subtries, _NODE), "subtries")
    if wide is not None:
        every = materialize(_with_wide_nodes(every, wide, block), "nodes")
    if least is None:
        return every
    every = every.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long")).otherwise(F.col("parent_conv_id")))
    firsts = every.filter("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens")
    )
    root = firsts.select(
        F.lit(least).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(n_convs).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(at_root or NOBODY).alias("ends_sha256"),
    )
    return every.unionByName(root)


def _turns_below() -> Column:
    return F.sum(F.col("n") - F.col("depth") + 1)


def _wide(deep: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Of conversations whose first turn is too wide: the rows of wide prefixes, and the rows below them with the subtrie (_unit) that they go to."""
    over = deep.groupBy(*_PREFIX).agg(_turns_below().alias("_size")).filter(F.col("_size") > most).select(*_PREFIX)
    wide = materialize(deep.join(materialize(over, "wide"), _PREFIX, "left_semi"), "wide-prefixes")
    # what is wide has wide prefixes, so a conversation's wide prefixes are its first ones; the next one heads a subtrie
    above = wide.groupBy("conv_id").agg(F.max("depth").alias("_above"))
    below = deep.join(above, "conv_id").filter(F.col("depth") > F.col("_above"))
    heads = below.filter(F.col("depth") == F.col("_above") + 1).select("conv_id", F.xxhash64(*_PREFIX).alias("_unit"))
    return wide, below.drop("_above").join(heads, "conv_id")


def _with_wide_nodes(nodes: DataFrame, wide: DataFrame, block: int) -> DataFrame:
    """The nodes of the subtries, linked to those of the wide prefixes. Each node counts for its least member; what stands below a wide prefix
    is summed along each member and then over all members. None of them is a leaf: at a prefix that nothing follows stands one turn."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    tops = wide.groupBy(*_PREFIX).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("ends_sha256").alias("ends_sha256")
    )
    tops = materialize(tops.withColumn("own", (F.col("n_convs") - 1) * F.col("n_bytes")), "wide-nodes")
    units = nodes.filter("parent_conv_id IS NULL AND depth > 1")
    parts = wide.select("conv_id", *_PREFIX, F.lit(0).alias("part"), zero.alias("leaves"), zero.alias("saved"))
    for node, leaves, saved in ((tops, zero, F.col("own")), (units, F.col("n_leaves"), F.col("saved_tokens"))):
        parts = parts.unionByName(
            node.select("conv_id", "depth", none.alias("f1"), none.alias("f2"), F.lit(1).alias("part"), leaves.alias("leaves"), saved.alias("saved"))
        )
    along = in_blocks(parts, ["conv_id"], ["depth", "part"], block, "wide-sums")
    summed = along.scan({"n_leaves": ("sum", F.col("leaves")), "saved_tokens": ("sum", F.col("saved"))}, backward=True).result()
    summed = summed.filter("part = 0").groupBy(*_PREFIX).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    # a node's least member has the parent's prefix too
    kids = units.select("conv_id", "depth").unionByName(tops.select("conv_id", "depth"))
    before = wide.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"))
    parents = tops.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("_parent"))
    links = materialize(kids.join(before, ["conv_id", "depth"]).join(parents, ["depth", "p1", "p2"]), "wide-links")
    counts = links.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    upper = tops.join(summed, _PREFIX).join(counts, _PREFIX).select(
        "conv_id", "depth", none.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256")
    )
    every = upper.unionByName(nodes).join(links.select("conv_id", "depth", "_parent"), ["conv_id", "depth"], "left")
    return every.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent")).drop("_parent")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of the one whose id is a multiple of five."""
    turns = materialize(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "ordered-turns")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    rebuilt, convs = graft(turns, heads, 5, 8)
    return prefix_trie(rebuilt, convs)


#: CRC-32 of the decimal id, bit by bit; prefixes as strings of digests; a node's subtree is found from the prefixes of its least member.
ORACLE = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda r, z: xor(r >> 1, (r & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1000000 + t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
d AS (SELECT conv_id, octet_length(encode(text)) AS bytes, row_number() OVER w AS depth,
    string_agg(md5(role || chr(1) || md5(text)), '') OVER w AS prefix FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
p AS (SELECT c.conv_id, 0 AS depth, '' AS prefix, 0 AS bytes FROM c UNION ALL SELECT conv_id, depth, prefix, bytes FROM d),
e AS (SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(prefix, depth) AS prefix FROM p GROUP BY conv_id) GROUP BY prefix),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS own FROM p GROUP BY prefix, depth),
k AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.prefix = left(n.prefix, 32 * u.depth)),
f AS (SELECT left(prefix, 32 * (depth - 1)) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT p.prefix, sum(k.own) AS saved, count(*) FILTER (f.n_children IS NULL) AS leaves
  FROM k LEFT JOIN f USING (prefix) JOIN p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY p.prefix)
SELECT k.conv_id, k.depth::BIGINT AS depth, k.parent_conv_id, k.n_convs::BIGINT AS n_convs, coalesce(f.n_children, 0)::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM k JOIN s USING (prefix) LEFT JOIN f USING (prefix) LEFT JOIN e USING (prefix)
"""
