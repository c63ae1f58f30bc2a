"""Operator 12 against a plain trie in Python, with subtries that are dealt out again."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from alertloom.llm.prefix_trie import graft, ordered_turns, prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth string, n string"


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], set()).add(c)
        nodes.setdefault(("end", path), set()).add(c)
    ends = {p[1]: v for p, v in nodes.items() if p and p[0] == "end"}
    nodes = {p: v for p, v in nodes.items() if not p or p[0] != "end"}
    out = set()
    for p, v in nodes.items():
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(o) > len(q) and o[: len(q)] == q for o in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        told = hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()
        out.add((min(v), len(p), min(nodes[p[:-1]]) if p else None, len(v), len(kids), len(leaves), saved, told))
    return out


def trie(spark, rows, most, block):
    turns = ordered_turns(spark.createDataFrame(rows, SCHEMA), block=block)
    rebuilt, convs = graft(turns, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, 5, 8)
    got = [tuple(r) for r in prefix_trie(rebuilt, convs, most, block).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        stem = rng.choice([["a"], ["a", "b"], ["a", "b", "c", "d", "e", "f", "g", "h", "i"], ["z"], []])
        for k, text in enumerate(stem + [rng.choice("abü") for _ in range(rng.randint(0, 6))] or ["only"]):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "user", "assistant", None]), rng.choice([text, text, text, None, ""]), "x", "y"))
    rng.shuffle(rows)
    return rows + rows[:7]


@pytest.mark.parametrize(("seed", "most", "block"), [(1, 50_000, 1_000_000), (2, 12, 1_000_000), (3, 1, 5)])
def test_nodes_are_those_of_a_plain_trie(spark, seed, most, block):
    rows = conversations(seed, 45) + [(None, 0, "user", "lost", "x", "y")]
    # many copies of one conversation, and one that is long
    rows += [(c, k, "user", f"t{k}", "x", "y") for c in range(1000, 1100, 5) for k in range(4)] + [(505, k, "user", f"l{k}", "x", "y") for k in range(60)]
    assert trie(spark, rows, most, block) == brute(rows)


def test_a_turnless_conversation_and_no_conversations(spark):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "gone", "x", "y")]
    assert trie(spark, rows, 10, 100) == brute(rows) and len(brute(rows)) == 1
    assert trie(spark, [], 10, 100) == set()
