"""Operator 11 against brute force, in one round and in many."""

import math
import random
import re
from collections import Counter

import pytest

from alertloom.llm.lexical import TERM, item_terms, ranked_search

SCHEMA = "doc_id long, text string, item_id string, n string, terms string, row string, score string"
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(TERM, (text or "").translate(UPPER))


def brute(docs, items, top):
    bags = [(i, terms(t)) for i, t in docs]
    full = [b for b in bags if b[1]]
    n_docs, n_terms = len(full), sum(len(b) for _, b in full)
    df = Counter(t for _, b in full for t in set(b))
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in queries.items():
        scores = []
        for d, b in full:
            tf, m, score = Counter(b), 25 + 75 * len(b) * n_docs // n_terms, 0
            for t, k in q.items():
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += k * w * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def search(spark, docs, items, top, **how):
    d = spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in docs], SCHEMA)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in ranked_search(d, q, top, **how).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ä", "ä", "漢字"]
    often = [1 / (k + 1) for k in range(63)]
    docs = [(rng.randrange(10**6), " ".join(rng.choices(words, often, k=rng.choice((1, 3, 10, 40, 400))))) for _ in range(150)]
    items = [(k, "-".join(rng.choices(words, often, k=rng.randint(1, 25)))) for k in range(12)]
    docs += [(7, items[0][1].upper())] * 3 + [(6, items[0][1])] * 12 + [(None, items[1][1]), (None, None), (8, ""), (9, " .,\n"), (10, "w1 " * 30_000 + "w59")]
    return docs, items + [(90, None), (91, ""), (92, "nowhere"), (None, "w1"), (3, "w3 w3 w40")]


@pytest.mark.parametrize(("seed", "top", "how"), [(1, 10, {}), (2, 10, {"first": 1}), (3, 3, {"first": 4, "most_terms": 0}), (4, 1000, {"first": 8})])
def test_the_best_documents_are_found(spark, seed, top, how):
    docs, items = corpus(seed)
    assert search(spark, docs, items, top, **how) == brute(docs, items, top)


def test_nothing_to_search(spark):
    docs, items = corpus(5)
    assert search(spark, [], items, 10) == []
    assert search(spark, [(1, None), (2, "")], items, 10) == []
    assert search(spark, docs, [], 10) == []
    assert search(spark, docs, [(1, "nowhere")], 10) == []
    assert search(spark, [(1, "same word"), (2, "same word")], [(1, "same")], 10) == brute([(1, "same word"), (2, "same word")], [(1, "same")], 10)


def test_terms_are_runs_of_letters_digits_and_others(spark):
    df = spark.createDataFrame([(1, "It's A_b c-3 É x")], "item_id long, text string")
    assert sorted((r.term, r.qtf) for r in item_terms(df).collect()) == [("3", 1), ("a", 1), ("b", 1), ("c", 1), ("it", 1), ("s", 1), ("É x", 1)]
