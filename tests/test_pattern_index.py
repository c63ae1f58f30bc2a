"""The index of patterns loses no pair that fits, and keeps candidates few."""

import json
import random

from pyspark.sql import functions as F

from alertloom.functions import shapes
from alertloom.operators import memory
from alertloom.operators.pattern_index import candidate_pairs

PATH = "struct<" + ",".join(f"{n}:string" for n in memory.LAYERS) + ">"


def template(rng, marks):
    number = rng.choice(["<NUMBER>"]) if marks else str(rng.randrange(99))
    kind = rng.randrange(5)
    if kind == 0:
        return rng.choice([f"login {number} ok", f"lo{number}", number, f"{number} end", "plain text", ""])
    if kind == 1:
        return json.dumps(rng.choice([number, [number, "x"], {"a": number}]))
    value = {"command": f"run {number} {rng.choice(['fast', 'slow'])}", "level": rng.choice(["1", "2", number]), "deep": {"x": [rng.choice("ab"), rng.choice([1, 2, None])]}}
    return json.dumps(value if kind < 4 else {**value, "more": 1}, sort_keys=True)


def test_no_pair_is_lost(spark):
    rng = random.Random(3)
    layer = lambda: rng.choice("ppppq")
    paths = [(str(i), ("s", layer(), f"10.0.{rng.randrange(3)}.{rng.randrange(9)}", layer(), layer(), template(rng, False))) for i in range(400)]
    patterns = []
    for i in range(120):
        net, text = rng.random() < 0.8, rng.random() < 0.7
        source = f"10.0.{rng.randrange(3)}.0/24" if net else f"10.0.{rng.randrange(3)}.{rng.randrange(9)}"
        form = template(rng, text)
        fields = ["source_entity"] * net + ["attribute_template"] * text
        rules = [(k, m, ["number:digits"]) for k, m in enumerate(shapes._MARK.findall(form))]
        patterns.append((f"g{i}", ("s", layer(), source, layer(), layer(), form), fields, rules))
    want = set()
    for digest, path in paths:
        for ident, form, fields, rules in patterns:
            layers = zip(memory.LAYERS, form, path, strict=True)
            if all(shapes.layer_matches(n, g, p, rules if n == "attribute_template" else []) if n in fields else g == p for n, g, p in layers):
                want.add((digest, ident))
    left = spark.createDataFrame(paths, f"digest string, path {PATH}")
    right = spark.createDataFrame([p[:3] for p in patterns], f"general_id string, pattern {PATH}, generalized_fields array<string>")
    got = [tuple(r) for r in candidate_pairs(left, right, memory.LAYERS, "attribute_template").collect()]
    assert len(set(got)) == len(got) and want <= set(got) and len(want) > 50
    assert len(got) < len(paths) * len(patterns) / 12


def test_a_path_meets_few_of_many_patterns(spark):
    layers = lambda c: F.struct(*[F.lit("x").alias(n) for n in memory.LAYERS[:-1]], c.alias("attribute_template"))
    text = lambda mark: F.concat(F.lit('{"command":"job '), mark, F.lit('","name":"n'), F.col("id").cast("string"), F.lit('"}'))
    left = spark.range(3000).select(F.col("id").cast("string").alias("digest"), layers(text(F.lit("7"))).alias("path"))
    right = spark.range(3000).select(
        F.col("id").cast("string").alias("general_id"), layers(text(F.lit("<NUMBER>"))).alias("pattern"), F.array(F.lit("attribute_template")).alias("generalized_fields")
    )
    got = candidate_pairs(left, right, memory.LAYERS, "attribute_template")
    assert got.count() == 3000 and got.filter("digest <> general_id").count() == 0


def test_no_patterns(spark):
    left = spark.createDataFrame([], f"digest string, path {PATH}")
    right = spark.createDataFrame([], f"general_id string, pattern {PATH}, generalized_fields array<string>")
    assert candidate_pairs(left, right, memory.LAYERS, "attribute_template").count() == 0


def test_equal_patterns_are_tested_as_one(spark, monkeypatch):
    seen = []
    pairs = memory.candidate_pairs
    monkeypatch.setattr(memory, "candidate_pairs", lambda paths, patterns, *rest: seen.append(patterns.count()) or pairs(paths, patterns, *rest))
    objects = spark.createDataFrame(
        [("x", "alert", "d", "s", ["10.0.0.9"], ["t"], ["tcp/1"], "{}")],
        "object_id string, object_type string, alert_source string, alert_semantics string, sources array<string>, targets array<string>, services array<string>, attributes string",
    )
    path = ("d", "s", "10.0.0.0/24", "t", "tcp/1", "")
    known = [(f"p{i}", path, "generalized", 5 + i, 2, True, True, None, ["source_entity"], [], "") for i in range(3)]
    kinds = "fingerprint_id string, path struct<" + ",".join(f"{c}:string" for c in memory.LAYERS) + ">, kind string, support long, distinct_exact_paths int, active boolean, verified boolean, expires_at timestamp, generalized_fields array<string>, constraints " + memory._RULE + ", digest string"
    decided = lambda rows: memory.decide(objects, spark.createDataFrame(rows, kinds)).first()
    assert decided(known).reason == "ambiguous_generalized_match"
    assert (decided(known[1:2]).fingerprint_id, decided(known[1:2]).support) == ("p1", 6)
    assert seen[0] == 1
