"""Scans by blocks against plain loops, with keys cut and whole."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import context as context_module
from alertloom.operators import scoring, sessions
from alertloom.operators.asof import nearest_seed
from alertloom.operators.blocks import in_blocks
from alertloom.operators.context import context
from alertloom.operators.sessions import session_starts


@pytest.mark.parametrize("rows", [7, 100_000])
@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_scans(spark, rows, backward, strict):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "a", "b", None, str(i)]), rng.choice([None, *range(30)]), i, rng.choice([None, *range(-9, 9)])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t long, id long, v long")
    v = F.col("v")
    wanted = {"s": ("sum", v), "x": ("xor", v), "hi": ("max", v), "lo": ("min", v), "near": ("last", v)}
    got = in_blocks(df, ["k"], ["t", "id"], rows).scan(wanted, backward, strict).result().collect()
    want = {}
    groups = {}
    for k, t, i, x in data:
        groups.setdefault(k, []).append(((-1 if t is None else t, i), i, x))
    for k, members in groups.items():
        seen = []
        for _, i, x in sorted(members, reverse=backward):
            if not strict and x is not None:
                seen.append(x)
            xor = 0
            for s in seen:
                xor ^= s
            want[i] = (k, sum(seen), xor, max(seen), min(seen), seen[-1]) if seen else (k, None, None, None, None, None)
            if strict and x is not None:
                seen.append(x)
    assert {r.id: (r.k, r.s, r.x, r.hi, r.lo, r.near) for r in got} == want


def test_a_key_with_most_rows_is_dealt_over_many_tasks(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 5 < 4, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("t"))
    blocks = in_blocks(df, ["k"], ["t"], 250)
    sizes = [r["count"] for r in blocks.rows.groupBy("k", "_block").count().collect()]
    assert max(sizes) <= 500 and len([s for s in sizes if s > 1]) >= 10
    numbers = blocks.number("n").result().filter("k = 'hot'").orderBy("t").select("n").collect()
    assert [r.n for r in numbers] == list(range(1, 3201))


def test_an_empty_table(spark):
    assert in_blocks(spark.createDataFrame([], "k string, t long"), ["k"], ["t"]).number("n").result().count() == 0


def fold(times, gap, cap):
    start, last, out = None, None, {}
    for t in sorted(set(times)):
        if start is None or (gap is not None and t - last > gap) or t - start > cap:
            start = t
        out[t] = start
        last = t
    return out


@pytest.mark.parametrize(("gap", "fold_times"), [(3, 1000), (3, 2), (None, 1000), (None, 2)])
def test_sessions_of_a_busy_key(spark, gap, fold_times):
    rng = random.Random(6)
    data = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, *range(500)])) for i in range(700)]
    df = spark.createDataFrame(data, "alert_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.alert_id: r.session_start for r in session_starts(df, ["k"], "ts", "alert_id", gap, 20, fold_times, block=40).collect()}
    starts = {k: fold([s for _, x, s in data if x == k and s is not None], gap, 20) for k in ("hot", "a", None)}
    assert got == {i: None if s is None else starts[k][s] * 1_000_000 for i, k, s in data}


def test_nearest_seeds_of_a_busy_key(spark):
    rng = random.Random(7)
    data = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, *range(120)]), rng.choice("spn")) for i in range(500)]
    df = spark.createDataFrame(data, "id long, k string, s long, kind string").withColumn("ts", F.timestamp_seconds("s"))
    got = nearest_seed(df, ["k"], "ts", "id", "id", F.col("kind") == "s", F.col("kind") == "p", 2, block=25).collect()
    want = {}
    for i, k, s, kind in data:
        seeds = [(t, j) for j, x, t, what in data if what == "s" and x == k and t is not None]
        best = None
        if kind == "p" and s is not None:
            before = max((x for x in seeds if x[0] < s), default=None)
            after = min((x for x in seeds if x[0] >= s), default=None)
            best = min(((abs(x[0] - s), *x) for x in (before, after) if x), default=None)
        want[i] = best[2] if best and best[0] <= 2 else None
    assert {r.id: r._near for r in got} == want and len(got) == len(data)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_context_of_a_busy_entity(spark, direction):
    rng = random.Random(8)
    data = [(f"o{i:03}", i * 7 % 400, rng.choice([["hot"], ["hot"], ["a", "b"], []]), rng.choice([["x"], ["hot", "y"], ["z"]])) for i in range(300)]
    objects = spark.createDataFrame(data, "object_id string, s long, sources array<string>, targets array<string>")
    objects = objects.withColumns({"start_ts": F.timestamp_seconds("s"), "end_ts": F.timestamp_seconds(F.col("s") + F.col("s") % 3)})
    found = [{tuple(map(str, r)) for r in context(objects, objects, direction, 60, 4, block=b).collect()} for b in (20, 1_000_000)]
    assert found[0] == found[1]
    spans = {i: (s, s + s % 3, set(a), set(b)) for i, s, a, b in data}
    want = 0
    for i, (s, e, a, b) in spans.items():
        seeds = (b or a | b) if direction == "forward" else a | b
        near = 0
        for j, (s2, e2, a2, b2) in spans.items():
            d = s2 - e if direction == "forward" else s - e2
            near += j != i and 0 < d <= 60 and bool(seeds & (a2 | b2))
        want += min(near, 4)
    assert len(found[0]) == want


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_evidence_is_ranked_by_its_keys_without_joins(spark, direction, monkeypatch):
    """The keys that led to a node tell its rank and relation, and an object with enough nodes of its pairs asks for nothing else."""
    seen = {}
    write = context_module.materialize

    def told(df, name):
        seen[name] = write(df, name)
        return seen[name]

    monkeypatch.setattr(context_module, "materialize", told)
    rng = random.Random(6)
    pick = lambda: rng.choice([["u"], ["u"], ["u", "h"], ["v"], ["h"], []])
    data = [(f"o{i:03}", rng.randrange(90), rng.choice([0, 0, 1, 3, -2]), pick(), pick()) for i in range(240)] + [(f"p{i}", i, 0, ["a"], ["b"]) for i in range(8)]
    objects = spark.createDataFrame(data, "object_id string, s long, n long, sources array<string>, targets array<string>")
    objects = objects.withColumns({"start_ts": F.timestamp_seconds("s"), "end_ts": F.timestamp_seconds(F.col("s") + F.col("n"))})
    columns = ["object_id", "cand_id", "temporal_role", "hop", "distance", "relevance_rank", "relationship", "priority", "c0", "c1", "n"]
    full = context(objects, objects, direction, 20, 4, tell=("n",)).select(*columns).collect()
    assert {r.priority for r in full} == {2, 3, 4, 5}
    chosen = objects.filter("object_id LIKE 'p%' OR object_id < 'o150'")
    for current in (objects, chosen):
        bare = context(objects, current, direction, 20, 4, tell=("c0", "c1", "n"), shared=False).select(*columns).collect()
        ids = {r.object_id for r in current.collect()}
        assert sorted(bare) == sorted(r for r in full if r.object_id in ids)
    left = {r.object_id for r in seen["context-open"].collect()}
    settled = {"p4", "p5", "p6", "p7"} if direction == "backward" else {"p0", "p1", "p2", "p3"}
    assert not settled & left and {f"p{i}" for i in range(8)} - settled <= left
    bare = context(objects, objects, direction, 20, 4, shared=False)
    assert "Join" not in bare._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        context(objects, objects, direction, 20, 4, 2, shared=False)


def test_tunnels_of_a_busy_key(spark):
    rng = random.Random(9)
    data = [(f"a{i:04}", rng.choice(["hot"] * 6 + ["b"]), rng.randrange(4000), rng.choice(["12x3-.4-.data.e0.com", "12x3-.4-.data.e1.com", "x.e0.com", "x.e1.com", "x.e2.com"])) for i in range(400)]
    df = spark.createDataFrame(data, "alert_id string, _source string, s long, name string").select(
        "alert_id", "_source", F.timestamp_seconds("s").alias("ts"), F.lit("t").alias("target_entity"), F.lit("dns").alias("_stable"), F.array("name").alias("_names"), F.lit("g").alias("signal"),
        F.when(F.col("name").startswith("12x3"), F.concat(F.lit("encoded_subdomain:"), F.substring("name", 15, 6))).alias("family"),
    )
    want = {}
    for key in ("hot", "b"):
        active = {}
        for ident, _, t, name in sorted((r for r in data if r[1] == key), key=lambda r: (r[2], r[0])):
            domain = name.split(".", 1)[1] if name[0] == "x" else name[14:]
            s = active.get(domain)
            fits = s is not None and t - s[1] <= 30 and t - s[0] <= 200
            if name[0] != "x" and not fits:
                s = active[domain] = [t, t]
            if name[0] != "x" or fits:
                s[1] = t
                want[ident] = (f"encoded_subdomain:{domain}", s[0] * 1_000_000)
    for block in (15, 1_000_000):
        got = {r.alert_id: (r.family, r.session_start) for r in sessions._tunnel_sessions(df, 30, 200, block).collect()}
        assert got == want


@pytest.mark.parametrize("rows", [7, 1_000_000])
def test_values_ahead(spark, rows):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "b", None]), i, rng.choice([None, i, i])) for i in range(120)]
    df = spark.createDataFrame(data, "key string, at int, v int")
    found = in_blocks(df, ["key"], ["at"], rows, stored=False).ahead("next", F.col("v"), 3).result().collect()
    assert {r.at: r.next for r in found} == {at: [v for k, a, v in data if k == key and a > at and v is not None][:3] for key, at, _ in data}


def test_only_the_best_of_a_hop_are_joined_and_expanded(spark, monkeypatch):
    """Fails if candidates that can't be among the best are paired, or objects with enough evidence go on to further hops."""
    seen = {}
    write = context_module.materialize

    def told(df, name):
        table = write(df, name)
        seen.setdefault(name, table)
        return table

    monkeypatch.setattr(context_module, "materialize", told)
    data = [(f"o{i:03}", i, "u", "h") for i in range(60)] + [("far", 0, "u", "other"), ("late", 100, "x", "h2")]
    objects = spark.createDataFrame(data, "object_id string, s long, a string, b string").select(
        "object_id", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("s").alias("end_ts"), F.array("a").alias("sources"), F.array("b").alias("targets")
    )
    found = context(objects, objects, "backward", 60, 4, 3).collect()
    assert max(r.relevance_rank for r in found) == 4
    assert max(r.relevance_rank for r in seen["context"].collect()) == 4
    settled = {r.object_id for r in seen["context"].groupBy("object_id").count().filter("count >= 4").collect()}
    assert settled and not settled & {r.object_id for r in seen["frontier"].collect()}


def test_degrees_are_counted_in_bounded_tasks(spark):
    data = [(f"o{i % 90}", e) for i in range(400) for e in (f"e{i % 7}", f"e{i % 3}")]
    links = spark.createDataFrame(data, "object_id string, entity string")
    found = scoring.entity_degrees(links, rows=50)
    assert {r.entity: r.degree for r in found.collect()} == {e: len({o for o, x in data if x == e}) for e in {x for _, x in data}}
    assert "RepartitionByExpression [entity" in found._jdf.queryExecution().optimizedPlan().toString()
