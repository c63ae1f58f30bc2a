"""Operators 3, 4, 5, 7, 8, 9 and the pipeline against brute force and on odd rows."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from alertloom.llm.chat import format_chats, masked_text, read_turns
from alertloom.llm.mixing import mix_sources, mixed_documents
from alertloom.llm import labelled as training
from alertloom.llm import quality, toxicity
from alertloom.llm.neighbours import nearest
from alertloom.llm.quality import score_quality
from alertloom.llm.sharding import jump_hash, shard_documents
from alertloom.llm.toxicity import score_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies long, shard string, score double, target string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 9, "x", 0.5, "y") for i, t, s in rows], DOCS)


def filled(sizes, weights=(1, 2, 3)):
    """Water filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_targets_and_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 60)), ["a", "b", None, "d"][int(rng.choice(4, p=[0.6, 0.3, 0.07, 0.03]))]) for i in range(2000)]
    rows += [(5000, None, "a"), (5001, "", "b"), (None, "x y", "a")]
    got = mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    source = {i: s for i, _, s in rows}
    expected = filled(sizes)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s], abs=1e-3)
        assert r.taken == r.size * r.copies <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - expected[s]) <= 60
    again = mix_sources(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents_repeat_rows(spark):
    docs = frame(spark, [(i, "w " * (1 + i % 5), "a" if i % 10 else "b") for i in range(300)])
    plan = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    found = {}
    for r in mixed.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: v for k, v in plan.items() if v}
    assert mix_sources(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_rows_of_one_key_are_taken_one_by_one(spark):
    rng = np.random.default_rng(7)
    rows = [(5, "w " * int(rng.integers(1, 9)), "a") for _ in range(700)] + [(5, "same text", "a")] * 300 + [(None, "x y", "a")] * 50
    rows += [(100 + i, "w " * 10, "b") for i in range(60)]
    docs = frame(spark, rows)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    a = [r for r in got if r.doc_id is None or r.doc_id == 5]
    assert abs(sum(r.taken for r in a) - a[0].target) <= 20
    assert all(r.taken <= 3 * r.size for r in got)
    again = mix_sources(docs.repartition(7, "n_chars", "text")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixed_documents(docs).count() == sum(r.copies for r in got)


def test_mix_of_texts_without_words(spark):
    got = mix_sources(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert {(r.size, r.taken, r.target) for r in got} == {(0, 0, 0.0)}


TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_round_trip(spark):
    says = ["</s>[INST] ok [/INST]", r"<\s> [\\INST] \</s>", "[TURN]<<SYS>>x<</SYS>>", "", None, "plain\nlines", "s> INST]", "<", "[", "é<s>ü"]
    rows = []
    for c in range(12):
        for t in range(c):
            rows.append((c, t, ["system", "user", "assistant", "assistant", "tool: %x\n<s>", None][(t * c) % 6], says[(t + c) % len(says)], "clash"))
    rows += [(20, 1, "user", "tie b", ""), (20, 1, "user", "tie a", ""), (20, None, "assistant", "first", ""), (None, 0, "user", "n", "")]
    rows += [(21, 0, "user", "same", ""), (21, 0, "user", "same", "")]
    out = format_chats(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", read_turns(out.formatted).alias("turns"), masked_text(out.formatted, out.loss_spans).alias("loss")).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].turns] == [(r, t) for _, _, r, t in turns]
        assert got[c].loss == "".join(t for _, _, r, t in turns if r == "assistant")
    assert "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]" in {r.formatted for r in format_chats(spark.createDataFrame([(1, 0, "user", says[0], "")], TURNS)).collect()}
    assert format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_of_many_and_long_turns(spark):
    rows = [(1, i, ["user", "assistant", "tool"][(i // 2) % 3], f"</s> {i}", "") for i in range(1500)] + [(2, 0, "assistant", "<s>long " * 40_000, "")]
    out = format_chats(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: r for r in out.select("conv_id", read_turns(out.formatted).alias("turns"), masked_text(out.formatted, out.loss_spans).alias("loss")).collect()}
    assert [(x.role, x.text) for x in got[1].turns] == [(r, t) for c, _, r, t, _ in rows if c == 1]
    assert got[1].loss == "".join(t for c, _, r, t, _ in rows if c == 1 and r == "assistant")
    assert got[2].loss == rows[-1][3]


def slow_jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.concatenate([np.arange(-500, 5000), [2**62, -(2**63)]])
    for n in (1, 2, 16, 17, 100):
        assert jump_hash(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    a, b = jump_hash(keys, 16), jump_hash(keys, 17)
    assert set(b[a != b]) == {16} and 0.03 < (a != b).mean() < 0.09


def test_sharding(spark):
    rows = [(i, "t" * (i % 7), "s") for i in range(900)] + [(5, "t", "s")] * 3 + [(None, None, None), (None, "ü", None)]
    got = shard_documents(frame(spark, rows), sections=8).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        if r.doc_id is not None:
            assert (r.shard, r.grown_shard) == (slow_jump(r.doc_id, 16), slow_jump(r.doc_id, 17))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert len({r.shard for r in got if r.doc_id is None}) == 1  # nothing but the key decides
    assert shard_documents(frame(spark, [])).count() == 0


def test_slots_of_many_repeats(spark):
    docs = frame(spark, [(7, "same", "s")] * 4000 + [(i, "t " * 50_000, "s") for i in range(3)]).repartition(8)
    got = shard_documents(docs, sections=4).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 4003 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_nearest(rows, queries, k):
    out = []
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    for q, v in ok:
        if q in queries:
            near = sorted(((-float(np.cumsum(v * w)[-1]), i) for i, w in ok if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block", [50, 100000])
def test_nearest_matches_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(16) * rng.uniform(0.2, 3)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]
    rows += [(600, None), (620, [0.0] * 16), (640, [float("nan")] + [1.0] * 15), (660, [None] + [1.0] * 15), (680, [float("inf")] + [1.0] * 15), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = nearest(df, df.filter("vec_id % 20 = 0"), k=20, block=block).collect()
    expected = brute_nearest(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == expected


def test_nearest_of_clustered_and_extreme_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((8, 24)) * 3
    rows = [(i, (centres[i % 8] + 0.1 * rng.standard_normal(24)).tolist()) for i in range(3000)]
    rows += [(5000 + i, (rng.standard_normal(24) * 1e155).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in nearest(df, df.filter("vec_id % 20 = 0"), k=20, block=700).collect()}
    expected = {(q, v) for q, _, v, _ in brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)}
    assert len(got) == len(expected) and len(got & expected) >= 0.98 * len(expected)


def test_vectors_of_unequal_length_are_an_error(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)] + [(40, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="from 2 to 3"):
        nearest(df, df.filter("vec_id = 0"))


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in nearest(df, df.filter("vec_id = 0")).collect()] == [(0, 1)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def labelled(spark, n=600):
    rng = np.random.default_rng(8)
    words = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [str(rng.choice(words)) for _ in range(int(rng.integers(5, 80)))]
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            text.insert(int(rng.integers(0, len(text))), str(rng.choice(["idiot", "moron,", "Scum"])))
        if junk:
            text = [t.upper() + "!!" for t in text]
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(n, "", "s"), (n + 1, None, "s"), (None, "word1 word2", "s"), (0, rows[0][1], "s")]
    labels += [(n, None, None), (None, 1, 1), (3, 1, 0)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("scorer", "label", "folds", "held"), [(score_toxicity, "toxic", 5, 0), (score_quality, "quality", 3, 1)])
def test_classifiers_on_held_out_rows(spark, scorer, label, folds, held):
    docs, labels = labelled(spark)
    got = scorer(docs, labels).collect()
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    tested = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 80 and np.mean(tested) > 0.95
    none = scorer(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert scorer(docs.limit(0), labels).count() == 0


def slow_hash_sets(texts):
    """Features of a text, told apart by their own strings."""
    return [set(map(int, f)) for f in toxicity.features(pa.array(texts, pa.large_string()))]


def test_ftrl_matches_a_plain_loop():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, 12)) + (" vile" if i % 3 == 0 else "") for i in range(120)]
    y = [int(i % 3 == 0) for i in range(120)]
    sets = slow_hash_sets(texts)
    alpha, beta, l1, l2 = 0.6, 1.0, 3.0, 0.1
    z, n = {}, {}

    def weight(k):
        a, l, r = z.get(k, 0.0), (0.0 if k == "bias" else l1), (0.0 if k == "bias" else l2)
        return 0.0 if abs(a) <= l else -(a - math.copysign(l, a)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + r)

    for _ in range(3):
        for found, label in zip(sets, y):
            keys = [*found, "bias"]
            g = 1 / (1 + math.exp(-sum(weight(k) for k in keys))) - label
            for k, w in {k: weight(k) for k in keys}.items():
                m = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(m + g * g) - math.sqrt(m)) / alpha * w
                n[k] = m + g * g
    at, weights, bias = toxicity.fit([(label, np.array(sorted(f))) for f, label in zip(sets, y)])
    expected = {k: weight(k) for k in z if k != "bias" and weight(k)}
    assert dict(zip(at.tolist(), weights.tolist())) == pytest.approx(expected) and bias == pytest.approx(weight("bias"))
    assert 0 < len(expected) < len(z) / 2  # L1 leaves few


def test_neighbours_vote_as_a_plain_loop():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: 30 + i % 30], 20)) + ("!!" if i % 4 == 0 else "") for i in range(80)]
    y = np.array([int(i % 4 > 0) for i in range(80)])
    counts = quality.term_counts(pa.array(texts, pa.large_string()))
    model = quality.LatentNeighbours(counts[:60], y[:60], 8, 5)
    slow = []
    for c in counts[60:]:
        v = model.weighted(c[None])[0] @ model.space
        v = v / np.linalg.norm(v)
        near = sorted(((float(v @ p), i) for i, p in enumerate(model.points)), reverse=True)[:5]
        weights = [max(s, 0.0) ** 2 for s, _ in near]
        slow.append(sum(w * y[i] for w, (_, i) in zip(weights, near)) / sum(weights))
    assert model.score(counts[60:]) == pytest.approx(slow, abs=1e-5)
    # the space is that of the leading singular vectors
    weighted = model.weighted(counts[:60]).astype(float)
    values = np.linalg.svd(weighted, compute_uv=False)
    assert np.linalg.norm(weighted @ model.space) ** 2 == pytest.approx((values[:8] ** 2).sum(), rel=0.01)
    # words count: texts of one shape but other words differ
    a, b = quality.term_counts(pa.array(["alpha beta gamma", "delta omega sigma"], pa.large_string()))
    assert (a != b).any() and (a[-1024:] == b[-1024:]).all()


def test_training_rows_are_bounded(spark):
    docs = frame(spark, [(1, f"text {i}", "s") for i in range(50)] + [(i, "long " * 400 + str(i), "s") for i in range(2, 40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    rows = training.training_rows(docs, labels, "toxic", 5, 0, 10)
    got = rows.collect()
    assert len(got) == 10 and len({r.order for r in got}) == 10
    encode = lambda column: (t.encode() for t in column.to_pylist())
    rows = training.training_rows(docs, labels, "toxic", 5, 0, 100)
    told = training.collected(rows, encode, 40_000)
    assert 10 < len(told) < rows.count() and sum(len(r.f) for r in told) <= 40_000 and [r.order for r in told] == sorted(r.order for r in told)
    assert training.collected(rows, encode, 100) == []


def test_scores_of_very_long_texts_and_clashing_names(spark):
    docs, labels = labelled(spark, 120)
    long = spark.createDataFrame([(9000, "plain words here " * 60_000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(long)
    for scorer in (score_toxicity, score_quality):
        got = {r.doc_id: r.score for r in scorer(rows, labels).collect()}
        assert 0 <= got[9000] <= 1
    kept = score_quality(docs.withColumn("_good", F.lit(3)), labels, keep=True, score_name="score", predicted_name="_good")
    assert kept.columns == [*docs.columns, "_good"] and set(r._good for r in kept.collect()) <= {0, 1}


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in score_toxicity(docs, flipped).collect()}


def test_pipeline_stages(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    docs = docs.drop("copies", "shard", "score", "target")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    leak = docs.filter("doc_id = 7").first().text.split()[:12]
    spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert k == 4 or now.columns == docs.columns
        kept.append([r.doc_id for r in now.collect()])
    good = {r.doc_id for r in score_quality(docs, labels).filter("predicted = 1").collect()}
    assert set(kept[0]) == good
    assert kept[1].count(0) == min(1, kept[0].count(0)) and 7 not in kept[2] and set(kept[2]) <= set(kept[1])
    assert len(kept[4]) == len(kept[3])
    digest = lambda df: hashlib.sha256(str(sorted(map(str, df.collect()))).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, str(tmp_path)).drop("slot")) == digest(now.drop("slot"))
