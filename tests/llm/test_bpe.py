"""Operator 13 against the tiktoken library, and its round trip."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from alertloom.llm.bpe import RankQueue, load_vocabulary, op13_bpe, read_ranks, token_bytes, token_ids

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


def encoding(vocabulary):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=read_ranks(vocabulary), special_tokens={})


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def check(spark, vocabulary, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = docs.withColumn("n", token_ids(F.col("text"), vocabulary, public.PATTERN))
    back = encoded.withColumn("back", token_bytes(F.col("n"), vocabulary))
    told = F.sha2(F.array_join(F.col("n").cast("array<string>"), ","), 256)
    same = F.col("back") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    got = back.select("doc_id", F.size("n").alias("size"), told.alias("told"), same.alias("same")).collect()
    enc = encoding(vocabulary)
    want = [(i, len(ids := enc.encode_ordinary(t or "")), digest(ids), True) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_ids_are_those_of_tiktoken(spark, name):
    rng = random.Random(5)
    rows = [(None, None, "x"), (1, "", "x"), (2, " \n\t  ", "x"), (3, "a" * 70_000, "x"), (3, "a" * 70_000, "x"), (4, "  'll we've 12345 <|endoftext|>", None)]
    alphabets = ("ab", "abcdefghijklmnopqrstuvwxyz '", " \n\ta", "äöéß漢字あい́😀", "0123456789", "".join(map(chr, range(1, 700))))
    for k, alphabet in enumerate(alphabets * 3):
        rows.append((10 + k, "".join(rng.choice(alphabet) for _ in range(rng.choice((3, 40, 900, 20_000)))), "x"))
    rows.append((99, "".join(rng.choice("abcdefgh漢 ") for _ in range(5 << 20)), "x"))  # longer than what is encoded together
    check(spark, load_vocabulary(public.path(name)), rows)


def test_merges_that_open_the_way_for_lower_ranks(spark):
    # `abc` and `cab` have lower ranks than the pairs that lead to them, so whole buckets may not be merged at once
    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"bca", b"cab", b"ca", b"ab", b"bc", b"abab", b"bb", b"aa", b"aaaa"]
    vocabulary = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    rng = random.Random(8)
    check(spark, vocabulary, [(k, "".join(rng.choice("abc") for _ in range(rng.randint(1, 60))), "x") for k in range(400)])


def test_the_queue_gives_ranks_in_order():
    rng = random.Random(2)
    for size in (1, 200, 70_000, 20_000_000):
        queue, waits = RankQueue(size), []
        for _ in range(300):
            rank = rng.randrange(size)
            queue.bucket(rank).append(rank)
            waits.append(rank)
            if rng.random() < 0.4:
                least = queue.least()
                assert least == min(waits) and set(queue.close(least)) == {least}
                waits = [w for w in waits if w != least]
        while (least := queue.least()) is not None:
            queue.close(least)
            assert least == min(waits)
            waits = [w for w in waits if w != least]
        assert not waits


def test_an_empty_table_and_a_bad_vocabulary(spark, tmp_path):
    check(spark, load_vocabulary(public.path("byte_bpe_50k.tiktoken")), [])
    (tmp_path / "few").write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError):
        load_vocabulary(str(tmp_path / "few"))
    with pytest.raises(ValueError):
        load_vocabulary(public.path("byte_bpe_50k.tiktoken"), most=1000)


def test_the_query_over_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_bpe(spark, sf).collect()}
    enc = encoding(load_vocabulary(public.path("byte_bpe_multi_50k.tiktoken")))
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        text = (r.text or "").encode()
        want[r.doc_id] = (len(ids), digest(ids), hashlib.sha256(text).hexdigest())
    assert got == want
