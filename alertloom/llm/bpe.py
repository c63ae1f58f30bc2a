"""Operator 13: byte-level BPE encoding and decoding.

Pre-tokens are merged with a rank queue: a hierarchical bitmap tells which merge ranks are waiting, its first
set bit is the next rank, and the bucket of a rank holds the positions of its pairs in a linked list of tokens.
Entries of pairs that have changed meanwhile are skipped. Pre-tokens don't touch each other, so all new ones of a few
megabytes of text share one queue and a bucket is merged in one step. The number of buckets is bounded by the vocabulary,
so very long pre-tokens do no harm. Python runs in tasks over Arrow columns.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of an index that one level of the bitmap resolves.
_BITS = 8
_MASK = (1 << _BITS) - 1
#: A vocabulary goes to every task; its file may have so many bytes.
MOST_BYTES = 64 << 20
#: Pre-tokens of up to SHORT characters are remembered, REMEMBERED of them a worker.
SHORT = 48
REMEMBERED = 150_000
#: So many characters are encoded together.
_AT_ONCE = 1 << 20
#: Rows that leave Arrow together.
_ROWS = 256


class RankQueue:
    """Buckets by rank under a bitmap of the ranks that wait, in levels of 256-bit words."""

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []  # finest first; the coarsest is one word
        while not self.levels or len(self.levels[-1]) > 1:
            ranks = max(1, (ranks + _MASK) >> _BITS)
            self.levels.append([0] * ranks)
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        """The bucket of this rank, opened if there is none."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            for level in self.levels:
                word, bit = rank >> _BITS, 1 << (rank & _MASK)
                before = level[word]
                level[word] = before | bit
                if before:  # the levels above know of this word
                    break
                rank = word
        return found

    def least(self) -> int | None:
        """The least rank that has a bucket: the first bit set on each level, from the coarsest down."""
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << _BITS | (word & -word).bit_length() - 1
        return rank

    def close(self, rank: int) -> list:
        """Takes the bucket of this rank away."""
        at = rank
        for level in self.levels:
            level[at >> _BITS] ^= 1 << (at & _MASK)
            at >>= _BITS
            if level[at]:
                break
        return self.buckets.pop(rank)


class Merges:
    """The merges of a vocabulary: byte strings by rank, where the rank is also the id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        size = max(ranks.values(), default=0) + 1
        self.queue = RankQueue(size)
        self.none = size  # stands between pre-tokens
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = sorted(
            (left * (size + 1) + right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        )
        self.keys = np.array([key for key, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.made = np.array([rank for _, rank in pairs] + [-1], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs of ids make, -1 for pairs that make none."""
        key = left * (self.none + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids (int32) of each pre-token, all merged together: a bucket is merged at once, in all pre-tokens.

        Within a pre-token the pair of least rank comes first, of equal ones the leftmost. That differs from a whole bucket
        only where a merge makes a pair of still lower rank; pre-tokens with such a pair are merged one pair at a time."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces])
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # one place before each pre-token, one after all
        n = int(starts[-1]) + 1
        token = np.full(n, self.none, np.int64)
        inside = np.ones(n, bool)
        inside[starts] = False
        token[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waits = np.full(n, -1, np.int64)
        waits[:-1] = self.pair_ranks(token[:-1], token[1:])
        queue, odd = self.queue, []

        def wait(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            firsts = ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else []
            bounds = [0, *cuts.tolist(), len(ranks)]
            for k, rank in enumerate(firsts):
                queue.bucket(rank).append(at[bounds[k] : bounds[k + 1]])

        first = np.flatnonzero(waits >= 0)
        wait(first, waits[first])
        while (rank := queue.least()) is not None:
            held = queue.close(rank)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[waits[at] == rank]  # the others have been merged, or stand beside another token now
            if len(at) > 1:
                touches = after[at[:-1]] == at[1:]
                if touches.any():  # of a run of pairs that overlap, every other one
                    index = np.arange(len(at))
                    opens = np.concatenate(([True], ~touches))
                    at = at[(index - np.maximum.accumulate(np.where(opens, index, 0))) % 2 == 0]
            if not len(at):
                continue
            taken = after[at]
            end = after[taken]
            sooner = self.pair_ranks(np.full(len(at), rank), token[end])
            token[at], after[at], before[end] = rank, end, at
            waits[taken], inside[taken] = -1, False
            look = np.concatenate((at, before[at]))
            ranks = self.pair_ranks(token[look], token[after[look]])
            waits[look] = ranks
            early = ((sooner >= 0) & (sooner < rank)) | ((ranks >= 0) & (ranks < rank)).reshape(2, -1).any(axis=0)
            if early.any():
                odd.append(at[early])
            useful = ranks >= 0
            if useful.any():
                wait(look[useful], ranks[useful])
        counts = np.add.reduceat(inside, starts[:-1], dtype=np.int64)
        packed = token[inside].astype(np.int32).tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.unique(np.searchsorted(starts, np.concatenate(odd), "right") - 1).tolist() if odd else []:
            out[k] = np.array(self.merge(pieces[k]), np.int32).tobytes()
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = np.array([whole], np.int32).tobytes()
        return out

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token, one pair at a time."""
        n, get, queue, longest = len(data), self.ranks.get, self.queue, self.longest
        after = list(range(1, n + 1))  # the token at p is data[p:after[p]]
        before = list(range(-1, n - 1))
        waits: list[int | None] = [None] * n  # rank of the pair that begins at p

        def look(p: int) -> None:
            end = after[p]
            end = after[end] if end < n else n + 1
            rank = get(data[p:end]) if end <= n and end - p <= longest else None
            waits[p] = rank
            if rank is not None:
                heappush(queue.bucket(rank), p)

        for p in range(n - 1):
            look(p)
        while (rank := queue.least()) is not None:
            held = queue.buckets[rank]
            p = heappop(held)
            if not held:
                queue.close(rank)
            if waits[p] != rank:
                continue
            taken = after[p]
            end = after[p] = after[taken]
            waits[taken] = None
            if end < n:
                before[end] = p
            look(p)
            if before[p] >= 0:
                look(before[p])
        out, p = [], 0
        while p < n:
            out.append(self.ranks[data[p : after[p]]])
            p = after[p]
        return out


class _Encoder:
    """Encodes texts; the packed ids of short pre-tokens are remembered in two generations, the used ones longest."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        self.merges = Merges(ranks)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> list[str]:
        """Has the packed ids of these pieces in `young`; gives those that are too long to stay there."""
        missing = list(pieces.difference(self.young))
        known = {piece: found for piece in missing if (found := self.old.get(piece)) is not None}
        new = [piece for piece in missing if piece not in known]
        self.young.update(known)
        self.young.update(zip(new, self.merges.merge_all([p.encode() for p in new]), strict=True))
        return [piece for piece in new if len(piece) > SHORT]

    def _packed(self, held: list[list[str]]) -> list[bytes]:
        """Packed ids of each list of pieces."""
        long = self._learn(set().union(*held))
        get = self.young.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in held]
        for piece in long:
            del self.young[piece]
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. Texts are taken together up to _AT_ONCE characters; a longer one goes part by part."""
        out: list[bytes] = []
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if held and size + len(text) > _AT_ONCE:
                out += self._packed(held)
                held, size = [], 0
            if len(text) <= _AT_ONCE:
                held.append(self.pattern.findall(text))
                size += len(text)
                continue
            pieces = (m.group() for m in self.pattern.finditer(text))
            parts = []
            while some := list(islice(pieces, _AT_ONCE // 4)):
                parts += self._packed([some])
            out.append(b"".join(parts))
        return out + self._packed(held)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file: a line has the bytes in base 64, a blank and the rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def load_vocabulary(path: str, most: int = MOST_BYTES) -> bytes:
    """The rank file, read where the job is started; it is told to all tasks, so it may have `most` bytes."""
    with open(path, "rb") as file:
        data = file.read(most + 1)
    if len(data) > most:
        raise ValueError(f"the vocabulary {path} has more than {most} bytes")
    if not set(range(256)) <= {token[0] for token in read_ranks(data) if len(token) == 1}:
        raise ValueError(f"the vocabulary {path} lacks single bytes")
    return data


@lru_cache(maxsize=4)
def _encoder(data: bytes, pattern: str) -> _Encoder:
    return _Encoder(read_ranks(data), pattern)


@lru_cache(maxsize=4)
def _tokens(data: bytes) -> pa.Array:
    """Bytes of each id; ids that the vocabulary lacks are null."""
    ranks = read_ranks(data)
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


def token_ids(text: Column, vocabulary: bytes, pattern: str) -> Column:
    """The ids of a text as array<int>: every match of the pattern is merged by itself, there are no special tokens.

    Null and empty texts have no ids. Bytes that are no UTF-8 are read as U+FFFD. A text of any length is encoded whole."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            parts = []
            for at in range(0, len(batch), _ROWS):
                texts = batch.slice(at, _ROWS).cast(pa.binary() if batch.type == pa.string() else pa.large_binary()).to_pylist()
                packed = encoder.encode([t.decode(errors="replace") if t else "" for t in texts])
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
                parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32))))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode(text)


def token_bytes(ids: Column, vocabulary: bytes) -> Column:
    """The bytes that ids stand for. A null array gives no bytes; an id outside the vocabulary is an error."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _tokens(vocabulary)
        for batch in batches:
            parts = []
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                ends = np.cumsum([0, *part.value_lengths().fill_null(0).to_numpy()])
                flat = tokens.take(part.flatten().cast(pa.int64()))
                if flat.null_count:
                    raise ValueError("an id is not in the vocabulary")
                cuts = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
                where = cuts[ends]
                data = flat.buffers()[2] if len(flat) else None
                whole = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(where.tobytes()), data or pa.py_buffer(b"")])
                parts.append(whole.cast(pa.binary()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return decode(ids)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, their digest, and the digest of the bytes that they decode to."""
    import public_tokenizers

    vocabulary = load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = docs.select("doc_id", token_ids(F.col("text"), vocabulary, public_tokenizers.PATTERN).alias("ids"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(token_bytes(F.col("ids"), vocabulary), 256).alias("decoded_sha256"),
    )
