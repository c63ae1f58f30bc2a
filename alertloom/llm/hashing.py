"""Vectorised word and shingle hashes over Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 256, dtype=np.int64).view(np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SEGMENT = 1 << 19
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _SEGMENT + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * _SEGMENT:
            _powers[base] = have
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word runs over the end of a document."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, stems: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """Hash of each word, the index of its document and, with stems, a row for each of those numbers
    of bytes: the hash of so long a beginning, 0 for words that aren't longer."""
    starts, ends = word_bounds(data, offsets)
    out = np.empty(len(starts), np.uint64)
    begun = np.zeros((len(stems), len(starts)), np.uint64)
    i = 0
    while i < len(starts):  # in segments, so that memory doesn't grow with a long text
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")))
        lo, hi = starts[i], ends[j - 1]
        piece = data[lo:hi]
        if lower:
            piece = _LOWER[piece]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[piece] * _power(_BASE, hi - lo), dtype=np.uint64)))
        a, b = starts[i:j] - lo, ends[i:j] - lo
        back = _power(_INVERSE, hi - lo)[a]
        out[i:j] = mix((sums[b] - sums[a]) * back + (b - a).astype(np.uint64))
        for row, n in enumerate(stems):
            longer = np.flatnonzero(b - a > n)
            begun[row, i + longer] = mix((sums[a[longer] + n] - sums[a[longer]]) * back[longer] + _U(n << 32))
        i = j
    of = np.searchsorted(offsets, starts, "right") - 1
    return (out, of, begun) if stems else (out, of)


def shingles(words: np.ndarray, docs: np.ndarray, n_docs: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles and the index of their document; a shorter text is one shingle."""
    counts = np.bincount(docs, minlength=n_docs)
    if len(words) >= n:
        wide = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            wide = mix(wide * _U(0x2545F4914F6CDD1D) + words[k : len(words) - n + 1 + k])
        whole = docs[: len(wide)] == docs[n - 1 :]
        wide, of = wide[whole], docs[: len(wide)][whole]
    else:
        wide, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        first = np.concatenate(([0], np.cumsum(counts)))[few]
        short = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = counts[few] > k
            short[has] = mix(short[has] * _U(0x2545F4914F6CDD1D) + words[first[has] + k])
        short = mix(short + counts[few].astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        wide, of = np.concatenate((wide, short)), np.concatenate((of, few))
        order = np.argsort(of, kind="stable")
        wide, of = wide[order], of[order]
    return wide, of


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a text without words."""
    step = 256
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        words, docs = word_hashes(*text_buffers(part))
        hashes, of = shingles(words, docs, len(part), n)
        cuts = np.searchsorted(of, np.arange(len(part) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(hashes[a:b])
