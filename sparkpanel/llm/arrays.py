"""Word and hash arrays over Arrow text columns, used inside Spark tasks.

A batch of texts is cut into slices of about ``SLICE_BYTES`` (a longer text
is a slice of its own), so the arrays of a task stay small whatever the batch.
Words are ``[^\\x20\\x09-\\x0D]+``; these separators are ASCII, so words can
be found on the UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n; those of a slice are kept, a longer text's are its own."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        steps = np.full(size, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size == SLICE_BYTES + 4096:
            _powers[base] = have
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Slice:
    """Texts ``first .. first + n`` of a batch as bytes, with word boundaries."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = solid[:-1]
            after = np.empty(len(data), bool)
            after[-1] = False
            after[:-1] = solid[1:]
            self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
            self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        cut = np.searchsorted(self.starts, offsets)
        self.words_from = cut  # words of text i: words_from[i] .. words_from[i + 1]
        self.n_words = np.diff(cut)
        self.doc_of_word = np.repeat(np.arange(self.n), self.n_words)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of the byte spans: polynomial prefix sums, then ``mix`` with the length."""
        data = self.data if data is None else data
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts]
                   + (ends - starts).astype(np.uint64))

    def word_hash(self, lower: bool = False) -> np.ndarray:
        data = self.data
        if lower:  # ASCII letters
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        return self.span_hash(self.starts, self.ends, data)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, text) of each window of k words that lies in one text."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc_of_word[:n] == self.doc_of_word[k - 1:])
        return at, self.doc_of_word[at]


def window_hash(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of words ``at .. at + k`` in order."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[at + j]
    return mix(out, k)


def per_text(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    got = np.bincount(index, weights=weights, minlength=n)
    return got.astype(np.int64) if weights is None else got


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) \
        else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), offsets


@functools.cache
def _trim():
    """The C library's call that gives freed memory back to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:
        return lambda _: 0


def give_back() -> None:
    """Give freed memory back to the system: a worker outlives its tasks, and an executor runs several."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column in slices of about ``limit`` bytes; freed memory is given back after each column."""
    data, offsets = raw_texts(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Slice(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j
    give_back()
