"""Word splitting and hashing over Arrow string columns with numpy.

The helpers work on one Arrow batch inside a Spark task.  A word is a run of
bytes of one class; both classes used here keep every byte above 0x7F inside
words, so splitting UTF-8 by bytes equals splitting by code points.

Word identity is a 64-bit hash: a polynomial over random byte values, then a
finalizer.  Sequences of words are compared through sums of word hashes with
odd multipliers.  Two different sequences of n words collide with probability
of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 17
_POWERS: dict[int, np.ndarray] = {}
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when asked for more."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, _BLOCK + 1)
        have = np.full(size, U(base & (2**64 - 1)))
        have[0] = U(1)
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@dataclass(frozen=True)
class Classes:
    """Which bytes are in words, and the value that each byte is hashed with."""

    word: np.ndarray
    value: np.ndarray


def _classes(is_word, fold_case: bool) -> Classes:
    word = np.array([is_word(b) for b in range(256)])
    same = np.array([b + 32 if fold_case and 0x41 <= b <= 0x5A else b for b in range(256)])
    return Classes(word, np.where(word, _BYTES[same], U(0)))


def _alnum(b: int) -> bool:
    return b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A


def _not_space(b: int) -> bool:
    return b != 0x20 and not 0x09 <= b <= 0x0D


#: Letters, digits and all that is not ASCII; A-Z count as a-z.
ALNUM = _classes(_alnum, True)
#: Whatever is not white space of ASCII; unchanged, and with A-Z as a-z.
SPACED = _classes(_not_space, False)
SPACED_FOLDED = _classes(_not_space, True)
#: Every byte counts.
BYTES = _classes(lambda b: True, False)


@dataclass
class Words:
    """The words of a batch of texts, in order.

    first[i]:first[i + 1] are the words of text i; start and end are byte
    positions in data.
    """

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(column: pa.Array, classes: Classes, hashed: bool = True) -> Words:
    """The words of each row of a string column."""
    data, offsets = utf8(column)
    inside = classes.word[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, first, start, end, word_hashes(data, start, end, classes) if hashed else np.zeros(0, np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, classes: Classes) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, side="right")))
        low = start[i]
        n = int(end[j - 1] - low)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(classes.value[data[low : low + n]] * _powers(_BASE, n)[:n], out=sums[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * _powers(_INVERSE, n + 1)[s]
        i = j
    return mix(out + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; gram i starts at word i.

    Grams that would cross the border of two texts are not marked here; see
    starts_of_grams.
    """
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size].copy()
    factor = 1
    for j in range(1, n):
        factor = factor * 0xA0761D6478BD642F & (2**64 - 1)
        out += hashes[j : j + size] * U(factor | 1)
    return mix(out + U(n))


def inside_text(words: Words, n: int) -> np.ndarray:
    """Which of the n-grams lie inside one text."""
    size = len(words.start) - n + 1
    if size <= 0:
        return np.zeros(0, bool)
    left = np.repeat(words.first[1:], words.count)[:size] - np.arange(size)
    return left >= n


def window_minimum(values: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive values the position of the least, the last of equals."""
    size = len(values) - w + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    best, where = values[:size].copy(), np.zeros(size, np.int64)
    for j in range(1, w):
        now = values[j : j + size]
        less = now <= best
        where[less] = j
        np.minimum(best, now, out=best)
    return where + np.arange(size)


def slices(batches, column: str, most: int = 1 << 22):
    """Record batches cut so that column has about most bytes, one row at least."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        i = 0
        while i < batch.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(i, j - i)
            i = j


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by keys, the first foremost, and where each run of the first key begins in it."""
    order = np.lexsort(keys[::-1])
    head = keys[0][order]
    return order, np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.zeros(0, np.int64)
