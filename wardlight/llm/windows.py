"""Word windows of whole texts in numpy: hashes, anchors and runs, for a batch of texts at once."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (a longer text alone); its arrays take about 100 times that.
PART = 1 << 21
_BASE, _U = np.uint64(0x9E3779B97F4A7C15), np.uint64
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PART)
            cls.up, cls.down = (np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


class Words(NamedTuple):
    """Words of several texts: byte places in ``data``, text number and hash of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray


def parts(column: pa.Array, size: int = PART) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and end row, bytes and offsets of parts of a text column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    word = ~_BLANK[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    ends = offsets[1:][offsets[1:] > 0]
    after[ends - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = _Powers.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, np.searchsorted(offsets, starts, "right") - 1, hashes)


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the least gram hash in the window of words that starts there, and whether the window lies in one text.

    Equal windows have equal anchors.
    """
    n = len(words.hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    count = len(words.hashes) - gram + 1
    g = np.zeros(count, np.uint64)
    for k in range(gram):
        g = g * _BASE + words.hashes[k:k + count]
    least, reach, wide = mix(g), 1, window - gram + 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if wide > reach:
        least = np.minimum(least[:len(least) - (wide - reach)], least[wide - reach:])
    return least[:n], words.text[:n] == words.text[window - 1:window - 1 + n]


def runs(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end window of maximal runs of windows of a text with one anchor."""
    if not len(least):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(change)
    first, end = edges[:-1], edges[1:]
    keep = valid[first]
    return first[keep], end[keep]
