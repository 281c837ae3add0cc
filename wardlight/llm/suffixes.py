"""Suffix arrays and common prefixes of byte runs, in numpy."""

from typing import NamedTuple

import numpy as np

#: Symbols of nine bits that fit into a key.
_PACKED, _BITS = 7, 9


class Text(NamedTuple):
    """Runs in a row, each followed by an end mark: symbols (byte + 1; end mark 0) and the keys of seven symbols from each place."""

    symbols: np.ndarray
    keys: np.ndarray
    starts: np.ndarray  # first place of each run

    @classmethod
    def of(cls, data: np.ndarray, lengths: np.ndarray) -> "Text":
        """``data`` holds the bytes of all runs, one after the other."""
        run = np.repeat(np.arange(len(lengths)), lengths)
        symbols = np.zeros(len(data) + len(lengths), np.uint64)
        symbols[np.arange(len(data)) + run] = data.astype(np.uint64) + np.uint64(1)
        keys, inside = np.zeros(len(symbols), np.uint64), np.ones(len(symbols), bool)
        padded = np.append(symbols, np.zeros(_PACKED, np.uint64))
        for k in range(_PACKED):
            here = padded[k:k + len(symbols)]
            inside &= here > 0  # nothing counts behind an end mark
            keys = keys << np.uint64(_BITS) | np.where(inside, here, np.uint64(0))
        return cls(symbols, keys, np.cumsum(lengths + 1) - lengths - 1)


def suffix_array(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and the rank of each place. End marks differ, earlier ones are less.

    Larsson and Sadakane: groups of suffixes that are equal so far are refined by the ranks of the
    suffixes behind them, which doubles the compared length; suffixes that stand alone are left out of later rounds.
    """
    n = len(text.keys)
    order = np.argsort(text.keys, kind="stable")
    sorted_keys = text.keys[order]
    first = np.ones(n, bool)
    first[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | (sorted_keys[1:] & np.uint64((1 << _BITS) - 1) == 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    places = np.flatnonzero(~first | ~np.append(first[1:], True))  # in groups of two or more
    length = _PACKED
    while len(places):
        own = order[places]
        pair = rank[own] << 32 | rank[own + length]
        turn = np.argsort(pair, kind="stable")
        own, pair = own[turn], pair[turn]
        order[places] = own
        first = np.ones(len(own), bool)
        first[1:] = pair[1:] != pair[:-1]
        rank[own] = np.maximum.accumulate(np.where(first, places, 0))
        places = places[~first | ~np.append(first[1:], True)]
        length *= 2
    return order, rank


def _direct(text: Text, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of pairs of places, compared key by key."""
    found = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    while len(left):
        x, y = text.keys[a[left] + found[left]], text.keys[b[left] + found[left]]
        same = np.zeros(len(left), np.int64)
        going = np.ones(len(left), bool)
        for k in range(_PACKED - 1, -1, -1):
            p, q = (v >> np.uint64(_BITS * k) & np.uint64((1 << _BITS) - 1) for v in (x, y))
            going &= (p == q) & (p > 0)
            same += going
        found[left] += same
        left = left[going]
    return found


def common_prefixes(text: Text, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place: symbols that its suffix shares with the one before it in order.

    Kasai's rule, in the order of the text: behind equal symbols a common prefix is one shorter than that
    of the place before. Only where the symbols differ is it compared, all such places at once.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    follows = (place > 0) & (before > 0)
    follows[follows] = (text.symbols[place[follows] - 1] == text.symbols[before[follows] - 1]) & (text.symbols[place[follows] - 1] > 0)
    compared = np.flatnonzero(~follows)
    start = np.zeros(n, np.int64)
    there = compared[before[compared] >= 0]
    start[there] = _direct(text, there, before[there])
    last = np.maximum.accumulate(np.where(follows, 0, place))
    return start[last] - (place - last)
