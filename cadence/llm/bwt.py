"""Repeated substrings by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

UNSET = -1


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Positions sorted by their next ``length`` symbols at least (symbols under 512)."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for j in range(7):  # seven symbols fit one integer
        key <<= 9
        key[:max(0, n - j)] |= symbols[j:]
    known = 7
    while True:
        order = np.argsort(key)
        if known >= length:
            return order
        ranked = key[order]
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
        key = rank * (n + 1)
        key[:max(0, n - known)] += rank[known:]
        known *= 2


def prefixes_below(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``order`` the length of the prefix that it shares with the place before,
    ``UNSET`` where that is ``length`` or more.

    Breadth first over the intervals of all strings, shortest first. From the interval of a string
    w the transform gives the intervals of cw for each symbol c before it; where such an interval
    ends, the shared prefix is as long as w, unless a shorter string has set it already. Only
    intervals that set a value go on, so no place is set twice; strings of ``length`` symbols are
    not extended.
    """
    n = len(symbols)
    before = symbols[order - 1].astype(np.uint16)
    before[order == 0] = 0
    # where the suffix one symbol longer stands in the order
    place = np.empty(n, np.int64)
    place[np.argsort(before, kind="stable")] = np.arange(n)
    common = np.full(n + 1, UNSET, np.int32)
    common[0] = 0
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for w in range(length):
        size = hi - lo
        inside = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        owner = np.repeat(np.arange(len(lo)), size)
        to = place[inside]
        by = np.argsort(to)
        to, owner, c = to[by], owner[by], before[inside][by]
        first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (c[1:] != c[:-1])
                                | (to[1:] != to[:-1] + 1)))
        starts = np.flatnonzero(first)
        ends = np.concatenate((starts[1:], [len(to)]))
        lo, hi = to[starts], to[ends - 1] + 1
        new = common[hi] == UNSET
        lo, hi = lo[new], hi[new]
        common[hi] = w
        if not len(lo):
            break
    return common[:n]


def repeated_starts(texts: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text the offsets where a string of ``length`` bytes starts that a text of a
    smaller owner also holds."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    data[ends] = 0  # a symbol that no text has
    order = suffix_order(data, length)
    common = prefixes_below(data, order, length)
    group = np.cumsum(common != UNSET) - 1
    text = np.repeat(np.arange(len(texts)), sizes + 1)[order]
    room = ends[text] - order >= length
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group[room], owners[text[room]])
    hit = np.flatnonzero(room)[owners[text[room]] > least[group[room]]]
    at, whose = order[hit] - (ends - sizes)[text[hit]], text[hit]
    by = np.lexsort((at, whose))
    return np.split(at[by], np.searchsorted(whose[by], np.arange(1, len(texts))))
