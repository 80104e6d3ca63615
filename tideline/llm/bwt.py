"""Classes of equal windows of a text, by interval expansion on its Burrows-Wheeler transform.

Suffixes are ordered by their first symbols only, as many as the windows have; the
transform of that order supports backward extension of strings up to that length.
Intervals of suffixes are extended to the left breadth first.  A string of ``l``
symbols that is extended sets common prefixes of length ``l`` at the ends of the
new interval, so common prefixes are found by increasing value; an interval that
sets none is not extended again.  Expansion stops at the window length: the ends
that are still unset then are inside a class of equal windows.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


def joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as one text of symbols, a separator after each, and where each begins.

    Symbols are bytes plus 1; UTF-8 has no byte 255.
    """
    sizes = np.diff(offsets)
    begins = offsets[:-1] - offsets[0] + np.arange(len(sizes))
    text = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.uint8)
    owner_shift = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(int(sizes.sum())) + owner_shift] = data[offsets[0]:offsets[-1]] + np.uint8(1)
    return text, begins


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first ``length`` symbols, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        keys = keys << np.uint64(8) | padded[k:k + n].astype(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    head = np.ones(n, dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=head[1:])
    # A suffix's rank is the place of the first suffix that is equal so far.
    rank = np.zeros(n + length, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    known = 8
    while known < length:
        alone = head & np.append(head[1:], True)
        left = np.flatnonzero(~alone)
        if not len(left):
            break
        step = min(known, length - known)
        own = order[left]
        keys = rank[own] << np.int64(32) | rank[own + step]
        by = np.argsort(keys)
        own, keys = own[by], keys[by]
        order[left] = own
        fresh = np.ones(len(left), dtype=bool)
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        head[left] = fresh
        rank[own] = np.maximum.accumulate(np.where(fresh, left, 0)) + 1
        known += step
    return order


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the intervals, and the interval of each."""
    sizes = last - first + 1
    of = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(of)) + (first - np.cumsum(sizes) + sizes)[of], of


def window_classes(text: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``text`` a class number: equal windows from there, equal numbers.

    Only meaningful where a window of ``length`` symbols holds no separator.
    """
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]
    # Place in the first column of each row's preceding symbol.
    origin = np.argsort(before, kind="stable")
    first_column = before[origin]
    ahead = np.empty(n, dtype=np.int64)
    ahead[origin] = np.arange(n)
    known = np.zeros(n + 1, dtype=bool)
    known[0] = known[n] = True
    low, high = np.zeros(1, dtype=np.int64), np.full(1, n - 1, dtype=np.int64)
    interval = np.full(n, -1, dtype=np.int64)
    for _ in range(length):
        rows, of = _spread(low, high)
        symbols = before[rows] != SEPARATOR
        places, of = ahead[rows[symbols]], of[symbols]
        if not len(places):
            break
        if len(places) * 8 > n:
            interval[places] = of
            places = np.flatnonzero(interval >= 0)
            of = interval[places]
            interval[places] = -1
        else:
            by = np.argsort(places)
            places, of = places[by], of[by]
        # Rows of one interval with one symbol before them are neighbours there.
        cut = np.ones(len(places), dtype=bool)
        cut[1:] = (of[1:] != of[:-1]) | (places[1:] != places[:-1] + 1) | (
            first_column[places[1:]] != first_column[places[:-1]])
        at = np.flatnonzero(cut)
        low, high = places[at], places[np.append(at[1:], len(places)) - 1]
        unset = ~known[low] | ~known[high + 1]
        known[low] = True
        known[high + 1] = True
        low, high = low[unset], high[unset]
        if not len(low):
            break
    classes = np.empty(n, dtype=np.int64)
    classes[order] = np.cumsum(known[:n]) - 1
    return classes
