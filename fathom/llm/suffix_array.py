"""Suffix arrays of many texts at once by induced sorting, and permuted common prefixes, as array operations.

The scans that induce an order read it from one end and push to places further on.  They run
over many texts side by side, one place of every text at a time.  When few texts are left, each
is read on by itself in blocks: all of a block up to the first place that the block itself
pushes to is final, so that much is done at once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: A number of texts are read side by side while the longest has at most so many places left for its square.
ABREAST = 64


class Lanes(NamedTuple):
    """Where each text begins and how long it is, the longest first."""

    begin: np.ndarray
    size: np.ndarray

    def reversed(self, n: int) -> Lanes:
        return Lanes(n - self.begin - self.size, self.size)


def _induce(order: np.ndarray, bucket: np.ndarray, wanted: np.ndarray, head: np.ndarray, lanes: Lanes) -> None:
    """Push the ``wanted`` predecessors of the suffixes in ``order`` to the heads of their buckets."""
    at, rising = 0, lanes.size[::-1]
    while True:
        live = len(rising) - int(np.searchsorted(rising, at, "right"))
        if not live or int(lanes.size[0]) - at > ABREAST * live * live:
            break
        cursor = lanes.begin[:live] + at
        for at in range(at, int(lanes.size[live - 1])):
            before = order[cursor] - 1
            before = before[before >= 0]
            before = before[wanted[before]]
            own = bucket[before]
            place = head[own]
            order[place] = before
            head[own] = place + 1
            cursor += 1
        at += 1
    for begin, size in zip(lanes.begin[:live].tolist(), lanes.size[:live].tolist(), strict=True):
        _induce_one(order, bucket, wanted, head, begin + at, begin + size)


def _induce_one(order: np.ndarray, bucket: np.ndarray, wanted: np.ndarray, head: np.ndarray, at: int, n: int) -> None:
    block = 512
    while at < n:
        stop = min(at + block, n)
        before = order[at:stop] - 1
        source = np.flatnonzero(before >= 0)
        source = source[wanted[before[source]]]
        if not len(source):
            at, block = stop, min(2 * block, 1 << 16)
            continue
        before = before[source]
        letter = bucket[before]
        turn = np.argsort(letter, kind="stable")
        by = letter[turn]
        fresh = np.ones(len(by), bool)
        fresh[1:] = by[1:] != by[:-1]
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(by)))
        place = np.empty(len(by), np.int64)
        place[turn] = head[by] + np.arange(len(by)) - np.repeat(first, size)
        nearest = int(place.min())
        if nearest < stop:
            # Sources before the nearest place are final; the rest wait for what is pushed there.
            ready = int(np.searchsorted(source, nearest - at))
            order[place[:ready]] = before[:ready]
            np.add.at(head, letter[:ready], 1)
            at, block = nearest, max(64, block // 2)
        else:
            order[place] = before
            head[by[first]] += size
            at, block = stop, min(2 * block, 1 << 16)


def _sorted_from(bucket: np.ndarray, low: np.ndarray, stars: np.ndarray, ends: np.ndarray, lanes: Lanes) -> np.ndarray:
    """All suffixes of every text, induced from the order of the leftmost smaller ones (``stars``)."""
    n = len(bucket)
    order = np.full(n, -1, np.int64)
    own = bucket[stars]
    turn = np.argsort(own, kind="stable")
    by = own[turn]
    last = np.searchsorted(by, by, "right")
    order[ends[by] - last + np.arange(len(by))] = stars[turn]
    starts = np.concatenate([[0], ends[:-1]])
    # A text's first suffix has no predecessor in it.
    inner = np.ones(n, bool)
    inner[lanes.begin + lanes.size - 1] = False
    _induce(order, bucket, ~low & inner, starts.copy(), lanes)
    placed = np.flatnonzero(order >= 0)
    order[placed[low[order[placed]]]] = -1
    order[lanes.begin] = lanes.begin + lanes.size - 1
    _induce(order[::-1], bucket, low & inner, n - ends, lanes.reversed(n))
    return order


def _named(text: np.ndarray, stars: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the substrings from star to star, ``order`` being sorted; equal ones share a number."""
    size = np.zeros(len(text), np.int64)
    size[stars[:-1]] = np.diff(stars)
    size = size[order] + 1
    same = size[1:] == size[:-1]
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        bad = text[order[left] + step] != text[order[left + 1] + step]
        same[left[bad]] = False
        step += 1
        left = left[~bad]
        left = left[size[left] > step]
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_arrays(text: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Orders of the suffixes of each text, one after another.

    ``text``: non-negative integers, those of text i from ``begin[i]`` on; the last one of a text
    is smaller than all others of it.
    """
    size = np.diff(np.append(begin, len(text)))
    wide = int(text.max(initial=0)) + 1
    bucket = np.repeat(np.arange(len(begin)), size) * wide + text
    if wide * len(begin) > 4 * len(text):  # letters that do not occur get no bucket
        bucket = np.unique(bucket, return_inverse=True)[1]
    return _orders(bucket, begin, size)


def _orders(bucket: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``suffix_arrays`` of letters that rise from text to text too."""
    n = len(bucket)
    turn = np.argsort(-size, kind="stable")
    lanes = Lanes(begin[turn], size[turn])
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(np.diff(bucket))
    rise[begin + size - 1] = 1
    # Equal neighbours are of the type of the next that differs.
    at = np.where(rise != 0, np.arange(n), n - 1)
    low = rise[np.minimum.accumulate(at[::-1])[::-1]] > 0
    star = np.zeros(n, bool)
    star[1:] = low[1:] & ~low[:-1]
    star[begin] = False
    star[begin + size - 1] = True
    stars = np.flatnonzero(star)
    ends = np.cumsum(np.bincount(bucket))
    order = _sorted_from(bucket, low, stars, ends, lanes)
    found = order[star[order]]
    names = _named(bucket, stars, found)
    if names[-1] + 1 < len(stars):
        place = np.cumsum(star) - 1
        reduced = np.empty(len(stars), np.int64)
        reduced[place[found]] = names
        at = np.searchsorted(stars, begin)
        found = stars[_orders(reduced, at, np.diff(np.append(at, len(stars))))]
    return _sorted_from(bucket, low, found, ends, lanes)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of one text."""
    return suffix_arrays(text, np.zeros(1, np.int64))


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By text position: symbols (16 bits at most) shared with the suffix that comes before in ``order``.

    Of several texts, the first in the order of each is held against the last of the text before.

    Where the symbols before a suffix and before its neighbour agree, its common prefix is one
    shorter than that of the position before; the others are compared, four symbols at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = text
    four = padded[:-3].copy()
    for k in range(1, 4):
        four |= padded[k : n + 1 + k] << np.uint64(16 * k)
    at = np.arange(n)
    own = (before > 0) & (at > 0)
    own[own] = text[at[own] - 1] == text[before[own] - 1]
    fresh = np.flatnonzero(~own)
    shared = np.zeros(len(fresh), np.int64)
    left = np.flatnonzero(before[fresh] >= 0)
    a, b = fresh[left], before[fresh[left]]
    while len(left):
        differ = four[a] ^ four[b]
        same = differ == 0
        over = ~same
        lowest = differ[over] & (~differ[over] + np.uint64(1))
        shared[left[over]] += np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 16
        shared[left[same]] += 4
        left, a, b = left[same], a[same] + 4, b[same] + 4
    return np.repeat(shared + fresh, np.diff(np.append(fresh, n))) - at
