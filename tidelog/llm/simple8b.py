"""Simple-8b word-aligned coding of unsigned integers, with array operations both ways.

A 64-bit word has a selector in its top four bits and as many ids of equal width as fit in the other
sixty. Ids are coded in blocks of BLOCK; `offsets` has each block's first word, so blocks decode on
their own and all at once. Ids of 2**60 and more are escapes: a zero in the words, their position and
value beside them.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Ids in a word and bits of each, by selector from 1; selector 0 is not used.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = np.uint64(1) << np.uint64(60)


def _width(ids: np.ndarray) -> np.ndarray:
    """For each id the last selector whose bits hold it."""
    edges = np.uint64(1) << BITS[1:].astype(np.uint64)
    return (1 + np.searchsorted(edges, ids, side="right")).astype(np.int8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, offsets (first word of each block), escape positions, escape values."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    at = np.flatnonzero(ids >= ESCAPE)
    escaped = ids[at]
    if len(at):
        ids = ids.copy()
        ids[at] = 0
    width = _width(ids)
    lo = np.arange(0, n, BLOCK)
    hi = np.minimum(lo + BLOCK, n)
    # the selector at each place: the one with most ids among those that hold all ids ahead of it in its block
    end = np.repeat(hi, hi - lo)
    here = np.arange(n)
    best = np.full(n, width.max(initial=1), np.int64)
    for k in range(int(width.max(initial=1)) - 1, int(width.min(initial=1)) - 1, -1):
        small = width <= k
        if np.count_nonzero(small) * 50 < n:  # so few that words of this width would hardly ever be used
            break
        over = np.append(0, np.cumsum(~small))
        fits = over[np.minimum(here + COUNTS[k], end)] == over[here]
        best[fits] = k
    places, blocks = [], []
    pos, live = lo.copy(), np.arange(len(lo))
    while len(live):
        places.append(pos)
        blocks.append(live)
        pos = pos + COUNTS[best[pos]]
        more = pos < hi[live]
        pos, live = pos[more], live[more]
    place = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    block = place // BLOCK
    selector = best[place] if n else np.zeros(0, np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for k in np.unique(selector):
        rows = np.flatnonzero(selector == k)
        index = place[rows][:, None] + np.arange(COUNTS[k])
        values = np.where(index < hi[block[rows]][:, None], ids[np.minimum(index, n - 1)], np.uint64(0))
        shifts = (np.arange(COUNTS[k]) * BITS[k]).astype(np.uint64)
        words[rows] |= np.bitwise_or.reduce(values << shifts, axis=1)
    return words, np.searchsorted(block, np.arange(len(lo))), at, escaped


def decode(words: np.ndarray, offsets: np.ndarray, n: int, at: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The n ids that encode() was given."""
    out = np.zeros(n, np.uint64)
    if n:
        words = np.asarray(words, np.uint64)
        selector = (words >> np.uint64(60)).astype(np.int64)
        before = np.append(0, np.cumsum(COUNTS[selector]))[:-1]
        block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words))))
        place = before - before[offsets][block] + block * BLOCK
        end = np.minimum((block + 1) * BLOCK, n)
        for k in np.unique(selector):
            rows = np.flatnonzero(selector == k)
            shifts = (np.arange(COUNTS[k]) * BITS[k]).astype(np.uint64)
            values = (words[rows][:, None] >> shifts) & np.uint64((1 << int(BITS[k])) - 1)
            index = place[rows][:, None] + np.arange(COUNTS[k])
            inside = index < end[rows][:, None]
            out[index[inside]] = values[inside]
        out[at] = escaped
    return out
