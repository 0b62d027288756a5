"""Sets of word shingles as 64-bit hashes, a slice of texts at a time.

Words are what lies between the white space [\\x20\\x09-\\x0D], A-Z lower-cased. A shingle is a run of `width` words; a text
with fewer words has its whole sequence as its one shingle, and a text without words none.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .common import mix64

_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts raw[off[i]:off[i+1]], and where each text's words begin (n + 1 places)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # blocks of whole words, so that a long text needs no long arrays
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)))
        lo, hi = starts[at], ends[to - 1]
        up, down = _powers(max(_BLOCK * 2, int(hi - lo) + 1)) if hi - lo < 2 * _BLOCK else _powers(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((_LOWER[raw[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        hashes[at:to] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return hashes, np.searchsorted(starts, off)


def shingle_sets(off: np.ndarray, raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the n + 1 places between them."""
    words, at = word_hashes(off, raw)
    count = np.diff(at)
    n = len(words) - width + 1
    shingles = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        if n > 0:
            shingles = mix64(shingles * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + n])
    sets, places = [], [0]
    for i in range(len(count)):
        if count[i] >= width:
            own = np.unique(shingles[at[i] : at[i + 1] - width + 1])
        elif count[i]:
            own = np.array([count[i]], np.uint64)
            for w in words[at[i] : at[i + 1]]:
                own = mix64(own * np.uint64(0xC2B2AE3D27D4EB4F) + w)
        else:
            own = shingles[:0]
        sets.append(own)
        places.append(places[-1] + len(own))
    return np.concatenate(sets) if sets else shingles[:0], np.array(places, np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))
