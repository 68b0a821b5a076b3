"""Threshold-bounded interval expansion over a Burrows-Wheeler transform.

`repeat_classes` sorts the suffixes of a block only as deep as the threshold asks, takes
its BWT, and finds the common-prefix values of neighbouring suffixes breadth first: a
level holds the intervals of all strings of one length that opened a new right border;
each is extended backward by every symbol in it (an LF step), and an extension whose
right border is still open closes it with the level's value and goes to the next level.
The search ends at the threshold; borders still open join suffixes that share at least
`threshold` symbols.
"""

from __future__ import annotations

import numpy as np

_SEP_BITS = 9  # 256 byte values and the separator


def bounded_suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least (s: uint16 below 2**9)."""
    n, have = len(s), 63 // _SEP_BITS
    key = np.zeros(n, np.uint64)
    for k in range(min(have, n)):
        key[: n - k] |= s[k:].astype(np.uint64) << np.uint64(_SEP_BITS * (have - 1 - k))
    sa = np.argsort(key)
    sorted_key = key[sa]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while have < depth:
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            break
        slot = np.flatnonzero(tied)  # only tied suffixes are sorted anew, each within its own slots
        at = sa[slot]
        far = at + have
        second = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        key = rank[at].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slot] = at
        split = np.ones(len(at), bool)
        split[1:] = key[1:] != key[:-1]
        new[slot] = split
        rank[at] = np.maximum.accumulate(np.where(split, slot, 0))
        have *= 2
    return sa


def repeat_classes(s: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of s (0 separates, other symbols are above 0), and for each of its slots whether it
    begins a class of suffixes with equal first `threshold` symbols.  Classes of suffixes that meet a
    separator earlier mean nothing."""
    n = len(s)
    sa = bounded_suffix_array(s, threshold + 1).astype(np.int32)
    bwt = s[sa - 1]
    bwt[sa == 0] = 0
    lf = np.empty(n, np.int32)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    closed = np.zeros(n + 1, bool)
    closed[[0, n]] = True
    # level 1: the interval of each symbol
    edge = np.append(0, np.cumsum(np.bincount(s)))
    lo, hi = edge[:-1], edge[1:]
    lo, hi = lo[hi > lo], hi[hi > lo]  # half open
    closed[hi] = True
    level = 1
    while level < threshold and len(lo):
        size = hi - lo
        slot = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(lo - (np.cumsum(size) - size), size)
        owner = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        keep = bwt[slot] != 0
        slot, owner = slot[keep], owner[keep]
        to = lf[slot]
        order = np.argsort(to)
        to, owner = to[order], owner[order]
        first = np.ones(len(to), bool)
        first[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (s[sa[to[1:]]] != s[sa[to[:-1]]])
        start = np.flatnonzero(first)
        stop = np.append(start[1:], len(to)) - 1
        lo, hi = to[start].astype(np.int64), to[stop].astype(np.int64) + 1 if len(start) else np.zeros(0, np.int64)
        fresh = ~closed[hi]
        lo, hi = lo[fresh], hi[fresh]
        closed[hi] = True
        level += 1
    return sa, closed[:n]
