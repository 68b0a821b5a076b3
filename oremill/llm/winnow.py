"""Cutting token sequences into fragments of windows that share a minimiser.

Equal windows of K tokens have equal smallest m-grams, so they lie in fragments with the
same minimiser; a fragment is a run of neighbouring windows with one minimiser.  Windows
need to be compared only within a minimiser, and a fragment stands for all its windows.
"""

from __future__ import annotations

import numpy as np

from .arrays import Spans, grams, sliding_min

#: Windows in one fragment at most; longer runs (periodic texts) are cut, which loses nothing.
LONGEST = 256

FRAGMENT = np.dtype([("mh", "<u8"), ("fh", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("n", "<u2"), ("twice", "?"), ("many", "?")])


def fragments(x: np.ndarray, off: np.ndarray, docs: np.ndarray, window: int, gram: int, base: np.ndarray | None = None) -> np.ndarray:
    """Fragments of a slice: x are token hashes, off the n + 1 offsets of the texts, docs their ids.

    base: tokens before each slice row, for rows that are parts of longer texts.
    """
    if len(x) < window:
        return np.zeros(0, FRAGMENT)
    gs = grams(x, gram)[: len(x) - gram + 1]
    low = sliding_min(gs, window - gram + 1)
    m = len(low)  # == len(x) - window + 1
    size = np.diff(off)
    row = np.flatnonzero(size >= window)
    if not len(row):
        return np.zeros(0, FRAGMENT)
    # a window that reaches over the end of its text is none
    ok = np.zeros(m + 1, np.int8)
    np.add.at(ok, off[row], 1)
    np.add.at(ok, np.minimum(off[row + 1] - window + 1, m), -1)
    ok = np.cumsum(ok[:m]) > 0
    new = np.ones(m, bool)
    new[1:] = low[1:] != low[:-1]
    new[off[row]] = True
    new &= ok
    start = np.flatnonzero(new)
    stop = np.minimum(np.append(start[1:], m), off[np.searchsorted(off, start, side="right")] - window + 1)
    n = stop - start
    if (n > LONGEST).any():
        times = -(-n // LONGEST)
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start = np.repeat(start, times) + k * LONGEST
        n = np.minimum(np.repeat(stop, times) - start, LONGEST)
    at = np.searchsorted(off, start, side="right") - 1
    out = np.empty(len(start), FRAGMENT)
    out["mh"], out["fh"] = low[start], Spans(x)(start, start + n + window - 1)
    out["twice"], out["many"] = _twice(gs, low[start], start, start + n + (window - gram)), False
    out["doc"], out["pos"], out["n"] = docs[at], start - off[at] + (0 if base is None else base[at]), n
    return out


def _twice(gs: np.ndarray, mh: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether a fragment holds its minimiser more than once, so that two of its own windows may be equal."""
    values = np.unique(mh)
    at = np.searchsorted(values, gs)
    at[at == len(values)] = 0
    place = np.flatnonzero(values[at] == gs)
    key = np.sort(at[place].astype(np.int64) * len(gs) + place)
    low = np.searchsorted(values, mh).astype(np.int64) * len(gs)
    return np.searchsorted(key, low + stop) - np.searchsorted(key, low + start) > 1
