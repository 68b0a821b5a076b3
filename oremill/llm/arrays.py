"""Numpy kernels shared by the operators that walk over whole texts.

Texts travel as Arrow binary columns.  A batch is viewed as one ``uint8`` array plus
offsets, cut into slices of bounded size, and every kernel below works on such a slice
without a Python loop over bytes, words or windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text that one slice holds at most; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Words longer than this are hashed one at a time by xxh3.
LONG_WORD = 512

_MIX_A, _MIX_B = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_BASE = U64(0x9E3779B97F4A7C15)

_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
NON_SPACE = ~_space
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[0x80:] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x *= _MIX_A
    x ^= x >> U64(33)
    x *= _MIX_B
    x ^= x >> U64(33)
    return x


#: A random 64-bit value for each byte.
BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * _BASE)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_WORD_POW = powers(0xD6E8FEB86659FD93, LONG_WORD + 1)


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column, and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if n == 0 or col.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (a, b) of rows that hold up to `limit` bytes, or one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a maximal run of `member` bytes in one text), and words before each text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = off[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):  # a run over a border of two texts is two words
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    total = int(size.sum())
    if total == len(data) and len(start) == 1:
        flat, first = data, np.zeros(1, np.int64)
        place = np.arange(total)
    else:
        first = np.cumsum(size) - size
        place = np.arange(total) - np.repeat(first, size)
        flat = data[place + np.repeat(start, size)]
    h = np.add.reduceat(BYTE_HASH[flat] * _WORD_POW[np.minimum(place, LONG_WORD)], first)
    h = mix(h + size.astype(U64) * _BASE)
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of x[i:i+n] for every i (the last n - 1 reach over the end, wrapped into a shorter gram)."""
    if n == 1:
        return x.copy()
    out, have = None, 0
    part, size, bits = x, 1, n
    base = 0x2545F4914F6CDD1D
    while bits:
        if bits & 1:
            if out is None:
                out, have = part, size
            else:
                out = out * U64(pow(base, size, 1 << 64)) + _shift(part, have)
                have += size
        bits >>= 1
        if bits:
            part = part * U64(pow(base, size, 1 << 64)) + _shift(part, size)
            size *= 2
    return mix(out)


def _shift(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    if k < len(x):
        out[: len(x) - k] = x[k:]
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for i up to len(x) - w."""
    part, size = x, 1
    while size * 2 <= w:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    rest = w - size
    return np.minimum(part[: len(part) - rest], part[rest:]) if rest else part


class Spans:
    """Hashes of arbitrary spans of a token array, from prefix sums."""

    _pow: dict = {}

    def __init__(self, x: np.ndarray, base: int = 0xA0761D6478BD642F):
        n = len(x) + 1
        up, down = self._pow.get(base, (np.ones(1, U64), np.ones(1, U64)))
        if len(up) < n:
            size = max(n, SLICE_BYTES + 1)
            up, down = powers(base, size), powers(pow(base, -1, 1 << 64), size)
            if size <= 1 << 23:
                self._pow[base] = up, down
        self.down, self.sums = down, np.zeros(n, U64)
        np.cumsum(x * up[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * _BASE)


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal disjoint runs, sorted; spans that touch are joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return s[new], e[last]
