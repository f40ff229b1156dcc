"""Words of Arrow text columns as 64-bit hashes, computed on whole batches with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its hash is a polynomial in a
random table of its bytes, taken modulo 2**64 from prefix sums over stretches of words, then mixed.
It doesn't depend on where the stretches begin, so they are short, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P, _P_INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_T = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_T_LOWER = _T[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_SEP = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_pow = {False: np.ones(1, U), True: np.ones(1, U)}
#: Bytes of text cut into words at once; a document longer than this is a block of its own.
BLOCK = 1 << 18
#: Bytes of whole words whose prefix sums are held at once, eight bytes each; a longer word is a stretch of its own.
STRETCH = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int, inverse: bool) -> np.ndarray:
    if len(_pow[inverse]) < n:
        steps = np.full(max(n, STRETCH), _P_INV if inverse else _P, U)
        steps[0] = 1
        _pow[inverse] = np.multiply.accumulate(steps)
    return _pow[inverse][:n]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes together stay under most, or that hold one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~sep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of these rows, their byte bounds, and for each row (and the end) its first word."""
    start, end = word_bounds(data, offsets, sep)
    rows = np.searchsorted(start, offsets)
    if not len(start):
        return np.zeros(0, U), start, end, rows
    table, out, i = _T_LOWER if lower else _T, np.empty(len(start), U), 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + STRETCH, "right")))
        s, e = start[i:j] - a, end[i:j] - a
        n = int(e[-1])
        sums = np.zeros(n + 1, U)
        np.cumsum(table[data[a : a + n]] * _powers(n, False), out=sums[1:])
        out[i:j] = mix((sums[e] - sums[s]) * _powers(n, True)[s] + (e - s).astype(U))
        i = j
    return out, start, end, rows


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words of one text; none if it has fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _P
        out += words[j : j + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
