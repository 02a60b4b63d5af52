"""Hashed words and word shingles of whole texts, in NumPy over raw UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
#: Bytes hashed at once; a text's pieces are cut at white space.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
    return _POWERS


def _piece_words(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``raw``, and where they start; no word crosses a position of ``cuts``."""
    solid = ~_WHITE[raw]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.empty(0, np.uint64), at
    fresh = np.empty(len(at), bool)
    fresh[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=fresh[1:])
    fresh[np.searchsorted(at, cuts[cuts <= at[-1]])] = True
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    values = _BYTE[raw[at]] * _powers(int(length.max()) + 1)[place]
    return mix(np.add.reduceat(values, first) + length.astype(np.uint64) * _STEP), at[first]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in ``raw``, and the first word of every text (one more at the end)."""
    hashes, starts, lo, n = [], [], int(offsets[0]), int(offsets[-1])
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n:
            # A piece ends where a text does, or else at white space.
            i = int(np.searchsorted(offsets, hi, side="right")) - 1
            if offsets[i] > lo:
                hi = int(offsets[i])
                break
            gap = np.flatnonzero(_WHITE[raw[hi - 65536 if hi - 65536 > lo else lo : hi]])
            if len(gap):
                hi = (hi - 65536 if hi - 65536 > lo else lo) + int(gap[-1]) + 1
                break
            hi = min(n, hi + PIECE)  # one word longer than a piece
        cuts = offsets[(offsets > lo) & (offsets < hi)] - lo if hi - lo else offsets[:0]
        h, s = _piece_words(raw[lo:hi], cuts)
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def shingle_sets(column, k: int):
    """Yields every text's set of ``k``-word shingles, as ascending distinct hashes.

    A text with fewer than ``k`` words has its whole sequence as the only shingle; one
    without words has none.
    """
    raw, ends = text_buffers(column)
    lo = 0
    while lo < len(ends) - 1:
        # Texts of about PIECE bytes at a time: the arrays are several times as large.
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, side="right")) - 1)
        yield from _sets(raw, ends[lo : hi + 1], k)
        lo = hi


def _sets(raw: np.ndarray, offsets: np.ndarray, k: int):
    words, first = word_hashes(raw, offsets)
    n = len(words)
    grams = np.empty(0, np.uint64)
    if n >= k:
        grams = words[: n - k + 1].copy()
        for j in range(1, k):
            grams = mix(grams * _STEP + words[j : n - k + 1 + j])
    for i in range(len(offsets) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        elif hi > lo:
            g = words[lo : lo + 1].copy()
            for w in words[lo + 1 : hi]:
                g = mix(g * _STEP + w)
            yield mix(g + np.uint64(hi - lo))
        else:
            yield np.empty(0, np.uint64)
