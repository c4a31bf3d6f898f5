"""Vectorised word kernels over Arrow string batches.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Every
separator is ASCII, so working on UTF-8 bytes never splits a character.  All
functions work on whole texts; the byte buffer of a batch is walked in slices
cut at separators, so memory does not depend on the length of one text.

Null texts behave as empty ones: no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

_U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Odd multipliers, one per place in a shingle.
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    grow = np.full(n, _BASE, np.uint64)
    grow[0] = 1
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    return np.cumprod(grow), np.cumprod(back)


_POWERS: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = _powers(max(n, SLICE_BYTES + 4096))
    return _POWERS[0], _POWERS[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the n+1 row offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the n+1 word offsets of the rows."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _slices(raw: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words that span about SLICE_BYTES bytes each (one word may be longer)."""
    out, at, n = [], 0, len(ends)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, base + SLICE_BYTES)), at + 1)
        out.append((at, to))
        at = to
    return out


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = IDENTITY) -> np.ndarray:
    """64-bit hash of each word; ``table`` maps bytes first (LOWER folds A-Z)."""
    value = _BYTE_VALUE[table]
    out = np.empty(len(starts), np.uint64)
    for a, b in _slices(raw, ends):
        lo, hi = int(starts[a]), int(ends[b - 1])
        grow, back = _power_tables(hi - lo + 1)
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(value[raw[lo:hi]] * grow[: hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return out


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, by its first word (rows are not looked at)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += h[k : k + n] * PLACE[k]
    return mix(total + _U(width))


def prefix_sums(h: np.ndarray, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """For ``window``: running sums of h[i]*B^i, and B^-i."""
    n = len(h)
    grow, back = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * grow[:n], out=total[1:])
    return total, back


def window(sums: tuple[np.ndarray, np.ndarray], first: np.ndarray, width: int) -> np.ndarray:
    """Hash of the words first..first+width."""
    total, back = sums
    length = np.full(1, width, np.uint64) * _U(0xA0761D6478BD642F)  # arrays wrap around in silence, scalars warn
    return mix((total[first + width] - total[first]) * back[first] + length)


def row_of(word_offsets: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
