"""Hashes of the words of many texts at once, straight from their UTF-8 bytes.

A word is a run of ASCII letters and digits and of bytes of other characters,
with A-Z read as a-z. All words of a block are hashed by one cumulative sum:
with an odd base ``b`` and numbers modulo 2**64, the sum of ``byte * b**-i``
over a word, times ``b**start``, depends on the word alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 2 << 20
_MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = None, None


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in one array, and the offsets of its rows; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def spans(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of member bytes; runs end at the end of a row."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = member[raw]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(raw))]) if len(raw) else cut[:0]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    if len(cut):
        start, end = np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, after ``table`` has mapped them. Spans are in order and apart; those longer than a block are cut for the sum only."""
    global _UP, _DOWN
    if _UP is None:
        _UP, _DOWN = _powers(_BASE), _powers(_INVERSE)
    out = np.zeros(len(start), dtype=np.uint64)
    k = 0
    while k < len(start):
        a = start[k]
        stop = max(int(np.searchsorted(end, a + _BLOCK, side="right")), k + 1)
        b = end[stop - 1]
        if b - a > _BLOCK:  # one giant span
            total = np.uint64(0)
            for c in range(a, b, _BLOCK):
                piece = table[raw[c : min(b, c + _BLOCK)]].astype(np.uint64) + np.uint64(1)
                total = (total + (piece * _DOWN[: len(piece)]).sum(dtype=np.uint64)) * _UP[7]
            out[k] = total
        else:
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum((table[raw[a:b]].astype(np.uint64) + np.uint64(1)) * _DOWN[: b - a], out=sums[1:])
            s, e = start[k:stop] - a, end[k:stop] - a
            out[k:stop] = (sums[e] - sums[s]) * _UP[s]
        k = stop
    return mix(out)
