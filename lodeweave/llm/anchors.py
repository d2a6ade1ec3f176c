"""Content-defined anchors: where equal strings must meet.

The anchor of a string of ``WIDTH`` bytes is the place of the smallest hash of
``K`` bytes within it, the leftmost of equals. It depends on the string alone, so
equal strings have equal anchors at equal places, and strings with the same
anchor stand in runs of neighbouring starts. A text of n bytes has about
``n * 2 / (WIDTH - K)`` such runs.
"""

from __future__ import annotations

import numpy as np

from . import words

WIDTH, K = 100, 32
_PLACE = np.uint64(21)
_IDENTITY = np.arange(256, dtype=np.uint8)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes from each place on; ``k`` is a power of two."""
    h, step, n = _BYTE[raw], int(_STEP), 1
    while n < k:
        h = h[:-n] * np.uint64(step) + h[n:]
        step = step * step & ((1 << 64) - 1)
        n *= 2
    return words.mix(h)


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def runs(raw: np.ndarray, offsets: np.ndarray, first: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Runs of starts with one anchor, in texts that stand one after the other in ``raw`` (at most 2**21 bytes).

    ``row``: the text; ``start``: the first start, in the text; ``count``: its
    number of starts; ``back``: bytes from the first start to the anchor;
    ``anchor``: the anchor's hash; ``place``: the first start, in ``raw``; ``whole``: a hash of all that the run's strings
    cover, of ``count`` and of ``back``. ``first`` is added to the starts of each
    text, for texts that are parts.
    """
    empty = {k: np.zeros(0, dtype=np.uint64 if k in ("anchor", "whole") else np.int64) for k in ("row", "start", "count", "back", "anchor", "place", "whole")}
    if len(raw) < WIDTH:
        return empty
    h = grams(raw)
    place = np.arange(len(h), dtype=np.uint64)
    best = _smallest((h >> _PLACE << _PLACE) | place, WIDTH - K + 1)
    at = (best & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    # Starts of strings that lie within one text.
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    start = np.flatnonzero(offsets[1:][row] - np.arange(len(at)) >= WIDTH)
    if not len(start):
        return empty
    at, row = at[start], row[start]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    count = np.diff(np.r_[new, len(start)])
    begin, at, row = start[new], at[new], row[new]
    back = at - begin
    whole = words.hashes(raw, begin, begin + count - 1 + WIDTH, _IDENTITY)
    whole = words.mix(whole + (back * 128 + count).astype(np.uint64) * _STEP)
    shift = first if first is not None else np.zeros(len(offsets) - 1, dtype=np.int64)
    return {"row": row, "start": begin - offsets[row] + shift[row], "count": count, "back": back, "anchor": h[at], "place": begin, "whole": whole}
