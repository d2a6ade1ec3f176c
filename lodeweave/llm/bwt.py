"""Burrows-Wheeler transforms of string shards, merged by interleave refinement.

The alphabet is blocks of ``STRIDE`` bytes: the symbol at place i of a string
stands for its bytes i to i + STRIDE, and the symbol before it for the bytes
from i - STRIDE on, so a string of n bytes is STRIDE chains of symbols that
cover all its places. Each chain ends in a place with no whole block, the
smallest suffix; these ends are in order of place and never equal.

``Shard`` sorts the suffixes of its own strings once and keeps, in that order,
the symbol before each (the transform). ``merge`` never sorts suffixes again:
it holds only the interleave, which shard the next suffix comes from. A round
reads every shard's transform in the order of the interleave and deals the
suffixes before them out by that symbol, stably, so after h rounds suffixes are
in the order of their first h symbols; where neighbours first fell apart gives
the length of their common prefix, and runs that never did are the repeated
intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STRIDE = 20


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative numbers below 2**32, by radix."""
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if int(x.max(initial=0)) < 1 << 16:
        return low
    return low[np.argsort((x >> 16).astype(np.uint16)[low], kind="stable")]


def order_of(key: np.ndarray, most: int) -> np.ndarray:
    """Argsort of numbers from 0 to ``most``, ties by place; key and place are sorted as one number where both fit one."""
    bits = max(1, len(key) - 1).bit_length()
    if most.bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    both = key << bits | np.arange(len(key), dtype=np.int64)
    both.sort()
    return both & ((1 << bits) - 1)


def by_home(interleave: np.ndarray, shards: int) -> np.ndarray:
    """Stable argsort of the shards' numbers."""
    if shards > 16:
        return np.argsort(interleave, kind="stable")
    return np.concatenate([np.flatnonzero(interleave == s) for s in range(shards)])


@dataclass
class Shard:
    """Suffixes in order: their places in the shard's bytes, and the symbols before them (0: none)."""

    place: np.ndarray
    before: np.ndarray
    ends: int  # suffixes without a symbol, which come first

    @classmethod
    def of(cls, symbol: np.ndarray, offsets: np.ndarray) -> Shard:
        """``symbol[i]``: the block's symbol from place i on, from 1, or 0 where the string has no whole block there. Each string is followed by one place, the end of its last chain, which ``offsets`` count as its own."""
        n = len(symbol)
        # Ranks of the first 1, 2, 4 ... symbols; ends rank by their place.
        end = symbol == 0
        ends = int(end.sum())
        rank = np.where(end, np.cumsum(end) - 1, ends - 1 + symbol.astype(np.int64))
        step, longest = STRIDE, int(np.diff(offsets).max(initial=0))
        while True:
            ahead = np.zeros(n, dtype=np.int64)
            if step < n:
                ahead[:-step] = rank[step:]
            ahead[rank < ends] = 0
            # What stands `step` on is in the same chain, unless an end came first; then the rank is already unique.
            most = int(rank.max(initial=0))
            key = rank * (most + 1) + ahead
            order = order_of(key, (most + 1) ** 2)
            key = key[order]
            new = np.zeros(n, dtype=np.int64)
            np.cumsum(key[1:] != key[:-1], out=new[1:])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = new
            if step > longest or int(new[-1]) == n - 1:
                break
            step *= 2
        row_start = np.repeat(offsets[:-1], np.diff(offsets))
        before = np.where(order - STRIDE >= row_start[order], symbol[np.maximum(order - STRIDE, 0)], 0)
        return cls(order, before, ends)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes by their first ``depth`` symbols, and each suffix's common prefix with the one ahead, in symbols up to ``depth``."""
    before = np.concatenate([s.before for s in shards]).astype(np.int32)
    home = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.before) for s in shards])
    n, ends = len(before), sum(s.ends for s in shards)
    # At first all suffixes are alike; ends stand first, and from the first round on they are one interval each.
    leading = np.concatenate([np.arange(len(s.before)) < s.ends for s in shards])
    interleave = np.concatenate([home[leading], home[~leading]])
    top = interleave[:ends].copy()
    block = np.zeros(n, dtype=np.int32)
    common = np.full(n, depth, dtype=np.int32)
    common[: ends + 1] = 0
    symbol, apart = np.empty_like(before), np.ones(n, dtype=bool)
    for h in range(1, depth + 1):
        # The j-th suffix of a shard in the interleave is the j-th of its transform.
        symbol[by_home(interleave, len(shards))] = before
        order = stable_order(symbol)
        order = order[n - np.count_nonzero(symbol) :]
        key, source = symbol[order], block[order]
        interleave = np.concatenate([top, interleave[order]])
        apart[ends + 1 :] = (key[1:] != key[:-1]) | (source[1:] != source[:-1])
        common[apart & (common == depth)] = h - 1
        block = np.cumsum(apart, dtype=np.int32) - np.int32(1)
    return interleave, common


def intervals(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, place and interval of each suffix; suffixes of one interval share their first ``depth`` symbols."""
    interleave, common = merge(shards, depth)
    place = np.empty(len(interleave), dtype=np.int64)
    place[by_home(interleave, len(shards))] = np.concatenate([s.place for s in shards])
    return interleave.astype(np.int64), place, np.cumsum(common < depth) - 1
