"""An M-tree over integer vectors that answers largest-inner-product queries exactly.

A vector ``x`` is set on a sphere by one more component, so that the Euclidean
distance to a query ``(q, 0)`` falls as the inner product rises: its square is
``|q|**2 + R**2 - 2 q.x``, an integer. The tree is the M-tree of that metric.
Nodes are pages: a node keeps, for each child, its pivot, the covering radius
and the distance to the parent's pivot; a leaf keeps its
rows and their distances to its pivot.

Search is best-first. Before a distance is computed, the triangle inequality on
stored distances, ``|d(q, parent) - d(parent, child)| - radius``, tells whether
it can matter. Bounds are floating point and are widened by ``SLACK`` times the
lengths involved, far more than their rounding; answers are compared as inner
products, which are exact below 2**53. Of the copies of one vector only the
``copies`` smallest ids can be in an answer, and the tree holds no others.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

SLACK = 1e-6


@dataclass
class Node:
    pivots: np.ndarray | None = None  # of the children
    norms: np.ndarray | None = None
    radius: np.ndarray | None = None
    parent: np.ndarray | None = None  # distances to this node's pivot
    children: list = field(default_factory=list)
    x: np.ndarray | None = None  # a leaf's rows, their ids, and their distances to its pivot
    ids: np.ndarray | None = None
    away: np.ndarray | None = None


def fewest_copies(ids: np.ndarray, vectors: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """Each vector with its ``copies`` smallest ids."""
    if not len(ids) or not vectors.shape[1]:
        order = np.argsort(ids, kind="stable")[:copies]
        return ids[order], vectors[order]
    order = np.lexsort((ids, *vectors.T))
    ids, vectors = ids[order], vectors[order]
    place = np.arange(len(ids))
    first = np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)]
    kept = place - np.maximum.accumulate(np.where(first, place, 0)) < copies
    return ids[kept], vectors[kept]


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 512, fan: int = 24, seed: int = 5, copies: int | None = None):
        if copies is not None:
            ids, vectors = fewest_copies(ids, vectors, copies)
        self.ids, self.x = ids.astype(np.int64), vectors.astype(np.float64)
        square = (self.x * self.x).sum(axis=1)
        self.r2 = float(square.max(initial=0.0))
        self._up = np.c_[self.x, np.sqrt(self.r2 - square)]
        self._leaf, self._fan, self._rng = leaf, fan, np.random.default_rng(seed)
        self.slack = SLACK * np.sqrt(self.r2)
        self.computed = 0
        self.root, self._pivot = None, None
        if len(ids):
            self._pivot = self._up[0]
            self.root = self._build(np.arange(len(ids)), self._pivot)
        del self.ids, self.x, self._up, self._rng  # the pages hold all

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> Node:
        away = np.sqrt(((self._up[rows] - pivot) ** 2).sum(axis=1))
        if len(rows) <= self._leaf:
            order = np.argsort(self.ids[rows])
            rows, away = rows[order], away[order]
            return Node(x=self.x[rows], ids=self.ids[rows], away=away)
        if away.max() <= self.slack:  # copies of one vector: pages in the order of their ids
            order = rows[np.argsort(self.ids[rows])]
            groups = np.array_split(order, min(self._fan, -(-len(rows) // self._leaf)))
            centers = np.repeat(pivot[None], len(groups), axis=0)
        else:
            centers = self._up[self._rng.choice(rows, min(self._fan, len(rows)), replace=False)]
            near = ((self._up[rows] ** 2).sum(axis=1)[:, None] - 2 * self._up[rows] @ centers.T + (centers**2).sum(axis=1)).argmin(axis=1)
            groups = [rows[near == k] for k in range(len(centers))]
            if max(map(len, groups)) == len(rows):  # the pivots told nothing apart
                order = rows[np.lexsort((self.ids[rows], away))]
                groups = np.array_split(order, self._fan)
                centers = self._up[[g[0] for g in groups]]
        kept = [k for k, g in enumerate(groups) if len(g)]
        centers, groups = centers[kept], [groups[k] for k in kept]
        return Node(
            pivots=centers,
            norms=(centers**2).sum(axis=1),
            radius=np.array([np.sqrt(((self._up[g] - c) ** 2).sum(axis=1)).max() for g, c in zip(groups, centers, strict=True)]),
            parent=np.sqrt(((centers - pivot) ** 2).sum(axis=1)),
            children=[self._build(g, c) for g, c in zip(groups, centers, strict=True)],
        )

    def search(self, query: np.ndarray, k: int, own: int | None = None, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the ``k`` rows with the largest, ties to smaller ids, without rows of id ``own``; rows below ``least`` may be left out."""
        q = query.astype(np.float64)
        up = np.r_[q, 0.0]
        qq = float(q @ q)
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        if self.root is None:
            return ids, scores.astype(np.int64)
        slack = self.slack + SLACK * np.sqrt(qq)
        reach = lambda score: float(np.sqrt(max(0.0, qq + self.r2 - 2 * score))) + slack
        limit = np.inf if least is None else reach(least)  # the k-th distance, widened
        heap = [(0.0, 0, float(np.sqrt(((up - self._pivot) ** 2).sum())), self.root)]
        count = 0
        while heap:
            bound, _, away, node = heapq.heappop(heap)
            if bound > limit:
                break
            if node.x is not None:
                live = np.abs(away - node.away) <= limit
                if own is not None:
                    live &= node.ids != own
                n = int(np.count_nonzero(live))
                if not n:
                    continue
                self.computed += n
                if 2 * n > len(live):  # the few others are cheaper to compute than to leave out
                    got, found = (node.x @ q)[live], node.ids[live]
                else:
                    got, found = node.x[live] @ q, node.ids[live]
                if len(ids) == k:
                    better = got >= scores[-1]
                    if not better.any():
                        continue
                    got, found = got[better], found[better]
                got, found = np.r_[scores, got], np.r_[ids, found]
                order = np.lexsort((found, -got))[:k]
                scores, ids = got[order], found[order]
                if len(ids) == k:
                    limit = min(limit, reach(scores[-1]))
                continue
            some = np.flatnonzero(np.abs(away - node.parent) - node.radius <= limit)
            if not len(some):
                continue
            self.computed += len(some)
            d = np.sqrt(np.maximum(0.0, node.norms[some] + qq - 2 * (node.pivots[some] @ up)))
            lows = np.maximum(0.0, d - node.radius[some])
            for i, low, near in zip(some.tolist(), lows.tolist(), d.tolist(), strict=True):
                if low <= limit:
                    count += 1
                    heapq.heappush(heap, (low, count, near, node.children[i]))
        return ids, np.rint(scores).astype(np.int64)
