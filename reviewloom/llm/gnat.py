"""A geometric near-neighbour access tree over whole-number points, searched for many queries at a time.

A node takes some of its points as split points, far from one another; every other point
goes to its nearest split point's child. For each pair (split point, child) the node
stores the range of distances from the split point to the child's points. A query
measures its distances to the split points, which are points themselves and so lower its
best distance; by the triangle inequality a child can be left out if, for any split
point, even the nearest end of its range is farther than the best distance so far. It is
left out only if strictly farther, with room for rounding on both sides, so that points
at the same distance are seen and ties can go to the lower index; distances are
compared as whole numbers.
"""

from __future__ import annotations

import numpy as np

#: Split points of a node, and points that are compared without a node.
SPLITS, LEAF = 8, 16
#: Relative room for rounding in square roots, sums and differences of doubles.
_ROOM = 1e-9


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``left`` to all of ``right``, exact for whole numbers within the limit of the caller."""
    if left.dtype == np.float64:  # all numbers stay below 2**53: products and sums are exact
        return (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2 * (left @ right.T)
    return ((left[:, None, :] - right[None, :, :])**2).sum(axis=2)


class Tree:
    """``points`` are whole numbers, as doubles where all squared distances are below 2**51, else as 64-bit integers."""

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None):
        index = np.arange(len(points)) if index is None else index
        self.children: list[Tree] = []
        chosen = [0]
        nearest = squared(points, points[:1])[:, 0]
        while len(points) > max(LEAF, SPLITS) and len(chosen) < SPLITS and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(points, points[chosen[-1:]])[:, 0])
        if len(chosen) < SPLITS:  # few points, or few different ones
            self.points, self.index = points, index
            return
        self.points, self.index = points[chosen], index[chosen]
        rest = np.setdiff1d(np.arange(len(points)), chosen)
        apart = squared(points[rest], self.points)
        home = apart.argmin(axis=1)
        lows, highs = [], []
        for child in range(len(chosen)):
            here = home == child
            if here.any():
                far = np.sqrt(apart[here].astype(np.float64))
                lows.append(far.min(axis=0) * (1 - _ROOM))
                highs.append(far.max(axis=0) * (1 + _ROOM))
                self.children.append(Tree(points[rest[here]], index[rest[here]]))
        self.lows, self.highs = np.array(lows), np.array(highs)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest point; ties go to the lower index."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), np.iinfo(np.int64).max)
        self._visit(queries, np.arange(len(queries)), best, index)
        return index, best

    def _visit(self, queries: np.ndarray, asks: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        apart = squared(queries[asks], self.points).astype(np.int64)
        order = np.argsort(self.index, kind="stable")
        least = apart[:, order].argmin(axis=1)  # the first of equal ones has the lowest index
        value, name = apart[np.arange(len(asks)), order[least]], self.index[order[least]]
        better = (value < best[asks]) | (value == best[asks]) & (name < index[asks])
        best[asks[better]], index[asks[better]] = value[better], name[better]
        if not self.children:
            return
        far = np.sqrt(apart.astype(np.float64))
        # children with the smallest lower bound on average come first: they lower the best distances
        gap = np.maximum(self.lows[None] - far[:, None] * (1 + _ROOM), far[:, None] * (1 - _ROOM) - self.highs[None]).max(axis=2)
        for child in np.argsort(gap.mean(axis=0), kind="stable"):
            reach = np.sqrt(best[asks].astype(np.float64)) * (1 + _ROOM)
            near = gap[:, child] <= reach
            if near.any():
                self.children[child]._visit(queries, asks[near], best, index)
