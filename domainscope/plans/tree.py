"""Exact nearest neighbours of many queries at once in a balanced k-d tree that is held in arrays.

The points are cut in halves level by level along the widest side of their box. A block of queries goes down the tree together: first each to the leaf that
it is in or near, whose points bound its distance; then all pairs of query and node whose box is within that bound, a level at a time. Boxes are in a space
in which no two rows are farther apart than by the metric (``Metric.embedded``); what counts are the metric's own distances of the rows in the leaves. So results
are those of a comparison with all points, at a cost of the tree's depth and a few leaves a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from domainscope.functions.metrics import Metric, Rows

#: Points of a leaf, at least; pairs of query and node, and distances, in memory at once.
LEAF, _PAIRS, _DISTANCES = 8, 1 << 20, 1 << 19
#: Beyond so many dimensions boxes rule out too little.
TREE_DIMENSIONS = 12


class Tree:
    """rows: prepared, at least one. labels: a group of each row, whose queries can't use it."""

    def __init__(self, rows: Rows, metric: Metric, labels: np.ndarray | None = None, leaf: int = LEAF):
        self.metric, self.levels = metric, metric.levels(rows)
        at = metric.embedded(rows, self.levels)
        n = len(at)
        depth = max(0, int(np.log2(max(1, n // leaf))))
        order = np.arange(n)
        self.starts = [(np.arange(2**d + 1) * n) >> d for d in range(depth + 1)]
        for d in range(depth):
            cuts, below = self.starts[d], self.starts[d + 1]
            for j in range(2**d):
                a, b = cuts[j], cuts[j + 1]
                some = at[order[a:b]]
                side = int((some.max(axis=0) - some.min(axis=0)).argmax())
                order[a:b] = order[a:b][np.argpartition(some[:, side], below[2 * j + 1] - a)]
        at = at[order]
        self.order, self.rows = order, Rows(rows.numeric[order], rows.categories[order])
        self.low, self.high = ([f.reduceat(at, s[:-1], axis=0) for s in self.starts] for f in (np.minimum, np.maximum))
        self.labels = labels[order] if labels is not None else None
        self.ends = [tuple(f.reduceat(self.labels, s[:-1]) for f in (np.minimum, np.maximum)) for s in self.starts] if labels is not None else None
        self.width = int(np.diff(self.starts[-1]).max())

    def _own(self, level: int, node: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Which nodes hold nothing but rows of the query's own label."""
        low, high = self.ends[level]
        return (low[node] == mine) & (high[node] == mine)

    def _home(self, at: np.ndarray, mine: np.ndarray | None) -> np.ndarray:
        """A leaf near each query that has a row it may use."""
        node = np.zeros(len(at), np.int64)
        for level in range(1, len(self.starts)):
            left, right = 2 * node, 2 * node + 1
            a, b = (self.metric.box(at, self.low[level][x], self.high[level][x]) for x in (left, right))
            if mine is not None:
                a[self._own(level, left, mine)], b[self._own(level, right, mine)] = np.inf, np.inf
            node = np.where(b < a, right, left)
        return node

    def _leaf(self, rows: Rows, q: np.ndarray, node: np.ndarray, mine: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Distances of queries to the rows of a leaf each (inf: none, or not to be used), and the rows' places in the tree."""
        cuts = self.starts[-1]
        place = cuts[node][:, None] + np.arange(self.width)
        no = place >= cuts[node + 1][:, None]
        place = np.minimum(place, len(self.order) - 1)
        d = self.metric.between(rows.numeric[q][:, None], rows.categories[q][:, None], self.rows.numeric[place], self.rows.categories[place])
        if mine is not None:
            no |= self.labels[place] == mine[q][:, None]
        d[no] = np.inf
        return d, place

    def within(self, rows: Rows, bound: np.ndarray, mine: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In parts: queries, rows of the tree (as they were given) and distances, of all pairs at most bound apart. A query's pairs may be in several parts."""
        at, reach = self.metric.embedded(rows, self.levels), self.metric.reach(bound)
        open_ = [np.flatnonzero(bound >= 0)]
        while open_:
            q = every = open_.pop()
            node, crowded = np.zeros(len(q), np.int64), False
            for level in range(len(self.starts)):
                if level:
                    q, node = np.repeat(q, 2), np.repeat(2 * node, 2)
                    node[1::2] += 1
                keep = self.metric.box(at[q], self.low[level][node], self.high[level][node]) <= reach[q]
                if mine is not None:
                    keep &= ~self._own(level, node, mine[q])
                q, node = q[keep], node[keep]
                if crowded := len(q) > _PAIRS and len(every) > 1:
                    break
            if crowded:
                open_ += [every[: len(every) // 2], every[len(every) // 2 :]]
                continue
            step = max(1, _DISTANCES // self.width)
            for a in range(0, len(q), step):
                some = q[a : a + step]
                d, place = self._leaf(rows, some, node[a : a + step], mine)
                i, j = np.nonzero(d <= bound[some][:, None])
                yield some[i], self.order[place[i, j]], d[i, j]

    def bounds(self, rows: Rows, k: int, mine: np.ndarray | None = None) -> np.ndarray:
        """A distance within which each query has k rows, or all there are; below 0: it may use none."""
        at, out = self.metric.embedded(rows, self.levels), np.full(len(rows), np.inf)
        if k <= np.diff(self.starts[-1]).min():
            step = max(1, _DISTANCES // self.width)
            for a in range(0, len(out), step):
                q = np.arange(a, min(a + step, len(out)))
                d, _ = self._leaf(rows, q, self._home(at[q], None if mine is None else mine[q]), mine)
                out[q] = np.partition(d, k - 1, axis=1)[:, k - 1]
        if mine is not None:
            out[self._own(0, np.zeros(len(out), np.int64), mine)] = -1.0
        return out

    def nearest(self, rows: Rows, k: int = 1, mine: np.ndarray | None = None, beyond: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, rows and distances by query and distance, of all pairs no farther than a query's k-th nearest (and beyond); prepared queries."""
        parts = []
        bound = self.bounds(rows, k, mine)
        for q, r, d in self.within(rows, bound + beyond * (bound >= 0), mine):
            parts.append((q, r, d))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, r, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((d, q))
        return q[by], r[by], d[by]

    def least(self, rows: Rows, mine: np.ndarray | None = None, place: int = 0) -> np.ndarray:
        """The distance to the nearest row, or to the next after so many; inf: there is none."""
        q, _, d = self.nearest(rows, place + 1, mine)
        out = np.full(len(rows), np.inf)
        first = np.searchsorted(q, np.arange(len(rows)))
        there = first + place < np.searchsorted(q, np.arange(len(rows)), "right")
        out[there] = d[first[there] + place]
        return out
