"""Exact top-k by inner product: KD-trees per shard, searched best-first under box-to-query bounds and a kth score passed on between shards."""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 48
#: Components of integer vectors up to this size have inner products that doubles hold exactly, for up to 512 dimensions.
SMALL = 2**22
LONG = 2**63 - 1
#: A class of large components spans so many powers of two; within a class, products do not leave the doubles.
SPAN = 400


class KDTree:
    """Median splits on the widest side of a node's box; every node keeps its tight bounding box."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        lows, highs = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node, inside = len(self.spans), points[self.order[a:b]]
            low, high = inside.min(axis=0), inside.max(axis=0)
            lows.append(low), highs.append(high)
            self.spans.append((a, b))
            self.children.append(None)
            if parent >= 0:
                left, right = self.children[parent] or (0, 0)
                self.children[parent] = (node, right) if side == 0 else (left, node)
            wide = int((high - low).argmax())
            if b - a > LEAF and high[wide] > low[wide]:
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(inside[:, wide], half)]
                todo += [(a + half, b, node, 1), (a, a + half, node, 0)]
        self.low, self.high = np.stack(lows), np.stack(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that a point inside each node's box can have, for each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floor(256 * x) / 2**(SPAN * c) of every component, c of every row): c is 0 unless a row has components of over SPAN bits."""
    x = vectors.astype(np.float64)
    bits = np.frexp(np.abs(x).max(axis=1))[1] + 8
    scale = np.maximum(0, bits - 1) // SPAN
    with np.errstate(over="ignore"):
        whole = np.floor(256 * x)
    return np.where(scale[:, None] == 0, whole, np.ldexp(x, 8 - SPAN * scale[:, None])), scale


def integers(row: np.ndarray, scale: int) -> list[int]:
    """The integers that a row of quantised stands for; scaled rows are exact but for what floor takes of components far below the largest."""
    return [int(np.floor(x)) for x in row.tolist()] if not scale else [_shifted(x, SPAN * scale) for x in row.tolist()]


def _shifted(x: float, by: int) -> int:
    top, bottom = x.as_integer_ratio()
    return (top << by) // bottom


def thinned(points: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which points to keep: of equal ones only the k + 1 smallest ids can be among the k best other rows, so a common vector costs that many."""
    by = np.lexsort((ids, *points.T[::-1]))
    new = np.r_[True, (points[by][1:] != points[by][:-1]).any(axis=1)]
    nth = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return by[nth <= k]


class TopProducts:
    """The largest integer inner products of floor(256 * component), ties to the smaller id.

    Rows of small components have products that doubles hold exactly. Others are searched with the error of doubles added to all bounds,
    and what comes near is computed in Python integers. A product beyond the range of a long counts as the nearest long.
    """

    score = "long"

    def lowest(self) -> int:
        return -LONG - 1

    def build(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple]:
        """A tree for each class of magnitude: (class, points, ids, rows, tree), class -1 for small components."""
        points, scale = quantised(vectors)
        scale = np.where(np.abs(points).max(axis=1) <= SMALL, np.where(scale == 0, -1, scale), scale) if points.shape[1] <= 512 else scale
        out = []
        for c in np.unique(scale).tolist():
            mine = np.flatnonzero(scale == c)
            mine = mine[thinned(points[mine], ids[mine], k)]
            tree = KDTree(points[mine])
            mine = mine[tree.order]
            tree.order = None
            held = points[mine]
            if c == -1:  # small integers are stored as such
                held = held.astype(np.result_type(*(np.min_scalar_type(int(x)) for x in (held.min(), held.max(), -1))))
            out.append((c, held, ids[mine], rows[mine], tree))
        return out

    def search(self, shard: list[tuple], rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q, q_scale = quantised(queries)
        q_small = (np.abs(q).max(axis=1) <= SMALL) & (q_scale == 0)
        heaps: list[list[tuple[int, int, int]]] = [[] for _ in q]
        for c, points, ids, names, tree in shard:
            points = points.astype(np.float64)
            bounds = tree.bounds(q)
            for i, heap in enumerate(heaps):
                scores_of = self.exact if c == -1 and q_small[i] else self.near
                error, shift = (0.0, 0) if scores_of == self.exact else (self.error(q[i], tree), SPAN * (max(c, 0) + int(q_scale[i])))
                bound, ahead, known = bounds[i] + error, [(-bounds[i, 0] - error, 0)], int(least[i])
                while ahead:
                    negative, node = heapq.heappop(ahead)
                    if len(heap) == k:
                        known = max(known, heap[0][0])
                    if self.longs(-negative, shift) < known:
                        break
                    if (pair := tree.children[node]) is not None:
                        for child in pair:
                            heapq.heappush(ahead, (-bound[child], child))
                        continue
                    a, b = tree.spans[node]
                    for j, x in scores_of(points[a:b], q[i], known, error, shift, max(c, 0), int(q_scale[i])):
                        if names[a + j] == rows[i]:
                            continue
                        new = (x, -int(ids[a + j]), int(names[a + j]))
                        if len(heap) < k:
                            heapq.heappush(heap, new)
                        elif new > heap[0]:
                            heapq.heapreplace(heap, new)
        flat = [(i, name, -d, x) for i, h in enumerate(heaps) for x, d, name in h if x >= int(least[i])]
        return tuple(np.array(col, dtype=np.int64) for col in zip(*flat, strict=True)) if flat else (np.zeros(0, dtype=np.int64),) * 4

    @staticmethod
    def longs(x: float, shift: int) -> float:
        """x * 2**shift, no further from 0 than a long can be."""
        if np.isnan(x):
            return float(2**63)
        return float(min(max(np.ldexp(x, shift), -(2.0**63)), 2.0**63))

    @staticmethod
    def error(q: np.ndarray, tree: KDTree) -> float:
        """What doubles can miss of any inner product of q with a point of the tree, and of its bounds."""
        widest = np.maximum(np.abs(tree.low[0]), np.abs(tree.high[0]))
        return float(np.abs(q) @ widest) * len(q) * 2.0**-50 + 1e-290

    @staticmethod
    def exact(points: np.ndarray, q: np.ndarray, least: int, error: float, shift: int, c: int, q_scale: int) -> list[tuple[int, int]]:
        scores = points @ q
        return [(int(j), int(scores[j])) for j in np.flatnonzero(scores >= least)]

    @staticmethod
    def near(points: np.ndarray, q: np.ndarray, least: int, error: float, shift: int, c: int, q_scale: int) -> list[tuple[int, int]]:
        with np.errstate(over="ignore"):
            scores = np.ldexp(points @ q + error, shift)
        whole = integers(q, q_scale)
        out = []
        for j in np.flatnonzero((scores >= least) | np.isnan(scores)):  # the error covers what doubles miss of least, too
            x = sum(a * b for a, b in zip(integers(points[j], c), whole, strict=True))
            out.append((int(j), min(max(x, -LONG - 1), LONG)))
        return out
