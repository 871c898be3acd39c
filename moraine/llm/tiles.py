"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors recomputed on the original vectors."""

from __future__ import annotations

import heapq

import numpy as np

TILE = 256


def int8_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, their scales, norm of what they lose), one scale a row."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    scale[scale == 0] = 1  # all components are zero or too small to be told from it
    code = np.rint(x / scale)
    with np.errstate(over="ignore"):
        return code.astype(np.int8), scale[:, 0], np.linalg.norm(x - code * scale, axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component after component, so equal vectors give equal scores anywhere."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
    return total


class Products:
    """The largest inner products in double precision; a product that leaves the doubles is infinite, one that is undefined takes no part.

    A product of int8 rows misses the true one by at most |q shown| |c lost| + |q lost| |c|. A pair survives if its
    upper bound reaches the kth lower bound of its query, or what other shards have; nothing within the bounds is lost.
    """

    score = "double"

    def lowest(self) -> float:
        return -np.inf

    def build(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int) -> tuple:
        with np.errstate(over="ignore"):
            return ids, rows, vectors, *int8_rows(vectors.astype(np.float64)), np.linalg.norm(vectors.astype(np.float64), axis=1)

    def search(self, shard: tuple, rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, names, vectors, cc, cs, cl, c_norm = shard
        queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
        qc, qs, ql = int8_rows(queries)
        kind = np.float32 if queries.shape[1] * 127 * 127 < 2**24 else np.float64  # sums of int8 products are then exact
        right, place = cc.T.astype(kind), {r: i for i, r in enumerate(names.tolist())}
        out: list[tuple[int, int, int, float]] = []
        for a in range(0, len(queries), TILE):
            part = slice(a, a + TILE)
            with np.errstate(over="ignore", invalid="ignore"):
                near = (qc[part].astype(kind) @ right).astype(np.float64) * (qs[part, None] * cs)
                shown = np.linalg.norm(qc[part] * qs[part, None], axis=1)
                error = (shown[:, None] * cl + ql[part, None] * c_norm) * (1 + 1e-9) + 1e-12 * np.abs(near)
                low, high = near - error, near + error
            low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
            for i, r in enumerate(rows[part].tolist()):
                if r in place:
                    low[i, place[r]] = high[i, place[r]] = -np.inf
            kth = np.partition(low, -k, axis=1)[:, -k] if k <= len(ids) else np.full(len(low), -np.inf)
            survives = (high >= np.maximum(kth, least[part])[:, None]) & (high > -np.inf)
            i, j = np.nonzero(survives)
            score = exact_products(queries[a + i], vectors[j])
            ok = ~np.isnan(score)
            i, j, score = i[ok], j[ok], score[ok]
            cuts = np.flatnonzero(np.diff(i)) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(i)], strict=True):
                best = heapq.nsmallest(k, zip((-score[s:e]).tolist(), ids[j[s:e]].tolist(), names[j[s:e]].tolist(), strict=True))
                out += [(a + int(i[s]), name, d, -x) for x, d, name in best if -x >= least[a + i[s]]]
        i, name, d, x = (np.array(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 4
        return i.astype(np.int64), name, d, x.astype(np.float64)
