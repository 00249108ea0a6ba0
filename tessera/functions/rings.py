"""Ring functions whose work grows about linearly with the vertices: Arrow batches of rings, numpy inside a ring."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType


def _each(rings: pa.Array, f: Callable[[np.ndarray], object], kind: pa.DataType) -> pa.Array:
    """``f`` of each ring's vertices as (n, 2); null of a null ring."""
    points = rings.flatten()
    xy = np.stack([points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1) if len(points) else np.zeros((0, 2))
    sizes = np.array(rings.value_lengths().fill_null(0).to_pylist(), np.int64)
    parts = np.split(xy, np.cumsum(sizes)[:-1]) if len(sizes) else []
    return pa.array([f(p) if ok else None for p, ok in zip(parts, rings.is_valid().to_pylist())], kind)


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, by monotone chains (Andrew, 1979)."""
    points = np.unique(xy, axis=0).tolist()
    if len(points) < 3:
        return np.array(points).reshape(-1, 2)

    def chain(side: list) -> list:
        out: list = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def widest(xy: np.ndarray) -> float | None:
    """Greatest distance of two vertices: calipers turned around the hull (Shamos, 1978)."""
    h = hull(xy).tolist()
    n = len(h)
    if n < 3:
        return math.dist(h[0], h[-1]) if n else None

    def area(i: int, j: int, k: int) -> float:
        return (h[j][0] - h[i][0]) * (h[k][1] - h[i][1]) - (h[j][1] - h[i][1]) * (h[k][0] - h[i][0])

    best, j = 0.0, 1
    for i in range(n):
        k = (i + 1) % n
        while area(i, k, (j + 1) % n) > area(i, k, j):
            j = (j + 1) % n
        best = max(best, math.dist(h[i], h[j]), math.dist(h[k], h[j]))
        # A parallel side offers its other end as well.
        if area(i, k, (j + 1) % n) == area(i, k, j):
            best = max(best, math.dist(h[i], h[(j + 1) % n]), math.dist(h[k], h[(j + 1) % n]))
    return best


def is_simple(xy: np.ndarray) -> bool:
    """Whether a ring's edges meet only where one ends and the next begins: no crossing, no touching vertex, no overlap, no
    spike. Vertices that repeat the one before (or the first at the end) do not count; fewer than three make no ring.

    Edges are dealt to the cells of a grid of about as many cells as edges; only edges of one cell are compared.
    """
    xy = xy[np.append(True, (xy[1:] != xy[:-1]).any(axis=1))] if len(xy) else xy
    if len(xy) > 1 and (xy[0] == xy[-1]).all():
        xy = xy[:-1]
    n = len(xy)
    if n < 3 or not np.isfinite(xy).all():
        return False
    to = np.roll(xy, -1, axis=0)
    step, after = to - xy, np.roll(to - xy, -1, axis=0)
    turn = step[:, 0] * after[:, 1] - step[:, 1] * after[:, 0]
    if ((turn == 0) & ((step * after).sum(axis=1) < 0)).any():
        return False
    low, high = np.minimum(xy, to), np.maximum(xy, to)
    cell = max(float((high.max(axis=0) - low.min(axis=0)).max()) / math.sqrt(n), float(np.abs(step).mean()), 1e-300)
    a, b = (np.floor((v - low.min(axis=0)) / cell).astype(np.int64) for v in (low, high))
    wide = b - a + 1
    count = wide[:, 0] * wide[:, 1]
    edge = np.repeat(np.arange(n), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    key = (a[edge, 0] + k % wide[edge, 0]) * (int(b[:, 1].max()) + 1) + a[edge, 1] + k // wide[edge, 0]
    order = np.lexsort((edge, key))
    edge, key = edge[order], key[order]
    # The edge ``d`` places further in the sorted list, as long as any is in the same cell.
    live, d = np.arange(len(edge)), 1
    while True:
        live = live[live + d < len(edge)]
        live = live[key[live] == key[live + d]]
        if not len(live):
            return True
        i, j = edge[live], edge[live + d]
        apart = (j - i != 1) & ~((i == 0) & (j == n - 1))
        if _meet(xy[i[apart]], to[i[apart]], xy[j[apart]], to[j[apart]]).any():
            return False
        d += 1


def _meet(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether the closed segments p-q and r-s have a point in common."""
    side = lambda a, b, c: np.sign((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    near = ((np.minimum(p, q) <= np.maximum(r, s)) & (np.minimum(r, s) <= np.maximum(p, q))).all(axis=1)
    return near & (side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)


@F.arrow_udf(DoubleType())
def diameter(ring: pa.Array) -> pa.Array:
    return _each(ring, widest, pa.float64())


@F.arrow_udf(BooleanType())
def simple(ring: pa.Array) -> pa.Array:
    return _each(ring, is_simple, pa.bool_())
