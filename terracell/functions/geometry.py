"""Polygons as triangles, and a bounding-volume hierarchy over them, in numpy."""

from __future__ import annotations

import numpy as np


def ear_clip(polygon: np.ndarray) -> np.ndarray:
    """Triangles (n-2, 3) of vertex numbers covering a simple polygon given as (n, 2) points.

    Either orientation; a repeated closing vertex is dropped; straight corners are cut
    off as flat triangles. Fewer than three different vertices give no triangle.
    """
    points = np.asarray(polygon, float)
    if len(points) > 1 and (points[0] == points[-1]).all():
        points = points[:-1]
    left = list(range(len(points)))
    if len(left) < 3:
        return np.zeros((0, 3), np.int64)
    x, y = points[:, 0], points[:, 1]
    area = float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))
    if area < 0:
        left.reverse()

    def cross(a: int, b: int, c: int) -> float:
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    out = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            turn = cross(a, b, c)
            if turn < 0:
                continue
            inside = any(
                cross(a, b, p) >= 0 and cross(b, c, p) >= 0 and cross(c, a, p) >= 0
                for p in left
                if p not in (a, b, c) and not any((points[p] == points[q]).all() for q in (a, b, c))
            )
            if turn == 0 or not inside:
                out.append((a, b, c))
                del left[k]
                break
        else:  # a self-crossing outline: cut somewhere, so that it ends
            out.append((left[-1], left[0], left[1]))
            del left[0]
    out.append(tuple(left))
    return np.array(out, np.int64)


def regular_polygon(radius: float, corners: int = 8) -> np.ndarray:
    """Corners of the regular polygon that encloses a circle."""
    angle = 2 * np.pi * np.arange(corners) / corners
    return np.column_stack([np.cos(angle), np.sin(angle)]) * (radius / np.cos(np.pi / corners))


def _spread(v: np.ndarray) -> np.ndarray:
    v = v & np.uint64(0x1FFFFF)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


class BoxTree:
    """A bounding-volume hierarchy over boxes, built bottom-up in Morton order.

    ``low`` and ``high`` are (n, d) corners, d up to 3. Each level halves the number of
    nodes, so the tree has log2(n) levels and 2 n boxes.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        n = len(low)
        self.n = n
        if not n:
            return
        centre = (low + high) / 2
        start, span = centre.min(0), np.maximum(np.ptp(centre, axis=0), 1e-300)
        grid = ((centre - start) / span * 0x1FFFFF).astype(np.uint64)
        code = np.zeros(n, np.uint64)
        for k in range(grid.shape[1]):
            code |= _spread(grid[:, k]) << np.uint64(k)
        self.order = np.argsort(code, kind="stable")
        self.levels = [(low[self.order], high[self.order])]
        while len(self.levels[-1][0]) > 1:
            a, b = self.levels[-1]
            at = np.arange(0, len(a), 2)
            self.levels.append((np.minimum.reduceat(a, at), np.maximum.reduceat(b, at)))

    def candidates(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point number, box number) of every box that holds a point, borders included."""
        if not self.n or not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who = np.arange(len(points))
        node = np.zeros(len(points), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[depth]
            if depth < len(self.levels) - 1:
                who, node = np.repeat(who, 2), np.repeat(node * 2, 2)
                node[1::2] += 1
                there = node < len(low)
                who, node = who[there], node[there]
            hit = np.ones(len(who), bool)
            for k in range(points.shape[1]):
                at = points[who, k]
                hit &= (low[node, k] <= at) & (at <= high[node, k])
            who, node = who[hit], node[hit]
        return who, self.order[node]


def in_triangles(points: np.ndarray, corners: np.ndarray, slack: float = 0.0) -> np.ndarray:
    """Whether point i lies in triangle i (corners (n, 3, 2), counter-clockwise or not), border included."""
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]

    def side(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (q[:, 0] - p[:, 0]) * (points[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (points[:, 0] - p[:, 0])

    u, v, w = side(a, b), side(b, c), side(c, a)
    return ((u >= -slack) & (v >= -slack) & (w >= -slack)) | ((u <= slack) & (v <= slack) & (w <= slack))
