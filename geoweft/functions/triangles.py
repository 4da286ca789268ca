"""Ear clipping, and a bounding-volume hierarchy of triangles or boxes with exact tests. Coordinates are integers of 32 bits with sign."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Point = tuple[int, int]
#: A number type whose products of two 33-bit differences are exact; plain Python integers where the machine has none.
_WIDE = np.longdouble if np.finfo(np.longdouble).nmant >= 63 else object


def turn(a: Point, b: Point, c: Point) -> int:
    """Twice the signed area of a, b, c; exact."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _holds(a: Point, b: Point, c: Point, p: Point) -> bool:
    s = (turn(a, b, p), turn(b, c, p), turn(c, a, p))
    return min(s) >= 0 or max(s) <= 0


def ear_clip(ring: list[Point]) -> list[tuple[Point, Point, Point]]:
    """Triangles of a simple ring, closed or open, in either direction.

    A ring without area (a segment or a single point, as of a box of no width) gives triangles without area, so that
    its edges still contain points. Rings that cross themselves are outside the contract; clipping still ends.
    """
    pts = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    if not pts:
        return []
    if len(pts) < 3:
        return [(pts[0], pts[-1], pts[-1])]
    if sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(pts, pts[1:] + pts[:1])) < 0:
        pts.reverse()
    out = []
    while len(pts) > 3:
        n = len(pts)
        for i in range(n):
            a, b, c = pts[i - 1], pts[i], pts[(i + 1) % n]
            if turn(a, b, c) > 0 and not any(_holds(a, b, c, p) for p in pts if p not in (a, b, c)):
                break
        else:
            # No proper ear: a corner that adds no area goes first, else any.
            i = next((i for i in range(n) if turn(pts[i - 1], pts[i], pts[(i + 1) % n]) == 0), 0)
        out.append((pts[i - 1], pts[i], pts[(i + 1) % n]))
        pts.pop(i)
    return [*out, tuple(pts)]


def clip_boxes(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Six corner coordinates of the two triangles of each box, those of box i at rows 2 i and 2 i + 1: any corner of a box is an ear."""
    out = np.stack([x0, y1, x0, y0, x1, y0, x1, y0, x1, y1, x0, y1], 1)
    return out.reshape(-1, 6)


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Position of each point on the Hilbert curve of order 16 over the whole square."""
    x, y = (x.astype(np.int64) + 2**31) >> 16, (y.astype(np.int64) + 2**31) >> 16
    d = np.zeros(len(x), np.int64)
    for bit in range(15, -1, -1):
        s = 1 << bit
        rx, ry = (x & s) > 0, (y & s) > 0
        d += s * s * ((3 * rx) ^ ry)
        flip = rx & ~ry
        x, y = np.where(flip, 0xFFFF - x, x), np.where(flip, 0xFFFF - y, y)
        x, y = np.where(ry, x, y), np.where(ry, y, x)
    return d


def _inside(corners: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each point, which lies in the box of its triangle, is in the triangle, edges included."""
    neg, pos = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for i, j in ((0, 2), (2, 4), (4, 0)):
        px, py, qx, qy = corners[:, i], corners[:, i + 1], corners[:, j], corners[:, j + 1]
        # The two products are compared, not subtracted: each is exact, their difference need not be.
        one, two = (y - py) * (qx - px), (x - px) * (qy - py)
        neg |= one < two
        pos |= one > two
    return ~(neg & pos)


class Hierarchy:
    """Boxes around boxes around items, packed along the Hilbert curve: FAN neighbours on it make one box of the level above.

    Items are triangles (six corner coordinates each) or, without an exact test, boxes (the first four).
    """

    FAN = 8
    #: Pairs of point and box looked at together: beyond it the points go in halves.
    PAIRS = 1 << 20

    def __init__(self, corners: np.ndarray, regions: np.ndarray | None = None, exact: bool = True) -> None:
        used = corners if exact else corners[:, :4]
        x, y = used[:, 0::2], used[:, 1::2]
        low, high = np.stack([x.min(1), y.min(1)], 1), np.stack([x.max(1), y.max(1)], 1)
        middle = (low + high) >> 1
        self.order = np.argsort(curve(middle[:, 0], middle[:, 1]), kind="stable")
        self.corners = corners[self.order] if exact else None
        # Regions as small numbers.
        self.regions = None if regions is None else np.unique(regions[self.order], return_inverse=True)[1]
        self.levels = [(low[self.order], high[self.order])]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            starts = np.arange(0, len(low), self.FAN)
            self.levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))
        # Within its box a triangle's products stay below 2 ** 62 unless it is wider than half the world.
        self.wide = exact and bool(len(low)) and int((self.levels[-1][1] - self.levels[-1][0]).max()) >= 2**31

    def pairs(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Points and items that hold them, as positions in what was given; of the items of one region that hold a point one comes.

        All items of a point come in one step, in which a region is met once; steps are as small as the pairs of one of them ask for.
        """
        todo = [np.arange(len(x))] if len(self.levels[0][0]) else []
        while todo:
            points = todo.pop()
            found = self._descend(points, x, y)
            if found is None:
                todo += [points[len(points) // 2 :], points[: len(points) // 2]]
                continue
            at, item = found
            if self.regions is not None and len(at):
                _, first = np.unique(at * len(self.regions) + self.regions[item], return_index=True)
                at, item = at[first], item[first]
            if len(at):
                yield at, self.order[item]

    def _descend(self, points: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        at, node = points, np.zeros(len(points), np.int64)
        for depth, (low, high) in enumerate(reversed(self.levels)):
            if depth:
                if len(at) * self.FAN > self.PAIRS and len(points) > 1:
                    return None
                node = (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = np.repeat(at, self.FAN)
                at, node = at[node < len(low)], node[node < len(low)]
            px, py = x[at], y[at]
            keep = (px >= low[node, 0]) & (px <= high[node, 0]) & (py >= low[node, 1]) & (py <= high[node, 1])
            at, node = at[keep], node[keep]
        if self.corners is not None:
            number = _WIDE if self.wide else np.int64
            keep = _inside(self.corners[node].astype(number), x[at].astype(number), y[at].astype(number))
            at, node = at[keep], node[keep]
        return at, node
