"""Areas of interest: boxes and polygons read from text, and features that lie in or meet them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions.mercator import project

Ring = list[tuple[float, float]]
#: Most corners of an area of interest: it is sent to every task.
MOST_CORNERS = 1_000_000


class AreaError(ValueError):
    """An area that cannot be read."""


def _degrees(lon: float, lat: float) -> tuple[float, float]:
    if not -180 <= lon <= 180 or not -90 <= lat <= 90:
        raise AreaError(f"{lon},{lat} is no place on earth")
    return lon, lat


def parse_box(text: str) -> tuple[float, float, float, float]:
    """`W,S,E,N` in degrees, commas optional; two numbers are a box of one point."""
    words = re.split(r"[\s,]+", text.strip())
    try:
        v = [float(w) for w in words]
    except ValueError:
        raise AreaError(f"no box: {text!r}") from None
    if len(v) == 2:
        v = v * 2
    if len(v) != 4:
        raise AreaError(f"a box has four numbers: {text!r}")
    return (*_degrees(v[0], v[1]), *_degrees(v[2], v[3]))


def _ring(points: Ring) -> Ring:
    if len(points) < 3:
        raise AreaError("a ring needs three corners")
    return points if points[0] == points[-1] else [*points, points[0]]


def parse_rings(text: str) -> list[Ring]:
    """Rings of an area: GeoJSON, WKT POLYGON or MULTIPOLYGON, or bare coordinates, after `latlon` with the latitude first."""
    text = text.strip()
    if text.startswith("{"):
        return _geojson(json.loads(text), 0)
    m = re.match(r"(polygon|multipolygon|lonlat|latlon)\b", text, re.I)
    if not m and re.match(r"[A-Za-z]", text):
        raise AreaError(f"unknown kind of area: {text[:20]!r}")
    swap = bool(m) and m[1].lower() == "latlon"
    body = text[m.end() :] if m else text
    if re.search(r"[^\s()\[\],;0-9eE+.-]", body):
        raise AreaError(f"unexpected characters in {text[:40]!r}")
    rings: list[list[list[float]]] = []
    corners: list[list[float]] = []  # of a ring of which each corner has its own brackets
    closed_before = False
    for token in re.findall(r"[(\[]|[)\]]|[^()\[\]]+", body):
        numbers = [float(x) for x in re.split(r"[\s,;]+", token) if x] if token not in "()[]" else []
        if len(numbers) == 2:
            corners.append(numbers)
        elif numbers:
            if len(numbers) % 2:
                raise AreaError("coordinates come in pairs")
            rings.append([numbers[i : i + 2] for i in range(0, len(numbers), 2)])
        closing = token in ")]"
        if closing and closed_before and corners:
            rings.append(corners)
            corners = []
        if token.strip(" ,;"):
            closed_before = closing
    if corners:
        rings.append(corners)
    return _checked([[(q, p) if swap else (p, q) for p, q in r] for r in rings])


def _checked(rings: list[Ring]) -> list[Ring]:
    out = [_ring([_degrees(*p) for p in r]) for r in rings]
    if not out:
        raise AreaError("an area needs a ring")
    if sum(map(len, out)) > MOST_CORNERS:
        raise AreaError(f"an area has at most {MOST_CORNERS} corners")
    return out


def _geojson(value: dict, depth: int) -> list[Ring]:
    kind = value.get("type")
    if kind == "Polygon":
        return _checked([[(p[0], p[1]) for p in r] for r in value["coordinates"]])
    if kind == "MultiPolygon":
        return _checked([[(p[0], p[1]) for p in r] for poly in value["coordinates"] for r in poly])
    if kind == "Feature" and depth < 2:
        return _geojson(value.get("geometry") or {}, depth + 1)
    if kind == "FeatureCollection" and depth == 0:
        features = value.get("features") or []
        if len(features) != 1:
            raise AreaError("a collection must have one feature")
        return _geojson(features[0], 1)
    raise AreaError(f"no polygon: {kind!r}")


def read_area(value: str) -> list[Ring]:
    """Rings of an area given in place, or in a file: after `@`, or where the value holds neither comma nor blank. Files end in .wkt unless they have an ending."""
    if value.startswith("@") or not re.search(r"[,\s]", value):
        path = value.removeprefix("@")
        path = path if os.path.splitext(path)[1] else path + ".wkt"
        with open(path, encoding="utf-8") as f:
            value = f.read()
    return parse_rings(value)


def box_units(box: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """A box of degrees in projected units."""
    return (*project(box[0], box[1]), *project(box[2], box[3]))


def ring_units(rings: list[Ring]) -> list[np.ndarray]:
    return [np.array([project(*p) for p in r], dtype=np.int64) for r in rings]


def ring_box(rings: list[np.ndarray]) -> tuple[int, int, int, int]:
    every = np.concatenate(rings)
    return (*map(int, every.min(0)), *map(int, every.max(0)))


def meets_box(box: tuple[int, int, int, int], minx: str = "minx", miny: str = "miny", maxx: str = "maxx", maxy: str = "maxy") -> Column:
    """Whether bounds (or, with the same name twice, a point) meet a box: four comparisons that reach the scan. W > E runs over the seam."""
    x0, y0, x1, y1 = box
    across = (F.col(minx) <= x1) & (F.col(maxx) >= x0) if x0 <= x1 else (F.col(maxx) >= x0) | (F.col(minx) <= x1)
    return across & (F.col(miny) <= y1) & (F.col(maxy) >= y0)


def inside_rings(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd over all rings; points on an edge are inside."""
    odd, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring[:-1].tolist(), ring[1:].tolist()):
            cross = (x - ax).astype(np.longdouble) * (by - ay) - (y - ay).astype(np.longdouble) * (bx - ax)
            edge |= (cross == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
            spans = (y >= min(ay, by)) & (y < max(ay, by))
            odd ^= spans & ((cross < 0) if by > ay else (cross > 0))
    return odd | edge


def _crosses(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any segment p-q meets any segment a-b (arrays of points)."""
    turn = lambda o, s, t: np.sign((s[:, 0] - o[:, 0]).astype(np.longdouble) * (t[:, 1] - o[:, 1]) - (s[:, 1] - o[:, 1]).astype(np.longdouble) * (t[:, 0] - o[:, 0]))
    for i in range(len(p)):
        P, Q = np.broadcast_to(p[i], a.shape), np.broadcast_to(q[i], a.shape)
        near = (np.maximum(a[:, 0], b[:, 0]) >= min(p[i, 0], q[i, 0])) & (np.minimum(a[:, 0], b[:, 0]) <= max(p[i, 0], q[i, 0])) & (np.maximum(a[:, 1], b[:, 1]) >= min(p[i, 1], q[i, 1])) & (np.minimum(a[:, 1], b[:, 1]) <= max(p[i, 1], q[i, 1]))
        if near.any() and ((turn(P, Q, a) * turn(P, Q, b) <= 0) & (turn(a, b, P) * turn(a, b, Q) <= 0) & near).any():
            return True
    return False


def shape_meets(shape: np.ndarray, closed: bool, area: bool, rings: list[np.ndarray]) -> bool:
    """Whether a line, ring or area meets an area: a corner inside, an edge that crosses, or a corner of any ring of the area inside a feature's area."""
    if inside_rings(shape[:, 0], shape[:, 1], rings).any():
        return True
    line = np.concatenate([shape, shape[:1]]) if closed else shape
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    if len(line) > 1 and _crosses(line[:-1], line[1:], a, b):
        return True
    corners = np.stack([r[0] for r in rings])
    return area and bool(inside_rings(corners[:, 0], corners[:, 1], [line]).any())


def points_in_area(points: DataFrame, rings: list[Ring]) -> DataFrame:
    """Rows of `points` (x, y, not null) inside an area, edges included; its box is compared first, in the scan."""
    units = ring_units(rings)
    box = ring_box(units)
    shared = points.sparkSession.sparkContext.broadcast(units)

    @F.pandas_udf("boolean")
    def inside(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(inside_rings(xs.to_numpy(np.int64), ys.to_numpy(np.int64), shared.value))

    return points.where(meets_box(box, "x", "y", "x", "y")).where(inside(F.col("x").cast("long"), F.col("y").cast("long")))


def shapes_in_area(shapes: DataFrame, rings: list[Ring]) -> DataFrame:
    """Rows of `shapes` (`shape` array of x, y, `closed`, `is_area`, and bounds) that meet an area."""
    units = ring_units(rings)
    shared = shapes.sparkSession.sparkContext.broadcast(units)

    @F.pandas_udf("boolean")
    def meets(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for xs, ys, closed, is_area in batches:
            yield pd.Series([shape_meets(np.stack([np.asarray(x, np.int64), np.asarray(y, np.int64)], 1), bool(c), bool(a), shared.value) for x, y, c, a in zip(xs, ys, closed, is_area)], dtype=bool)

    long_array = lambda f: F.transform("shape", lambda p: p[f].cast("long"))
    return shapes.where(meets_box(ring_box(units))).where(meets(long_array("x"), long_array("y"), "closed", "is_area"))
