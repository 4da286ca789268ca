"""Projection, tile arithmetic and Hilbert order, as column expressions.

The world is a square of 2^32 units; x runs from -2^31 at 180 degrees west, y grows to the north. Geographic coordinates are integers of
100 nanodegrees. Tiles of zoom z are 2^z by 2^z cells, column 0 in the west, row 0 in the north.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 10_000_000
#: Latitudes beyond this do not project into the square (degrees).
MOST_LATITUDE = 85.05112878


def project_x(lon: Column) -> Column:
    return F.round(lon.cast("double") / UNIT / 360.0 * 2.0**32).cast("long")


def project_y(lat: Column) -> Column:
    rad = F.radians(F.least(F.greatest(lat.cast("double") / UNIT, F.lit(-MOST_LATITUDE)), F.lit(MOST_LATITUDE)))
    y = F.log(F.tan(F.lit(math.pi / 4) + rad / 2)) / (2 * math.pi) * 2.0**32
    return F.least(F.greatest(F.round(y), F.lit(-(2.0**31))), F.lit(2.0**31 - 1)).cast("long")


def lon_degrees(x: Column) -> Column:
    return x.cast("double") * 360.0 / 2.0**32


def lat_degrees(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y.cast("double") * (2 * math.pi) / 2.0**32)))


def project(lon: float, lat: float) -> tuple[int, int]:
    """Projected x, y of degrees, for literals on the driver."""
    lat = max(-MOST_LATITUDE, min(MOST_LATITUDE, lat))
    y = math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) / (2 * math.pi) * 2**32
    return max(-(2**31), min(2**31 - 1, round(lon / 360 * 2**32))), max(-(2**31), min(2**31 - 1, round(y)))


def tile_column(x: Column, zoom: int) -> Column:
    return F.shiftright(x.cast("long") + F.lit(2**31), 32 - zoom).cast("int")


def tile_row(y: Column, zoom: int) -> Column:
    return F.shiftright(F.lit(2**31 - 1) - y.cast("long"), 32 - zoom).cast("int")


def tile_box(zoom: int, col: Column, row: Column) -> tuple[Column, Column, Column, Column]:
    """minx, miny, maxx, maxy of a tile."""
    extent = 2 ** (32 - zoom)
    minx = col.cast("long") * extent - 2**31
    maxy = F.lit(2**31 - 1) - row.cast("long") * extent
    return minx, maxy - (extent - 1), minx + (extent - 1), maxy


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Position on the Hilbert curve of order `bits` over the whole square: one fold over the bits, within generated code."""
    cx, cy = F.shiftright(x.cast("long") + F.lit(2**31), 32 - bits), F.shiftright(y.cast("long") + F.lit(2**31), 32 - bits)
    top = 1 << (bits - 1)

    def step(acc: Column, i: Column) -> Column:
        s = F.expr(f"cast({top} as bigint)") if i is None else F.call_function("shiftright", F.lit(top).cast("long"), i)
        px, py = acc["x"], acc["y"]
        rx = F.when(px.bitwiseAND(s) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        ry = F.when(py.bitwiseAND(s) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        d = acc["d"] + s * s * (F.lit(3) * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, F.lit(2**bits - 1) - px).otherwise(px), F.when(flip, F.lit(2**bits - 1) - py).otherwise(py)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    zero = F.struct(cx.alias("x"), cy.alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), zero, step, lambda acc: acc["d"])
