"""The tile pyramid: cells counted, summed up the levels, kept by density; points and features put into tiles; index groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoweft.functions import mercator
from geoweft.session import materialize

#: Zoom of the finest cells.
CELL_ZOOM = 12
# The estimate of a tile's size, in bytes per node, bytes per tile, and a parent's share of its children's.
BYTES_PER_NODE, BYTES_PER_TILE, CHILD_SHARE = 10, 32, 16_384


def cell_counts(points: DataFrame) -> DataFrame:
    """`col`, `row`, `nodes`: points per cell of zoom 12; at most 4096 by 4096 rows, combined before they move."""
    return points.groupBy(mercator.tile_column(F.col("x"), CELL_ZOOM).alias("col"), mercator.tile_row(F.col("y"), CELL_ZOOM).alias("row")).agg(F.count("*").alias("nodes"))


def tile_rollup(cells: DataFrame, levels: list[int]) -> DataFrame:
    """`zoom`, `col`, `row`, `nodes` on every level: each cell goes to its ancestor on each, which are then summed."""
    each = F.explode(F.array(*(F.struct(F.lit(z).alias("zoom"), F.shiftright("col", CELL_ZOOM - z).alias("col"), F.shiftright("row", CELL_ZOOM - z).alias("row")) for z in levels)))
    return cells.select(each.alias("t"), "nodes").groupBy("t.zoom", "t.col", "t.row").agg(F.sum("nodes").alias("nodes"))


def kept_tiles(rollup: DataFrame, min_density: int, max_tiles: int) -> DataFrame:
    """Tiles that are kept: the root, and those of at least `min_density` nodes, the `max_tiles` largest of all (ties by zoom, column, row).

    The limit belongs to the pyramid: what is not kept falls to the next kept ancestor, nothing is lost.
    """
    dense = rollup.where((F.col("zoom") == 0) | (F.col("nodes") >= min_density))
    return dense.orderBy(F.desc("nodes"), "zoom", "col", "row").limit(max_tiles)


def size_estimates(rollup: DataFrame, kept: DataFrame, levels: list[int]) -> DataFrame:
    """Kept tiles with `bytes`: per node and tile, of kept children a small share and of others all, level by level from below."""
    parts = kept.select("zoom", "col", "row", F.lit(True).alias("kept"))
    t = rollup.join(parts, ["zoom", "col", "row"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    levels = sorted(levels)
    finest = levels[-1]
    below = t.where(F.col("zoom") == finest).withColumn("bytes", (F.col("nodes") * BYTES_PER_NODE + BYTES_PER_TILE).cast("long"))
    out = below.where("kept")
    for z in reversed(levels[:-1]):
        child = F.floor(F.col("bytes") / CHILD_SHARE) + F.when(F.col("kept"), 0).otherwise(F.col("bytes"))
        shift = below.select(F.shiftright("col", levels[levels.index(z) + 1] - z).alias("col"), F.shiftright("row", levels[levels.index(z) + 1] - z).alias("row"), child.alias("_c"))
        sums = shift.groupBy("col", "row").agg(F.sum("_c").alias("_c"))
        below = t.where(F.col("zoom") == z).join(sums, ["col", "row"], "left").withColumn("bytes", (F.lit(BYTES_PER_TILE) + F.coalesce("_c", F.lit(0))).cast("long")).select(*t.columns, "bytes")
        out = out.unionByName(below.where("kept"))
    return out.select("zoom", "col", "row", "nodes", "bytes")


def tile_name(zoom: Column, col: Column, row: Column) -> Column:
    return F.concat_ws("/", zoom.cast("string"), col.cast("string"), row.cast("string"))


def assign_points(points: DataFrame, kept: DataFrame, levels: list[int]) -> DataFrame:
    """`points` with `tile`, the deepest kept tile that holds them.

    A map from cell to tile is made on the cells, of which there are at most 4096 by 4096; points then take one equi-join on
    their cell, broadcast or shuffled by its actual size.
    """
    cells = points.select(mercator.tile_column(F.col("x"), CELL_ZOOM).alias("_cc"), mercator.tile_row(F.col("y"), CELL_ZOOM).alias("_cr")).distinct()
    each = F.explode(F.array(*(F.struct(F.lit(z).alias("zoom"), F.shiftright("_cc", CELL_ZOOM - z).alias("col"), F.shiftright("_cr", CELL_ZOOM - z).alias("row")) for z in levels)))
    ancestors = cells.select("_cc", "_cr", each.alias("a")).select("_cc", "_cr", "a.*")
    deepest = ancestors.join(kept.select("zoom", "col", "row"), ["zoom", "col", "row"]).groupBy("_cc", "_cr").agg(F.max(F.struct("zoom", "col", "row")).alias("t"))
    named = materialize(deepest.select("_cc", "_cr", tile_name(F.col("t.zoom"), F.col("t.col"), F.col("t.row")).alias("tile")), "cells")
    at = points.withColumns({"_cc": mercator.tile_column(F.col("x"), CELL_ZOOM), "_cr": mercator.tile_row(F.col("y"), CELL_ZOOM)})
    return at.join(named, ["_cc", "_cr"], "left").drop("_cc", "_cr")


def covering_tile(levels: list[int], minx: str = "minx", miny: str = "miny", maxx: str = "maxx", maxy: str = "maxy") -> Column:
    """Name of the smallest tile of the given levels that covers bounds, whether it is kept or not."""
    out = tile_name(F.lit(0), F.lit(0), F.lit(0))
    for z in sorted(levels):
        c0, c1 = mercator.tile_column(F.col(minx), z), mercator.tile_column(F.col(maxx), z)
        r0, r1 = mercator.tile_row(F.col(maxy), z), mercator.tile_row(F.col(miny), z)
        out = F.when((c0 == c1) & (r0 == r1), tile_name(F.lit(z), c0, r0)).otherwise(out)
    return out


def assign_bounds(features: DataFrame, kept: DataFrame, levels: list[int]) -> DataFrame:
    """`features` with bounds and `tile`: the deepest kept tile that covers them, by an equi-join per distinct covering tile."""
    placed = features.withColumn("_cover", covering_tile(levels))
    part = lambda i: F.split_part("_cover", F.lit("/"), F.lit(i)).cast("int")
    covers = placed.select("_cover").distinct().select("_cover", part(1).alias("_z"), part(2).alias("_c"), part(3).alias("_r"))
    up_by = lambda c, z: F.call_function("shiftright", c, F.col("_z") - z)
    up = F.explode(F.filter(F.array(*(F.struct(F.lit(z).alias("zoom"), up_by(F.col("_c"), z).alias("col"), up_by(F.col("_r"), z).alias("row")) for z in levels)), lambda t: t["zoom"] <= F.col("_z")))
    rows = covers.select("_cover", "_z", up.alias("a")).select("_cover", "a.*")
    deepest = rows.join(kept.select("zoom", "col", "row"), ["zoom", "col", "row"]).groupBy("_cover").agg(F.max(F.struct("zoom", "col", "row")).alias("t"))
    names = deepest.select("_cover", tile_name(F.col("t.zoom"), F.col("t.col"), F.col("t.row")).alias("tile"))
    return placed.join(names, "_cover", "left").drop("_cover")


def hilbert_pack(features: DataFrame, bucket: int = 16, within: Sequence[str] = ()) -> DataFrame:
    """`features` (tile, minx, miny, maxx, maxy, ftype, id) with `hilbert` of their centre and `leaf`, filled with `bucket` features in that order within the tile (and the columns `within`).

    Numbers run within a tile and a slice of the curve, so that a tile with a third of all features is spread over many tasks; a
    slice's last leaf may hold fewer.
    """
    centre = lambda a, b: F.floor((F.col(a).cast("long") + F.col(b).cast("long")) / 2)
    d = features.withColumn("hilbert", mercator.hilbert(centre("minx", "maxx"), centre("miny", "maxy")))
    slices = d.withColumn("_slice", F.shiftright("hilbert", 20))
    w = Window.partitionBy("tile", *within, "_slice").orderBy("hilbert", "ftype", "id")
    return slices.withColumn("leaf", F.concat_ws("-", F.col("_slice").cast("string"), F.floor((F.row_number().over(w) - 1) / bucket).cast("string"))).drop("_slice")


def index_groups(features: DataFrame, max_groups: int = 8, min_features: int = 300) -> DataFrame:
    """Index groups per tile: rows `tile`, `itype` (n, w, a, r), `category`, `features`, with `kept_as` the category or -1 for the mixed group.

    Categories of fewer than `min_features`, and all but the `max_groups - 1` largest, go to the mixed group. There are at most 31
    categories, so the windows are over a few rows each.
    """
    counts = features.groupBy("tile", "itype", "category").agg(F.count("*").alias("features"))
    large = (F.col("category") >= 0) & (F.col("features") >= min_features)
    w = Window.partitionBy("tile", "itype", large).orderBy(F.desc("features"), "category")
    return counts.withColumn("_n", F.row_number().over(w)).withColumn("kept_as", F.when(large & (F.col("_n") <= max_groups - 1), F.col("category")).otherwise(-1)).drop("_n")
