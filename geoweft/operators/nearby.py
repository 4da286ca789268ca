"""Points near other points, and regions containing points.

Polygons are triangulated by ear clipping, the triangles are arranged in a bounding-volume hierarchy, points descend it in
vectors, and the candidate triangles are tested exactly. What is near a point lies in the square around it, which is a polygon
like others, and within the exact distance. The lower hierarchies, one per leaf, are built in the tasks to which the leaves are distributed;
the upper one is the same over the boxes of the leaves. How many items there are decides how they travel, never which pairs come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.functions.triangles import Hierarchy, clip_boxes, curve, ear_clip
from geoweft.session import materialize, materialize_counted, partitions

WORLD = 2**32
CORNERS = ["ax", "ay", "bx", "by", "cx", "cy"]
CORNER_SCHEMA = ", ".join(f"{c} long" for c in CORNERS)
#: Most items that are collected and sent to all tasks.
BOUND = 50_000
#: Items of a leaf, whose hierarchy is built in one task, and boxes by which points find a leaf; a box is of four items at least, so that levels end.
LEAF_ITEMS, PARTS = 4_096, 64
#: Points that one task takes of a leaf, unless that made more than HOT_LEAVES leaves hot.
POINTS_PER_TASK, HOT_LEAVES = 500_000, 1_000


def near_pairs(points: DataFrame, point_columns: Sequence[str], sites: DataFrame, site_columns: Sequence[str], radius: int, period: int = WORLD, broadcast_bound: int = BOUND, leaf_size: int = LEAF_ITEMS) -> DataFrame:
    """Pairs of rows, as `p` (struct of `point_columns`) and `s` (struct of `site_columns`), at a straight distance of at most `radius`; `x` runs around with `period`.

    Both sides have integer `x`, `y`; rows with a null coordinate are near nothing. A pair comes once per point row and site row.
    The square around each point is cut into triangles (four if it runs across the seam), sites are found in these as in any
    region, and the exact distance decides.
    """
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    there = lambda df: df.where("x is not null and y is not null")
    # Row numbers are written once: they tell the squares of equal rows apart.
    numbered, n = materialize_counted(there(points).select(F.struct(F.struct(*point_columns).alias("p"), x.alias("x"), y.alias("y")).alias("i"), x.alias("x"), y.alias("y"), F.monotonically_increasing_id().alias("region")), "points")
    half = period // 2

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            px, py, reach = b["x"].to_numpy(), b["y"].to_numpy(), min(radius, half)
            x0, x1 = px - reach, px + reach
            west, east = x0 < -half, x1 > half - 1
            at = np.concatenate([np.arange(len(px)), np.flatnonzero(west), np.flatnonzero(east)])
            lows = np.concatenate([np.maximum(x0, -half), x0[west] + period, np.full(int(east.sum()), -half)])
            highs = np.concatenate([np.minimum(x1, half - 1), np.full(int(west.sum()), half - 1), x1[east] - period])
            corners = clip_boxes(lows, py[at] - radius, highs, py[at] + radius)
            twice = pa.array(np.repeat(at, 2))
            yield pa.RecordBatch.from_arrays([b["region"].take(twice), b["i"].take(twice), *(pa.array(c) for c in corners.T)], names=["region", "i", *CORNERS])

    triangles = numbered.mapInArrow(squares, f"region long, i {numbered.schema['i'].dataType.simpleString()}, {CORNER_SCHEMA}")
    places = there(sites).select(F.struct(F.struct(*site_columns).alias("s"), x.alias("x"), y.alias("y")).alias("p"), x.alias("x"), y.alias("y"))

    def near(pairs: DataFrame) -> DataFrame:
        straight = F.abs(F.col("p.x") - F.col("i.x"))
        dx, dy = F.least(straight, F.lit(period) - straight), F.abs(F.col("p.y") - F.col("i.y"))
        return pairs.where((dx <= radius) & (dx * dx + dy * dy <= radius * radius))

    return _hits(places, triangles, True, broadcast_bound, leaf_size, near, 2 * n).select(F.col("i.p").alias("p"), F.col("p.s").alias("s"))


def box_rings(bounds: tuple[int, int, int, int] | None, period: int = WORLD) -> list[list[tuple[int, int]]]:
    """The rings of a box minx, miny, maxx, maxy: none if null or empty, two if it crosses the seam of `x`."""
    if bounds is None or any(v is None for v in bounds):
        return []
    minx, miny, maxx, maxy = map(int, bounds)
    if miny > maxy:
        return []
    spans = [(minx, maxx)] if minx <= maxx else [(minx, period // 2 - 1), (-(period // 2), maxx)]
    return [[(a, miny), (b, miny), (b, maxy), (a, maxy)] for a, b in spans]


def triangle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """`region`, `ring` (flat x, y list) to `region` and six corner coordinates."""
    for b in batches:
        out = [(r, *p, *q, *s) for r, flat in zip(b["region"], b["ring"]) for p, q, s in ear_clip([(int(flat[i]), int(flat[i + 1])) for i in range(0, len(flat), 2)])]
        yield pd.DataFrame(out, columns=["region", "ax", "ay", "bx", "by", "cx", "cy"])


TRIANGLES = "region long, ax long, ay long, bx long, by long, cx long, cy long"


def box_triangles(boxes: DataFrame, region: str, bounds: str, period: int = WORLD) -> DataFrame:
    """Triangles of boxes in a struct column `bounds`; null and empty boxes have none, boxes over the seam are cut there."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat = [(r, [float(v) if v is None else v for p in ring for v in p]) for r, *box in b.itertuples(index=False, name=None) for ring in box_rings(tuple(None if pd.isna(v) else v for v in box), period)]
            yield from triangle_rows(iter([pd.DataFrame(flat, columns=["region", "ring"])]))

    fields = [F.col(f"{bounds}.{f}").cast("long").alias(f) for f in ("minx", "miny", "maxx", "maxy")]
    return boxes.where(F.col(region).isNotNull()).select(F.col(region).cast("long").alias("region"), *fields).mapInPandas(rows, TRIANGLES)


def inside_pairs(points: DataFrame, point_key: str, triangles: DataFrame, broadcast_bound: int = BOUND, leaf_size: int = LEAF_ITEMS) -> DataFrame:
    """Pairs (`point_key`, `region`): the regions of which a triangle holds the point, edges included, once per point row.

    Points with a null coordinate are inside nothing; rows of equal keys are points of their own.
    """
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    places = points.where("x is not null and y is not null").select(F.struct(F.col(point_key).alias("key")).alias("p"), x.alias("x"), y.alias("y"))
    items = triangles.select("region", F.struct("region").alias("i"), *CORNERS)
    return _hits(places, items, True, broadcast_bound, leaf_size).select(F.col("p.key").alias(point_key), "region")


def _hits(points: DataFrame, items: DataFrame, exact: bool, bound: int, leaf_size: int, decide: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, least: int = 0) -> DataFrame:
    """`p`, `i`, `region`: points (`p`, `x`, `y`) with the items (`region`, `i`, CORNERS; `least` of them at least) that hold them, once per point row and region; `decide` filters pairs.

    Up to `bound` items (counted; of some 100 bytes) are sent to all tasks as one hierarchy. More of them are put in the order of
    the Hilbert curve, in which `leaf_size` neighbours make a leaf, however many share a centre. Leaves are found by this same function, for their
    boxes are items in turn, far fewer; so each point meets each item of its leaves, whatever the number of levels.
    """
    few = items.limit(bound + 1).toArrow() if least <= bound else None
    if few is not None and few.num_rows <= bound:
        tree = points.sparkSession.sparkContext.broadcast(_Leaf.of(few, exact))

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from tree.value.meet(b, "x", "y")

        return decide(points.mapInArrow(test, _pair_schema(points, items)))
    # The region breaks ties, so that a place with a third of all items is spread over many tasks.
    held = "abc" if exact else "ab"
    middle = lambda a: F.call_function("shiftright", F.least(*(f"{c}{a}" for c in held)) + F.greatest(*(f"{c}{a}" for c in held)), F.lit(1))

    @F.pandas_udf("long")
    def along(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(curve(x.to_numpy(), y.to_numpy()))

    placed = items.withColumn("_at", along(middle("x"), middle("y")))
    ordered = placed.repartitionByRange("_at", "region").sortWithinPartitions("_at", "region")
    # Numbers run within each partition: the upper bits are the partition's.
    leaves = ordered.withColumn("_n", F.monotonically_increasing_id()).withColumn("leaf", F.expr(f"shiftleft(shiftright(_n, 33), 33) + pmod(_n, shiftleft(1L, 33)) div {leaf_size}"))
    leaves = materialize(leaves.withColumn("part", F.expr(f"pmod(_n, shiftleft(1L, 33)) div {max(4, leaf_size // PARTS)}")).drop("_at", "_n"), "leaves")
    low = lambda a: F.min(F.least(*(f"{c}{a}" for c in held)))
    high = lambda a: F.max(F.greatest(*(f"{c}{a}" for c in held)))
    # A leaf has a box for each of its PARTS, so that a point between them does not travel to it.
    boxes = leaves.groupBy(F.col("leaf").alias("region"), "part").agg(low("x").alias("ax"), low("y").alias("ay"), high("x").alias("bx"), high("y").alias("by"))
    boxes, most = materialize_counted(boxes.select("region", F.struct(F.lit(0).alias("none")).alias("i"), "ax", "ay", "bx", "by", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")), "boxes")
    numbered = points.select(F.struct("p", "x", "y", F.monotonically_increasing_id().alias("row")).alias("p"), "x", "y")
    routed, n = materialize_counted(_hits(numbered, boxes, False, max(bound, 2 * partitions(points.sparkSession)), leaf_size, least=most).select("p", F.col("region").alias("leaf")), "routed")
    # Leaves that many points meet are taken by several tasks: by their share there are at most HOT_LEAVES of them.
    many = max(POINTS_PER_TASK, n // HOT_LEAVES)
    hot = routed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > many).collect()
    salts = F.coalesce(F.create_map(*(F.lit(v) for r in hot for v in (r["leaf"], -(-r["n"] // many))))[F.col("leaf")], F.lit(1)) if hot else F.lit(1)
    none = lambda kind: F.lit(None).cast(kind)
    left = leaves.select("leaf", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)).alias("salt"), F.lit(0).alias("side"), "region", "i", *CORNERS, none(routed.schema["p"].dataType).alias("p"))
    right = routed.select("leaf", F.pmod(F.xxhash64("p.row"), salts).cast("int").alias("salt"), F.lit(1).alias("side"), none("long").alias("region"), none(items.schema["i"].dataType).alias("i"), F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), *(none("long").alias(c) for c in CORNERS[2:]), "p")
    both = left.unionByName(right).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "side")
    pairs = both.mapInArrow(_leafwise(exact), _pair_schema(routed, items))
    met = decide(pairs.select("p.p", "i", "region", F.col("p.row").alias("_row")))
    # Items of one region may lie in several leaves.
    return met.dropDuplicates(["_row", "region"]).select("p", "i", "region")


def _pair_schema(points: DataFrame, items: DataFrame) -> str:
    return f"p {points.schema['p'].dataType.simpleString()}, i {items.schema['i'].dataType.simpleString()}, region long"


class _Leaf:
    """The items of one leaf with their hierarchy."""

    def __init__(self, tree: Hierarchy, i: pa.Array, region: pa.Array) -> None:
        self.tree, self.i, self.region = tree, i, region

    @classmethod
    def of(cls, items: pa.Table, exact: bool) -> _Leaf:
        held = lambda c: items[c].combine_chunks() if isinstance(items[c], pa.ChunkedArray) else items[c]
        corners = np.stack([items[c].to_numpy() for c in CORNERS], 1).astype(np.int64) if items.num_rows else np.empty((0, 6), np.int64)
        return cls(Hierarchy(corners, items["region"].to_numpy().astype(np.int64), exact), held("i"), held("region"))

    def meet(self, points: pa.RecordBatch, x: str, y: str) -> Iterator[pa.RecordBatch]:
        for at, item in self.tree.pairs(points[x].to_numpy(), points[y].to_numpy()):
            yield pa.RecordBatch.from_arrays([points["p"].take(pa.array(at)), self.i.take(pa.array(item)), self.region.take(pa.array(item))], names=["p", "i", "region"])


def _leafwise(exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by leaf, salt and side: a leaf's items are held, its points pass in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, leaf = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([b[c].to_numpy().astype(np.int64) for c in ("leaf", "salt", "side")], 1)
            ends = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(marks)]
            for i, j in zip(ends, ends[1:]):
                now = tuple(marks[i, :2])
                if now != key:
                    key, held, leaf = now, [], None
                if marks[i, 2] == 0:
                    held.append(b.slice(i, j - i).select(["region", "i", *CORNERS]))
                elif held:
                    leaf = leaf or _Leaf.of(pa.Table.from_batches(held), exact)
                    yield from leaf.meet(b.slice(i, j - i), "ax", "ay")

    return run
