"""Geometries of features as nested coordinates, and their text forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import mercator
from geoweft.functions import tags as T
from geoweft.functions.text import degrees_text
from geoweft.model import Graph
from geoweft.operators import area, assemble

POINT = "struct<x:bigint,y:bigint>"
#: A part of a geometry: point, line or polygon (an outer ring and its holes), rings closed.
PART = f"struct<kind:string,rings:array<array<{POINT}>>>"


def stitch(lines: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Closed rings from lines joined at their ends; lines that close no ring are left out."""
    rings = [list(x) for x in lines if len(x) > 3 and x[0] == x[-1]]
    rest = [list(x) for x in lines if len(x) > 1 and x[0] != x[-1]]
    at: dict[tuple[int, int], set[int]] = {}
    for i, x in enumerate(rest):
        at.setdefault(x[0], set()).add(i)
        at.setdefault(x[-1], set()).add(i)
    used: set[int] = set()
    for i, x in enumerate(rest):
        if i in used:
            continue
        used.add(i)
        ring = list(x)
        while ring[0] != ring[-1]:
            nxt = min((j for j in at[ring[-1]] if j not in used), default=None)
            if nxt is None:
                break
            used.add(nxt)
            ring += rest[nxt][1:] if rest[nxt][0] == ring[-1] else rest[nxt][-2::-1]
        if len(ring) > 3 and ring[0] == ring[-1]:
            rings.append(ring)
    return rings


def polygons(outer: list[list[tuple[int, int]]], inner: list[list[tuple[int, int]]]) -> list[list[list[tuple[int, int]]]]:
    """Outer rings, each with the inner rings that lie in it; an inner ring in none is left out."""
    out = [[r] for r in stitch(outer)]
    for hole in stitch(inner):
        x, y = np.array([hole[0][0]]), np.array([hole[0][1]])
        home = next((p for p in out if area.inside_rings(x, y, [np.array(p[0], dtype=np.int64)])[0]), None)
        if home:
            home.append(hole)
    return out


def _area_parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for rows in batches:
        out = []
        for ways in rows:
            by = {"outer": [], "inner": []}
            for w in ways if ways is not None else []:
                if w["role"] in by or w["role"] == "":
                    by[w["role"] or "outer"].append([(int(p["x"]), int(p["y"])) for p in w["line"]])
            out.append([{"kind": "polygon", "rings": [[{"x": x, "y": y} for x, y in r] for r in poly]} for poly in polygons(by["outer"], by["inner"])])
        yield pd.Series(out)


def geometries(graph: Graph, rules: list[T.AreaRule] | None = None) -> DataFrame:
    """`ftype`, `id`, `parts` (array of PART), `whole`: point, line, polygon, multipolygon or collection, for all located nodes, valid ways and relations.

    Ways that are areas are polygons. Relations that are areas have their outer and inner member ways stitched to rings, with
    everything else of theirs left out; other relations are the collection of their node and way members, and empty if they have none.
    """
    pt = lambda x, y: F.struct(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))
    part = lambda kind, rings: F.struct(kind.alias("kind"), rings.alias("rings"))
    nodes = graph.located_nodes().select(F.lit("node").alias("ftype"), "id", F.lit("point").alias("whole"), F.array(part(F.lit("point"), F.array(F.array(pt("x", "y"))))).alias("parts"))
    flags = assemble.area_flags(graph, rules)
    line = F.transform(F.when(F.col("closed"), F.concat("shape", F.slice("shape", 1, 1))).otherwise(F.col("shape")), lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y")))
    kind = F.when(F.col("is_area"), "polygon").otherwise("line")
    ways = assemble.way_shapes(graph).join(flags.where("ftype = 'way'").select("id", "is_area"), "id").select(F.lit("way").alias("ftype"), "id", kind.alias("whole"), F.array(part(kind, F.array(line))).alias("parts"))
    lines = ways.select(F.lit("way").alias("mtype"), F.col("id").alias("ref"), F.col("parts")[0]["kind"].alias("k"), F.col("parts")[0]["rings"][0].alias("line"))
    points = nodes.select(F.lit("node").alias("mtype"), F.col("id").alias("ref"), F.lit("point").alias("k"), F.col("parts")[0]["rings"][0].alias("line"))
    members = assemble.relation_members(graph).where("mtype <> 'relation'").join(lines.unionByName(points), ["mtype", "ref"])
    held = members.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "mtype", "ref", "role", "k", "line"))).alias("m"))
    rels = flags.where("ftype = 'relation'").select("id", "is_area").join(held, "id", "left")
    loose = F.coalesce(F.transform("m", lambda m: part(m["k"], F.array(m["line"]))), F.array().cast(f"array<{PART}>"))
    rings = F.pandas_udf(_area_parts, f"array<{PART}>")(F.transform(F.filter("m", lambda m: m["mtype"] == "way"), lambda m: F.struct(m["role"].alias("role"), m["line"].alias("line"))))
    rels_area = rels.where("is_area").select("id", rings.alias("parts")).select(F.lit("relation").alias("ftype"), "id", F.when(F.size("parts") == 1, "polygon").otherwise("multipolygon").alias("whole"), "parts")
    rels_loose = rels.where("not is_area").select(F.lit("relation").alias("ftype"), "id", F.lit("collection").alias("whole"), loose.alias("parts"))
    return nodes.unionByName(ways).unionByName(rels_area).unionByName(rels_loose)


def _texts(point, ring_open: str, ring_close: str):
    ring = lambda r: F.concat(F.lit(ring_open), F.array_join(F.transform(r, point), ","), F.lit(ring_close))
    rings = lambda p: F.concat(F.lit(ring_open), F.array_join(F.transform(p["rings"], ring), ","), F.lit(ring_close))
    return ring, rings


def _lon_lat(p: Column, precision: int) -> tuple[Column, Column]:
    return degrees_text(mercator.lon_degrees(p["x"]), precision), degrees_text(mercator.lat_degrees(p["y"]), precision)


def wkt(whole: Column, parts: Column, precision: int = 7) -> Column:
    """Well-known text; an empty geometry for no parts."""
    point = lambda p: F.concat_ws(" ", *_lon_lat(p, precision))
    ring, rings = _texts(point, "(", ")")
    one = lambda p: F.when(p["kind"] == "point", F.concat(F.lit("POINT"), ring(p["rings"][0]))).when(p["kind"] == "line", F.concat(F.lit("LINESTRING"), ring(p["rings"][0]))).otherwise(F.concat(F.lit("POLYGON"), rings(p)))
    return (
        F.when((F.size(parts) == 0) & (whole == "collection"), "GEOMETRYCOLLECTION EMPTY")
        .when(F.size(parts) == 0, "POLYGON EMPTY")
        .when(whole == "collection", F.concat(F.lit("GEOMETRYCOLLECTION("), F.array_join(F.transform(parts, one), ","), F.lit(")")))
        .when(whole == "multipolygon", F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(parts, rings), ","), F.lit(")")))
        .otherwise(F.array_join(F.transform(parts, one), ","))
    )


def geojson(whole: Column, parts: Column, precision: int = 7) -> Column:
    """A GeoJSON geometry."""
    point = lambda p: F.concat(F.lit("["), F.concat_ws(",", *_lon_lat(p, precision)), F.lit("]"))
    ring, rings = _texts(point, "[", "]")
    held = lambda kind, c: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), c, F.lit("}"))
    one = lambda p: F.when(p["kind"] == "point", held("Point", point(p["rings"][0][0]))).when(p["kind"] == "line", held("LineString", ring(p["rings"][0]))).otherwise(held("Polygon", rings(p)))
    return (
        F.when((whole == "collection") | (F.size(parts) == 0) & (whole != "multipolygon"), F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(F.transform(parts, one), ","), F.lit("]}")))
        .when(whole == "multipolygon", held("MultiPolygon", F.concat(F.lit("["), F.array_join(F.transform(parts, rings), ","), F.lit("]"))))
        .otherwise(F.array_join(F.transform(parts, one), ","))
    )


def centre(parts: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a geometry's bounds; null for none."""
    points = F.flatten(F.flatten(F.transform(parts, lambda p: p["rings"])))
    mid = lambda f: (F.array_min(F.transform(points, lambda p: p[f])) + F.array_max(F.transform(points, lambda p: p[f]))) / 2
    return mercator.lon_degrees(mid("x")), mercator.lat_degrees(mid("y"))
