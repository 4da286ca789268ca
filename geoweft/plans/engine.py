"""Queries on the engine's own operators, over the tables nodes, ways, relations and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import tags as T
from geoweft.functions import text
from geoweft.model import Graph
from geoweft.operators import area, assemble, relations, strings, tiling
from geoweft.operators.features import features, selected
from geoweft.session import materialize

LEVELS = T.parse_zoom_levels(T.ZOOM_LEVELS)
#: Density from which tiles are kept and most tiles, as the queries use them on tables of a few hundred thousand nodes.
DENSITY, TILES = 500, 64
BOX = "-20,-30,40,55"
POLYGON = "POLYGON((-20 -30, 40 -35, 60 20, 10 50, 5 10, -20 -30))"


def _selected(query: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        f = selected(Graph.load(spark, folder), query)
        return f.select("ftype", "id", T.tags_text(F.col("tags")).alias("tags_text"))

    return run


def count_by_type(spark: SparkSession, folder: str) -> DataFrame:
    f = features(Graph.load(spark, folder), bounds=False)
    return f.groupBy("ftype", "is_area").agg(F.count("*").alias("features"))


def keys_projection(spark: SparkSession, folder: str) -> DataFrame:
    f = selected(Graph.load(spark, folder), "wa[building]")
    kept = T.keep_tags(F.col("tags"), ["building", "note"])
    return f.select("ftype", "id", T.tag(F.col("tags"), "note").alias("note"), T.tags_text(kept).alias("tags_text"))


def bbox_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = Graph.load(spark, folder).located_nodes()
    return nodes.where(area.meets_box(area.box_units(area.parse_box(BOX)), "x", "y", "x", "y")).select("id", "x", "y")


def bbox_ways(spark: SparkSession, folder: str) -> DataFrame:
    ways = assemble.way_status(Graph.load(spark, folder)).where("status = 'ok'")
    return ways.where(area.meets_box(area.box_units(area.parse_box(BOX)))).select("id", "minx", "miny", "maxx", "maxy")


def polygon_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return area.points_in_area(Graph.load(spark, folder).located_nodes(), area.parse_rings(POLYGON)).select("id")


def polygon_ways(spark: SparkSession, folder: str) -> DataFrame:
    g = Graph.load(spark, folder)
    xs, ys = F.transform("shape", lambda p: p["x"]), F.transform("shape", lambda p: p["y"])
    shapes = assemble.way_shapes(g).withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})
    shapes = shapes.join(assemble.area_flags(g).where("ftype = 'way'").select("id", "is_area"), "id")
    return area.shapes_in_area(shapes, area.parse_rings(POLYGON)).select("id")


def way_assembly(spark: SparkSession, folder: str) -> DataFrame:
    s = assemble.way_shapes(Graph.load(spark, folder))
    return s.select("id", "closed", F.size("shape").alias("nodes"), F.array_join(F.transform("shape", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",").alias("coordinates"))


def way_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.way_status(Graph.load(spark, folder)).where("status <> 'ok'").select("id", "n_refs", "n_missing", "status")


def closed_rings(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.way_status(Graph.load(spark, folder)).where("status = 'ok' and closed").select("id", "n_refs")


def way_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.way_status(Graph.load(spark, folder)).where("status = 'ok'").select("id", "minx", "miny", "maxx", "maxy")


def area_flag(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.area_flags(Graph.load(spark, folder))


def relation_members(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.resolved_members(Graph.load(spark, folder)).select("id", "pos", "mtype", "ref", "role", "found")


def missing_members(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.missing_members(Graph.load(spark, folder))


def parents(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.parents(Graph.load(spark, folder)).select("ftype", "id", F.array_join(F.col("parents").cast("array<string>"), ",").alias("parent_ids"))


def waynode_semi(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.node_roles(Graph.load(spark, folder)).where("waynode").select("id")


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.node_roles(Graph.load(spark, folder)).where("orphan").select("id")


def shared_location(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.node_roles(Graph.load(spark, folder)).where("shared").select("id", "tagged")


def node_features(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.node_features(Graph.load(spark, folder)).select("id", "x", "y", T.tags_text(F.col("tags")).alias("tags_text"))


def role_runs(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.member_runs(Graph.load(spark, folder)).groupBy("id").agg(F.sum(F.col("role_changes").cast("long")).alias("role_runs"))


def super_levels(spark: SparkSession, folder: str) -> DataFrame:
    return relations.levels(Graph.load(spark, folder))


def cycle_breaks(spark: SparkSession, folder: str) -> DataFrame:
    return relations.break_cycles(Graph.load(spark, folder))[1].select(F.col("src").alias("relation_id"), F.col("dst").alias("member_id"))


def relation_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return relations.relation_bounds(Graph.load(spark, folder))


def relation_scores(spark: SparkSession, folder: str) -> DataFrame:
    return Graph.load(spark, folder).relations("members", "tags").select("id", relations.score(F.col("members"), F.col("tags")).alias("score"))


def osm_stats(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.osm_stats(Graph.load(spark, folder))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.cell_counts(Graph.load(spark, folder).located_nodes())


def cell_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _cells(spark, folder)


def tile_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.tile_rollup(_cells(spark, folder), LEVELS)


def tile_density(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.kept_tiles(tiling.tile_rollup(_cells(spark, folder), LEVELS), DENSITY, 65_535)


def tile_topk(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.kept_tiles(tiling.tile_rollup(_cells(spark, folder), LEVELS), 1, TILES)


def tile_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rollup = materialize(tiling.tile_rollup(_cells(spark, folder), LEVELS), "rollup")
    return tiling.size_estimates(rollup, tiling.kept_tiles(rollup, DENSITY, 65_535), LEVELS)


def tile_assignment(spark: SparkSession, folder: str) -> DataFrame:
    nodes = Graph.load(spark, folder).located_nodes()
    kept = tiling.kept_tiles(tiling.tile_rollup(tiling.cell_counts(nodes), LEVELS), DENSITY, 65_535)
    return tiling.assign_points(nodes, kept, LEVELS).select("id", "tile")


def string_usage(spark: SparkSession, folder: str) -> DataFrame:
    return strings.string_usage(Graph.load(spark, folder))


def string_topk(spark: SparkSession, folder: str) -> DataFrame:
    return strings.string_table(strings.string_usage(Graph.load(spark, folder)), min_usage=3, max_strings=400)


def index_category(spark: SparkSession, folder: str) -> DataFrame:
    f = features(Graph.load(spark, folder), bounds=False)
    found = T.categories(F.col("tags"), T.parse_indexed_keys(T.INDEXED_KEYS))
    return f.select("ftype", "id", T.category(found).alias("category"), T.index_bits(found).alias("index_bits"))


def index_groups(spark: SparkSession, folder: str) -> DataFrame:
    f = features(Graph.load(spark, folder), bounds=False)
    itype = F.when(F.col("is_area"), "a").otherwise(F.substring("ftype", 1, 1))
    keyed = f.select(F.lit("0/0/0").alias("tile"), itype.alias("itype"), T.category(T.categories(F.col("tags"), T.parse_indexed_keys(T.INDEXED_KEYS))).alias("category"))
    return tiling.index_groups(keyed, min_features=20)


def hilbert_pack(spark: SparkSession, folder: str) -> DataFrame:
    nodes = Graph.load(spark, folder).located_nodes("tile")
    f = nodes.select(F.lit("node").alias("ftype"), "id", "tile", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    return tiling.hilbert_pack(f).select("id", "tile", "hilbert", "leaf")


def list_ids(spark: SparkSession, folder: str) -> DataFrame:
    f = selected(Graph.load(spark, folder), "na[amenity]")
    return f.select(text.typed_id(F.col("ftype"), F.col("id")).alias("line"), text.packed_id(F.col("ftype"), F.col("id")).alias("packed"))


QUERIES = {
    "count_by_type": count_by_type,
    "selector_key": _selected("w[highway]"),
    "selector_eq": _selected("na[amenity=tree]"),
    "selector_prefix": _selected("*[power=s*]"),
    "selector_not": _selected("n[amenity][!note]"),
    "selector_noteq": _selected("war[building][building!=no]"),
    "selector_any": _selected("n[amenity=gate,tree], r[type=m*]"),
    "keys_projection": keys_projection,
    "list_ids": list_ids,
    "bbox_nodes": bbox_nodes,
    "bbox_ways": bbox_ways,
    "polygon_nodes": polygon_nodes,
    "polygon_ways": polygon_ways,
    "way_assembly": way_assembly,
    "way_rejects": way_rejects,
    "closed_rings": closed_rings,
    "way_bounds": way_bounds,
    "area_flag": area_flag,
    "relation_members": relation_members,
    "missing_members": missing_members,
    "parents": parents,
    "waynode_semi": waynode_semi,
    "orphans": orphans,
    "shared_location": shared_location,
    "node_features": node_features,
    "role_runs": role_runs,
    "super_levels": super_levels,
    "cycle_breaks": cycle_breaks,
    "relation_bounds": relation_bounds,
    "relation_scores": relation_scores,
    "osm_stats": osm_stats,
    "cell_counts": cell_counts,
    "tile_rollup": tile_rollup,
    "tile_density": tile_density,
    "tile_topk": tile_topk,
    "tile_sizes": tile_sizes,
    "tile_assignment": tile_assignment,
    "string_usage": string_usage,
    "string_topk": string_topk,
    "index_category": index_category,
    "index_groups": index_groups,
    "hilbert_pack": hilbert_pack,
}
