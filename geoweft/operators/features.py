"""The union of all features, as queries, exports and the store see them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.functions import tags as T
from geoweft.model import Graph
from geoweft.operators import assemble, relations
from geoweft.plans import selector

BOUNDS = ("minx", "miny", "maxx", "maxy")


def features(graph: Graph, bounds: bool = True, rules: list[T.AreaRule] | None = None, types: str = "nwar", relation_tags: DataFrame | None = None, query: str = "*") -> DataFrame:
    """Features of the given query types (all those of elements that may be one of them): `ftype`, `id`, `is_area`, `tags` (synthetic ones of nodes included), and with `bounds` minx, miny, maxx, maxy.

    Each branch has its type as a literal, so a predicate on types also drops the branches it excludes before anything of them is read.
    What `query` says of tags is asked of the elements before they are joined with anything; the rest of it is left to the caller.
    Relations have the tags of their elements, or those of `relation_tags` (id, tags), as a build adds to them.
    Valid ways and relations only: a relation without anything located at any depth is no feature.
    """
    rules = rules if rules is not None else T.parse_area_rules(T.AREA_RULES)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    tags = F.coalesce("tags", none).alias("tags")
    box = lambda *c: [F.col(x).cast("long").alias(b) for x, b in zip(c, BOUNDS)] if bounds else []
    narrow = any(s.clauses for s in selector.parse(query)) and all(s.clauses for s in selector.parse(query))
    branches = []
    if "n" in types:
        wanted = selector.tags_predicate(query, "n") if narrow else None
        nodes = assemble.node_features(graph, wanted, not (narrow and selector.needs_tag(query, "n", T.SYNTHETIC)))
        branches.append(nodes.select(F.lit("node").alias("ftype"), "id", F.lit(False).alias("is_area"), "tags", *box("x", "y", "x", "y")))
    if set(types) & set("wa"):
        ways = graph.ways("node_ids", "tags")
        ways = ways.where(selector.tags_predicate(query, "wa")) if narrow else ways
        status = assemble.way_status(graph, ways.select("id", "node_ids")).where("status = 'ok'")
        branches.append(ways.drop("node_ids").join(status, "id").select(F.lit("way").alias("ftype"), "id", assemble.way_area(F.col("closed"), F.col("tags"), rules).alias("is_area"), tags, *box(*BOUNDS)))
    if set(types) & set("ar"):
        outer = F.coalesce(F.exists("members", lambda m: m["role"] == "outer"), F.lit(False))
        rels = graph.relations("members", "tags")
        narrow &= relation_tags is None
        rels = rels.where(selector.tags_predicate(query, "ar")) if narrow else rels
        if narrow and "r" not in types:
            rels = rels.where(outer)
        valid = None if bounds else assemble.valid_relations(graph, rels.select("id", "members") if narrow else None)
        rels = rels.select("id", (outer & T.area_tags(F.col("tags"), rules, "type")).alias("is_area"), tags)
        rels = rels.drop("tags").join(relation_tags, "id") if relation_tags is not None else rels
        rels = rels.join(relations.relation_bounds(graph), "id") if bounds else rels.join(valid, "id", "left_semi")
        branches.append(rels.select(F.lit("relation").alias("ftype"), "id", "is_area", "tags", *box(*BOUNDS)))
    return reduce(DataFrame.unionByName, branches)


def selected(graph: Graph, query: str, bounds: bool = False) -> DataFrame:
    """Features that match a query; only the branches it accepts are built."""
    return features(graph, bounds, types=selector.accepted_types(query), query=query).where(selector.predicate(query))
