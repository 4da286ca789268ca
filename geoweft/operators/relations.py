"""Relations of relations: cycles broken, levels, and bounds from the bottom up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import tags as T
from geoweft.model import Graph
from geoweft.operators import assemble, hierarchy
from geoweft.session import materialize, materialize_counted

#: Levels beyond this are left out.
MOST_LEVEL = 9
# Scores by which the relation to lose a member is chosen on a cycle.
ONLY_RELATIONS, PER_LEVEL, TOP_LEVEL = 1_000_000_000, 1_000_000, 14
TYPE_SCORES = {"superroute": 50_000_000, "route_master": 50_000_000, "network": 100_000_000, "site": 20_000_000}


def relation_links(graph: Graph) -> DataFrame:
    """Distinct links `src`, `dst` between existing relations, self-references left out."""
    there = graph.ids("relation").select(F.col("id").alias("ref"))
    links = assemble.relation_members(graph).where("mtype = 'relation'").select("id", "ref").distinct().join(there, "ref", "left_semi")
    return hierarchy.distinct_links(links, "id", "ref")


def score(members: Column, tags: Column) -> Column:
    """How high in a hierarchy a relation stands, by its members and tags."""
    others = F.size(F.filter(members, lambda m: F.lower(F.substring(m["type"], 1, 1)) != "r"))
    base = F.when(others > 0, others).otherwise(ONLY_RELATIONS)
    kind = T.tag(tags, "type")
    by_type = F.coalesce(*(F.when(kind == k, v) for k, v in TYPE_SCORES.items()), F.lit(0))
    level = F.coalesce((TOP_LEVEL - T.tag(tags, "admin_level").try_cast("double")) * PER_LEVEL, F.lit(0.0))
    return base + by_type + level


def break_cycles(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Links without cycles, and the links removed.

    Per component and round, the relation of the lowest score (then id) loses its link to the member of the least id within the
    component. The first round finds components among all links, later ones look at the links inside those components only.
    """
    links = materialize(relation_links(graph), "links")
    scores = graph.relations("members", "tags").select(F.col("id").alias("src"), score(F.col("members"), F.col("tags")).alias("_score"))
    inner, removed = links, None
    while True:
        cycles = hierarchy.cycle_members(inner)
        if not cycles.limit(1).count():
            break
        part = cycles.select(F.col("id").alias("src"), F.col("root_id").alias("_a"))
        inner = inner.join(part, "src").join(cycles.select(F.col("id").alias("dst"), F.col("root_id").alias("_b")), "dst").where("_a = _b").select("src", "dst", "_a")
        lost = inner.join(scores, "src").groupBy("_a").agg(F.min_by(F.struct("src", "dst"), F.struct("_score", "src", "dst")).alias("l")).select("l.src", "l.dst")
        lost = materialize(lost, "lost")
        removed = lost if removed is None else removed.unionByName(lost)
        inner = materialize(inner.select("src", "dst").join(lost, ["src", "dst"], "left_anti"), "inner")
    if removed is None:
        return links, links.limit(0)
    return materialize(links.join(removed, ["src", "dst"], "left_anti"), "acyclic"), removed


def levels(graph: Graph, links: DataFrame | None = None) -> DataFrame:
    """Every relation with `level`: 0 without relation members, else one more than its highest member; `omitted` beyond MOST_LEVEL.

    Links of cycles are broken first, unless `links` are those left. Round k keeps the relations that have a way down of k links, so there are as many rounds
    as levels.
    """
    links = links if links is not None else break_cycles(graph)[0]
    reach = links.select(F.col("src").alias("id")).distinct()
    parts = [graph.ids("relation").select("id", F.lit(0).alias("level"))]
    level = 1
    while True:
        reach, n = materialize_counted(reach, "level")
        if not n:
            break
        parts.append(reach.select("id", F.lit(level).alias("level")))
        level += 1
        reach = links.join(reach.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("id").agg(F.max("level").alias("level")).withColumn("omitted", F.col("level") > MOST_LEVEL)


def direct_bounds(graph: Graph) -> DataFrame:
    """Bounds of each relation's found node and way members."""
    nodes = graph.located_nodes().select(F.lit("node").alias("mtype"), F.col("id").alias("ref"), F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    ways = assemble.way_status(graph).where("status = 'ok'").select(F.lit("way").alias("mtype"), F.col("id").alias("ref"), "minx", "miny", "maxx", "maxy")
    m = assemble.relation_members(graph).where("mtype <> 'relation'").join(nodes.unionByName(ways), ["mtype", "ref"])
    return m.groupBy("id").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def relation_bounds(graph: Graph) -> DataFrame:
    """Bounds of each relation that has a located member at any depth; members of a cycle share theirs.

    Bounds go up the links by pointer doubling, all four at once, the upper ones negated so that the least wins.
    """
    up = materialize(relation_links(graph).select(F.col("dst").alias("src"), F.col("src").alias("dst")), "up")
    own = graph.ids("relation").select("id").join(direct_bounds(graph), "id", "left")
    names = ["a", "b", "c", "d"]
    start = materialize(own.select("id", F.col("minx").cast("long").alias("a"), F.col("miny").cast("long").alias("b"), (-F.col("maxx").cast("long")).alias("c"), (-F.col("maxy").cast("long")).alias("d")), "bounds")
    done = hierarchy.propagate_min(up, start, names)
    return done.where("a is not null").select("id", F.col("a").alias("minx"), F.col("b").alias("miny"), (-F.col("c")).alias("maxx"), (-F.col("d")).alias("maxy"))


def kept_members(resolved: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of `assemble.resolved_members` that a store has: found ones, without the links removed from cycles."""
    return resolved.where("found").join(removed.select(F.lit("relation").alias("mtype"), F.col("src").alias("id"), F.col("dst").alias("ref")), ["mtype", "id", "ref"], "left_anti")


def synthetic_relation_tags(graph: Graph, resolved: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Relations with tags added: MISSING_MEMBERS and REMOVED_REFCYCLES with their numbers, where not zero.

    Tags of these names in the data give way. `resolved` and `removed` are resolved members and links removed from cycles, if known.
    """
    removed = removed if removed is not None else break_cycles(graph)[1]
    lost = removed.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("lost"))
    j = graph.relations("tags").join(assemble.missing_members(graph, resolved).select("id", "missing"), "id", "left").join(lost, "id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    extra = lambda c, k: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.create_map(F.lit(k), F.col(c).cast("string"))).otherwise(none)
    return j.select("id", F.map_concat(F.map_filter(F.coalesce("tags", none), lambda k, v: ~k.isin(T.MISSING_MEMBERS, T.REMOVED_REFCYCLES)), extra("missing", T.MISSING_MEMBERS), extra("lost", T.REMOVED_REFCYCLES)).alias("tags"))
