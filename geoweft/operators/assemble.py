"""Elements joined into features: ways with their nodes, relations with their members, and what follows from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoweft.functions import tags as T
from geoweft.model import Graph, member_type
from geoweft.operators import hierarchy
from geoweft.session import materialize, materialize_counted


def way_nodes(graph: Graph, ways: DataFrame | None = None) -> DataFrame:
    """One row per way (of all, or of `ways`: id, node_ids) and position: `id`, `pos`, `ref`, and `x`, `y` of the node, null where no located node has that id."""
    exploded = (graph.ways("node_ids") if ways is None else ways).select("id", F.posexplode_outer("node_ids").alias("pos", "ref"))
    nodes = graph.located_nodes().select(F.col("id").alias("ref"), "x", "y")
    return exploded.join(nodes, "ref", "left").select("id", "pos", "ref", "x", "y")


def way_status(graph: Graph, ways: DataFrame | None = None) -> DataFrame:
    """Each way (of all, or of `ways`: id, node_ids) once: `n_refs`, `n_missing`, `closed` (first and last node are the same), `status`, and the bounds of its nodes.

    status: `missing` if any node is, `short` with fewer than two nodes, `ring` for a closed way of fewer than three beside the
    closing one, else `ok`. One aggregate over the joined positions, without gathering them.
    """
    last = F.max(F.struct("pos", "ref"))["ref"]
    first = F.min(F.struct("pos", "ref"))["ref"]
    n = F.count("pos")
    g = way_nodes(graph, ways).groupBy("id").agg(
        n.cast("int").alias("n_refs"),
        (n - F.count("x")).cast("int").alias("n_missing"),
        F.coalesce((n > 1) & (first == last), F.lit(False)).alias("closed"),
        *(f(c).alias(f"{p}{c}") for c in ("x", "y") for p, f in (("min", F.min), ("max", F.max))),
    )
    status = F.when(F.col("n_missing") > 0, "missing").when(F.col("n_refs") < 2, "short").when(F.col("closed") & (F.col("n_refs") < 4), "ring").otherwise("ok")
    return g.withColumn("status", status)


def way_shapes(graph: Graph) -> DataFrame:
    """Valid ways with their coordinates in order: `id`, `closed`, `shape` (array of x, y; of a ring without the closing node), `node_ids`.

    A way with a missing node is left out as a whole, never shortened.
    """
    held = F.array_sort(F.collect_list(F.struct("pos", "ref", "x", "y")))
    g = way_nodes(graph).where("pos is not null").groupBy("id").agg(held.alias("p"), F.count("x").alias("n"))
    g = g.where("n = size(p) and n > 1").withColumn("closed", F.expr("p[0].ref = element_at(p, -1).ref")).where("not closed or n > 3")
    kept = F.when(F.col("closed"), F.expr("slice(p, 1, size(p) - 1)")).otherwise(F.col("p"))
    return g.select("id", "closed", F.transform(kept, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("shape"), F.transform(kept, lambda q: q["ref"]).alias("node_ids"))


def relation_members(graph: Graph, relations: DataFrame | None = None) -> DataFrame:
    """One row per relation (of all, or of `relations`: id, members) and member that names an element: `id`, `pos`, `mtype`, `ref`, `role` ('' for null), self-references left out."""
    rows = (graph.relations("members") if relations is None else relations).select("id", F.explode("members").alias("m"))
    return rows.select("id", F.col("m.pos").alias("pos"), member_type(F.col("m.type")).alias("mtype"), F.col("m.ref").alias("ref"), F.coalesce("m.role", F.lit("")).alias("role")).where(
        "mtype is not null and ref is not null and not (mtype = 'relation' and ref = id)"
    )


def _placed(graph: Graph) -> DataFrame:
    """(ftype, id) of located nodes and valid ways."""
    nodes = graph.located_nodes().select(F.lit("node").alias("ftype"), "id")
    return nodes.unionByName(way_status(graph).where("status = 'ok'").select(F.lit("way").alias("ftype"), "id"))


def valid_relations(graph: Graph, only: DataFrame | None = None) -> DataFrame:
    """`id` of relations that have a located node or valid way at some depth; others are dropped, and missing to their parents.

    Most have one directly. Only links of the others are followed, upwards with doubling jumps. With `only` (id, members) none but these are asked
    about, and the rest of the hierarchy is looked at only if some of them have nothing themselves but relations.
    """
    if only is not None:
        members = relation_members(graph, only)
        refs = members.where("mtype = 'way'").select(F.col("ref").alias("id")).distinct()
        ways = way_status(graph, graph.ways("node_ids").join(refs, "id", "left_semi")).where("status = 'ok'").select(F.lit("way").alias("mtype"), F.col("id").alias("ref"))
        nodes = graph.located_nodes().select(F.lit("node").alias("mtype"), F.col("id").alias("ref"))
        hit = members.where("mtype <> 'relation'").join(nodes.unionByName(ways), ["mtype", "ref"], "left_semi").select("id").distinct().withColumn("direct", F.lit(True))
        # One row for each that may be valid: whether it is, or has relations to ask further.
        asked, n = materialize_counted(members.groupBy("id").agg(F.bool_or(F.col("mtype") == "relation").alias("upper")).join(hit, "id", "left").where("direct or upper"), "asked")
        direct = asked.where("direct").select("id")
        rest = asked.where("direct is null").select("id")
        return direct.unionByName(valid_relations(graph).join(rest, "id", "left_semi")) if n and rest.limit(1).count() else direct
    return graph.once("valid relations", lambda: _all_valid_relations(graph))


def _all_valid_relations(graph: Graph) -> DataFrame:
    members = relation_members(graph)
    placed = _placed(graph).select(F.col("ftype").alias("mtype"), F.col("id").alias("ref"))
    direct = materialize(members.where("mtype <> 'relation'").join(placed, ["mtype", "ref"], "left_semi").select("id").distinct(), "direct")
    open_links = members.where("mtype = 'relation'").select(F.col("ref").alias("src"), F.col("id").alias("dst")).distinct().join(direct.select(F.col("id").alias("dst")), "dst", "left_anti")
    links, n = materialize_counted(open_links.join(graph.ids("relation").withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst"), "open-links")
    if not n:
        return direct
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct().join(direct.withColumn("_d", F.lit(0)), "id", "left")
    reached = hierarchy.propagate_min(links, ends.select("id", F.coalesce("_d", F.lit(1)).alias("label")))
    return direct.union(reached.where("label = 0").select("id")).distinct()


def elements(graph: Graph) -> DataFrame:
    """(ftype, id) of all elements that members can resolve to: located nodes, valid ways, valid relations."""
    return _placed(graph).unionByName(valid_relations(graph).select(F.lit("relation").alias("ftype"), "id"))


def resolved_members(graph: Graph) -> DataFrame:
    """`relation_members` with `found`: whether the element exists."""
    known = elements(graph).select(F.col("ftype").alias("mtype"), F.col("id").alias("ref"), F.lit(True).alias("_f"))
    return relation_members(graph).join(known, ["mtype", "ref"], "left").select("id", "pos", "mtype", "ref", "role", F.coalesce("_f", F.lit(False)).alias("found"))


def missing_members(graph: Graph, resolved: DataFrame | None = None) -> DataFrame:
    """Relations with members: `members`, `missing`, `kept` (false for one of which nothing is found)."""
    missing = F.sum(F.when(F.col("found"), 0).otherwise(1))
    resolved = resolved if resolved is not None else resolved_members(graph)
    return resolved.groupBy("id").agg(F.count("*").alias("members"), missing.alias("missing"), (missing < F.count("*")).alias("kept"))


def parents(graph: Graph, found: DataFrame | None = None) -> DataFrame:
    """`ftype`, `id` of each found member (or of those in `found`) with `parents`, the ids of its relations in ascending order."""
    found = found if found is not None else resolved_members(graph).where("found")
    return found.groupBy(F.col("mtype").alias("ftype"), F.col("ref").alias("id")).agg(F.array_sort(F.collect_set(F.col("id"))).alias("parents"))


def way_area(closed: Column, tags: Column, rules: list[T.AreaRule]) -> Column:
    return closed & T.area_tags(tags, rules, "area")


def area_flags(graph: Graph, rules: list[T.AreaRule] | None = None) -> DataFrame:
    """`ftype`, `id`, `is_area` of valid ways and of relations: a way that is closed, a relation with an outer member, and by their tags."""
    rules = rules if rules is not None else T.parse_area_rules(T.AREA_RULES)
    ways = graph.ways("tags").join(way_status(graph).where("status = 'ok'").select("id", "closed"), "id")
    ways = ways.select(F.lit("way").alias("ftype"), "id", way_area(F.col("closed"), F.col("tags"), rules).alias("is_area"))
    outer = F.exists("members", lambda m: m["role"] == "outer")
    relations = graph.relations("members", "tags").select(F.lit("relation").alias("ftype"), "id", (F.coalesce(outer, F.lit(False)) & T.area_tags(F.col("tags"), rules, "type")).alias("is_area"))
    return ways.unionByName(relations)


def node_roles(graph: Graph) -> DataFrame:
    """Located nodes with what they are: `tagged`, `waynode` (of any way), `member` (of any relation), `shared` (location), `orphan`."""
    nodes = graph.located_nodes("tags").select("id", "x", "y", (F.coalesce(F.size("tags"), F.lit(0)) > 0).alias("tagged"))
    in_way = graph.ways("node_ids").select(F.explode("node_ids").alias("id")).where("id is not null").distinct().withColumn("waynode", F.lit(True))
    in_relation = relation_members(graph).where("mtype = 'node'").select(F.col("ref").alias("id")).distinct().withColumn("member", F.lit(True))
    # Counted by an aggregate and joined back rather than by a window: a location with a third of all nodes combines before it moves.
    shared = nodes.groupBy("x", "y").count().where("count > 1").select("x", "y", F.lit(True).alias("shared"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    j = nodes.join(in_way, "id", "left").join(in_relation, "id", "left").join(shared, ["x", "y"], "left").select("id", "x", "y", "tagged", no("waynode"), no("member"), no("shared"))
    return j.withColumn("orphan", ~F.col("tagged") & ~F.col("waynode") & ~F.col("member"))


def node_features(graph: Graph, wanted: Column | None = None, untagged: bool = True) -> DataFrame:
    """Nodes that are features (tagged, members, at a shared location, or orphans) with their tags, synthetic ones included: `id`, `x`, `y`, `tags`.

    An untagged node gets the tag DUPLICATE at a shared location and ORPHAN if nothing uses it. A tagged one is a feature whatever uses it, so it is
    joined with nothing. `wanted` is a condition on real tags, for the tagged; `untagged` says whether others may be left out.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    tagged = F.coalesce(F.size("tags"), F.lit(0)) > 0
    own = graph.located_nodes("tags").where(tagged if wanted is None else tagged & wanted).select("id", "x", "y", "tags")
    if not untagged:
        return own
    roles = node_roles(graph).where("not tagged and (member or shared or orphan)")
    extra = F.map_concat(
        F.when(F.col("shared"), F.create_map(F.lit(T.DUPLICATE), F.lit("yes"))).otherwise(none),
        F.when(F.col("orphan"), F.create_map(F.lit(T.ORPHAN), F.lit("yes"))).otherwise(none),
    )
    return own.unionByName(roles.select("id", "x", "y", extra.alias("tags")))


def osm_stats(graph: Graph) -> DataFrame:
    """Counts over all current elements: one row per type with elements, members (or node references), tags, and the greatest id."""
    n_tags = F.coalesce(F.sum(F.when(F.col("tags").isNotNull(), F.size("tags"))), F.lit(0)).cast("long").alias("tags")
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).cast("long").alias("members")
    row = lambda df, t, m: df.agg(F.count("*").alias("elements"), m, n_tags, F.max("id").alias("max_id")).select(F.lit(t).alias("ftype"), "elements", "members", "tags", "max_id")
    return (
        row(graph.nodes("tags"), "node", F.lit(0).cast("long").alias("members"))
        .unionByName(row(graph.ways("node_ids", "tags"), "way", size("node_ids")))
        .unionByName(row(graph.relations("members", "tags"), "relation", size("members")))
    )


def member_runs(graph: Graph) -> DataFrame:
    """Members in order with `role_changes`: whether the role differs from that of the member before; the first one's does."""
    w = Window.partitionBy("id").orderBy("pos")
    return relation_members(graph).withColumn("role_changes", ~F.col("role").eqNullSafe(F.lag("role").over(w)))
