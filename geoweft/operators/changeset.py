"""Changes against the graph: which take effect, the graph after them, and what they change beyond themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import tags as T
from geoweft.model import MEMBERS, TAGS, Graph, member_type
from geoweft.operators import assemble, upsert
from geoweft.operators.current import current_narrow, flag

KEYS = ["ftype", "id"]
VALUES = ["x", "y", "refs", "members", "tags"]


def stated_delete() -> Column:
    """A change is a delete by its flag, or by its op trimmed and in lower case."""
    return flag("is_deleted") | F.coalesce(F.lower(F.trim("op")) == "delete", F.lit(False))


def deletes() -> Column:
    """A stated delete, a way of fewer than two nodes, or a relation without members."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return stated_delete() | ((F.col("ftype") == "way") & (size("refs") < 2)) | ((F.col("ftype") == "relation") & (size("members") < 1))


def latest(changes: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """The deciding change of each element (ftype, id, version, is_delete, seq, values)."""
    return upsert.deciding_changes(changes.withColumn("_deletes", deletes()), KEYS, "version", "_deletes", "seq", values)


def base_versions(graph: Graph) -> DataFrame:
    """(ftype, id, version, is_deleted) of all elements, deleted ones included."""
    out = None
    for ftype, rows in graph.tables.items():
        part = rows.select(F.lit(ftype).alias("ftype"), "id", "version", "is_deleted")
        out = part if out is None else out.unionByName(part)
    return current_narrow(out, [], KEYS)


def effective(graph: Graph, changes: DataFrame, values: tuple[str, ...] = tuple(VALUES)) -> DataFrame:
    """Deciding changes that take effect, with `existed`: whether there was a live element before."""
    base = base_versions(graph).withColumnsRenamed({"version": "_v", "is_deleted": "_d"})
    j = latest(changes, values).join(base, KEYS, "left")
    return j.where(F.col("version") + F.col("is_delete").cast("int") > F.coalesce("_v", F.lit(0))).withColumn("existed", F.coalesce(~F.col("_d"), F.lit(False))).drop("_v", "_d")


def late_changes(graph: Graph, changes: DataFrame) -> DataFrame:
    """Changes that are passed over: `reason` is `no version`, `superseded` by a deciding one, or `late` against the element. Copies count once."""
    rows = changes.withColumn("_deletes", deletes()).select("ftype", "id", "seq", "version", "_deletes").distinct()
    eff = effective(graph, changes, ()).select("ftype", "id", F.col("seq").alias("_seq"))
    decided = latest(changes).select("ftype", "id", F.col("seq").alias("_dec"))
    j = rows.join(decided, KEYS, "left").join(eff, KEYS, "left")
    reason = F.when(F.col("version").isNull(), "no version").when(~F.col("seq").eqNullSafe(F.col("_dec")), "superseded").when(F.col("_seq").isNull(), "late")
    return j.select("ftype", "id", "seq", reason.alias("reason")).where("reason is not null")


def change_tags(tags: Column) -> Column:
    """A change's list of tags as a map: entries without a key or value are left out, of a key that comes twice the last counts."""
    kept = F.filter(tags, lambda t: t["k"].isNotNull() & t["v"].isNotNull())
    keys = F.array_distinct(F.transform(kept, lambda t: t["k"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(kept, lambda t: t["k"] == k), -1)["v"].alias("value")))
    return F.map_from_entries(F.coalesce(last, F.array().cast("array<struct<key:string,value:string>>")))


def future(graph: Graph, eff: DataFrame) -> Graph:
    """The graph after effective changes: each is one more version of its element, a delete one beyond its own number.

    A relation's references to itself are dropped. Way geometries, bounds, areas and levels follow by deriving them from this graph, so an
    update equals a rebuild by construction.
    """
    number = (F.col("version") + F.col("is_delete").cast("int")).cast("int").alias("version")
    own = lambda t: eff.where(F.col("ftype") == t)
    tags = change_tags(F.col("tags")).cast(TAGS).alias("tags")
    gone = F.col("is_delete").alias("is_deleted")
    nodes = own("node").select("id", number, "x", "y", gone, tags)
    ways = own("way").select("id", number, F.col("refs").alias("node_ids"), gone, tags)
    numbered = F.transform("members", lambda m, i: F.struct(i.alias("pos"), m["type"].alias("type"), m["ref"].alias("ref"), m["role"].alias("role")))
    others = F.filter(numbered, lambda m: ~((member_type(m["type"]) == "relation") & m["ref"].eqNullSafe(F.col("id"))))
    rels = own("relation").select("id", number, others.cast(MEMBERS).alias("members"), gone, tags)
    add = lambda old, new: old.select(*new.columns).unionByName(new)
    return Graph(add(graph.tables["node"], nodes), add(graph.tables["way"], ways), add(graph.tables["relation"], rels))


def member_diff(graph: Graph, eff: DataFrame) -> DataFrame:
    """Memberships that changes add or remove: `id` of the relation, `mtype`, `ref`, `action`. Each member counts once per relation."""
    changed = eff.where("ftype = 'relation'")
    past = assemble.relation_members(graph).join(changed.select("id"), "id", "left_semi").select("id", "mtype", "ref").distinct()
    m = changed.where("not is_delete").select("id", F.explode("members").alias("m")).select("id", member_type(F.col("m.type")).alias("mtype"), F.col("m.ref").alias("ref"))
    after = m.where("mtype is not null and ref is not null and not (mtype = 'relation' and ref = id)").distinct()
    on = ["id", "mtype", "ref"]
    return after.join(past, on, "left_anti").withColumn("action", F.lit("added")).unionByName(past.join(after, on, "left_anti").withColumn("action", F.lit("removed")))


def updated_parents(graph: Graph, eff: DataFrame) -> DataFrame:
    """(`ftype`, `id`) with `parents` after the changes: past ones without the removed, and the added."""
    diff = member_diff(graph, eff)
    past = assemble.relation_members(graph).select("id", "mtype", "ref").distinct()
    now = past.join(diff.where("action = 'removed'"), ["id", "mtype", "ref"], "left_anti").unionByName(diff.where("action = 'added'").select("id", "mtype", "ref"))
    return now.groupBy(F.col("mtype").alias("ftype"), F.col("ref").alias("id")).agg(F.array_sort(F.collect_set(F.col("id"))).alias("parents"))


def way_diff(graph: Graph, eff: DataFrame) -> DataFrame:
    """Changed ways that exist on both sides: `same_nodes`, and how many distinct nodes they gain and lose (null references are none)."""
    j = graph.ways("node_ids").join(eff.where("ftype = 'way' and not is_delete and existed").select("id", "refs"), "id")
    n = lambda a, b: F.size(F.array_except(F.array_compact(a), F.array_compact(b)))
    return j.select("id", F.col("node_ids").eqNullSafe(F.col("refs")).alias("same_nodes"), n("refs", "node_ids").alias("gained"), n("node_ids", "refs").alias("lost"))


def tag_diff(graph: Graph, eff: DataFrame) -> DataFrame:
    """Changed elements that exist on both sides, with `same_tags`."""
    out = None
    for ftype, rows in (("node", graph.nodes("tags")), ("way", graph.ways("tags")), ("relation", graph.relations("tags"))):
        j = rows.join(eff.where((F.col("ftype") == ftype) & ~F.col("is_delete") & F.col("existed")).select("id", F.col("tags").alias("_new")), "id")
        part = j.select(F.lit(ftype).alias("ftype"), "id", (T.sorted_tags(F.col("tags")) == T.sorted_tags(change_tags(F.col("_new")))).alias("same_tags"))
        out = part if out is None else out.unionByName(part)
    return out


def moved_nodes(graph: Graph, eff: DataFrame) -> DataFrame:
    """`id` of live nodes of which a change alters the place."""
    j = graph.nodes("x", "y").join(eff.where("ftype = 'node' and not is_delete").select("id", F.col("x").alias("_x"), F.col("y").alias("_y")), "id")
    return j.where("not (x <=> _x and y <=> _y)").select("id")


def implicit_way_changes(graph: Graph, eff: DataFrame) -> DataFrame:
    """`id` of ways that no change names and of which a node moves."""
    uses = graph.ways("node_ids").join(eff.where("ftype = 'way'").select("id"), "id", "left_anti").select("id", F.explode("node_ids").alias("ref"))
    return uses.join(moved_nodes(graph, eff).withColumnRenamed("id", "ref"), "ref", "left_semi").select("id").distinct()


def coincident_nodes(graph: Graph, eff: DataFrame) -> DataFrame:
    """`id` of nodes that no change names, at a place where a change puts another node."""
    to = eff.where("ftype = 'node' and not is_delete and x is not null and y is not null").select("x", "y").distinct()
    still = graph.located_nodes().join(eff.where("ftype = 'node'").select("id"), "id", "left_anti")
    return still.join(to, ["x", "y"], "left_semi").select("id")


def area_changes(graph: Graph, eff: DataFrame) -> DataFrame:
    """Ways and relations that are areas before or after the changes, not both, with `is_area` after."""
    before = assemble.area_flags(graph).withColumnRenamed("is_area", "_was")
    after = assemble.area_flags(future(graph, eff))
    return after.join(before, KEYS).where("_was <> is_area").select(*KEYS, "is_area")


def actions(graph: Graph, eff: DataFrame) -> DataFrame:
    """All that changes bring about, one row each: `ftype`, `id`, `action`, for elements changed themselves and those changed by others."""
    did = eff.select("ftype", "id", F.when(F.col("is_delete"), "deleted").when(F.col("existed"), "modified").otherwise("created").alias("action"))
    diff = member_diff(graph, eff)
    members = diff.select(F.col("mtype").alias("ftype"), F.col("ref").alias("id"), F.concat(F.lit("member_"), F.col("action")).alias("action")).distinct()
    before = graph.ways("node_ids").join(eff.where("ftype = 'way'").select("id"), "id", "left_semi").select(F.explode("node_ids").alias("id")).where("id is not null").distinct()
    after = eff.where("ftype = 'way' and not is_delete").select(F.explode("refs").alias("id")).where("id is not null").distinct()
    others = graph.ways("node_ids").join(eff.where("ftype = 'way'").select("id"), "id", "left_anti").select(F.explode("node_ids").alias("id")).distinct()
    node = lambda df, action: df.select(F.lit("node").alias("ftype"), "id", F.lit(action).alias("action"))
    becomes = after.join(before, "id", "left_anti").join(others, "id", "left_anti")
    leaves = before.join(after, "id", "left_anti").join(others, "id", "left_anti")
    implicit = implicit_way_changes(graph, eff).select(F.lit("way").alias("ftype"), "id", F.lit("moved").alias("action"))
    return did.unionByName(members).unionByName(node(becomes, "becomes_waynode")).unionByName(node(leaves, "leaves_ways")).unionByName(node(coincident_nodes(graph, eff), "coincident")).unionByName(implicit)
