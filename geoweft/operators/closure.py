"""Export closure: features with the elements they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.functions import tags as T
from geoweft.model import Graph
from geoweft.operators import assemble, hierarchy
from geoweft.session import materialize

#: Types of relations that are completed unless others are named.
COMPLETE = ("multipolygon",)


def complete_types(text: str) -> tuple[str, ...] | None:
    """`all` (None), `none`, or a list of values of the tag `type`, separated by commas."""
    if text == "all":
        return None
    return () if text == "none" else tuple(t.strip() for t in text.split(",") if t.strip())


def closure(graph: Graph, hits: DataFrame, complete: tuple[str, ...] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(`ftype`, `id`) of `hits` and of all elements below them, each once, with `hit`: whether it was asked for.

    Relations of the types in `complete` (None: all) bring their members, relations among them theirs in turn; ways bring their nodes.
    Members of other relations come only if they are among `allowed` (ftype, id: those in the area asked for, say); None lets none through.
    """
    members = assemble.resolved_members(graph).where("found")
    upper, hits = above_nodes(hits, members, graph.relations("tags"), complete, allowed)
    nodes = graph.ways("node_ids").join(upper.where("ftype = 'way'").select("id"), "id", "left_semi").select(F.lit("node").alias("ftype"), F.explode("node_ids").alias("id"))
    nodes = nodes.join(graph.located_nodes().select("id"), "id", "left_semi").select("ftype", "id")
    every = upper.unionByName(nodes).distinct()
    return every.join(hits.withColumn("hit", F.lit(True)), ["ftype", "id"], "left").select("ftype", "id", F.coalesce("hit", F.lit(False)).alias("hit"))


def above_nodes(hits: DataFrame, members: DataFrame, relations: DataFrame, complete: tuple[str, ...] | None, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The closure without the nodes of ways, and the distinct hits; from found members (id, mtype, ref) and relations (id, tags)."""
    hits = materialize(hits.select("ftype", "id").distinct(), "hits")
    if complete is not None:
        whole = relations.select("id", F.coalesce(T.tag(F.col("tags"), "type").isin(*complete) if complete else F.lit(False), F.lit(False)).alias("_whole"))
        members = members.join(whole, "id")
        if allowed is None:
            members = members.where("_whole")
        else:
            near = allowed.select(F.col("ftype").alias("mtype"), F.col("id").alias("ref"), F.lit(True).alias("_near")).distinct()
            members = members.join(near, ["mtype", "ref"], "left").where("_whole or _near")
    members = materialize(members.select("id", "mtype", "ref").distinct(), "members")
    start = relations.select("id").join(hits.where("ftype = 'relation'").select("id", F.lit(0).alias("_l")), "id", "left").select("id", F.coalesce("_l", F.lit(1)).alias("label"))
    links = members.where("mtype = 'relation'").select(F.col("id").alias("src"), F.col("ref").alias("dst"))
    reached = hierarchy.propagate_min(materialize(links, "links"), start).where("label = 0").select("id")
    below = members.join(reached, "id", "left_semi").where("mtype <> 'relation'").select(F.col("mtype").alias("ftype"), F.col("ref").alias("id"))
    upper = hits.unionByName(below).unionByName(reached.select(F.lit("relation").alias("ftype"), "id")).distinct()
    return materialize(upper, "closure"), hits
