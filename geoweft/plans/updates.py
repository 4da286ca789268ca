"""Queries on changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import tags as T
from geoweft.model import Graph
from geoweft.operators import assemble, changeset
from geoweft.plans.oracles import BASE
from geoweft.session import materialize, table


def _both(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame]:
    graph = Graph.load(spark, folder)
    return graph, materialize(changeset.effective(graph, table(spark, folder, "changes")), "effective")


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    return changeset.latest(table(spark, folder, "changes")).select("ftype", "id", "version", "is_delete", "seq")


def late_changes(spark: SparkSession, folder: str) -> DataFrame:
    return changeset.late_changes(Graph.load(spark, folder), table(spark, folder, "changes"))


def member_diff(spark: SparkSession, folder: str) -> DataFrame:
    return changeset.member_diff(*_both(spark, folder)).select("id", "mtype", "ref", "action")


def updated_parents(spark: SparkSession, folder: str) -> DataFrame:
    return changeset.updated_parents(*_both(spark, folder)).select("ftype", "id", F.array_join(F.col("parents").cast("array<string>"), ",").alias("parent_ids"))


def way_diff(spark: SparkSession, folder: str) -> DataFrame:
    return changeset.way_diff(*_both(spark, folder))


def tag_diff(spark: SparkSession, folder: str) -> DataFrame:
    return changeset.tag_diff(*_both(spark, folder))


def implicit_way_change(spark: SparkSession, folder: str) -> DataFrame:
    return changeset.implicit_way_changes(*_both(spark, folder))


def coincident_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return changeset.coincident_nodes(*_both(spark, folder))


def change_actions(spark: SparkSession, folder: str) -> DataFrame:
    return changeset.actions(*_both(spark, folder)).groupBy("ftype", "action").agg(F.count("*").alias("elements"))


def area_changes(spark: SparkSession, folder: str) -> DataFrame:
    return changeset.area_changes(*_both(spark, folder))


def merge_apply(spark: SparkSession, folder: str) -> DataFrame:
    """All live elements after the changes, with their tags."""
    g = changeset.future(*_both(spark, folder))
    out = None
    for ftype, rows in (("node", g.nodes("tags")), ("way", g.ways("tags")), ("relation", g.relations("tags"))):
        part = rows.select(F.lit(ftype).alias("ftype"), "id", T.tags_text(F.col("tags")).alias("tags_text"))
        out = part if out is None else out.unionByName(part)
    return out


def merged_ways(spark: SparkSession, folder: str) -> DataFrame:
    """Ways after the changes, as assembled from nodes after the changes."""
    return assemble.way_status(changeset.future(*_both(spark, folder))).select("id", "n_refs", "n_missing", "closed", "status", "minx", "miny", "maxx", "maxy")


QUERIES = {
    "latest_version": latest_version,
    "late_changes": late_changes,
    "member_diff": member_diff,
    "updated_parents": updated_parents,
    "way_diff": way_diff,
    "tag_diff": tag_diff,
    "implicit_way_change": implicit_way_change,
    "coincident_nodes": coincident_nodes,
    "change_actions": change_actions,
    "area_changes": area_changes,
    "merge_apply": merge_apply,
    "merged_ways": merged_ways,
}

_ALL = " union all ".join(f"select * exclude (rn) from (select '{f}' as ftype, id, version, coalesce(is_deleted, false) as del, row_number() over (partition by id order by version desc) as rn from {t}) where rn = 1" for f, t in (("node", "nodes"), ("way", "ways"), ("relation", "relations")))
_CH = BASE + f""", ch as (select *, coalesce(is_deleted, false) or coalesce(lower(trim(op, ' ')) = 'delete', false)
  or (ftype = 'way' and coalesce(len(refs), 0) < 2) or (ftype = 'relation' and coalesce(len(members), 0) < 1) as del from changes),
dec as (select * exclude (rn) from (select *, row_number() over (partition by ftype, id order by version desc, del desc, seq) as rn from ch where version is not null) where rn = 1),
bv as ({_ALL}),
eff as (select d.*, coalesce(not b.del, false) as existed from dec d left join bv b on b.ftype = d.ftype and b.id = d.id where d.version + d.del::int > coalesce(b.version, 0)),
past as (select distinct id, mtype, ref from mem where id in (select id from eff where ftype = 'relation')),
ahead as (select distinct id, case lower(m.type[1]) when 'n' then 'node' when 'w' then 'way' when 'r' then 'relation' end as mtype, m.ref as ref
  from (select id, unnest(members) as m from eff where ftype = 'relation' and not del)),
after as (select * from ahead where mtype is not null and ref is not null and not (mtype = 'relation' and ref = id)),
diff as (select *, 'added' as action from (select * from after except select * from past) union all select *, 'removed' from (select * from past except select * from after)),
moved as (select n.id from n join eff e on e.ftype = 'node' and e.id = n.id and not e.del where n.x is distinct from e.x or n.y is distinct from e.y),
impl as (select distinct id from wn where id not in (select id from eff where ftype = 'way') and ref in (select id from moved)),
coin as (select distinct nl.id from nl join eff e on e.ftype = 'node' and not e.del and e.x = nl.x and e.y = nl.y where nl.id not in (select id from eff where ftype = 'node')),
etag as (select ftype, id, seq, string_agg(k || '=' || v, ',' order by k) as txt from
  (select ftype, id, seq, t.k as k, arg_max(t.v, pos) as v from (select ftype, id, seq, unnest(tags) as t, unnest(range(len(tags))) as pos from eff where not del) where t.k is not null and t.v is not null group by ftype, id, seq, t.k)
  group by ftype, id, seq),
alln as (select 'node' as ftype, id, tags from n union all select 'way', id, tags from w union all select 'relation', id, tags from r),
txt as (select ftype, id, coalesce(list_aggregate(list_transform(list_sort(map_keys(tags)), lambda k: k || '=' || coalesce(tags[k], '')), 'string_agg', ','), '') as txt from alln),
futn as (select id, x, y from nl where id not in (select id from eff where ftype = 'node') union all select id, x, y from eff where ftype = 'node' and not del and x is not null and y is not null),
futw as (select id, node_ids from w where id not in (select id from eff where ftype = 'way') union all select id, refs from eff where ftype = 'way' and not del),
fwn as (select e.id, e.pos, e.ref, futn.x, futn.y from (select id, unnest(range(len(node_ids))) as pos, unnest(node_ids) as ref from futw) e left join futn on futn.id = e.ref),
fws as (select futw.id, count(fwn.pos)::int as n_refs, (count(fwn.pos) - count(fwn.x))::int as n_missing,
  coalesce(count(fwn.pos) > 1 and arg_min(fwn.ref, fwn.pos) = arg_max(fwn.ref, fwn.pos), false) as closed,
  min(fwn.x) as minx, min(fwn.y) as miny, max(fwn.x) as maxx, max(fwn.y) as maxy from futw left join fwn on fwn.id = futw.id group by futw.id),
ew as (select unnest(node_ids) as ref from w where id in (select id from eff where ftype = 'way')),
ea as (select unnest(refs) as ref from eff where ftype = 'way' and not del),
eo as (select unnest(node_ids) as ref from w where id not in (select id from eff where ftype = 'way')),
acts as (select ftype, id, case when del then 'deleted' when existed then 'modified' else 'created' end as action from eff
  union all select distinct mtype, ref, 'member_' || action from diff
  union all (select 'node', ref, 'becomes_waynode' from ea where ref is not null except select 'node', ref, 'becomes_waynode' from ew except select 'node', ref, 'becomes_waynode' from eo)
  union all (select 'node', ref, 'leaves_ways' from ew where ref is not null except select 'node', ref, 'leaves_ways' from ea except select 'node', ref, 'leaves_ways' from eo)
  union all select 'node', id, 'coincident' from coin union all select 'way', id, 'moved' from impl)
"""
ORACLE = {
    "latest_version": _CH + "select ftype, id, version, del as is_delete, seq from dec",
    "late_changes": _CH
    + """select distinct c.ftype, c.id, c.seq, case when c.version is null then 'no version' when c.seq is distinct from d.seq then 'superseded' else 'late' end as reason
from ch c left join dec d on d.ftype = c.ftype and d.id = c.id left join eff e on e.ftype = c.ftype and e.id = c.id
where c.version is null or c.seq is distinct from d.seq or e.seq is null""",
    "member_diff": _CH + "select id, mtype, ref, action from diff",
    "updated_parents": _CH
    + """select mtype as ftype, ref as id, string_agg(id::varchar, ',' order by id) as parent_ids from
((select distinct id, mtype, ref from mem except select id, mtype, ref from diff where action = 'removed') union all select id, mtype, ref from diff where action = 'added') group by mtype, ref""",
    "way_diff": _CH
    + """select w.id, w.node_ids is not distinct from e.refs as same_nodes,
len(list_filter(list_distinct(e.refs), lambda x: not list_contains(w.node_ids, x)))::int as gained,
len(list_filter(list_distinct(w.node_ids), lambda x: not list_contains(e.refs, x)))::int as lost
from w join eff e on e.ftype = 'way' and e.id = w.id and not e.del and e.existed""",
    "tag_diff": _CH
    + """select e.ftype, e.id, coalesce(g.txt, '') = t.txt as same_tags from eff e join txt t on t.ftype = e.ftype and t.id = e.id
left join etag g on g.ftype = e.ftype and g.id = e.id where not e.del and e.existed""",
    "implicit_way_change": _CH + "select id from impl",
    "coincident_nodes": _CH + "select id from coin",
    "change_actions": _CH + "select ftype, action, count(*) as elements from acts group by ftype, action",
    "merge_apply": _CH
    + """select ftype, id, txt as tags_text from txt where not exists (select 1 from eff where eff.ftype = txt.ftype and eff.id = txt.id)
union all select e.ftype, e.id, coalesce(g.txt, '') from eff e left join etag g on g.ftype = e.ftype and g.id = e.id where not e.del""",
    "merged_ways": _CH
    + """select id, n_refs, n_missing, closed, case when n_missing > 0 then 'missing' when n_refs < 2 then 'short' when closed and n_refs < 4 then 'ring' else 'ok' end as status,
minx, miny, maxx, maxy from fws""",
}
