"""Queries p2 to p6: the data problems of the geographic tables, each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.model import Graph, member_type
from geoweft.operators import changeset, hierarchy, nearby, orphans, upsert, wide
from geoweft.operators.current import current_narrow, current_wide, flag
from geoweft.session import materialize, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Existing nodes within 200 units of a changed node, and the load areas that contain it."""
    changed = table(spark, folder, "changes").where((F.col("ftype") == "node") & ~changeset.stated_delete() & F.col("x").isNotNull() & F.col("y").isNotNull())
    points = changed.select("seq", "id", "x", "y").distinct()
    nodes = current_narrow(table(spark, folder, "nodes"), ["x", "y"]).where("not is_deleted")
    near = nearby.near_pairs(points, ["seq", "id"], nodes, ["id"], 200).where("not (p.id <=> s.id)").select(F.lit("near").alias("kind"), F.col("p.seq").alias("seq"), F.col("s.id").alias("other_id"))
    triangles = nearby.box_triangles(table(spark, folder, "load_areas"), "area_id", "bounds")
    inside = nearby.inside_pairs(points, "seq", triangles).select(F.lit("inside").alias("kind"), "seq", F.col("region").alias("other_id"))
    return near.unionByName(inside)


def _wide_state(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str], list[wide.WideColumn]]:
    """The wide table of `tag_rows`, delivered in a batch per year, through the log."""
    keys, columns = ["ftype", "id"], wide.wide_columns(table(spark, folder, "tag_columns"))
    rows = table(spark, folder, "tag_rows").withColumn("_year", F.coalesce(F.year(orphans.utc_date(F.unix_micros("ts"))), F.lit(0)))
    log = wide.WideLog(spark, keys, columns)
    log.append(rows, "k", "v", ["rev", "pos"], batch="_year")
    log.compact()
    return log.read(), keys, columns


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each cell of the wide table that is not null, in its type's text form."""
    return wide.wide_cells(*_wide_state(spark, folder))


def p3_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The wide table itself: one row per element that has a cell of any column, typed columns."""
    return wide.typed_wide(*_wide_state(spark, folder))


def _changes_applied(spark: SparkSession, folder: str) -> upsert.BucketedTable:
    base = changeset.base_versions(Graph.load(spark, folder)).withColumn("seq", F.lit(None).cast("long"))
    store = upsert.BucketedTable.create(base, changeset.KEYS, grouped=True)
    store.apply(changeset.latest(table(spark, folder, "changes")), upsert.merge_versions(changeset.KEYS))
    return store


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The elements of which a change takes effect, with the change that decides and the outcome."""
    state = _changes_applied(spark, folder).read()
    return state.where("seq is not null").select("ftype", "id", "seq", F.when(F.col("is_deleted"), "deleted").otherwise("live").alias("outcome"))


def p4_state(spark: SparkSession, folder: str) -> DataFrame:
    """Every element after the changes: version, live or deleted, and the change that decided it, if any."""
    state = _changes_applied(spark, folder).read()
    return state.select("ftype", "id", "version", F.when(F.col("is_deleted"), "deleted").otherwise("live").alias("outcome"), "seq")


def _parents(tables: dict[str, DataFrame]) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    order = F.coalesce(F.col("version"), F.lit(-(2**31)))
    # On a tie of versions a row that is not deleted wins; the greatest order is odd for it.
    best = F.max(order.cast("long") * 2 + F.when(flag("is_deleted"), 0).otherwise(1))
    every = None
    for ftype, rows in tables.items():
        part = rows.where("id is not null").select(F.lit(ftype).alias("ref_type"), F.col("id").alias("ref_id"), "version", "is_deleted", "ts")
        every = part if every is None else every.unionByName(part)
    found = every.groupBy("ref_type", "ref_id").agg((F.pmod(best, F.lit(2)) == 0).alias("is_deleted"), F.min(us).alias("first_us"))
    return found.select("ref_type", "ref_id", "is_deleted", "first_us", F.coalesce(orphans.month_number(F.col("first_us")), F.lit(orphans.UNKNOWN)).alias("first_period"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """References of current ways and relations to elements that are missing, deleted or written later."""
    tables = {ftype: table(spark, folder, name) for ftype, name in (("node", "nodes"), ("way", "ways"), ("relation", "relations"))}
    ways = current_wide(tables["way"], ["ts", "node_ids"]).where("not is_deleted")
    relations = current_wide(tables["relation"], ["ts", "members"]).where("not is_deleted")
    wide_refs = ways.select(F.lit("ways").alias("tbl"), F.col("id").alias("src_id"), "ts", F.lit("node").alias("ref_type"), F.explode(F.array_distinct("node_ids")).alias("ref_id"))
    members = F.array_distinct(F.transform("members", lambda m: F.struct(F.lower(F.substring(m["type"], 1, 1)).alias("t"), m["ref"].alias("ref"))))
    member_refs = relations.select("id", "ts", F.explode(members).alias("m")).select(F.lit("relations").alias("tbl"), F.col("id").alias("src_id"), "ts", member_type(F.col("m.t")).alias("ref_type"), F.col("m.ref").alias("ref_id"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    refs = wide_refs.unionByName(member_refs).select("tbl", "src_id", "ref_type", "ref_id", us.alias("ref_us"), F.coalesce(orphans.month_number(us), F.lit(orphans.UNKNOWN)).alias("period"))
    month = F.coalesce(F.date_format(orphans.utc_date(F.col("ref_us")), "yyyy-MM"), F.lit("unknown"))
    return orphans.orphan_references(refs, _parents(tables)).select("tbl", month.alias("ref_month"), "src_id", "ref_type", "ref_id", "reason")


def _relation_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links from current, live relations to their current, live relation members."""
    live = current_wide(table(spark, folder, "relations"), ["members"]).where("not is_deleted").select("id", F.explode_outer(F.filter("members", lambda m: F.lower(F.substring(m["type"], 1, 1)) == "r")).alias("m"))
    links = live.where("m.ref is not null").select("id", F.col("m.ref").alias("ref")).distinct()
    there = current_narrow(table(spark, folder, "relations"), []).where("not is_deleted").select(F.col("id").alias("ref"))
    return hierarchy.distinct_links(links.join(there, "ref", "left_semi"), "id", "ref")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every way down from each root of the relation hierarchies, and the relations on cycles."""
    links = materialize(_relation_links(spark, folder), "links")
    cycles = hierarchy.cycle_members(links)
    paths = hierarchy.root_paths(links, cycles)
    tree = paths.select(F.lit("tree").alias("kind"), "root_id", F.col("id").alias("rel_id"), (F.size("path") - 1).alias("steps_down"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path_ids"))
    cycle = cycles.select(F.lit("cycle").alias("kind"), "root_id", F.col("id").alias("rel_id"), F.lit(0).alias("steps_down"), F.lit("").alias("path_ids"))
    return tree.unionByName(cycle)


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_wide": p3_wide, "p4_found": p4_found, "p4_state": p4_state, "p5_found": p5_found, "p6_found": p6_found}

_CUR = """select * exclude (rn) from (select *, row_number() over (partition by id order by version desc) as rn from {t}) where rn = 1"""
_CELLS = """
with spec as (select k as attr, col_name, col_type from tag_columns),
ranked as (select r.ftype, r.id, s.col_name, s.col_type, trim(r.v, ' ') as v,
  row_number() over (partition by r.ftype, r.id, s.col_name order by r.rev desc, r.pos desc) as rn
  from tag_rows r join spec s on lower(trim(r.k, ' ')) = s.attr),
cells as (select ftype, id, col_name, case col_type
  when 'integer' then case when regexp_full_match(v, '[+-]?[0-9]+') then cast(try_cast(v as bigint) as varchar) end
  when 'decimal' then case when regexp_full_match(v, '[+-]?[0-9]+([.][0-9]{1,2})?') then cast(try_cast(v as decimal(38, 2)) as varchar) end
  when 'boolean' then case when lower(v) in ('yes', 'true', '1') then 'true' when lower(v) in ('no', 'false', '0') then 'false' end
  when 'date' then case when regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then cast(try_cast(v as date) as varchar) end
  when 'text' then case when v <> '' then v end end as cell
  from ranked where rn = 1)
"""
_BASE = "select '{f}' as ftype, id, version, coalesce(is_deleted, false) as del from ({c})"
_STATE = (
    "with base as ("
    + " union all ".join(_BASE.format(f=f, c=_CUR.format(t=t)) for f, t in (("node", "nodes"), ("way", "ways"), ("relation", "relations")))
    + """),
ch as (select ftype, id, version, seq, coalesce(is_deleted, false) or coalesce(lower(trim(op, ' ')) = 'delete', false)
  or (ftype = 'way' and coalesce(len(refs), 0) < 2) or (ftype = 'relation' and coalesce(len(members), 0) < 1) as del
  from changes where version is not null),
dec as (select * from (select *, row_number() over (partition by ftype, id order by version desc, del desc, seq) as rn from ch) where rn = 1),
st as (select coalesce(b.ftype, d.ftype) as ftype, coalesce(b.id, d.id) as id, b.version as bv, b.del as bd, d.version as dv, d.del as dd, d.seq,
  coalesce(d.version + d.del::int > coalesce(b.version, 0), false) as eff from base b full outer join dec d on b.ftype = d.ftype and b.id = d.id)
"""
)
# Columns and SQL types of the wide table, as the specification table lists them.
_WIDE = {
    "lanes": "bigint", "maxspeed": "bigint", "layer": "bigint", "population": "bigint", "building_levels": "bigint", "height": "decimal(38, 2)", "width": "decimal(38, 2)", "ele": "decimal(38, 2)",
    "oneway": "boolean", "lit": "boolean", "bridge": "boolean", "start_date": "date", "check_date": "date", "name_text": "varchar", "ref_text": "varchar", "surface": "varchar",
}
ORACLE = {
    "p3_wide": _CELLS + "select ftype, id, " + ", ".join(f"max(case when col_name = '{c}' then cell end)::{t} as {c}" for c, t in _WIDE.items()) + " from cells group by ftype, id",
    "p2_found": f"""
with pts as (select distinct seq, id, x::bigint as x, y::bigint as y from changes where ftype = 'node' and not coalesce(is_deleted, false)
  and coalesce(lower(trim(op, ' ')), '') <> 'delete' and x is not null and y is not null),
cur as (select id, x::bigint as x, y::bigint as y from ({_CUR.format(t="nodes")}) where not coalesce(is_deleted, false) and x is not null and y is not null),
shifted as (select id, x + w as x, y from cur, (values (0), (4294967296), (-4294967296)) t(w))
select 'near' as kind, p.seq, n.id as other_id from pts p join shifted n on n.y between p.y - 200 and p.y + 200 and n.x between p.x - 200 and p.x + 200
where (n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y) <= 40000 and n.id is distinct from p.id
union all
select 'inside' as kind, p.seq, a.area_id as other_id from pts p join load_areas a on p.y between a.bounds.miny and a.bounds.maxy
where case when a.bounds.minx <= a.bounds.maxx then p.x between a.bounds.minx and a.bounds.maxx else p.x >= a.bounds.minx or p.x <= a.bounds.maxx end""",
    "p3_found": _CELLS + "select ftype, id, col_name, cell from cells where cell is not null",
    "p4_found": _STATE + "select ftype, id, seq, case when dd then 'deleted' else 'live' end as outcome from st where eff",
    "p4_state": _STATE
    + """select ftype, id, case when eff then dv else bv end as version, case when case when eff then dd else bd end then 'deleted' else 'live' end as outcome,
case when eff then seq end as seq from st where eff or bv is not null""",
    "p5_found": f"""
with el as (select 'node' as t, id, version, is_deleted, epoch_us(ts) as us from nodes union all select 'way', id, version, is_deleted, epoch_us(ts) from ways
  union all select 'relation', id, version, is_deleted, epoch_us(ts) from relations),
par as (select t, id, min(us) as first_us, arg_max(coalesce(is_deleted, false), version) as del from el group by t, id),
refs as (
  select 'ways' as tbl, id as src_id, epoch_us(ts) as us, 'node' as t, unnest(node_ids) as ref from ({_CUR.format(t="ways")}) where not coalesce(is_deleted, false)
  union all
  select 'relations', id, us, case lower(m.type[1]) when 'n' then 'node' when 'w' then 'way' when 'r' then 'relation' end, m.ref
  from (select id, epoch_us(ts) as us, unnest(members) as m from ({_CUR.format(t="relations")}) where not coalesce(is_deleted, false))),
d as (select distinct * from refs where ref is not null and t is not null),
j as (select d.*, case when p.id is null then 'missing' when p.del then 'deleted' when p.first_us > d.us then 'late' end as reason
  from d left join par p on p.t = d.t and p.id = d.ref)
select tbl, coalesce(strftime(make_timestamp(us), '%Y-%m'), 'unknown') as ref_month, src_id, t as ref_type, ref as ref_id, reason from j where reason is not null""",
    "p6_found": f"""
with recursive live as (select id, members from ({_CUR.format(t="relations")}) where not coalesce(is_deleted, false)),
links as (select distinct l.id as src, l.m.ref as dst from (select id, unnest(members) as m from live) l
  where lower(l.m.type[1]) = 'r' and l.m.ref in (select id from live)),
walk as (select src as root_id, src as id, [src] as path from (select distinct src from links) where src not in (select dst from links)
  union all select w.root_id, l.dst, list_append(w.path, l.dst) from walk w join links l on l.src = w.id where not list_contains(w.path, l.dst)),
reach as (select src as a, dst as b from links union select r.a, l.dst from reach r join links l on l.src = r.b)
select 'tree' as kind, root_id, id as rel_id, (len(path) - 1)::int as steps_down, array_to_string(path, '/') as path_ids from walk
union all
select 'cycle', min(f.b), f.a, 0, '' from reach f join reach g on g.a = f.b and g.b = f.a group by f.a""",
}
