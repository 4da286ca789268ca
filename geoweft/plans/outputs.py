"""Queries on outputs: export closure, formats, bounds and the store, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoweft.functions import tags as T
from geoweft.model import Graph
from geoweft.operators import area, assemble, changeset, closure, geometry, relations, tiling
from geoweft.operators.features import features, selected
from geoweft.plans.engine import BOX, DENSITY, LEVELS
from geoweft.plans.oracles import _HITS, _ROLL, BASE
from geoweft.plans.updates import _CH, _both
from geoweft.session import filesystem, materialize, table
from geoweft.sinks import formats, osm
from geoweft.store import BuildOptions, Store, rebuild


def _shaped(spark: SparkSession, folder: str, query: str) -> DataFrame:
    g = Graph.load(spark, folder)
    return selected(g, query).join(geometry.geometries(g), ["ftype", "id"])


def csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    return formats.lines(_shaped(spark, folder, "n[highway]"), "csv", ["id", "lon", "lat", "highway", "note"], precision=4)


def brief_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return formats.lines(selected(Graph.load(spark, folder), "w[amenity]"), "brief")


def count_matches(spark: SparkSession, folder: str) -> DataFrame:
    return formats.lines(selected(Graph.load(spark, folder), "na[natural]"), "count")


def geojsonl(spark: SparkSession, folder: str) -> DataFrame:
    return formats.lines(_shaped(spark, folder, "*"), "geojsonl")


def wkt(spark: SparkSession, folder: str) -> DataFrame:
    return formats.lines(_shaped(spark, folder, "war"), "wkt")


def _closure(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame]:
    g = Graph.load(spark, folder)
    return g, closure.closure(g, selected(g, "r[amenity]"))


def export_closure(spark: SparkSession, folder: str) -> DataFrame:
    return _closure(spark, folder)[1]


def xml_elements(spark: SparkSession, folder: str) -> DataFrame:
    return osm.export_rows(*_closure(spark, folder)).orderBy("code", "id").select(osm.xml_element().alias("line"))


def result_bounds(spark: SparkSession, folder: str) -> DataFrame:
    f = assemble.way_status(Graph.load(spark, folder)).where("status = 'ok'").where(area.meets_box(area.box_units(area.parse_box(BOX))))
    return f.agg(F.count("*").alias("features"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def way_tile_changes(spark: SparkSession, folder: str) -> DataFrame:
    """How often the tile of zoom 12 changes along each valid way."""
    from geoweft.functions import mercator

    g = Graph.load(spark, folder)
    at = F.concat_ws("/", mercator.tile_column(F.col("x"), 12).cast("string"), mercator.tile_row(F.col("y"), 12).cast("string"))
    before = F.lag("t").over(Window.partitionBy("id").orderBy("pos"))
    placed = assemble.way_nodes(g).where("x is not null").select("id", "pos", at.alias("t")).withColumn("b", before)
    return placed.groupBy("id").agg(F.sum(F.when(F.col("b").isNotNull() & (F.col("b") != F.col("t")), 1).otherwise(0)).alias("tile_changes"))


def bounds_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Relations of which the bounds change with the changes, with those after; null where nothing is left."""
    g, eff = _both(spark, folder)
    before = relations.relation_bounds(g).select("id", F.struct("minx", "miny", "maxx", "maxy").alias("b"))
    after = relations.relation_bounds(changeset.future(g, eff)).select("id", F.struct("minx", "miny", "maxx", "maxy").alias("a"))
    return before.join(after, "id", "full_outer").where("not (a <=> b)").select("id", "a.minx", "a.miny", "a.maxx", "a.maxy")


def tiles_in_box(spark: SparkSession, folder: str) -> DataFrame:
    """Kept tiles that an area needs."""
    kept = tiling.kept_tiles(tiling.tile_rollup(tiling.cell_counts(Graph.load(spark, folder).located_nodes()), LEVELS), DENSITY, 65_535)
    extent = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - F.col("zoom"))
    x0, y1 = F.col("col").cast("long") * extent - 2**31, F.lit(2**31 - 1) - F.col("row").cast("long") * extent
    boxed = kept.withColumns({"minx": x0, "maxx": x0 + extent - 1, "maxy": y1, "miny": y1 - extent + 1})
    return boxed.where(area.meets_box(area.box_units(area.parse_box(BOX)))).select("zoom", "col", "row", "nodes")


def build_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Features by type, nodes used by ways, and members that resolve."""
    g = Graph.load(spark, folder)
    counts = features(g, bounds=False).groupBy(F.concat("ftype", F.lit("_features")).alias("what")).agg(F.count("*").alias("n"))
    used = assemble.node_roles(g).where("waynode").agg(F.count("*").alias("n")).select(F.lit("waynodes").alias("what"), "n")
    found = assemble.resolved_members(g).where("found").agg(F.count("*").alias("n")).select(F.lit("members").alias("what"), "n")
    return counts.unionByName(used).unionByName(found)


def tag_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct tag tables and how many elements share each."""
    g = Graph.load(spark, folder)
    every = g.nodes("tags").unionByName(g.ways("tags")).unionByName(g.relations("tags"))
    return every.groupBy(T.tags_text(F.col("tags")).alias("tags_text")).agg(F.count("*").alias("elements"))


def display_widths(spark: SparkSession, folder: str) -> DataFrame:
    """Longest key and value of all features, in characters."""
    f = features(Graph.load(spark, folder), bounds=False).select(F.explode("tags").alias("k", "v"))
    return f.agg(F.max(F.char_length("k")).alias("key_width"), F.max(F.char_length("v")).alias("value_width"))


def delta_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Node references of ways as differences and summed up again: both columns agree."""
    refs = Graph.load(spark, folder).ways("node_ids").select("id", F.posexplode("node_ids").alias("pos", "ref")).where("ref is not null")
    w = Window.partitionBy("id").orderBy("pos")
    coded = refs.withColumn("delta", F.col("ref") - F.coalesce(F.lag("ref").over(w), F.lit(0)))
    return coded.withColumn("decoded", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("id", "pos", "delta", "decoded")


_STORES: dict[tuple, Store] = {}


def _store(spark: SparkSession, folder: str) -> Store:
    """The store of a folder, built once per application and state of its files as one builds it once for all queries."""
    files = []
    for name in ("nodes", "ways", "relations"):
        fs, where = filesystem(spark, f"{folder}/{name}.parquet")
        found = fs.listStatus(where)
        files += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    key = (spark.sparkContext.applicationId, folder, *sorted(files))
    if key not in _STORES:
        _STORES[key] = rebuild(Graph.load(spark, folder), BuildOptions(min_tile_density=DENSITY, updatable=True))
    return _STORES[key]


def store_query(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).features("wa[building]", bbox=area.parse_box(BOX)).select("ftype", "id", "tile")


def store_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).tile_stats()


def contents_hash(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).contents_hash()


def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).violations()


def node_count_dump(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with nodes as lines of tile, tab, count."""
    c = tiling.cell_counts(Graph.load(spark, folder).located_nodes())
    return c.select(F.concat(tiling.tile_name(F.lit(tiling.CELL_ZOOM), F.col("col"), F.col("row")), F.lit("\t"), F.col("nodes").cast("string")).alias("line"))


def change_record(spark: SparkSession, folder: str) -> DataFrame:
    """Effective changes, as an update archive holds them."""
    eff = materialize(changeset.effective(Graph.load(spark, folder), table(spark, folder, "changes")), "effective")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).alias(f"n_{c}")
    return eff.select("ftype", "id", "version", "seq", "is_delete", "existed", "x", "y", size("refs"), size("members"), size("tags"))


QUERIES = {
    f.__name__: f
    for f in (csv_rows, brief_blocks, count_matches, geojsonl, wkt, export_closure, xml_elements, result_bounds, way_tile_changes, bounds_cascade, tiles_in_box, build_statistics, tag_tables, display_widths, delta_decode)
    + (store_query, store_tiles, contents_hash, check_violations, node_count_dump, change_record)
}

_X0, _Y0, _X1, _Y1 = area.box_units(area.parse_box(BOX))


def _degrees(e: str) -> str:
    text = f"regexp_replace(regexp_replace(printf('%.4f', {e}), '([.][0-9]*?)0+$', '\\1'), '[.]$', '')"
    return f"case when {text} = '-0' then '0' else {text} end"


_ESC = """case when regexp_matches({v}, '[,"\\r\\n]') then '"' || replace({v}, '"', '""') || '"' else coalesce({v}, '') end"""
_ALONG = """((x::bigint + 2147483648) >> 20) || '/' || ((2147483647 - y::bigint) >> 20)"""


def _reach_bounds(nodes: str, ways: str, members: str, rels: str, p: str) -> str:
    return f"""{p}loc as (select 'node' as t, id, x as minx, y as miny, x as maxx, y as maxy from {nodes} union all select 'way', id, minx, miny, maxx, maxy from {ways}),
{p}d as (select m.id, minx, miny, maxx, maxy from {members} m join {p}loc l on l.t = m.mtype and l.id = m.ref),
{p}lk as (select distinct m.id as src, m.ref as dst from {members} m where m.mtype = 'relation' and m.ref in (select id from {rels})),
{p}rc as (select src as a, dst as b from {p}lk union select r.a, l.dst from {p}rc r join {p}lk l on l.src = r.b),
{p}ev as (select id, minx, miny, maxx, maxy from {p}d union all select r.a, minx, miny, maxx, maxy from {p}rc r join {p}d on {p}d.id = r.b),
{p}bd as (select id, min(minx)::bigint as minx, min(miny)::bigint as miny, max(maxx)::bigint as maxx, max(maxy)::bigint as maxy from {p}ev group by id)"""


ORACLE = {
    "csv_rows": BASE
    + f"""select 'N' || nf.id || ',' || {_degrees("x::double * 360.0 / 4294967296.0")} || ',' || {_degrees("degrees(atan(sinh(y::double * (2 * pi()) / 4294967296.0)))")}
|| ',' || {_ESC.format(v="tags['highway']")} || ',' || {_ESC.format(v="tags['note']")} as line from nf where map_contains(tags, 'highway')""",
    "brief_blocks": BASE
    + """, e as (select id, map_entries(tags) as es, list_max(list_transform(map_keys(tags), lambda k: length(k))) as wd from f where ftype = 'way' and not is_area and map_contains(tags, 'amenity'))
select 'way/' || id || list_aggregate(list_transform(list_sort(es), lambda x: chr(10) || '  ' || rpad(x.key, wd::int, ' ') || ' = ' || coalesce(x.value, '')), 'string_agg', '') as line from e""",
    "count_matches": BASE + "select count(*)::varchar as line from f where (ftype = 'node' or is_area) and map_contains(tags, 'natural')",
    "export_closure": BASE
    + """, hits as (select id from f where ftype = 'relation' and not is_area and map_contains(tags, 'amenity')),
fm as (select distinct id, mtype, ref from res where found),
up as (select id from hits union select fm.ref from up join fm on fm.id = up.id and fm.mtype = 'relation'),
lo as (select distinct mtype as ftype, ref as id from fm where id in (select id from up) and mtype <> 'relation'),
nw as (select distinct 'node' as ftype, ref as id from wn where x is not null and id in (select id from lo where ftype = 'way')),
al as (select 'relation' as ftype, id from up union select ftype, id from lo union select ftype, id from nw)
select ftype, id, ftype = 'relation' and id in (select id from hits) as hit from al""",
    "result_bounds": BASE + f"select count(*) as features, min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy from st where status = 'ok' and {_HITS}",
    "way_tile_changes": BASE
    + f"""select id, sum((b is not null and b <> t)::int)::bigint as tile_changes from
(select id, t, lag(t) over (partition by id order by pos) as b from (select id, pos, {_ALONG} as t from wn where x is not null)) group by id""",
    "bounds_cascade": _CH
    + f""", okw as (select id, minx, miny, maxx, maxy from st where status = 'ok'),
okf as (select id, minx, miny, maxx, maxy from fws where n_missing = 0 and n_refs >= 2 and not (closed and n_refs < 4)),
futr as (select id from r where id not in (select id from eff where ftype = 'relation') union all select id from eff where ftype = 'relation' and not del),
futm as (select id, mtype, ref from mem where id not in (select id from eff where ftype = 'relation') union all select id, mtype, ref from after),
{_reach_bounds("nl", "okw", "mem", "r", "p")}, {_reach_bounds("futn", "okf", "futm", "futr", "q")}
select coalesce(a.id, b.id) as id, a.minx, a.miny, a.maxx, a.maxy from qbd a full outer join pbd b on a.id = b.id
where (a.minx, a.miny, a.maxx, a.maxy) is distinct from (b.minx, b.miny, b.maxx, b.maxy)""",
    "tiles_in_box": _ROLL
    + f"""select zoom, col, row, nodes from roll where (zoom = 0 or nodes >= {DENSITY})
and (col::bigint << (32 - zoom)) - 2147483648 <= {_X1} and ((col + 1)::bigint << (32 - zoom)) - 2147483649 >= {_X0}
and 2147483647 - (row::bigint << (32 - zoom)) >= {_Y0} and 2147483648 - ((row + 1)::bigint << (32 - zoom)) <= {_Y1}""",
    "build_statistics": BASE
    + """select ftype || '_features' as what, count(*) as n from f group by ftype union all select 'waynodes', count(*) from roles where waynode
union all select 'members', count(*) from res where found""",
    "tag_tables": BASE
    + """, every as (select tags from n union all select tags from w union all select tags from r)
select coalesce(list_aggregate(list_transform(list_sort(map_keys(tags)), lambda k: k || '=' || coalesce(tags[k], '')), 'string_agg', ','), '') as tags_text, count(*) as elements from every group by 1""",
    "display_widths": BASE + "select max(length(k))::int as key_width, max(length(v))::int as value_width from (select unnest(map_keys(tags)) as k, unnest(map_values(tags)) as v from f)",
    "delta_decode": BASE + "select id, pos::int as pos, ref - coalesce(lag(ref) over (partition by id order by pos), 0) as delta, ref as decoded from wn where ref is not null",
    "check_violations": "select 'node' as ftype, 0::bigint as id, '' as problem where false",
    "node_count_dump": _ROLL + "select '12/' || col || '/' || row || chr(9) || nodes as line from cells",
    "change_record": _CH
    + """select ftype, id, version, seq, del as is_delete, existed, x, y, coalesce(len(refs), 0)::int as n_refs, coalesce(len(members), 0)::int as n_members, coalesce(len(tags), 0)::int as n_tags from eff""",
}
