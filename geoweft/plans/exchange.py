"""Queries on files written and read back, on stores and bundles, and on geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import mercator, text
from geoweft.functions import tags as T
from geoweft.model import Graph, member_type
from geoweft.operators import area, changeset
from geoweft.plans.engine import BOX, DENSITY, POLYGON
from geoweft.plans.oracles import ORACLE as ENGINE
from geoweft.plans.oracles import _HITS, _X0, _X1, _Y0, _Y1, BASE, _polygon_sql, area_sql, tile_sizes_ctes
from geoweft.plans.outputs import _degrees, _shaped, _store
from geoweft.plans.problems import ORACLE as PROBLEMS
from geoweft.plans.updates import _CH
from geoweft.session import scratch_path, table
from geoweft.sinks import formats, osm
from geoweft.sources import osc, pbf
from geoweft.store import Store
from geoweft.streaming import changes as stream


def _refs(column: str) -> Column:
    return F.coalesce(F.array_join(F.transform(column, lambda r: r.cast("string")), ","), F.lit("")).alias("refs_text")


def _members(column: str) -> Column:
    one = lambda m: F.concat_ws(" ", member_type(m["type"]), m["ref"].cast("string"), F.coalesce(m["role"], F.lit("")))
    return F.coalesce(F.array_join(F.transform(column, one), ","), F.lit("")).alias("members_text")


def pbf_elements(spark: SparkSession, folder: str) -> DataFrame:
    """All elements with what of them resolves, written to a PBF file and read back."""
    g = Graph.load(spark, folder)
    every = g.located_nodes().select(F.lit("node").alias("ftype"), "id")
    for t in ("way", "relation"):
        every = every.unionByName(g.ids(t).select(F.lit(t).alias("ftype"), "id"))
    path = scratch_path(spark, "elements") + ".osm.pbf"
    from geoweft.session import filesystem

    fs, where = filesystem(spark, path)
    fs.mkdirs(where.getParent())
    osm.write_pbf(osm.export_rows(g, every), path)
    return pbf.read_pbf(spark, path).select("ftype", "id", _refs("node_ids"), _members("members"), T.tags_text(F.col("tags")).alias("tags_text"))


def change_archive(spark: SparkSession, folder: str) -> DataFrame:
    """All changes, written to change files and read back, with their order as a number from 0."""
    path = scratch_path(spark, "archive")
    osm.write_changes(table(spark, folder, "changes"), path)
    back = osc.read_changes(spark, path)
    tags = F.array_join(F.transform("tags", lambda t: F.concat(t["k"], F.lit("="), t["v"])), ",").alias("tags_text")
    return back.select("ftype", "id", "version", "is_deleted", F.when(F.col("ftype") == "node", F.col("x")).alias("x"), F.when(F.col("ftype") == "way", _refs("refs")).otherwise("").alias("refs_text"), F.when(F.col("ftype") == "relation", _members("members")).otherwise("").alias("members_text"), tags)


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The changes as a stream into the bucketed table of all elements: the state that all of them at once leave."""
    base = changeset.base_versions(Graph.load(spark, folder)).withColumn("seq", F.lit(None).cast("long"))
    state = stream.state_table(spark, base, scratch_path(spark, "state"))
    stream.follow(spark, f"{folder}/changes.parquet*", state, scratch_path(spark, "progress")).awaitTermination()
    return state.read().select("ftype", "id", "version", F.when(F.col("is_deleted"), "deleted").otherwise("live").alias("outcome"), "seq")


def change_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Changes with the texts that outputs make of them: escapes, coordinates, paths of sequences, addresses, ages."""
    c = table(spark, folder, "changes")
    tag = F.try_element_at(F.filter("tags", lambda t: t["v"].isNotNull()), F.lit(1))["v"]
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    url = text.feature_url(F.col("ftype"), F.col("id"))
    return c.select(
        "seq", text.xml_escape(tag).alias("xml"), text.json_text(tag).alias("json"), text.csv_escape(tag).alias("csv"), text.degrees_fixed(F.col("lat")).alias("lat_text"), text.revision_path(F.col("seq")).alias("path"),
        url.alias("url"), text.url_parts(url)["host"].alias("host"), text.template("{ftype}:{none}{id}", F.create_map().cast("map<string,string>"), {"ftype": F.col("ftype"), "id": F.col("id")}).alias("label"), text.time_ago(F.col("ts"), now).alias("age"),
    ).distinct()


def mercator_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Current nodes projected from their degrees, and their tile of zoom 12."""
    n = Graph.load(spark, folder).nodes("lon", "lat").where("lon is not null and lat is not null").select("id", mercator.project_x(F.col("lon")).alias("px"), mercator.project_y(F.col("lat")).alias("py"))
    return n.select("id", "px", "py", mercator.tile_column(F.col("px"), 12).alias("col"), mercator.tile_row(F.col("py"), 12).alias("row"))


def wkt_lines(spark: SparkSession, folder: str) -> DataFrame:
    return formats.lines(_shaped(spark, folder, "w[highway]"), "wkt", precision=5)


def geojson_points(spark: SparkSession, folder: str) -> DataFrame:
    return formats.lines(_shaped(spark, folder, "n[amenity]"), "geojsonl", ["amenity"], precision=5)


def store_features(spark: SparkSession, folder: str) -> DataFrame:
    """All features of a store with their bounds and tile."""
    return _store(spark, folder).features().select("ftype", "id", "is_area", "tile", "minx", "miny", "maxx", "maxy")


def bundle_features(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles that a box needs, saved as a bundle, loaded into a new store, and all features there."""
    whole, box = _store(spark, folder), area.parse_box(BOX)
    bundle, other = scratch_path(spark, "bundle"), Store(spark, scratch_path(spark, "loaded"))
    whole.save(bundle, box)
    other.load(bundle)
    return other.features().select("ftype", "id", "tile")


QUERIES = {f.__name__: f for f in (pbf_elements, change_archive, change_stream, change_texts, mercator_forward, wkt_lines, geojson_points, store_features, bundle_features)}

_REFS = "coalesce(list_aggregate(list_transform({c}, lambda r: r::varchar), 'string_agg', ','), '')"
_TAGS = "coalesce(list_aggregate(list_transform(list_sort(map_keys(tags)), lambda k: k || '=' || coalesce(tags[k], '')), 'string_agg', ','), '')"
_DELETE = "(coalesce(is_deleted, false) or coalesce(lower(trim(op, ' ')) = 'delete', false))"
_KIND = "case lower(m.type[1]) when 'n' then 'node' when 'w' then 'way' when 'r' then 'relation' end"
#: Links of cycles that lose one (each component is free of cycles then), the links left, and levels on them.
CUT = f""", rc2 as (select src as a, dst as b from links union select rc2.a, l.dst from rc2 join links l on l.src = rc2.b),
scc as (select f.a as id, min(f.b) as root from rc2 f join rc2 g on g.a = f.b and g.b = f.a group by f.a),
scr as ({ENGINE["relation_scores"].removeprefix(BASE)}),
lost as (select p.root, arg_min({{'s': l.src, 'd': l.dst}}, {{'score': scr.score, 's': l.src, 'd': l.dst}}) as e from links l join scc p on p.id = l.src join scc q on q.id = l.dst and q.root = p.root join scr on scr.id = l.src group by p.root),
acy as (select src, dst from links where not exists (select 1 from lost where lost.e.s = links.src and lost.e.d = links.dst)),
lev as (select id, 0 as level from r union select acy.src, lev.level + 1 from lev join acy on acy.dst = lev.id),
levels as (select id, max(level)::int as level from lev group by id)
"""
#: Bounds of features but relations of too high a level, and the deepest kept tile that covers them.
PLACED = tile_sizes_ctes() + CUT + f""", loc as (select 'node' as t, id, x as minx, y as miny, x as maxx, y as maxy from nl union all select 'way', id, minx, miny, maxx, maxy from st where status = 'ok'),
dbd as (select mem.id, minx, miny, maxx, maxy from mem join loc on loc.t = mem.mtype and loc.id = mem.ref),
rch as (select src as a, dst as b from links union select rch.a, l.dst from rch join links l on l.src = rch.b),
evr as (select id, minx, miny, maxx, maxy from dbd union all select rch.a, minx, miny, maxx, maxy from rch join dbd on dbd.id = rch.b),
rbd as (select id, min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy from evr group by id),
bds as (select * from loc union all select 'relation', id, minx, miny, maxx, maxy from rbd),
fb as (select f.ftype, f.id, f.is_area, f.tags, b.minx::bigint as minx, b.miny::bigint as miny, b.maxx::bigint as maxx, b.maxy::bigint as maxy from f join bds b on b.t = f.ftype and b.id = f.id
  where not (f.ftype = 'relation' and f.id in (select id from levels where level > 9))),
inn as (select fb.ftype, fb.id, max({{'z': k.zoom, 'c': k.col, 'r': k.row}}) as t from fb, sizes k where k.col = ((minx + 2147483648) >> (32 - k.zoom)) and k.col = ((maxx + 2147483648) >> (32 - k.zoom))
  and k.row = ((2147483647 - maxy) >> (32 - k.zoom)) and k.row = ((2147483647 - miny) >> (32 - k.zoom)) group by fb.ftype, fb.id),
placed as (select fb.*, inn.t.z as z, inn.t.c as c, inn.t.r as r, inn.t.z || '/' || inn.t.c || '/' || inn.t.r as tile from fb join inn on inn.ftype = fb.ftype and inn.id = fb.id)
"""


def _hilbert_sql(bits: int = 16) -> str:
    """The curve's position of each node, a common table expression per bit."""
    steps = [f", h0 as (select id, tile, (x::bigint + 2147483648) >> {32 - bits} as hx, (y::bigint + 2147483648) >> {32 - bits} as hy, 0::bigint as d from nl)"]
    for i in range(bits):
        s, top = 1 << (bits - 1 - i), (1 << bits) - 1
        rx, ry = f"((hx & {s}) > 0)::bigint", f"((hy & {s}) > 0)::bigint"
        turned = f"case when {ry} = 0 and {rx} = 1 then {top} - {{0}} else {{0}} end"
        steps.append(f", h{i + 1} as (select id, tile, case when {ry} = 0 then {turned.format('hy')} else hx end as hx, case when {ry} = 0 then {turned.format('hx')} else hy end as hy, d + {s * s} * xor(3 * {rx}, {ry}) as d from h{i})")
    return "".join(steps)


def _polygon_ways_sql() -> str:
    """Corners inside, edges that meet, or a corner of the polygon inside a way's area; products are 128 bits wide."""
    units = area.ring_units(area.parse_rings(POLYGON))
    ring = units[0].tolist()
    turn = lambda o, s, t: f"sign(({s[0]}::hugeint - ({o[0]})) * ({t[1]}::hugeint - ({o[1]})) - ({s[1]}::hugeint - ({o[1]})) * ({t[0]}::hugeint - ({o[0]})))"
    a, b = ("ux", "uy"), ("vx", "vy")
    meets = " or ".join(
        f"(greatest(ux, vx) >= {min(p[0], q[0])} and least(ux, vx) <= {max(p[0], q[0])} and greatest(uy, vy) >= {min(p[1], q[1])} and least(uy, vy) <= {max(p[1], q[1])} "
        f"and {turn(p, q, a)} * {turn(p, q, b)} <= 0 and {turn(a, b, p)} * {turn(a, b, q)} <= 0)"
        for p, q in zip(ring[:-1], ring[1:])
    )
    cx, cy = ring[0]
    cross = f"(({cx} - ux::hugeint) * (vy::hugeint - uy) - ({cy} - uy::hugeint) * (vx::hugeint - ux))"
    edge = f"bool_or({cross} = 0 and {cx} between least(ux, vx) and greatest(ux, vx) and {cy} between least(uy, vy) and greatest(uy, vy))"
    odd = f"sum(({cy} >= least(uy, vy) and {cy} < greatest(uy, vy) and case when vy > uy then {cross} < 0 else {cross} > 0 end)::int) % 2 = 1"
    x0, y0, x1, y1 = area.ring_box(units)
    return (
        BASE
        + f""", okw as (select st.id, st.closed and {area_sql("area", "w.tags")} as is_area from st join w on w.id = st.id where status = 'ok' and minx <= {x1} and maxx >= {x0} and miny <= {y1} and maxy >= {y0}),
seg as (select wn.id, x as ux, y as uy, lead(x) over (partition by wn.id order by pos) as vx, lead(y) over (partition by wn.id order by pos) as vy from wn join okw on okw.id = wn.id),
hit as (select distinct wn.id from wn join okw on okw.id = wn.id where {_polygon_sql()} union select id from seg where vx is not null and ({meets})
  union select seg.id from seg join okw on okw.id = seg.id where is_area and vx is not null group by seg.id having {edge} or {odd})
select id from hit"""
    )


ORACLE = {
    "pbf_elements": BASE
    + f"""select 'node' as ftype, id, '' as refs_text, '' as members_text, {_TAGS} as tags_text from nl
union all select 'way', id, coalesce((select string_agg(wn.ref::varchar, ',' order by wn.pos) from wn where wn.id = w.id and wn.x is not null), ''), '', {_TAGS} from w
union all select 'relation', id, '', coalesce((select string_agg(k.mtype || ' ' || k.ref || ' ' || k.role, ',' order by k.pos) from
  (select rm.* from rm where rm.ref is not null and ((mtype = 'node' and ref in (select id from nl)) or (mtype = 'way' and ref in (select id from w)) or (mtype = 'relation' and ref in (select id from r)))) k where k.id = r.id), ''), {_TAGS} from r""",
    "change_archive": f"""
select ftype, id, version, {_DELETE} as is_deleted, case when ftype = 'node' and lon is not null then round(round(lon * 10000000)::int / 10000000 / 360.0 * 4294967296.0)::int end as x,
case when ftype = 'way' then {_REFS.format(c="list_filter(refs, lambda r: r is not null)")} else '' end as refs_text,
case when ftype = 'relation' then coalesce(list_aggregate(list_transform(list_filter(members, lambda m: m.ref is not null and {_KIND} is not null), lambda m: {_KIND} || ' ' || m.ref || ' ' || coalesce(m.role, '')), 'string_agg', ','), '') else '' end as members_text,
coalesce(list_aggregate(list_transform(list_filter(tags, lambda t: t.k is not null and t.v is not null), lambda t: t.k || '=' || t.v), 'string_agg', ','), '') as tags_text
from changes where ftype in ('node', 'way', 'relation') and id is not null""",
    "change_stream": PROBLEMS["p4_state"],
    "change_texts": """
with c as (select seq, ftype, id, lat, ts, list_filter(tags, lambda t: t.v is not null)[1].v as v from changes), s as (select *, epoch(timestamp '2030-01-01')::bigint - floor(epoch(ts))::bigint as ago from c)
select distinct seq, replace(replace(replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') as xml, coalesce(to_json(v)::varchar, 'null') as json,
case when regexp_matches(v, '[,"\r\n]') then '"' || replace(v, '"', '""') || '"' else coalesce(v, '') end as csv, printf('%.7f', lat) as lat_text,
printf('%03d/%03d/%03d', seq // 1000000, seq // 1000 % 1000, seq % 1000) as path, 'https://www.openstreetmap.org/' || coalesce(ftype, '') || '/' || coalesce(id::varchar, '') as url, 'www.openstreetmap.org' as host,
coalesce(ftype, '') || ':' || coalesce(id::varchar, '') as label,
case when ago < 60 then ago || case when ago = 1 then ' second ago' else ' seconds ago' end when ago < 3600 then ago // 60 || case when ago // 60 = 1 then ' minute ago' else ' minutes ago' end
when ago < 86400 then ago // 3600 || case when ago // 3600 = 1 then ' hour ago' else ' hours ago' end else ago // 86400 || case when ago // 86400 = 1 then ' day ago' else ' days ago' end end as age from s""",
    "mercator_forward": BASE
    + """, p as (select id, round(lon::double / 10000000 / 360.0 * 4294967296.0)::bigint as px,
least(greatest(round(ln(tan(pi() / 4 + radians(least(greatest(lat::double / 10000000, -85.05112878), 85.05112878)) / 2)) / (2 * pi()) * 4294967296.0), -2147483648.0), 2147483647.0)::bigint as py from n where lon is not null and lat is not null)
select id, px, py, ((px + 2147483648) >> 20)::int as col, ((2147483647 - py) >> 20)::int as row from p""",
    "wkt_lines": BASE
    + f"""select 'LINESTRING(' || string_agg({_degrees("x::double * 360.0 / 4294967296.0").replace("%.4f", "%.5f")} || ' ' || {_degrees("degrees(atan(sinh(y::double * (2 * pi()) / 4294967296.0)))").replace("%.4f", "%.5f")}, ',' order by pos) || ')' as line
from wn join f on f.id = wn.id and f.ftype = 'way' and not f.is_area and map_contains(f.tags, 'highway') group by wn.id""",
    "geojson_points": BASE
    + f"""select '{{"type":"Feature","id":"N' || id || '","geometry":{{"type":"Point","coordinates":[' || {_degrees("x::double * 360.0 / 4294967296.0").replace("%.4f", "%.5f")} || ',' || {_degrees("degrees(atan(sinh(y::double * (2 * pi()) / 4294967296.0)))").replace("%.4f", "%.5f")}
|| ']}},"properties":{{"amenity":' || coalesce(to_json(tags['amenity'])::varchar, 'null') || '}}}}' as line from nf where map_contains(tags, 'amenity')""",
    "store_features": PLACED + "select ftype, id, is_area, tile, minx, miny, maxx, maxy from placed",
    "store_query": PLACED + f"select ftype, id, tile from placed where (ftype = 'way' or is_area) and tags['building'] is not null and {_HITS}",
    "store_tiles": PLACED
    + """select zoom || '/' || col || '/' || row as tile, zoom, col, row, nodes, (select count(*) from placed p where p.z = zoom and p.c = col and p.r = row) as features, bytes from sizes""",
    "bundle_features": PLACED
    + f"""select ftype, id, tile from placed where (c::bigint << (32 - z)) - 2147483648 <= {_X1} and ((c + 1)::bigint << (32 - z)) - 2147483649 >= {_X0}
and 2147483647 - (r::bigint << (32 - z)) >= {_Y0} and 2147483648 - ((r + 1)::bigint << (32 - z)) <= {_Y1}""",
    "cycle_breaks": BASE + CUT + "select e.s as relation_id, e.d as member_id from lost",
    "super_levels": BASE + CUT + "select id, level, level > 9 as omitted from levels",
    "hilbert_pack": BASE
    + _hilbert_sql()
    + """select id, tile, d as hilbert, (d >> 20) || '-' || ((row_number() over (partition by tile, d >> 20 order by d, id) - 1) // 16) as leaf from h16""",
    "polygon_ways": _polygon_ways_sql(),
    "area_changes": _CH
    + f""", ekv as (select ftype, id, t.k as k, arg_max(t.v, pos) as v from (select ftype, id, unnest(tags) as t, unnest(range(len(tags))) as pos from eff where not del) where t.k is not null and t.v is not null group by ftype, id, t.k),
etm as (select ftype, id, map(list(k), list(v)) as tags from ekv group by ftype, id),
wt as (select id, tags from w where id not in (select id from eff where ftype = 'way') union all select e.id, m.tags from eff e left join etm m on m.ftype = 'way' and m.id = e.id where e.ftype = 'way' and not e.del),
wasw as (select 'way' as ftype, w.id, st.closed and {area_sql("area", "w.tags")} as is_area from w join st on st.id = w.id and st.status = 'ok'),
nowa as (select 'way' as ftype, wt.id, fws.closed and {area_sql("area", "wt.tags")} as is_area from wt join fws on fws.id = wt.id where n_missing = 0 and n_refs >= 2 and not (fws.closed and n_refs < 4)),
wasr as (select 'relation' as ftype, id, coalesce(len(list_filter(members, lambda m: m.role = 'outer')) > 0, false) and {area_sql("type")} as is_area from r),
rt as (select e.id, m.tags, len(list_filter(e.members, lambda m: m.role = 'outer' and not coalesce(lower(m.type[1]) = 'r' and m.ref = e.id, false))) > 0 as has_outer from eff e left join etm m on m.ftype = 'relation' and m.id = e.id where e.ftype = 'relation' and not e.del),
nowr as (select * from wasr where id not in (select id from eff where ftype = 'relation') union all select 'relation', id, coalesce(has_outer, false) and {area_sql("type")} from rt),
was as (select * from wasw union all select * from wasr), now as (select * from nowa union all select * from nowr)
select now.ftype, now.id, now.is_area from now join was on was.ftype = now.ftype and was.id = now.id where now.is_area <> was.is_area""",
}
