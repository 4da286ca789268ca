"""SQL for DuckDB of the queries in `engine`."""

from __future__ import annotations

from geoweft.functions import tags as T
from geoweft.operators import area, strings, tiling
from geoweft.plans.engine import BOX, DENSITY, LEVELS, POLYGON, TILES

_CUR = "select * exclude (rn) from (select *, row_number() over (partition by id order by version desc) as rn from {t}) where rn = 1 and not coalesce(is_deleted, false)"
_TYPE = "case lower({m}.type[1]) when 'n' then 'node' when 'w' then 'way' when 'r' then 'relation' end"


def _tag(key: str, tags: str = "tags") -> str:
    return f"{tags}['{key}']"


def area_sql(decisive: str, tags: str = "tags") -> str:
    """The default area rules as an SQL condition."""

    def hit(r: T.AreaRule) -> str:
        v, values = _tag(r.key, tags), ", ".join(f"'{x}'" for x in sorted(r.values))
        some = "true" if not r.values else f"{v} {'not ' if r.exclude else ''}in ({values})"
        return f"coalesce({v} <> 'no' and not regexp_full_match({v}, '-?(0|[1-9][0-9]*)([.][0-9]*[1-9])?') and {some}, false)"

    rules = T.parse_area_rules(T.AREA_RULES)
    own = next(r for r in rules if r.key == decisive)
    return f"case when {_tag(decisive, tags)} is not null then {hit(own)} else {' or '.join(map(hit, rules))} end"


#: Common table expressions: current elements, way positions and states, members, and features.
BASE = f"""
with recursive n as ({_CUR.format(t="nodes")}), w as ({_CUR.format(t="ways")}), r as ({_CUR.format(t="relations")}),
nl as (select * from n where x is not null and y is not null),
wn as (select e.id, e.pos, e.ref, nl.x, nl.y from (select id, unnest(range(len(node_ids))) as pos, unnest(node_ids) as ref from w) e left join nl on nl.id = e.ref),
ws as (select w.id, count(wn.pos)::int as n_refs, (count(wn.pos) - count(wn.x))::int as n_missing,
  coalesce(count(wn.pos) > 1 and arg_min(wn.ref, wn.pos) = arg_max(wn.ref, wn.pos), false) as closed,
  min(wn.x) as minx, min(wn.y) as miny, max(wn.x) as maxx, max(wn.y) as maxy from w left join wn on wn.id = w.id group by w.id),
st as (select *, case when n_missing > 0 then 'missing' when n_refs < 2 then 'short' when closed and n_refs < 4 then 'ring' else 'ok' end as status from ws),
rm as (select id, m.pos as pos, {_TYPE.format(m="m")} as mtype, m.ref as ref, coalesce(m.role, '') as role from (select id, unnest(members) as m from r)),
mem as (select * from rm where mtype is not null and ref is not null and not (mtype = 'relation' and ref = id)),
pl as (select 'node' as ftype, id from nl union all select 'way', id from st where status = 'ok'),
vr as (select mem.id from mem join pl on pl.ftype = mem.mtype and pl.id = mem.ref union select mem.id from vr join mem on mem.mtype = 'relation' and mem.ref = vr.id),
el as (select ftype, id from pl union all select 'relation', id from vr),
res as (select mem.*, el.id is not null as found from mem left join el on el.ftype = mem.mtype and el.id = mem.ref),
roles as (select id, x, y, tags, coalesce(cardinality(tags), 0) > 0 as tagged, id in (select unnest(node_ids) from w) as waynode,
  id in (select ref from mem where mtype = 'node') as member, count(*) over (partition by x, y) > 1 as shared from nl),
orole as (select *, not tagged and not coalesce(waynode, false) and not member as orphan from roles),
nf as (select id, x, y, map_from_entries(list_concat(coalesce(map_entries(tags), []),
  list_concat(case when not tagged and shared then [{{'key': '{T.DUPLICATE}', 'value': 'yes'}}] else [] end,
  case when orphan then [{{'key': '{T.ORPHAN}', 'value': 'yes'}}] else [] end))) as tags from orole where tagged or member or shared or orphan),
f as (select 'node' as ftype, id, false as is_area, tags from nf
  union all select 'way', w.id, st.closed and {area_sql("area", "w.tags")}, w.tags from w join st on st.id = w.id and st.status = 'ok'
  union all select 'relation', id, coalesce(len(list_filter(members, lambda m: m.role = 'outer')) > 0, false) and {area_sql("type")}, tags from r where id in (select id from vr)),
ft as (select *, coalesce(list_aggregate(list_transform(list_sort(map_keys(tags)), lambda k: k || '=' || coalesce(tags[k], '')), 'string_agg', ','), '') as tags_text from f),
links as (select distinct id as src, ref as dst from mem where mtype = 'relation' and ref in (select id from r))
"""
_SEL = BASE + "select ftype, id, tags_text from ft where "
_X0, _Y0, _X1, _Y1 = area.box_units(area.parse_box(BOX))
_HITS = f"minx <= {_X1} and maxx >= {_X0} and miny <= {_Y1} and maxy >= {_Y0}"


def _polygon_sql() -> str:
    """Even-odd with edges, over the corners of the polygon in projected units; products are 128 bits wide."""
    ring = area.ring_units(area.parse_rings(POLYGON))[0].tolist()
    cross = lambda a, b: f"((x::hugeint - ({a[0]})) * ({b[1]} - ({a[1]})) - (y::hugeint - ({a[1]})) * ({b[0]} - ({a[0]})))"
    edges = list(zip(ring[:-1], ring[1:]))
    on = " or ".join(f"({cross(a, b)} = 0 and x between {min(a[0], b[0])} and {max(a[0], b[0])} and y between {min(a[1], b[1])} and {max(a[1], b[1])})" for a, b in edges)
    odd = " + ".join(f"(y >= {min(a[1], b[1])} and y < {max(a[1], b[1])} and {cross(a, b)} {'<' if b[1] > a[1] else '>'} 0)::int" for a, b in edges)
    return f"(({on}) or ({odd}) % 2 = 1)"


_ROLL = BASE + f""", cells as (select ((x::bigint + 2147483648) >> 20)::int as col, ((2147483647 - y::bigint) >> 20)::int as row, count(*) as nodes from nl group by 1, 2),
lv as (select unnest({LEVELS}) as zoom),
roll as (select zoom::int as zoom, (col >> (12 - zoom))::int as col, (row >> (12 - zoom))::int as row, sum(nodes)::bigint as nodes from cells, lv group by 1, 2, 3)
"""
_USAGE = BASE + """, uses as (select unnest(map_keys(tags)) as str, 1 as k from n union all select unnest(map_values(tags)), 0 from n
  union all select unnest(map_keys(tags)), 1 from w union all select unnest(map_values(tags)), 0 from w
  union all select unnest(map_keys(tags)), 1 from r union all select unnest(map_values(tags)), 0 from r
  union all select coalesce(m.role, ''), 0 from (select unnest(members) as m from r)),
usage as (select str, sum(k)::bigint as key_count, sum(1 - k)::bigint as value_count, count(*) as total from uses where str is not null group by str)
"""
_KEYS = T.parse_indexed_keys(T.INDEXED_KEYS)
_REQUIRED = list(dict.fromkeys([*strings.CORE, *_KEYS]))
_CATS = "list_sort(list_distinct(list_filter(list_transform(map_keys(tags), lambda k: case k " + " ".join(f"when '{k}' then {c}" for k, c in _KEYS.items()) + " end), lambda c: c is not null)))"
_CATF = BASE + f""", cat as (select ftype, id, is_area, coalesce({_CATS}, []) as c from f),
cats as (select ftype, id, is_area, case len(c) when 0 then 0 when 1 then c[1] else -1 end as category, coalesce(list_sum(list_transform(c, lambda x: 1 << (x - 1))), 0)::int as index_bits from cat)
"""


def _string_table_sql(min_usage: int, max_strings: int) -> str:
    n = len(_REQUIRED)
    first = max(0, min(strings.MIXED, max_strings) - n)
    room = max(0, min(strings.KEYS, max_strings) - n - first)
    listed = ", ".join(f"('{s}', {i})" for i, s in enumerate(_REQUIRED, 1))
    return (
        _USAGE
        + f""", req(str, pos) as (values {listed}),
top as (select str, row_number() over (order by total desc, str) as pos from usage where total >= {min_usage} and str not in (select str from req)),
mixed as (select str, pos from top where pos <= {first}),
ks as (select * from (select str, row_number() over (order by key_count desc, str) as pos from usage where key_count >= {min_usage}
  and str not in (select str from req) and str not in (select str from mixed)) where pos <= {room}),
every as (select str, 0 as part, pos from req union all select str, 1, pos from mixed union all select str, 2, pos from ks
  union all select str, 3, pos from top where pos > {first} and str not in (select str from ks)),
coded as (select (row_number() over (order by part, pos) - 1)::int as code, str, ['required', 'mixed', 'keys', 'rest'][part + 1] as part from every)
select code, str, part from coded where code < {max_strings}"""
    )


def tile_sizes_ctes() -> str:
    """The sizes of tiles, a common table expression per level from the finest to the root, and `sizes` of those kept."""
    steps, levels = [], sorted(LEVELS)
    kept = f"(zoom = 0 or nodes >= {DENSITY})"
    for i, z in reversed(list(enumerate(levels))):
        if z == levels[-1]:
            steps.append(f"b{z} as (select *, {kept} as kept, nodes * {tiling.BYTES_PER_NODE} + {tiling.BYTES_PER_TILE} as bytes from roll where zoom = {z})")
            continue
        below, shift = f"b{levels[i + 1]}", levels[i + 1] - z
        steps.append(
            f"b{z} as (select r.*, {kept} as kept, {tiling.BYTES_PER_TILE} + coalesce(c.s, 0) as bytes from roll r left join (select col >> {shift} as pc, row >> {shift} as pr, "
            f"sum(bytes // {tiling.CHILD_SHARE} + case when kept then 0 else bytes end) as s from {below} group by 1, 2) c on c.pc = r.col and c.pr = r.row where r.zoom = {z})"
        )
    whole = " union all ".join(f" select zoom, col, row, nodes, bytes::bigint as bytes from b{z} where kept" for z in levels)
    return _ROLL + ", " + ", ".join(steps) + f", sizes as ({whole}) "


ORACLE = {
    "string_topk": _string_table_sql(3, 400),
    "tile_sizes": tile_sizes_ctes() + "select zoom, col, row, nodes, bytes from sizes",
    "count_by_type": BASE + "select ftype, is_area, count(*) as features from f group by ftype, is_area",
    "selector_key": _SEL + "ftype = 'way' and not is_area and tags['highway'] is not null",
    "selector_eq": _SEL + "(ftype = 'node' or is_area) and tags['amenity'] = 'tree'",
    "selector_prefix": _SEL + "starts_with(tags['power'], 's')",
    "selector_not": _SEL + "ftype = 'node' and map_contains(tags, 'amenity') and not map_contains(tags, 'note')",
    "selector_noteq": _SEL + "ftype <> 'node' and tags['building'] is not null and tags['building'] <> 'no'",
    "selector_any": _SEL + "(ftype = 'node' and tags['amenity'] in ('gate', 'tree')) or (ftype = 'relation' and not is_area and starts_with(tags['type'], 'm'))",
    "keys_projection": BASE
    + """select ftype, id, tags['note'] as note, 'building=' || tags['building'] || coalesce(',note=' || tags['note'], '') as tags_text
from f where (ftype = 'way' or is_area) and map_contains(tags, 'building')""",
    "list_ids": BASE
    + """select upper(ftype[1]) || id as line, (id << 2) | case ftype when 'node' then 0 when 'way' then 1 else 2 end as packed
from f where (ftype = 'node' or is_area) and map_contains(tags, 'amenity')""",
    "bbox_nodes": BASE + f"select id, x, y from nl where x between {_X0} and {_X1} and y between {_Y0} and {_Y1}",
    "bbox_ways": BASE + f"select id, minx, miny, maxx, maxy from st where status = 'ok' and {_HITS}",
    "polygon_nodes": BASE + f"select id from nl where {_polygon_sql()}",
    "way_assembly": BASE
    + """select st.id, st.closed, (case when st.closed then n_refs - 1 else n_refs end)::int as nodes,
string_agg(wn.x || ' ' || wn.y, ',' order by wn.pos) as coordinates
from st join wn on wn.id = st.id and (not st.closed or wn.pos < st.n_refs - 1) where status = 'ok' group by st.id, st.closed, st.n_refs""",
    "way_rejects": BASE + "select id, n_refs, n_missing, status from st where status <> 'ok'",
    "closed_rings": BASE + "select id, n_refs from st where status = 'ok' and closed",
    "way_bounds": BASE + "select id, minx, miny, maxx, maxy from st where status = 'ok'",
    "area_flag": BASE
    + f"""select 'way' as ftype, w.id, st.closed and {area_sql("area", "w.tags")} as is_area from w join st on st.id = w.id and st.status = 'ok'
union all select 'relation', id, coalesce(len(list_filter(members, lambda m: m.role = 'outer')) > 0, false) and {area_sql("type")} from r""",
    "relation_members": BASE + "select id, pos, mtype, ref, role, found from res",
    "missing_members": BASE + "select id, count(*) as members, sum((not found)::int)::bigint as missing, bool_or(found) as kept from res group by id",
    "parents": BASE + "select mtype as ftype, ref as id, string_agg(id::varchar, ',' order by id) as parent_ids from (select distinct mtype, ref, id from res where found) group by mtype, ref",
    "waynode_semi": BASE + "select id from roles where waynode",
    "orphans": BASE + "select id from orole where orphan",
    "shared_location": BASE + "select id, tagged from roles where shared",
    "node_features": BASE + "select nf.id, x, y, tags_text from nf join ft on ft.ftype = 'node' and ft.id = nf.id",
    "role_runs": BASE + "select id, sum((role is distinct from prev)::int)::bigint as role_runs from (select id, role, lag(role) over (partition by id order by pos) as prev from mem) group by id",
    "relation_bounds": BASE
    + """, loc as (select 'node' as t, id, x as minx, y as miny, x as maxx, y as maxy from nl union all select 'way', id, minx, miny, maxx, maxy from st where status = 'ok'),
d as (select mem.id, minx, miny, maxx, maxy from mem join loc on loc.t = mem.mtype and loc.id = mem.ref),
reach as (select src as a, dst as b from links union select reach.a, l.dst from reach join links l on l.src = reach.b),
every as (select id, minx, miny, maxx, maxy from d union all select reach.a, minx, miny, maxx, maxy from reach join d on d.id = reach.b)
select id, min(minx)::bigint as minx, min(miny)::bigint as miny, max(maxx)::bigint as maxx, max(maxy)::bigint as maxy from every group by id""",
    "relation_scores": BASE
    + """select id, case when len(list_filter(members, lambda m: lower(m.type[1]) <> 'r')) > 0 then len(list_filter(members, lambda m: lower(m.type[1]) <> 'r')) else 1000000000 end
+ case tags['type'] when 'superroute' then 50000000 when 'route_master' then 50000000 when 'network' then 100000000 when 'site' then 20000000 else 0 end
+ coalesce((14 - try_cast(tags['admin_level'] as double)) * 1000000, 0.0) as score from r""",
    "osm_stats": BASE
    + """select 'node' as ftype, count(*) as elements, 0::bigint as members, coalesce(sum(cardinality(tags)), 0)::bigint as tags, max(id) as max_id from n
union all select 'way', count(*), coalesce(sum(len(node_ids)), 0)::bigint, coalesce(sum(cardinality(tags)), 0)::bigint, max(id) from w
union all select 'relation', count(*), coalesce(sum(len(members)), 0)::bigint, coalesce(sum(cardinality(tags)), 0)::bigint, max(id) from r""",
    "cell_counts": _ROLL + "select col, row, nodes from cells",
    "tile_rollup": _ROLL + "select zoom, col, row, nodes from roll",
    "tile_density": _ROLL + f"select zoom, col, row, nodes from roll where zoom = 0 or nodes >= {DENSITY} order by nodes desc, zoom, col, row limit 65535",
    "tile_topk": _ROLL + f"select zoom, col, row, nodes from roll order by nodes desc, zoom, col, row limit {TILES}",
    "tile_assignment": _ROLL
    + f""", kept as (select * from roll where zoom = 0 or nodes >= {DENSITY}),
placed as (select nl.id, max({{'z': k.zoom, 'c': k.col, 'r': k.row}}) as t from nl, lv join kept k on k.zoom = lv.zoom
  and k.col = ((nl.x::bigint + 2147483648) >> (32 - lv.zoom)) and k.row = ((2147483647 - nl.y::bigint) >> (32 - lv.zoom)) group by nl.id)
select id, t.z || '/' || t.c || '/' || t.r as tile from placed""",
    "string_usage": _USAGE + "select str, key_count, value_count, total from usage",
    "index_category": _CATF + "select ftype, id, category, index_bits from cats",
    "index_groups": _CATF
    + """, g as (select '0/0/0' as tile, case when is_area then 'a' else ftype[1] end as itype, category, count(*) as features from cats group by 1, 2, 3),
k as (select *, category >= 0 and features >= 20 as large from g),
o as (select *, row_number() over (partition by tile, itype, large order by features desc, category) as pos from k)
select tile, itype, category, features, case when large and pos <= 7 then category else -1 end as kept_as from o""",
}
