"""Query language, tag rules, areas, assembly, formats, store, files, streaming and commands."""

import datetime
import gzip
import json
import os
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft import cli
from geoweft.functions import mercator, text
from geoweft.functions import tags as T
from geoweft.model import Graph
from geoweft.operators import area, assemble, changeset, closure, geometry, relations, strings, tiling
from geoweft.operators.features import features
from geoweft.plans import outputs, selector
from geoweft.sinks import formats, osm
from geoweft.sources import osc, pbf, wire
from geoweft.store import BuildOptions, Store, StoreError
from geoweft.streaming import changes as stream

from .conftest import rows

T0 = datetime.datetime(2024, 1, 15)


def n(i, x, y, tags=None, **more):
    return {"id": i, "version": 1, "x": x, "y": y, "tags": tags, "tile": "0/0/0", **more}


def w(i, refs, tags=None, **more):
    return {"id": i, "version": 1, "node_ids": refs, "tags": tags, **more}


def r(i, members, tags=None, **more):
    return {"id": i, "version": 1, "members": [(p, *m) for p, m in enumerate(members)], "tags": tags, **more}


M = 10_000_000
NODES = [n(1, 0, 0), n(2, M, 0), n(3, M, M), n(4, 0, M), n(5, 5 * M, 5 * M, {"amenity": "cafe", "name": "A,\"b\"\n<&>"}), n(6, 7 * M, 0), n(7, 7 * M, 0), n(8, 7 * M, 0, {"shop": "x"}), n(9, 3 * M, 3 * M), n(10, None, None, {"amenity": "cafe"})]
WAYS = [
    w(1, [1, 2, 3, 4, 1], {"building": "yes"}), w(2, [1, 2, 3, 4, 1], {"building": "no"}), w(3, [1, 2, 3, 4, 1], {"building": "yes", "area": "no"}), w(4, [1, 2, 3, 4, 1], {"natural": "cliff"}), w(5, [1, 2, 3, 4, 1], {"natural": "water"}),
    w(6, [1, 2, 99], {"highway": "Ahorn"}), w(7, [1]), w(8, [1, 2, 1]), w(9, [1, 2, 3], {"highway": "Birke"}), w(10, [1, 10]), w(11, None), w(12, [1, 2, 3, 4, 1], {"building": "3"}), w(13, [3, 4, 1], {"highway": "Ahorn"}), w(14, [1, None]),
]
RELATIONS = [
    r(1, [("w", 9, "outer"), ("way", 13, "outer"), ("w", 77, "inner")], {"type": "multipolygon", "landuse": "x"}),
    r(2, [("w", 1, None)], {"type": "multipolygon"}),
    r(3, [("w", 1, "outer")], {"type": "route", "landuse": "x"}),
    r(4, [("n", 9, "label"), ("r", 4, "")]),
    r(5, [("n", 5, ""), ("r", 6, "")]), r(6, [("n", 5, ""), ("n", 1, ""), ("r", 5, "")]),
    r(7, [("n", 1234, "")]),
]


@pytest.fixture
def graph(folder, spark):
    return Graph.load(spark, folder(nodes=NODES, ways=WAYS, relations=RELATIONS))


def test_selector_grammar():
    assert selector.parse("na[tourism=museum]") == [selector.Selector("na", (selector.Clause("tourism", "=", (selector.Value("museum"),)),))]
    assert selector.parse("w[highway][name=A*]")[0].clauses[1].values[0].wild
    assert selector.parse("a[name='La Condamine']")[0].clauses[0].values == (selector.Value("La Condamine", True),)
    assert selector.accepted_types("w[a], n") == "nw" and selector.required_keys("w[a][b!=c], n[a=1]") == {"a"}
    for bad in ("", "x", "w[", "w[a", "w[a=]", "nn", "w[a='x]", "w]", "n,", "w[a<b]", "*[a]]"):
        with pytest.raises(selector.QueryError):
            selector.parse(bad)


def test_selector_meaning(spark):
    data = [(1, "node", False, {"a": "x1", "h": "12"}), (2, "way", False, {"a": "y", "b": "no"}), (3, "way", True, {"b": "yes"}), (4, "relation", False, None), (5, "relation", True, {"a": "1x"})]
    df = spark.createDataFrame(data, "id long, ftype string, is_area boolean, tags map<string,string>")
    ids = lambda q: [x[0] for x in df.where(selector.predicate(q)).orderBy("id").select("id").collect()]
    cases = {"*": [1, 2, 3, 4, 5], "n": [1], "w": [2], "a": [3, 5], "r": [4], "nar": [1, 3, 4, 5], "*[a]": [1, 2, 5], "*[!a]": [3, 4], "*[a=x*]": [1], "*[a=*x]": [5], "*[a=*x*]": [1, 5], "*[a='x*']": [], "*[a=y,1x]": [2, 5], "*[a!=y]": [1, 3, 4, 5], "*[h>=12]": [1], "*[h<12]": [], "w[b=no], n": [1, 2]}
    for q, want in cases.items():
        assert ids(q) == want, q


def test_tag_parsers():
    assert [(x.key, x.exclude) for x in T.parse_area_rules("a, b (x, y), c (except z)")] == [("a", False), ("b", False), ("c", True)]
    assert T.parse_indexed_keys("a b/c, d") == {"a": 1, "b": 2, "c": 2, "d": 3}
    assert T.parse_zoom_levels("0,3,6") == [0, 3, 6] and len(T.parse_area_rules(T.AREA_RULES)) == 28
    for f, bad in ((T.parse_area_rules, "a (b"), (T.parse_area_rules, "a, a"), (T.parse_area_rules, "a ()"), (T.parse_indexed_keys, "a b a"), (T.parse_indexed_keys, " ".join(f"k{i}" for i in range(31))), (T.parse_zoom_levels, "bad_bad"), (T.parse_zoom_levels, "13")):
        with pytest.raises(ValueError):
            f(bad)


def test_scalars(spark):
    df = spark.createDataFrame([("1.5", "a<b&\"c'", -1234567.0), ("1.50", None, 0.5), ("-0", "", 2.0), ("007", "x\ny,z", 1e9)], "v string, s string, d double")
    assert [x[0] and str(float(x[0])) for x in df.select(T.strict_decimal(F.col("v"))).collect()] == ["1.5", None, None, None]
    assert [x[0] for x in df.select(text.xml_escape(F.col("s"))).collect()][0] == "a&lt;b&amp;&quot;c&apos;"
    assert [x[0] for x in df.select(text.csv_escape(F.col("s"))).collect()] == ['"a<b&""c\'"', "", "", '"x\ny,z"']
    assert [x[0] for x in df.select(text.json_text(F.col("s"))).collect()][1:] == ["null", '""', '"x\\ny,z"']
    assert [x[0] for x in df.select(text.degrees_text(F.col("d"), 3)).collect()] == ["-1234567", "0.5", "2", "1000000000"]
    one = spark.range(1)
    assert one.select(text.revision_path(F.lit(6_012_345))).collect()[0][0] == "006/012/345" == osc.sequence_path(6_012_345)
    assert one.select(text.template("{type} {name}{none}!", F.create_map(F.lit("name"), F.lit("N")), {"type": F.lit("way")})).collect()[0][0] == "way N!"
    assert tuple(one.select(text.url_parts(F.lit("https://a.b:81/c/d?e"))).collect()[0][0]) == ("https", "a.b", 81, "/c/d")
    assert text.parse_colour("red: w[highway]") == ("red", "w[highway]") and text.parse_colour("w[highway]") == (None, "w[highway]")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert one.select(text.time_ago(F.lit("2024-01-07").cast("timestamp"), now)).collect()[0][0] == "3 days ago"


def test_mercator_and_hilbert(spark):
    df = spark.createDataFrame([(lon, lat) for lon in (-180, -1, 0, 77, 179) for lat in (-85, -10, 0, 60, 85)], "lon int, lat int").select((F.col("lon") * mercator.UNIT).alias("lon"), (F.col("lat") * mercator.UNIT).alias("lat"))
    df = df.select("*", mercator.project_x(F.col("lon")).alias("x"), mercator.project_y(F.col("lat")).alias("y"))
    for x in df.select("*", mercator.lon_degrees(F.col("x")).alias("a"), mercator.lat_degrees(F.col("y")).alias("b")).collect():
        assert abs(x.a - x.lon / 1e7) < 1e-6 and abs(x.b - x.lat / 1e7) < 1e-6 and mercator.project(x.lon / 1e7, x.lat / 1e7) == (x.x, x.y)
    grid = spark.range(256).select(((F.col("id") % 16) * 2**28 - 2**31).alias("x"), (F.floor(F.col("id") / 16) * 2**28 - 2**31).alias("y"))
    at = {x.d: (x.x >> 28, x.y >> 28) for x in grid.select("*", mercator.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect()}
    assert sorted(at) == list(range(256))
    assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(255))


def test_area_literals():
    assert area.parse_box("1,2,3,4") == area.parse_box("1 2 3 4") == (1, 2, 3, 4) and area.parse_box("5, 6") == (5, 6, 5, 6)
    ring = [(0, 0), (4, 0), (4, 4), (0, 0)]
    for t in ("POLYGON((0 0, 4 0, 4 4, 0 0))", "0 0 4 0 4 4", "((0 0, 4 0, 4 4))", "lonlat 0,0,4,0,4,4", "[[0,0],[4,0],[4,4],[0,0]]", '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}', '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}}]}'):
        assert area.parse_rings(t) == [ring], t
    assert area.parse_rings("latlon 1 2 3 4 5 6")[0][0] == (2, 1)
    assert len(area.parse_rings("MULTIPOLYGON(((0 0,9 0,9 9,0 0),(1 1,2 1,2 2,1 1)),((20 20,21 20,21 21,20 20)))")) == 3
    assert len(area.parse_rings("[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]")) == 2
    for bad in ("circle(1 2)", "1 2 3", "1 2 3 4", "200 0 1 1 2 2", '{"type":"FeatureCollection","features":[]}', "POLYGON()"):
        with pytest.raises((area.AreaError, ValueError)):
            area.parse_rings(bad)
    for bad in ("1,2,3", "a,b", "0,0,181,0", "0,-91,0,0"):
        with pytest.raises(area.AreaError):
            area.parse_box(bad)
    square = [np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]), np.array([[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]])]
    x, y = np.array([5, 1, 0, 10, 11, 4]), np.array([5, 1, 0, 5, 5, 5])
    assert area.inside_rings(x, y, square).tolist() == [False, True, True, True, False, True]
    assert area.shape_meets(np.array([[-5, 5], [15, 5]]), False, False, square) and not area.shape_meets(np.array([[-5, 15], [15, 16]]), False, False, square)
    assert area.shape_meets(np.array([[-5, -5], [20, -5], [20, 20], [-5, 20]]), True, True, square)


def test_feature_around_a_later_polygon():
    rings = area.ring_units(area.parse_rings("MULTIPOLYGON(((50 50,51 50,51 51,50 50)),((1 1,2 1,2 2,1 1)))"))
    around = area.ring_units([[(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)]])[0]
    away = area.ring_units([[(10, 0), (15, 0), (15, 5), (10, 5), (10, 0)]])[0]
    for order in (rings, rings[::-1]):
        assert area.shape_meets(around, False, True, order) and not area.shape_meets(around, False, False, order)
        assert not area.shape_meets(away, False, True, order)


def test_assembly(graph):
    status = {x.id: (x.n_refs, x.n_missing, x.closed, x.status) for x in assemble.way_status(graph).collect()}
    assert status[6][3] == "missing" and status[7][3] == "short" and status[8][3] == "ring" and status[10][3] == "missing" and status[11] == (0, 0, False, "short") and status[14][3] == "missing"
    assert status[1] == (5, 0, True, "ok")
    shapes = {x.id: x for x in assemble.way_shapes(graph).collect()}
    assert set(shapes) == {i for i, s in status.items() if s[3] == "ok"} and [tuple(p) for p in shapes[1].shape] == [(0, 0), (M, 0), (M, M), (0, M)] and shapes[9].node_ids == [1, 2, 3]
    flags = {(x.ftype, x.id): x.is_area for x in assemble.area_flags(graph).collect()}
    want = {1: True, 2: False, 3: False, 4: False, 5: True, 9: False, 12: False}
    assert {i: flags["way", i] for i in want} == want
    assert [flags["relation", i] for i in (1, 2, 3)] == [True, False, False]
    miss = {x.id: (x.members, x.missing, x.kept) for x in assemble.missing_members(graph).collect()}
    assert miss[1] == (3, 1, True) and miss[7] == (1, 1, False) and miss[4] == (1, 0, True)
    roles = {x.id: x for x in assemble.node_roles(graph).collect()}
    assert roles[6].shared and roles[8].shared and roles[6].orphan and not roles[9].orphan and not roles[1].orphan and 10 not in roles
    feats = {x.id: x.tags for x in assemble.node_features(graph).collect()}
    assert feats[6] == {T.DUPLICATE: "yes", T.ORPHAN: "yes"} and feats[8] == {"shop": "x"} and feats[9] == {} and 2 not in feats
    parents = {(x.ftype, x.id): x.parents for x in assemble.parents(graph).collect()}
    assert parents["node", 5] == [5, 6] and parents["way", 1] == [2, 3]


def test_cycles_and_bounds(graph):
    kept, removed = relations.break_cycles(graph)
    assert [tuple(x) for x in removed.collect()] == [(5, 6)] and [tuple(x) for x in kept.collect()] == [(6, 5)]
    assert {x.id: x.level for x in relations.levels(graph).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0}
    tags = {x.id: x.tags for x in relations.synthetic_relation_tags(graph).collect()}
    assert tags[5] == {T.REMOVED_REFCYCLES: "1"} and tags[1][T.MISSING_MEMBERS] == "1"
    b = {x.id: (x.minx, x.miny, x.maxx, x.maxy) for x in relations.relation_bounds(graph).collect()}
    assert b[5] == b[6] == (0, 0, 5 * M, 5 * M) and 7 not in b and b[1] == (0, 0, M, M)


def test_deep_chain_is_omitted(folder, spark):
    g = Graph.load(spark, folder(nodes=[n(1, 0, 0)], relations=[r(i, [("r", i + 1, ""), ("n", 1, "")]) for i in range(1, 13)]))
    got = {x.id: (x.level, x.omitted) for x in relations.levels(g).collect()}
    assert got[12] == (0, False) and got[3] == (9, False) and got[2] == (10, True) and got[1] == (11, True)


def test_tiles(graph, spark):
    cells = tiling.cell_counts(graph.located_nodes())
    roll = tiling.tile_rollup(cells, [0, 6, 12])
    sums = {x[0]: x[1] for x in roll.groupBy("zoom").agg(F.sum("nodes")).collect()}
    assert sums == {0: 9, 6: 9, 12: 9}
    kept = tiling.kept_tiles(roll, 2, 100)
    named = {x.id: x.tile for x in tiling.assign_points(graph.located_nodes(), kept, [0, 6, 12]).collect()}
    brute = {(x.zoom, x.col, x.row) for x in kept.collect()}
    for node in NODES:
        if node["x"] is not None:
            best = max(z for z in (0, 6, 12) if (z, (node["x"] + 2**31) >> (32 - z), (2**31 - 1 - node["y"]) >> (32 - z)) in brute)
            assert named[node["id"]].startswith(f"{best}/")
    table = strings.string_table(strings.string_usage(graph), 2, 256).collect()
    assert [x.str for x in table[:5]] == strings.CORE and len({x.str for x in table}) == len(table) and [x.code for x in table] == list(range(len(table)))


def test_formats_agree(graph, tmp_path):
    f = features(graph, bounds=False).join(geometry.geometries(graph), ["ftype", "id"]).cache()
    for query in ("*", "w[highway][name=A*]", "a", "n[amenity]", "a[leisure=park][name='This park does not exist!']"):
        hits = f.where(selector.predicate(query))
        want = int(formats.lines(hits, "count").collect()[0][0])
        out = {}
        for name in ("geojsonl", "geojson", "wkt", "list", "csv", "brief"):
            path = str(tmp_path / name)
            assert formats.write_file(formats.lines(hits, name), name, path) == want
            out[name] = open(path, encoding="utf-8", newline="").read()
        collection = json.loads(out["geojson"])
        assert len(collection["features"]) == want and len([json.loads(x) for x in out["geojsonl"].splitlines()]) == want and len(out["list"].splitlines()) == want
        if want == 0:
            assert out["wkt"] == "GEOMETRYCOLLECTION EMPTY\n" and out["geojsonl"] == "" and collection["type"] == "FeatureCollection"
        if want == 1:
            assert not out["wkt"].startswith("GEOMETRYCOLLECTION(")
    one = f.where(selector.predicate("n[amenity]"))
    line = formats.lines(one, "csv", ["id", "name"]).collect()[0][0]
    assert line == 'N5,"A,""b""\n<&>"'
    assert json.loads(formats.lines(one, "geojsonl", ["name"]).collect()[0][0])["properties"] == {"name": 'A,"b"\n<&>'}
    area_text = formats.lines(f.where("ftype = 'relation' and id = 1"), "wkt", precision=0).collect()[0][0]
    assert area_text.startswith("POLYGON((") and area_text.count(" ") == 5
    assert formats.map_html([("red", f)], str(tmp_path / "m.html")) == f.count() and "fitBounds" in (tmp_path / "m.html").read_text()
    with pytest.raises(formats.FormatError):
        formats.resolve_format("bananas")
    assert [formats.resolve_format(None, x) for x in ("a.geojson", "b.osm.pbf", "c", None)] == ["geojson", "pbf", "brief", "brief"]


def test_export_round_trip(graph, spark, tmp_path):
    hits = features(graph, bounds=False).where("ftype = 'relation'").select("ftype", "id")
    whole = {(x.ftype, x.id): x.hit for x in closure.closure(graph, hits).collect()}
    assert whole["node", 4] is False and ("way", 9) in whole and ("way", 5) not in whole and whole["relation", 5] is True
    few = {(x.ftype, x.id) for x in closure.closure(graph, hits, ("multipolygon",)).collect()}
    near = spark.createDataFrame([("node", 5), ("way", 2)], "ftype string, id long")
    more = {(x.ftype, x.id) for x in closure.closure(graph, hits, ("multipolygon",), near).collect()}
    assert more - few == {("node", 5)}
    assert ("node", 5) not in few and ("way", 13) in few and closure.complete_types("all") is None and closure.complete_types("none") == ()
    out = osm.export_rows(graph, closure.closure(graph, hits))
    assert osm.write_xml(out, str(tmp_path / "x.osm")) == len(whole)
    root = ET.parse(tmp_path / "x.osm").getroot()
    keys = [("node way relation".split().index(e.tag), int(e.get("id"))) for e in root]
    assert keys == sorted(keys)
    osm.write_pbf(out, str(tmp_path / "x.pbf"))
    back = pbf.read_pbf(spark, str(tmp_path / "x.pbf"))
    a = {(x.code, x.id): (x.node_ids, [(m.type, m.ref, m.role) for m in x.members or []], x.tags or {}) for x in out.collect()}
    b = {(["node", "way", "relation"].index(x.ftype), x.id): (x.node_ids, [(m.type, m.ref, m.role) for m in x.members or []], x.tags or {}) for x in back.collect()}
    assert a == b
    assert pbf.as_graph(back).located_nodes().count() == sum(k[0] == 0 for k in a)


def test_wire_and_broken_files(tmp_path):
    values = [0, 1, -1, 127, 128, -(2**62), 2**62, 300]
    assert wire.unpack(wire.pack(values, True), True).tolist() == values and wire.deltas(wire.pack_deltas(values)).tolist() == values
    assert [wire.read_varint(wire.varint(v), 0)[0] for v in (0, 127, 128, 2**40)] == [0, 127, 128, 2**40]
    with pytest.raises(ValueError):
        wire.unpack(b"\x80")
    p = tmp_path / "bad.pbf"
    for data in (b"\x00\x00\xff\xff", b"\x00", osm.blob("OSMHeader", b"")[:-3], osm.blob("Other", b"")):
        p.write_bytes(data)
        with pytest.raises((pbf.PbfError, ValueError)):
            list(pbf.blobs(str(p)))
    with pytest.raises(pbf.PbfError):
        pbf.inflate(wire.field(4, b"lzma"))
    plain = wire.field(2, wire.field(1, b""))
    with pytest.raises(pbf.PbfError):
        list(pbf.decode(plain))


OSC = """<?xml version="1.0"?><osmChange><create><node id="11" version="1" lat="1.5" lon="-2"><tag k="a" v="b"/></node></create>
<modify><way id="9" version="2"><nd ref="1"/><nd ref="11"/></way><relation id="4" version="2"><member type="node" ref="9" role=""/></relation></modify><delete><node id="9" version="2"/></delete></osmChange>"""


def test_change_files(spark, tmp_path, graph):
    (tmp_path / "a.osc").write_text(OSC)
    with gzip.open(tmp_path / "b.osc.gz", "wt") as f:
        f.write(OSC.replace('version="2"', 'version="3"'))
    c = osc.read_changes(spark, str(tmp_path / "a.osc"), str(tmp_path / "b.osc.gz")).orderBy("seq").collect()
    assert [(x.ftype, x.id, x.op, x.is_deleted) for x in c[:4]] == [("node", 11, "create", False), ("way", 9, "modify", False), ("relation", 4, "modify", False), ("node", 9, "delete", True)]
    assert len(c) == 8 and c[1].refs == [1, 11] and c[4].seq > c[3].seq and (c[0].x, c[0].y) == mercator.project(-2, 1.5)
    for bad in ("<osm/>", "<osmChange><move/></osmChange>", "<osmChange><create><node version='1'/></create></osmChange>", "<osmChange><create><node id='1'><nd ref='1'/></node></create></osmChange>", "<osmChange><create><way id='1'><nd/></way></create></osmChange>", "<osmChange>"):
        with pytest.raises(osc.ChangeFileError):
            list(osc.parse_changes(bad.encode(), "x"))
    assert osc.parse_state("#x\nsequenceNumber=42\ntimestamp=2024-01-02T03\\:04\\:05Z\n") == (42, "2024-01-02T03:04:05Z")
    g = Graph(*(spark.createDataFrame(graph.tables[t].collect(), graph.tables[t].schema) for t in ("node", "way", "relation")))
    eff = changeset.effective(g, osc.read_changes(spark, str(tmp_path / "a.osc")))
    assert {(x.ftype, x.id, x.existed) for x in eff.collect()} == {("node", 11, False), ("way", 9, True), ("relation", 4, True), ("node", 9, True)}
    acts = {(x.ftype, x.id, x.action) for x in changeset.actions(g, eff).collect()}
    assert {("node", 11, "created"), ("node", 11, "becomes_waynode"), ("way", 9, "modified"), ("node", 9, "deleted")} <= acts
    after = changeset.future(g, eff)
    assert {x.id: x.node_ids for x in after.ways("node_ids").collect()}[9] == [1, 11] and 9 not in {x.id for x in after.nodes("x").collect()}


def test_stream_equals_batch(spark, tmp_path, folder):
    ch = [{"seq": s, "ftype": "node", "id": i % 5, "version": v, "op": o, "x": s, "y": s} for s, (i, v, o) in enumerate([(0, 5, "modify"), (1, 3, "create"), (0, 4, "modify"), (1, 3, "delete"), (2, 1, "modify"), (3, None, "modify"), (1, 2, "modify"), (0, 5, "modify")])]
    base = spark.createDataFrame([("node", 0, 4, False, None), ("node", 2, 1, False, None)], "ftype string, id long, version int, is_deleted boolean, seq long")
    from .conftest import fill

    src = tmp_path / "in"
    for k, part in enumerate((ch[5:], ch[:3], ch[3:5], ch[:1])):
        spark.createDataFrame(fill(stream.SCHEMA, part), stream.SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    live = stream.state_table(spark, base, str(tmp_path / "live"))
    q = stream.follow(spark, str(src), live, str(tmp_path / "cp"), files_per_batch=1)
    assert q.awaitTermination(120)
    once = stream.state_table(spark, base, str(tmp_path / "once"))
    assert stream.merge_batch(once, spark.createDataFrame(fill(stream.SCHEMA, ch), stream.SCHEMA), 0)
    assert not stream.merge_batch(once, spark.createDataFrame(fill(stream.SCHEMA, ch), stream.SCHEMA), 0)
    assert rows(live.read()) == rows(once.read())
    assert {x.id: (x.version, x.is_deleted, x.seq) for x in once.read().collect()} == {0: (5, False, 0), 1: (3, True, 3), 2: (1, False, None)}


def test_stream_of_change_files(spark, tmp_path):
    base = spark.createDataFrame([("node", 9, 1, False, None)], "ftype string, id long, version int, is_deleted boolean, seq long")
    for number, body in ((1, OSC), (2, OSC.replace('version="2"', 'version="3"'))):
        path = tmp_path / "rep" / f"{osc.sequence_path(number)}.osc.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        with gzip.open(path, "wt") as f:
            f.write(body)
        path.with_name(path.name.replace(".osc.gz", ".state.txt")).write_text(f"sequenceNumber={number}\ntimestamp=2024-01-0{number}T00\\:00\\:00Z\n")
    live = stream.state_table(spark, base, str(tmp_path / "live"))
    assert stream.follow_files(spark, str(tmp_path / "rep"), live, str(tmp_path / "cp"), files_per_batch=1).awaitTermination(120)
    assert {(x.ftype, x.id): (x.version, x.is_deleted) for x in live.read().collect()} == {("node", 9): (3, True), ("node", 11): (1, False), ("way", 9): (3, False), ("relation", 4): (3, False)}
    states = osc.replication_states(spark, str(tmp_path / "rep"))
    assert osc.sequence_at(states, datetime.datetime(2024, 1, 1, 12)).collect()[0][0] == 1


def test_store_finds_relations_by_bounds_and_by_members(folder, spark, tmp_path):
    far = [n(20, -50 * M, -50 * M), n(21, -49 * M, -50 * M)]
    more = [
        r(20, [("w", 9, "outer")], {"type": "multipolygon", "mark": "yes"}), r(21, [("r", 20, "")], {"mark": "yes"}), r(22, [("r", 21, ""), ("n", 20, "")], {"mark": "yes"}),
        r(23, [("w", 20, "outer")], {"type": "multipolygon", "mark": "yes"}), r(24, [("r", 23, "")], {"mark": "yes"}), r(25, [("n", 20, ""), ("n", 5, "")], {"mark": "yes"}),
    ]
    g = Graph.load(spark, folder(nodes=NODES + far, ways=[*WAYS, w(20, [20, 21])], relations=RELATIONS + more))
    store = Store.build(g, str(tmp_path / "store"), BuildOptions(min_tile_density=1))
    rels = {x.id: x for x in store.features("ra[mark]").collect()}
    assert set(rels) == {20, 21, 22, 23, 24, 25} and not any(rels[i].parts for i in (20, 21, 23, 24)) and rels[20].is_area
    for box in ("-1,-1,1,1", "-45,-45,-35,-35", "0.1,0.1,0.2,0.2", "20,20,30,30"):
        x0, y0, x1, y1 = area.box_units(area.parse_box(box))
        want = {i for i, x in rels.items() if x.minx <= x1 and x.maxx >= x0 and x.miny <= y1 and x.maxy >= y0}
        assert {x.id for x in store.features("ra[mark]", bbox=area.parse_box(box)).collect()} == want, box
    inside = lambda q, t: {x.id for x in store.features(q, rings=area.parse_rings(t)).collect()}
    assert inside("ra[mark]", "-1 -1 1 -1 1 1 -1 1") == {20, 21, 22}
    assert inside("r[mark]", "-45 -45 -35 -45 -35 -35 -45 -35") == {22, 24, 25} and inside("a[mark]", "-45 -45 -35 -45 -35 -35 -45 -35") == {23}
    # Within the bounds of 22 and 25, but away from all members.
    assert inside("ra[mark]", "-2 -2 -1 -2 -1 -1 -2 -1") == set()


def test_store_has_tags_and_members_of_a_build(folder, spark, tmp_path):
    late = r(8, [("n", 5, ""), ("n", 1234, ""), ("w", 6, "")], {"type": "x", T.MISSING_MEMBERS: "77"})
    g = Graph.load(spark, folder(nodes=NODES, ways=WAYS, relations=[*RELATIONS, late]))
    store = Store.build(g, str(tmp_path / "store"), BuildOptions(min_tile_density=1, updatable=True))
    f = {x.id: x for x in store.features("ra").where("ftype = 'relation'").collect()}
    synthetic = {i: {k: v for k, v in x.tags.items() if k.startswith(T.SYNTHETIC)} for i, x in f.items()}
    assert synthetic == {1: {T.MISSING_MEMBERS: "1"}, 2: {}, 3: {}, 4: {}, 5: {T.REMOVED_REFCYCLES: "1"}, 6: {}, 8: {T.MISSING_MEMBERS: "2"}}
    assert {x.id for x in store.features(f"ra[{T.MISSING_MEMBERS}]").collect()} == {1, 8}
    members = {i: [(m.pos, m.type, m.ref, m.role) for m in x.members] for i, x in f.items()}
    assert members[1] == [(0, "way", 9, "outer"), (1, "way", 13, "outer")] and members[5] == [(0, "node", 5, "")] and members[8] == [(0, "node", 5, "")]
    assert f[6].parents is None and f[5].parents == [6]
    # Missing members are still known to updates: one that comes later resolves.
    (tmp_path / "c.osc").write_text('<osmChange version="0.6"><create><node id="1234" version="1" lat="1.5" lon="-2"/></create></osmChange>')
    after = store.update(osc.read_changes(spark, str(tmp_path / "c.osc")), str(tmp_path / "after"))
    got = {x.id: x for x in after.features("r").collect()}
    assert got[8].tags[T.MISSING_MEMBERS] == "1" and [m.ref for m in got[8].members] == [5, 1234]


def test_store_of_a_folder_follows_its_files(folder, spark, tmp_path, monkeypatch):
    d = folder(nodes=NODES)
    built = []
    monkeypatch.setattr(outputs, "rebuild", lambda g, o: built.append(g) or len(built))
    assert outputs._store(spark, d) == outputs._store(spark, d) == 1
    spark.createDataFrame([(1, 0, 0)], "id long, x int, y int").write.mode("overwrite").parquet(f"{d}/nodes.parquet")
    assert outputs._store(spark, d) == 2


def test_violations_are_found(spark, tmp_path):
    part = lambda x, y: [("point", [[(x, y)]])]
    base = ("n", "node", False, {"a": "b"}, 5, 5, 5, 5, "0/0/0", part(5, 5), None)
    names = "itype string, ftype string, is_area boolean, tags map<string,string>, minx long, miny long, maxx long, maxy long, tile string, parts array<struct<kind:string,rings:array<array<struct<x:long,y:long>>>>>, parents array<long>"
    at = {c.split()[0]: i for i, c in enumerate(names.split(", "))}
    faults = [
        (1, {}, set()), (0, {}, {"id is zero"}), (50_000_000_001, {}, {"id is very large"}), (2, {}, {"id comes twice"}), (2, {}, {"id comes twice"}), (3, {"tile": None}, {"no tile"}), (4, {"tile": "1/0/0"}, {"node outside its tile"}),
        (5, {"tags": {T.ORPHAN: "yes"}, "parents": [9]}, {"orphan is a member"}), (6, {"tags": {T.DUPLICATE: "no"}}, {"synthetic tag is not yes"}), (7, {"tags": {T.ORPHAN: "yes", "a": "b"}}, {"synthetic tag beside others"}),
        (8, {"minx": 6}, {"empty bounds", "bounds are not tight"}), (9, {"maxx": 7}, {"bounds are not tight"}), (10, {"is_area": True}, {"node is an area", "wrong index"}), (11, {"itype": "w"}, {"wrong index"}),
    ]
    data = [(i, *(more.get(c, v) for c, v in zip(at, base))) for i, more, _ in faults]
    spark.createDataFrame(data, f"id long, {names}").write.parquet(str(tmp_path / "bad" / "features"))
    got = {}
    for x in Store(spark, str(tmp_path / "bad")).violations().collect():
        got.setdefault(x.id, set()).add(x.problem)
    assert got == {i: want for i, _, want in faults if want}


def test_store_rules_groups_and_checksums(folder, spark, tmp_path):
    """Own area rules reach geometries; options order features within a tile; a value that flips is found by its tile's checksum."""
    tagged = [n(30 + i, i * M, 0, {"amenity": "x"} if i % 2 else {"shop": "y"}) for i in range(12)]
    g = Graph.load(spark, folder(nodes=NODES + tagged, ways=[w(1, [1, 2, 3, 4, 1], {"foo": "bar"}), w(2, [1, 2, 3, 4, 1], {"building": "yes"})]))
    s = Store.build(g, str(tmp_path / "s"), BuildOptions(areas="foo", min_tile_density=1_000, max_key_indexes=2, key_index_min_features=3, rtree_branch_size=4))
    ways = {x.id: (x.is_area, x.itype, x.whole) for x in s.features("wa").collect()}
    assert ways == {1: (True, "a", "polygon"), 2: (False, "w", "line")}
    points = s.features("n").collect()
    assert len({x.key_group for x in points}) == 2 and all(sum(y.leaf == x.leaf and y.key_group == x.key_group and y.tile == x.tile for y in points) <= 4 for x in points)
    assert s.violations().count() == 0
    broken = s.table("features").withColumn("tags", F.when(F.col("id") == 31, F.create_map(F.lit("amenity"), F.lit("z"))).otherwise(F.col("tags")))
    broken.write.partitionBy("itype").parquet(str(tmp_path / "broken"))
    os.rename(tmp_path / "s" / "features", tmp_path / "whole")
    os.rename(tmp_path / "broken", tmp_path / "s" / "features")
    found = [x.problem for x in s.violations().collect()]
    assert found == ["checksum differs: 0/0/0"]


def test_change_archive_round_trip(spark, tmp_path):
    tags = [("k", "a\n\t<&>'\""), (None, "x"), ("y", None)]
    ch = [{"seq": s, "ftype": "node", "id": s, "version": s % 3 or None, "op": " DELETE" if s % 4 == 0 else None, "lat": 1.5, "lon": -2.0, "tags": tags} for s in range(50)] + [{"seq": 99, "ftype": None, "id": 1}]
    from .conftest import fill

    osm.write_changes(spark.createDataFrame(fill(stream.SCHEMA, ch), stream.SCHEMA).repartition(5), str(tmp_path / "archive"))
    back = osc.read_changes(spark, str(tmp_path / "archive")).orderBy("seq").collect()
    assert [(x.id, x.version, x.is_deleted) for x in back] == [(s, s % 3 or None, s % 4 == 0) for s in range(50)]
    assert all([tuple(t) for t in x.tags] == tags[:1] and (x.x, x.y) == mercator.project(-2, 1.5) for x in back)


def test_store_and_commands(graph, spark, tmp_path, folder, capsys):
    source = os.path.dirname(graph.tables["node"].inputFiles()[0].removeprefix("file://")).rsplit("/", 1)[0]
    s = str(tmp_path / "store")
    assert cli.main(["build", s, source, "-l", "0,3,6", "--min-tile-density", "1", "-u"], spark) == 0
    assert cli.main(["build", s, source], spark) == 1
    assert cli.main(["build", s + "x", source, "--levels", "bad_bad_bad"], spark) == 2
    assert cli.main(["query", s, "n", "-f", "bananas"], spark) == 2 and "invalid" in capsys.readouterr().err
    assert cli.main(["query", s, "w[", "-f", "list"], spark) == 2 and cli.main(["nonsense"], spark) == 2
    capsys.readouterr()
    assert cli.main(["query", s, "n[amenity]", "-f", "list"], spark) == 0 and capsys.readouterr().out == "N5\n"
    assert cli.main(["query", s, "*", "-f", "count", "-b", "0.1,0.1,0.5,0.5"], spark) == 0
    boxed = int(capsys.readouterr().out)
    store = Store(spark, s)
    assert boxed == store.features("*", bbox=(0.1, 0.1, 0.5, 0.5)).count() < store.features().count()
    assert {(x.ftype, x.id) for x in store.features("*", rings=area.parse_rings("0.2 0.2 0.25 0.2 0.25 0.25")).collect()} >= {("way", 1), ("relation", 1)}
    assert cli.main(["check", s], spark) == 0 and "No errors" in capsys.readouterr().out
    bundle, other = str(tmp_path / "bundle"), str(tmp_path / "other")
    assert cli.main(["save", s, bundle], spark) == 0
    assert cli.main(["load", other, bundle, "-b", "0.1,0.1,0.2,0.2"], spark) == 0
    part = Store(spark, other)
    have = {(t.zoom, t.col, t.row) for t in part.table("tiles").collect()}
    lack = {(t.zoom, t.col, t.row) for t in store.table("tiles").collect()} - have
    shown = {(t.zoom, t.col, t.row) for t in part.missing_tiles().collect()}
    assert lack and shown <= lack and not any((z, c >> (a[0] - z), q >> (a[0] - z)) in shown for a in shown for z, c, q in [(z, a[1], a[2]) for z in (0, 3, 6) if z < a[0]])
    assert cli.main(["map", other, "-o", str(tmp_path / "missing.html")], spark) == 0 and (tmp_path / "missing.html").read_text().count("add({") == len(shown)
    assert cli.main(["load", other, bundle], spark) == 0
    assert cli.main(["load", other, bundle], spark) == 0 and capsys.readouterr().out.splitlines()[-1] == "0 tiles loaded"
    assert rows(Store(spark, other).contents_hash()) == rows(store.contents_hash())
    for args in (["info", s], ["info", s, "--tiles"], ["hash", s], ["tiles", s, "0/0/0"], ["map", s, "red: w", "-o", str(tmp_path / "map.html")], ["query", s, "r", "-o", str(tmp_path / "r.osm")], ["query", s, "*", "-o", str(tmp_path / "all.pbf"), "-R", "all"]):
        assert cli.main(args, spark) == 0, args
    plain = Store.build(Graph.load(spark, source), str(tmp_path / "plain"), BuildOptions(min_tile_density=1))
    with pytest.raises(StoreError):
        plain.graph()
    for name in ("p.osm", "p.pbf"):
        assert cli.main(["query", plain.path, "ra", "-o", str(tmp_path / name), "-R", "all"], spark) == 0
    way = ET.parse(tmp_path / "p.osm").getroot().find("way[@id='9']")
    assert [(nd.get("ref"), float(nd.get("lon"))) for nd in way.findall("nd")][0] == (None, 0.0) and len(way.findall("nd")) == 3
    back = {x.id: x.places for x in pbf.read_pbf(spark, str(tmp_path / "p.pbf")).where("ftype = 'way'").collect()}
    assert len(back[9]) == 3 and back[9][0].lon == 0 and abs(back[9][1].lon - M * 360 / 2**32 * 1e7) < 1
    (tmp_path / "c.osc").write_text(OSC)
    updated = str(tmp_path / "updated")
    assert cli.main(["update", s, str(tmp_path / "c.osc"), "-o", updated], spark) == 0
    eff = changeset.effective(store.graph(), osc.read_changes(spark, str(tmp_path / "c.osc")))
    fresh = Store.build(changeset.future(store.graph(), eff), str(tmp_path / "fresh"), BuildOptions(levels="0,3,6", min_tile_density=1, updatable=True))
    assert rows(fresh.contents_hash()) == rows(Store(spark, updated).contents_hash()) != rows(store.contents_hash())
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "fresh")).load(bundle)
    with pytest.raises(ValueError):
        BuildOptions(max_strings=1).check()
