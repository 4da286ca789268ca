"""Elements written as OSM XML and OSM PBF: nodes, ways, relations, each in the order of ids."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import mercator, text
from geoweft.functions import tags as T
from geoweft.model import Graph, member_type
from geoweft.operators.closure import above_nodes as closure_above
from geoweft.session import open_file, rename_file
from geoweft.sources import wire
from geoweft.sources.pbf import MEMBER_TYPES

GENERATOR = "geoweft"
#: Elements of one PBF block.
BLOCK = 8_000


def export_rows(graph: Graph, closure: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The elements of a closure (ftype, id, hit) with all that output needs: `code`, `id`, `lon`, `lat` (degrees), `node_ids`, `members`, `tags`.

    Members that the closure lacks are left out of their relations, missing nodes out of their ways.
    """
    kept = T.keep_tags(F.col("tags"), keys).alias("tags")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = lambda t: closure.where(F.col("ftype") == t).select("id")
    members_type = "array<struct<pos:int,type:string,ref:bigint,role:string>>"
    nodes = graph.located_nodes("tags").join(own("node"), "id", "left_semi").select(F.lit(0).alias("code"), "id", mercator.lon_degrees(F.col("x")).alias("lon"), mercator.lat_degrees(F.col("y")).alias("lat"), none("array<bigint>", "node_ids"), none(members_type, "members"), kept)
    ways = graph.ways("node_ids", "tags").join(own("way"), "id", "left_semi")
    refs = ways.select("id", F.posexplode("node_ids").alias("pos", "ref")).join(own("node").withColumnRenamed("id", "ref"), "ref", "left_semi")
    refs = refs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda p: p["ref"]).alias("node_ids"))
    ways = ways.drop("node_ids").join(refs, "id", "left").select(F.lit(1).alias("code"), "id", none("double", "lon"), none("double", "lat"), "node_ids", none(members_type, "members"), kept)
    rels = graph.relations("members", "tags").join(own("relation"), "id", "left_semi")
    m = rels.select("id", F.explode("members").alias("m")).select("id", F.col("m.pos").alias("pos"), member_type(F.col("m.type")).alias("ftype"), F.col("m.ref").alias("ref"), F.coalesce("m.role", F.lit("")).alias("role"))
    m = m.join(closure.select("ftype", F.col("id").alias("ref")), ["ftype", "ref"], "left_semi")
    held = m.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("ftype").alias("type"), "ref", "role"))).cast(members_type).alias("members"))
    rels = rels.drop("members").join(held, "id", "left").select(F.lit(2).alias("code"), "id", none("double", "lon"), none("double", "lat"), none("array<bigint>", "node_ids"), "members", kept)
    return nodes.unionByName(ways).unionByName(rels)


def export_features(store, hits: DataFrame, complete: tuple[str, ...] | None = None, allowed: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """As `export_rows`, for a store without node ids of ways: ways have a `line` of places instead, and bring no nodes."""
    f = store.table("features")
    m = f.where("ftype = 'relation'").select("id", F.explode("members").alias("m")).select("id", F.col("m.pos").alias("pos"), member_type(F.col("m.type")).alias("mtype"), F.col("m.ref").alias("ref"), F.coalesce("m.role", F.lit("")).alias("role"))
    found = m.join(f.select(F.col("ftype").alias("mtype"), F.col("id").alias("ref")), ["mtype", "ref"], "left_semi")
    upper, _ = closure_above(hits, found, f.where("ftype = 'relation'").select("id", "tags"), complete, allowed)
    held = m.join(upper.select(F.col("ftype").alias("mtype"), F.col("id").alias("ref")), ["mtype", "ref"], "left_semi")
    members_type = "array<struct<pos:int,type:string,ref:bigint,role:string>>"
    held = held.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("mtype").alias("type"), "ref", "role"))).cast(members_type).alias("members"), F.lit("relation").alias("ftype"))
    rows = f.drop("members").join(upper, ["ftype", "id"], "left_semi").join(held, ["ftype", "id"], "left")
    ring = F.col("parts")[0]["rings"][0]
    place = lambda p: F.struct(mercator.lon_degrees(p["x"]).alias("lon"), mercator.lat_degrees(p["y"]).alias("lat"))
    point = F.when(F.col("ftype") == "node", place(ring[0]))
    real = T.without_synthetic(F.col("tags"))
    return rows.select(
        text.type_code(F.col("ftype")).alias("code"), "id", point["lon"].alias("lon"), point["lat"].alias("lat"), F.lit(None).cast("array<bigint>").alias("node_ids"), "members",
        T.keep_tags(real, keys).alias("tags"), F.when(F.col("ftype") == "way", F.transform(ring, place)).alias("line"),
    )


def xml_element(located: bool = False) -> Column:
    """One element with its children, from the columns of `export_rows`, or if `located` of `export_features`."""
    esc = text.xml_escape
    tags = F.array_join(F.transform(T.sorted_tags(F.col("tags")), lambda e: F.concat(F.lit('<tag k="'), esc(e["key"]), F.lit('" v="'), esc(F.coalesce(e["value"], F.lit(""))), F.lit('"/>'))), "")
    nds = F.array_join(F.transform("node_ids", lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), "")
    if located:
        spot = lambda p: F.concat(F.lit('<nd lat="'), text.degrees_fixed(p["lat"]), F.lit('" lon="'), text.degrees_fixed(p["lon"]), F.lit('"/>'))
        nds = F.array_join(F.transform("line", spot), "")
    members = F.array_join(F.transform("members", lambda m: F.concat(F.lit('<member type="'), m["type"], F.lit('" ref="'), m["ref"].cast("string"), F.lit('" role="'), esc(m["role"]), F.lit('"/>'))), "")
    name = F.element_at(F.array(*map(F.lit, MEMBER_TYPES)), F.col("code") + 1)
    place = F.when(F.col("code") == 0, F.concat(F.lit(' lat="'), text.degrees_fixed(F.col("lat")), F.lit('" lon="'), text.degrees_fixed(F.col("lon")), F.lit('"'))).otherwise("")
    inner = F.concat(F.coalesce(nds, F.lit("")), F.coalesce(members, F.lit("")), tags)
    start = F.concat(F.lit("<"), name, F.lit(' id="'), F.col("id").cast("string"), F.lit('" version="1"'), place)
    return F.when(inner == "", F.concat(start, F.lit("/>"))).otherwise(F.concat(start, F.lit(">"), inner, F.lit("</"), name, F.lit(">")))


def write_xml(rows: DataFrame, path: str) -> int:
    """An OSM XML file; the sorted elements stream through the driver, a partition at a time. Returns their number."""
    n = 0
    with open_file(path + ".tmp", "wb") as out:
        out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6" generator="{GENERATOR}" upload="false">\n'.encode())
        for r in rows.orderBy("code", "id").select(xml_element("line" in rows.columns)).toLocalIterator():
            out.write((r[0] + "\n").encode())
            n += 1
        out.write(b"</osm>\n")
    rename_file(path + ".tmp", path)
    return n


def blob(kind: str, data: bytes) -> bytes:
    body = wire.field(2, len(data)) + wire.field(3, zlib.compress(data))
    head = wire.field(1, kind.encode()) + wire.field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def header_block(source: str = "", located: bool = False) -> bytes:
    optional = [b"Sort.Type_then_ID"] + [b"LocationsOnWays"] * located
    parts = [wire.field(4, f) for f in (b"OsmSchema-V0.6", b"DenseNodes")] + [wire.field(5, f) for f in optional] + [wire.field(16, GENERATOR.encode())]
    return b"".join(parts) + (wire.field(17, source.encode()) if source else b"")


class _Strings:
    def __init__(self) -> None:
        self.numbers: dict[str, int] = {"": 0}

    def __call__(self, s: str | None) -> int:
        return self.numbers.setdefault(s or "", len(self.numbers))

    def table(self) -> bytes:
        return b"".join(wire.field(1, s.encode("utf-8")) for s in self.numbers)


def encode_block(rows: pd.DataFrame) -> bytes:
    """A block of rows of one type."""
    number = _Strings()
    code = int(rows["code"].iloc[0])
    pairs = [[] if t is None else sorted(dict(t).items()) for t in rows["tags"]]
    if code == 0:
        words = [w for p in pairs for w in (*(number(s) for kv in p for s in kv), 0)]
        at = lambda c: (rows[c] * 1e7).round().astype("int64").to_numpy()
        dense = wire.field(1, wire.pack_deltas(rows["id"].to_numpy())) + wire.field(8, wire.pack_deltas(at("lat"))) + wire.field(9, wire.pack_deltas(at("lon")))
        group = wire.field(2, dense + (wire.field(10, wire.pack(words)) if any(pairs) else b""))
    else:
        parts = []
        lines = rows["line"] if "line" in rows else [None] * len(rows)
        for fid, refs, members, p, line in zip(rows["id"].tolist(), rows["node_ids"], rows["members"], pairs, lines):
            e = wire.field(1, fid) + wire.field(2, wire.pack([number(k) for k, _ in p])) + wire.field(3, wire.pack([number(v) for _, v in p]))
            if code == 1:
                e += wire.field(8, wire.pack_deltas([] if refs is None else list(refs)))
                if line is not None:
                    e += b"".join(wire.field(k, wire.pack_deltas([round(q[c] * 1e7) for q in line])) for k, c in ((9, "lat"), (10, "lon")))
            else:
                m = [] if members is None else list(members)
                e += wire.field(8, wire.pack([number(x["role"]) for x in m])) + wire.field(9, wire.pack_deltas([x["ref"] for x in m])) + wire.field(10, wire.pack([MEMBER_TYPES.index(x["type"]) for x in m]))
            parts.append(wire.field(code + 2, e))
        group = b"".join(parts)
    return wire.field(1, number.table()) + wire.field(2, group)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for _, part in b.groupby("code", sort=True):
            for i in range(0, len(part), BLOCK):
                rows = part.iloc[i : i + BLOCK]
                yield pd.DataFrame({"code": [int(rows["code"].iloc[0])], "first": [int(rows["id"].iloc[0])], "blob": [blob("OSMData", encode_block(rows))]})


def write_pbf(rows: DataFrame, path: str, source: str = "") -> int:
    """An OSM PBF file. Tasks encode and compress their sorted ranges; the driver only joins the finished blobs, in order. Returns the number of blobs."""
    n = 0
    encoded = rows.repartitionByRange("code", "id").sortWithinPartitions("code", "id").mapInPandas(_blocks, "code int, first long, blob binary")
    with open_file(path + ".tmp", "wb") as out:
        out.write(blob("OSMHeader", header_block(source, "line" in rows.columns)))
        for r in encoded.toLocalIterator():
            out.write(r["blob"])
            n += 1
    rename_file(path + ".tmp", path)
    return n


def change_element() -> Column:
    """One change in the section it belongs to, from the columns of the changes table; what has no key, value, reference or type is left out."""
    def esc(c: Column) -> Column:
        for plain, entity in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    quoted = lambda c: esc(text.xml_escape(c))
    given = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), c.cast("string"), F.lit('"')), F.lit(""))
    joined = lambda items, held, one: F.coalesce(F.array_join(F.transform(F.filter(items, held), one), ""), F.lit(""))
    tags = joined("tags", lambda t: t["k"].isNotNull() & t["v"].isNotNull(), lambda t: F.concat(F.lit('<tag k="'), quoted(t["k"]), F.lit('" v="'), quoted(t["v"]), F.lit('"/>')))
    refs = joined("refs", lambda r: r.isNotNull(), lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>')))
    members = joined("members", lambda m: member_type(m["type"]).isNotNull() & m["ref"].isNotNull(), lambda m: F.concat(F.lit('<member type="'), member_type(m["type"]), F.lit('" ref="'), m["ref"].cast("string"), F.lit('" role="'), quoted(F.coalesce(m["role"], F.lit(""))), F.lit('"/>')))
    inner = F.concat(F.when(F.col("ftype") == "way", refs).otherwise(""), F.when(F.col("ftype") == "relation", members).otherwise(""), tags)
    place = F.when(F.col("ftype") == "node", F.concat(given("lat", F.col("lat")), given("lon", F.col("lon")))).otherwise("")
    section = F.when(F.coalesce("is_deleted", F.lit(False)) | F.coalesce(F.lower(F.trim("op")) == "delete", F.lit(False)), "delete").when(F.lower(F.trim("op")) == "create", "create").otherwise("modify")
    return F.concat(F.lit("<"), section, F.lit("><"), F.col("ftype"), given("id", F.col("id")), given("version", F.col("version")), place, F.lit(">"), inner, F.lit("</"), F.col("ftype"), F.lit("></"), section, F.lit(">"))


def write_changes(changes: DataFrame, folder: str) -> None:
    """An update archive: change files, gzipped, in a folder, one per task, in the order of `seq` within and between files.

    Files are written by Spark's commit protocol, so there are as many of any size, on any file system; `osc.read_changes` reads them back.
    A change without type or id is none.
    """

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"line": ['<?xml version="1.0" encoding="UTF-8"?>', f'<osmChange version="0.6" generator="{GENERATOR}">']})
        yield from batches
        yield pd.DataFrame({"line": ["</osmChange>"]})

    rows = changes.where(F.col("ftype").isin("node", "way", "relation") & F.col("id").isNotNull())
    ordered = rows.repartitionByRange("seq").sortWithinPartitions("seq").select(change_element().alias("line"))
    ordered.mapInPandas(framed, "line string").write.option("compression", "gzip").text(folder)
