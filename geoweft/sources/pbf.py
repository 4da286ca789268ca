"""OSM PBF files as a data source, `geoweft_pbf`: the driver reads blob headers only, tasks decode ranges of blobs.

    spark.dataSource.register(PbfSource)
    spark.read.format("geoweft_pbf").load(path)

One row per element: ftype, id, lon and lat (100 nanodegrees), node_ids, members, tags, and of ways the places of their nodes where
a file has them. Dense nodes, raw and zlib blobs are read; other
compressions, plain nodes and unknown fields are errors. Histories, users and changesets of elements are passed over.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geoweft.session import open_file
from geoweft.sources import wire

SCHEMA = "ftype string, id long, lon int, lat int, node_ids array<bigint>, members array<struct<pos:int,type:string,ref:bigint,role:string>>, tags map<string,string>, places array<struct<lon:int,lat:int>>"
ARROW = pa.schema(
    [
        ("ftype", pa.string()),
        ("id", pa.int64()),
        ("lon", pa.int32()),
        ("lat", pa.int32()),
        ("node_ids", pa.list_(pa.int64())),
        ("members", pa.list_(pa.struct([("pos", pa.int32()), ("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))),
        ("tags", pa.map_(pa.string(), pa.string())),
        ("places", pa.list_(pa.struct([("lon", pa.int32()), ("lat", pa.int32())]))),
    ]
)
# Limits of header and blob sizes, names of member types, and the features that a reader must know.
MOST_HEADER, MOST_BLOB = 256, 64 * 1024 * 1024
MEMBER_TYPES = ("node", "way", "relation")
KNOWN_FEATURES = {"OsmSchema-V0.6", "DenseNodes", "HistoricalInformation", "LocationsOnWays", "Sort.Type_then_ID"}


class PbfError(ValueError):
    """A file that cannot be read; the message says why."""


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """Type, offset and size of each blob, from the headers."""
    size = os.path.getsize(path)
    with open_file(path) as f:
        at = 0
        while at < size:
            head = f.read(4)
            if len(head) < 4:
                raise PbfError(f"{path}: cut off at {at}")
            n = struct.unpack(">I", head)[0]
            if n > MOST_HEADER:
                raise PbfError(f"{path}: blob header of {n} bytes at {at}")
            values = dict(wire.fields(f.read(n)))
            kind, length = values.get(1, b"").decode(), values.get(3)
            if kind not in ("OSMHeader", "OSMData") or length is None or length > MOST_BLOB:
                raise PbfError(f"{path}: unknown blob {kind!r} at {at}")
            at += 4 + n
            if at + length > size:
                raise PbfError(f"{path}: cut off in the blob at {at}")
            yield kind, at, length
            at += length
            f.seek(at)


def inflate(blob: bytes) -> bytes:
    v = dict(wire.fields(blob))
    if 1 in v:
        return v[1]
    if 3 in v:
        data = zlib.decompress(v[3])
        if len(data) != v.get(2, len(data)):
            raise PbfError("a blob has not the size it states")
        return data
    raise PbfError(f"blob with unknown compression (fields {sorted(v)})")


def header(path: str) -> dict[str, object]:
    """Generator, source and replication state of a file's header block; times in seconds."""
    kind, at, n = next(blobs(path), (None, 0, 0))
    if kind != "OSMHeader":
        raise PbfError(f"{path}: no header block")
    with open_file(path) as f:
        f.seek(at)
        block = inflate(f.read(n))
    names = {16: "generator", 17: "source", 32: "replication_timestamp", 33: "replication_sequence", 34: "replication_url"}
    out: dict[str, object] = {"required_features": []}
    for k, v in wire.fields(block):
        if k == 4:
            out["required_features"].append(v.decode())
        elif k in names:
            out[names[k]] = v.decode() if isinstance(v, bytes) else v
    if unknown := set(out["required_features"]) - KNOWN_FEATURES:
        raise PbfError(f"{path}: needs {sorted(unknown)}")
    return out


def _strings(block: bytes) -> list[str]:
    out = []
    for k, v in wire.fields(block):
        if k != 1:
            raise PbfError("a string table has only strings")
        out.append(v.decode("utf-8", "replace"))
    return out


def decode(block: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of a data block, one batch per group. Groups are decoded once the block's granularity is known."""
    groups, strings, granularity, lat0, lon0 = [], [], 100, 0, 0
    for k, v in wire.fields(block):
        if k == 1:
            strings = _strings(v)
        elif k == 2:
            groups.append(v)
        elif k == 17:
            granularity = v
        elif k == 19:
            lat0 = v - (1 << 64) if v >> 63 else v
        elif k == 20:
            lon0 = v - (1 << 64) if v >> 63 else v
        elif k != 18:
            raise PbfError(f"unknown field {k} in a block")
    for g in groups:
        rows: list[dict] = []
        for k, v in wire.fields(g):
            if k == 2:
                rows += _dense(v, strings, granularity, lat0, lon0)
            elif k == 3:
                rows.append(_way(v, strings))
            elif k == 4:
                rows.append(_relation(v, strings))
            elif k == 1:
                raise PbfError("plain nodes are not supported, only dense ones")
            elif k != 5:
                raise PbfError(f"unknown field {k} in a group")
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


def _dense(data: bytes, strings: list[str], granularity: int, lat0: int, lon0: int) -> list[dict]:
    v = dict(wire.fields(data))
    ids, lats, lons = (wire.deltas(v.get(k, b"")) for k in (1, 8, 9))
    if not len(ids) == len(lats) == len(lons):
        raise PbfError("dense nodes differ in ids and positions")
    lats, lons = (lat0 + granularity * lats) // 100, (lon0 + granularity * lons) // 100
    words = wire.unpack(v.get(10, b"")).tolist()
    out, at = [], 0
    for i, y, x in zip(ids.tolist(), lats.tolist(), lons.tolist()):
        tags = []
        while at < len(words) and words[at]:
            tags.append((strings[words[at]], strings[words[at + 1]]))
            at += 2
        at += 1
        out.append({"ftype": "node", "id": i, "lon": x, "lat": y, "tags": tags})
    return out


def _tags(v: dict, strings: list[str]) -> list[tuple[str, str]]:
    return [(strings[a], strings[b]) for a, b in zip(wire.unpack(v.get(2, b"")).tolist(), wire.unpack(v.get(3, b"")).tolist(), strict=True)]


def _way(data: bytes, strings: list[str]) -> dict:
    v = dict(wire.fields(data))
    places = [{"lon": x, "lat": y} for x, y in zip(wire.deltas(v[10]).tolist(), wire.deltas(v[9]).tolist(), strict=True)] if 9 in v and 10 in v else None
    return {"ftype": "way", "id": v[1], "node_ids": wire.deltas(v.get(8, b"")).tolist(), "tags": _tags(v, strings), "places": places}


def _relation(data: bytes, strings: list[str]) -> dict:
    v = dict(wire.fields(data))
    roles, refs, kinds = wire.unpack(v.get(8, b"")).tolist(), wire.deltas(v.get(9, b"")).tolist(), wire.unpack(v.get(10, b"")).tolist()
    members = [{"pos": i, "type": MEMBER_TYPES[t], "ref": r, "role": strings[o]} for i, (o, r, t) in enumerate(zip(roles, refs, kinds, strict=True))]
    return {"ftype": "relation", "id": v[1], "members": members, "tags": _tags(v, strings)}


class Blobs(InputPartition):
    def __init__(self, path: str, spans: list[tuple[int, int]]) -> None:
        self.path, self.spans = path, spans


class PbfReader(DataSourceReader):
    def __init__(self, path: str, per_task: int) -> None:
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[Blobs]:
        header(self.path)
        spans = [(at, n) for kind, at, n in blobs(self.path) if kind == "OSMData"]
        return [Blobs(self.path, spans[i : i + self.per_task]) for i in range(0, len(spans), self.per_task)]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as f:
            for at, n in partition.spans:
                f.seek(at)
                yield from decode(inflate(f.read(n)))


class PbfSource(DataSource):
    """Option `path` (a local path that all executors mount, or the address of a shared file system), `blobsPerTask` (16)."""

    @classmethod
    def name(cls) -> str:
        return "geoweft_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], int(self.options.get("blobspertask", 16)))


def read_pbf(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PbfSource)
    return spark.read.format("geoweft_pbf").load(path)


def as_graph(rows: DataFrame):
    """A graph of the elements read; positions are projected."""
    from pyspark.sql import functions as F

    from geoweft.functions.mercator import project_x, project_y
    from geoweft.model import Graph

    one = (F.lit(1).alias("version"), F.lit(False).alias("is_deleted"))
    kind = lambda t: rows.where(F.col("ftype") == t)
    nodes = kind("node").select("id", *one, "lon", "lat", project_x(F.col("lon")).cast("int").alias("x"), project_y(F.col("lat")).cast("int").alias("y"), "tags")
    return Graph(nodes, kind("way").select("id", *one, "node_ids", "tags"), kind("relation").select("id", *one, "members", "tags"))
