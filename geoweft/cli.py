"""Commands: build, query, map, info, load, save, check, update, hash, tiles.

    python -m geoweft build STORE SOURCE        (SOURCE: an .osm.pbf file, or a folder of nodes, ways and relations tables)
    python -m geoweft query STORE 'na[tourism=museum]' -f geojson -o museums.geojson

Wrong arguments end with status 2, other failures with status 1.
"""

from __future__ import annotations

import argparse
import os
import sys

from geoweft.operators import area
from geoweft.plans import selector
from geoweft.session import local_session
from geoweft.sinks import formats
from geoweft.sources import osc
from geoweft.store import BuildOptions, Store, StoreError


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="geoweft", description=__doc__.splitlines()[0])
    p.add_argument("-V", "--version", action="version", version="geoweft 1")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *words: str, where: bool = False, many: str | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for w in words:
            c.add_argument(w)
        if many:
            c.add_argument(many, nargs="+" if many != "layers" else "*")
        if where:
            c.add_argument("-a", "--area", help="WKT, GeoJSON or coordinates, or a file of them")
            c.add_argument("-b", "--bbox", help="W,S,E,N")
        c.add_argument("--threads", type=int, default=0)
        return c

    b = command("build", "make a store", "store", "source")
    for flag, kind in (("--areas", str), ("--indexed-keys", str), ("--max-strings", int), ("--min-string-usage", int), ("--max-tiles", int), ("--min-tile-density", int), ("--max-key-indexes", int), ("--key-index-min-features", int), ("--rtree-branch-size", int)):
        b.add_argument(flag, type=kind)
    b.add_argument("-l", "--levels")
    b.add_argument("-w", "--waynode-ids", action="store_true", default=None)
    b.add_argument("-u", "--updatable", action="store_true", default=None)
    b.add_argument("-i", "--id-indexing", action="store_true", default=None)
    q = command("query", "find features", "store", where=True, many="query")
    q.add_argument("-f", "--format")
    q.add_argument("-o", "--output")
    q.add_argument("-k", "--keys")
    q.add_argument("-p", "--precision", type=int, default=7)
    q.add_argument("-R", "--complete-relations", default="multipolygon")
    m = command("map", "draw a map", "store", where=True, many="layers")
    m.add_argument("-o", "--output", default="map.html")
    for flag in ("--popup", "--tooltip", "--link"):
        m.add_argument(flag)
    command("info", "show properties", "store").add_argument("--tiles", action="store_true")
    command("load", "add tiles of a bundle", "store", "bundle", where=True)
    command("save", "write tiles to a bundle", "store", "bundle", where=True)
    command("check", "find what is wrong", "store")
    command("update", "apply change files", "store", many="files").add_argument("-o", "--output", help="the new store; by default STORE is replaced")
    command("hash", "show the hash of the contents", "store")
    command("tiles", "list the features of a tile", "store", "tile")
    return p


def _where(args: argparse.Namespace) -> tuple[tuple[float, ...] | None, list | None]:
    return area.parse_box(args.bbox) if args.bbox else None, area.read_area(args.area) if args.area else None


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = _parser()
    try:
        args = parser.parse_args(argv)
    except SystemExit as x:
        return int(x.code or 0)
    try:
        return _run(args, spark)
    except (selector.QueryError, area.AreaError, formats.FormatError, ValueError) as x:
        print(f"geoweft: {x}", file=sys.stderr)
        return 2
    except (StoreError, OSError) as x:
        print(f"geoweft: {x}", file=sys.stderr)
        return 1


def _run(args: argparse.Namespace, spark) -> int:
    # Everything that can be wrong in the arguments is looked at before Spark starts.
    name, query, options, where = None, None, None, (None, None)
    if args.command == "query":
        query, name = " ".join(args.query), formats.resolve_format(args.format, args.output)
        if not 0 <= args.precision <= 15:
            raise ValueError("precision is from 0 to 15")
        selector.parse(query)
    if args.command == "build":
        given = {k: v for k, v in vars(args).items() if v is not None and k in BuildOptions.__dataclass_fields__}
        options = BuildOptions(**given).check()
    if hasattr(args, "bbox"):
        where = _where(args)
    if not 0 <= args.threads <= 4 * (os.cpu_count() or 1):
        raise ValueError("too many threads")
    spark = spark or local_session(args.threads or "*")
    store = Store(spark, args.store)
    return globals()[f"_{args.command}"](args, spark, store, name=name, query=query, options=options, where=where)


def _build(args, spark, store, options, **_) -> int:
    from geoweft.model import Graph
    from geoweft.sources import pbf

    info = {"source": args.source}
    if os.path.isdir(args.source):
        graph = Graph.load(spark, args.source)
    else:
        info |= {k: str(v) for k, v in pbf.header(args.source).items() if k.startswith("replication") or k == "source"}
        graph = pbf.as_graph(pbf.read_pbf(spark, args.source))
    Store.build(graph, args.store, options, info)
    return 0


def _query(args, spark, store, name, query, where, **_) -> int:
    from pyspark.sql import functions as F

    keys = [k.strip() for k in args.keys.split(",")] if args.keys and args.keys != "*" else None
    found = store.features(query, *where)
    output = args.output
    if name in ("xml", "pbf"):
        from geoweft.operators import closure
        from geoweft.sinks import osm

        if not output:
            raise ValueError(f"{name} needs an output file")
        near = store.features("*", *where).select("ftype", "id") if any(where) else None
        complete, hits = closure.complete_types(args.complete_relations), found.select("ftype", "id")
        if store.meta()["waynode_ids"] == "True":
            graph = store.graph()
            rows = osm.export_rows(graph, closure.closure(graph, hits, complete, near), keys)
        else:
            rows = osm.export_features(store, hits, complete, near, keys)
        osm.write_xml(rows, output) if name == "xml" else osm.write_pbf(rows, output)
        return 0
    lines = formats.lines(found.withColumn("whole", F.coalesce("whole", F.lit("collection"))), name, keys, args.precision)
    if output:
        formats.write_file(lines, name, output, keys)
    else:
        look = formats.layout(name, keys)
        n = 0
        for r in lines.toLocalIterator():
            sys.stdout.write((look.header if n == 0 else look.separator) + r[0])
            n += 1
        sys.stdout.write(look.footer if n else look.empty or "")
    return 0


def _map(args, spark, store, where, **_) -> int:
    from geoweft.functions.text import parse_colour

    layers = [] if args.layers else [("gray", _boxes(store.missing_tiles()))]
    for text in args.layers:
        colour, query = parse_colour(text)
        layers.append((colour, store.features(query, *where).where("size(parts) > 0")))
    formats.map_html(layers, args.output, args.popup, args.tooltip, args.link)
    return 0


def _boxes(tiles):
    """Tiles as features: their boxes as polygons."""
    from pyspark.sql import functions as F

    from geoweft.functions.mercator import tile_box
    from geoweft.operators import tiling

    out = None
    for z in range(13):
        x0, y0, x1, y1 = tile_box(z, F.col("col"), F.col("row"))
        ring = F.array(*(F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))))
        part = tiles.where(F.col("zoom") == z).select(
            F.lit("tile").alias("ftype"), F.lit(0).cast("long").alias("id"), F.create_map(F.lit("tile"), tiling.tile_name(F.col("zoom"), F.col("col"), F.col("row"))).alias("tags"),
            F.lit("polygon").alias("whole"), F.array(F.struct(F.lit("polygon").alias("kind"), F.array(ring).alias("rings"))).alias("parts"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def _info(args, spark, store, **_) -> int:
    if args.tiles:
        for r in store.tile_stats().orderBy("zoom", "col", "row").toLocalIterator():
            print(",".join(map(str, r)))
        return 0
    for k, v in sorted(store.info().items()):
        print(f"{k}: {v}")
    return 0


def _load(args, spark, store, where, **_) -> int:
    print(f"{store.load(args.bundle, *where)} tiles loaded")
    return 0


def _save(args, spark, store, where, **_) -> int:
    store.save(args.bundle, *where)
    return 0


def _check(args, spark, store, **_) -> int:
    n = 0
    for r in store.violations().toLocalIterator():
        print(f"{r['ftype']}/{r['id']}: {r['problem']}")
        n += 1
    print("No errors found" if not n else f"{n} errors found")
    return int(n > 0)


def _update(args, spark, store, **_) -> int:
    from geoweft.session import filesystem

    to = args.output or store.path + ".new"
    store.update(osc.read_changes(spark, *args.files), to)
    if not args.output:
        fs, old = filesystem(spark, store.path)
        aside, new = (spark._jvm.org.apache.hadoop.fs.Path(store.path + x) for x in (".old", ".new"))
        fs.rename(old, aside), fs.rename(new, old), fs.delete(aside, True)
    return 0


def _hash(args, spark, store, **_) -> int:
    print(f"contents: {store.contents_hash().collect()[0][0]}")
    return 0


def _tiles(args, spark, store, **_) -> int:
    for r in store.dump_tile(args.tile).toLocalIterator():
        print(r[0])
    return 0
