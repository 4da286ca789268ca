"""The feature store: built once from a graph, queried many times; saved to and loaded from bundles; checked and hashed.

A store is a folder of Parquet tables: `features` (partitioned by index type n, w, a, r; sorted by tile and Hilbert position, so that row groups cover
small boxes, and by index group; with `leaf`, the branch of that order), `nodes` (all located nodes), `tiles` (those loaded), `catalog` (all of the build), `indexes` (groups of keys per tile),
`checksums` (per tile), `strings` and `meta`. A bundle has the same tables, for the tiles of an area.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import text
from geoweft.functions import tags as T
from geoweft.model import MEMBERS, Graph, member_type
from geoweft.operators import area, assemble, geometry, hierarchy, relations, strings, tiling
from geoweft.operators.features import BOUNDS, features
from geoweft.plans import selector
from geoweft.session import filesystem, materialize, scratch_path


class StoreError(RuntimeError):
    """A store or bundle that cannot be used as asked."""


@dataclass
class BuildOptions:
    """Options of a build; ranges are checked on use."""

    areas: str = T.AREA_RULES
    indexed_keys: str = T.INDEXED_KEYS
    max_strings: int = 32_000
    min_string_usage: int = 300
    max_tiles: int = 65_535
    min_tile_density: int = 75_000
    levels: str = T.ZOOM_LEVELS
    max_key_indexes: int = 8
    key_index_min_features: int = 300
    rtree_branch_size: int = 16
    id_indexing: bool = False
    waynode_ids: bool = False
    updatable: bool = False

    def check(self) -> BuildOptions:
        # The range of each number.
        ranges = {"max_strings": (256, 65_534), "min_string_usage": (1, 100_000_000), "max_tiles": (1, 8_000_000), "min_tile_density": (1, 10_000_000), "max_key_indexes": (0, 30), "key_index_min_features": (0, 1_000_000), "rtree_branch_size": (4, 255)}
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} is from {low} to {high}")
        T.parse_zoom_levels(self.levels), T.parse_area_rules(self.areas), T.parse_indexed_keys(self.indexed_keys)
        if self.updatable:
            self.id_indexing = self.waynode_ids = True
        return self


class Store:
    """An open store."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def has(self, table: str) -> bool:
        fs, where = filesystem(self.spark, f"{self.path}/{table}")
        return fs.exists(where)

    def exists(self) -> bool:
        return self.has("meta")

    def meta(self) -> dict[str, str]:
        """Properties; there are about twenty."""
        return {r["key"]: r["value"] for r in self.table("meta").collect()}

    @classmethod
    def build(cls, graph: Graph, path: str, options: BuildOptions | None = None, info: dict[str, str] | None = None) -> Store:
        """Derive all features of a graph and write the store. An existing store at `path` is an error."""
        o = (options or BuildOptions()).check()
        spark = graph.tables["node"].sparkSession
        self = cls(spark, path)
        if self.exists():
            raise StoreError(f"{path} exists")
        levels = T.parse_zoom_levels(o.levels)
        nodes = graph.located_nodes()
        rollup = materialize(tiling.tile_rollup(tiling.cell_counts(nodes), levels), "rollup")
        kept = materialize(tiling.kept_tiles(rollup, o.min_tile_density, o.max_tiles), "tiles")
        sized = materialize(tiling.size_estimates(rollup, kept, levels), "sized")
        for name in ("catalog", "tiles"):
            sized.coalesce(1).write.parquet(f"{self.path}/{name}")
        tiling.assign_points(nodes, kept, levels).repartitionByRange("tile", "id").sortWithinPartitions("tile", "id").write.parquet(f"{self.path}/nodes")
        found = T.categories(F.col("tags"), T.parse_indexed_keys(o.indexed_keys))
        acyclic, removed = relations.break_cycles(graph)
        resolved = materialize(assemble.resolved_members(graph), "resolved")
        kept_members = relations.kept_members(resolved, removed)
        rules = T.parse_area_rules(o.areas)
        f = features(graph, True, rules, relation_tags=relations.synthetic_relation_tags(graph, resolved, removed))
        deep = relations.levels(graph, acyclic).where("omitted").select(F.lit("relation").alias("ftype"), "id")
        # Written in steps, so that each plan stays small.
        f = materialize(f.join(deep, ["ftype", "id"], "left_anti"), "features")
        f = f.withColumns({"category": T.category(found), "index_bits": T.index_bits(found), "itype": F.when(F.col("is_area"), "a").otherwise(F.substring("ftype", 1, 1))})
        f = f.join(assemble.parents(graph, kept_members), ["ftype", "id"], "left")
        shapes = materialize(geometry.geometries(graph, rules).select("ftype", "id", "whole", "parts"), "shapes")
        f = f.join(shapes, ["ftype", "id"], "left")
        if o.waynode_ids:
            f = f.join(graph.ways("node_ids").select(F.lit("way").alias("ftype"), "id", "node_ids"), ["ftype", "id"], "left")
        else:
            f = f.withColumn("node_ids", F.lit(None).cast("array<bigint>"))
        held = F.array_sort(F.collect_list(F.struct("pos", F.col("mtype").alias("type"), "ref", "role"))).cast(MEMBERS)
        f = f.join(kept_members.groupBy(F.lit("relation").alias("ftype"), "id").agg(held.alias("members")), ["ftype", "id"], "left")
        f = f.withColumn("members", F.when(F.col("ftype") == "relation", F.coalesce("members", F.array().cast(MEMBERS))))
        # All members, missing ones too, for `graph`: changes may bring them.
        if o.waynode_ids:
            f = f.join(graph.relations("members").select(F.lit("relation").alias("ftype"), "id", F.col("members").alias("source_members")), ["ftype", "id"], "left")
        else:
            f = f.withColumn("source_members", F.lit(None).cast(MEMBERS))
        placed = tiling.assign_bounds(f.withColumns({b: F.coalesce(b, F.lit(0).cast("long")) for b in BOUNDS}), kept, levels)
        placed = materialize(placed, "placed")
        groups = materialize(tiling.index_groups(placed.select("tile", "itype", "category"), o.max_key_indexes, o.key_index_min_features), "groups")
        groups.coalesce(1).write.parquet(f"{self.path}/indexes")
        grouped = placed.join(groups.select("tile", "itype", "category", F.col("kept_as").alias("key_group")), ["tile", "itype", "category"])
        ordered = tiling.hilbert_pack(grouped, o.rtree_branch_size, ["itype", "key_group"])
        sort = ["itype", "tile", "key_group", "hilbert"]
        ordered.repartitionByRange(*sort).sortWithinPartitions(*sort).write.partitionBy("itype").parquet(f"{self.path}/features")
        self.tile_hashes().coalesce(1).write.parquet(f"{self.path}/checksums")
        strings.string_table(strings.string_usage(graph), o.min_string_usage, o.max_strings, o.indexed_keys).coalesce(1).write.parquet(f"{self.path}/strings")
        meta = {"guid": str(uuid.uuid4()), "built": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "tiles": str(kept.count()), "revision": "0"}
        meta |= {k: str(v) for k, v in asdict(o).items()} | (info or {})
        self._write_meta(meta)
        return self

    def _write_meta(self, meta: dict[str, str]) -> None:
        self.spark.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.parquet(f"{self.path}/meta")

    def features(self, query: str = "*", bbox: tuple[float, ...] | None = None, rings: list[area.Ring] | None = None) -> DataFrame:
        """Features that match a query and meet a box or area.

        Types prune partitions, boxes are compared with the bounds in the scan, and keys that all matches have are tested by their
        index bits before tags are read.
        """
        f = self.table("features")
        types = selector.accepted_types(query)
        keys = T.parse_indexed_keys(self.meta()["indexed_keys"])
        mask = 0
        for k in selector.required_keys(query):
            mask |= 1 << (keys[k] - 1) if k in keys else 0
        f = f.where(F.col("itype").isin(*types)) if types != "nwar" else f
        f = f.where(F.col("index_bits").bitwiseAND(mask) == mask) if mask else f
        f = f.where(selector.predicate(query))
        if bbox:
            f = f.where(area.meets_box(area.box_units(bbox)))
        if rings:
            f = self._in_area(f, rings, bool(set(types) & set("ar")))
        return f

    def _in_area(self, f: DataFrame, rings: list[area.Ring], with_relations: bool = True) -> DataFrame:
        """Rows of `f` that meet an area. A relation that is no area, or of which no ring closes, does if a member at any depth does."""
        units = area.ring_units(rings)
        shared = self.spark.sparkContext.broadcast(units)

        def meets(parts: pd.Series) -> pd.Series:
            def one(p) -> bool:
                for part in p if p is not None else []:
                    for ring in part["rings"]:
                        xy = np.array([[q["x"], q["y"]] for q in ring], dtype=np.int64)
                        if area.shape_meets(xy, False, part["kind"] == "polygon", shared.value):
                            return True
                return False

            return pd.Series([one(p) for p in parts], dtype=bool)

        near, hit = area.meets_box(area.ring_box(units)), F.pandas_udf(meets, "boolean")
        own = f.where(near & (F.col("ftype") != "relation")).where(hit("parts"))
        if not with_relations:
            return own
        # Bounds hold those of members at all depths, so relations beyond the box have no member that meets the area.
        every = self.table("features").where(near)
        rels = every.where("ftype = 'relation'").withColumn("shaped", F.col("is_area") & (F.size("parts") > 0))
        members = rels.where("not shaped").select("id", F.explode("members").alias("m")).select("id", member_type(F.col("m.type")).alias("ftype"), F.col("m.ref").alias("ref"))
        # Parts of a relation that is no area are its node and way members; an area without rings needs theirs looked up.
        bare = members.join(rels.where("is_area and not shaped").select("id"), "id", "left_semi").where("ftype <> 'relation'")
        shapes = every.where("ftype <> 'relation'").select("ftype", F.col("id").alias("ref"), "parts")
        direct = rels.where(hit("parts")).select("id").union(shapes.join(bare, ["ftype", "ref"]).where(hit("parts")).select("id")).distinct()
        labels = materialize(rels.select("id").join(direct.withColumn("_d", F.lit(0)), "id", "left").select("id", F.coalesce("_d", F.lit(1)).alias("label")), "direct")
        links = hierarchy.distinct_links(members.where("ftype = 'relation'"), "ref", "id").join(rels.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
        met = hierarchy.propagate_min(materialize(links, "links"), labels).where("label = 0").select("id")
        return own.unionByName(f.where(near & (F.col("ftype") == "relation")).join(met, "id", "left_semi").select(f.columns))

    def contents_hash(self) -> DataFrame:
        """One row, `contents`: the same for two stores of the same features, however they are laid out."""
        return self.table("features").agg(F.bit_xor(self._row_hash()).alias("contents"))

    def tile_hashes(self) -> DataFrame:
        """`tile`, `features`, `checksum` of its features."""
        return self.table("features").groupBy("tile").agg(F.count("*").alias("features"), F.bit_xor(self._row_hash()).alias("checksum"))

    def _row_hash(self) -> Column:
        entries = F.to_json(F.struct(F.col("parts"), F.col("members")))
        return F.xxhash64("ftype", "id", "is_area", T.tags_text(F.col("tags")), *BOUNDS, F.array_join(F.col("parents").cast("array<string>"), ","), entries)

    def tile_stats(self) -> DataFrame:
        """`tile`, `zoom`, `col`, `row`, `nodes`, `features`, `bytes` (estimated)."""
        name = tiling.tile_name(F.col("zoom"), F.col("col"), F.col("row"))
        return self.table("tiles").withColumn("tile", name).join(self.tile_hashes().select("tile", "features"), "tile", "left").select("tile", "zoom", "col", "row", "nodes", F.coalesce("features", F.lit(0).cast("long")).alias("features"), "bytes")

    def info(self) -> dict[str, object]:
        """Properties, with the number of features by type and the indexed keys in order."""
        m = self.meta()
        counts = {r["itype"]: r["n"] for r in self.table("features").groupBy("itype").agg(F.count("*").alias("n")).collect()}
        return {**m, "features": counts, "indexed_keys": sorted(T.parse_indexed_keys(m["indexed_keys"]))}

    def dump_tile(self, tile: str) -> DataFrame:
        """Readable lines of the features of one tile."""
        head = F.concat(text.typed_id(F.col("ftype"), F.col("id")), F.lit(" "), F.col("itype"), F.lit(" ["), F.concat_ws(" ", *BOUNDS), F.lit("] "), T.tags_text(F.col("tags")))
        return self.table("features").where(F.col("tile") == tile).select(head.alias("line"))

    def violations(self) -> DataFrame:
        """What is wrong with the store: `ftype`, `id`, `problem`. Empty for a sound one."""
        f = self.table("features")
        out = lambda df, name: df.select("ftype", "id", F.lit(name).alias("problem"))
        located = F.coalesce(F.size("parts") > 0, F.lit(False))
        no_bounds = located & ((F.col("minx") > F.col("maxx")) | (F.col("miny") > F.col("maxy")))
        flags = [T.tag(F.col("tags"), k) for k in (T.DUPLICATE, T.ORPHAN)]
        part = lambda i: F.split_part("tile", F.lit("/"), F.lit(i)).cast("int")
        own = F.when(F.col("tile").isNotNull(), F.call_function("shiftright", F.col("minx") + 2**31, 32 - part(1)) == part(2))
        points = F.flatten(F.flatten(F.transform("parts", lambda p: p["rings"])))
        tight = (F.array_min(F.transform(points, lambda p: p["x"])) == F.col("minx")) & (F.array_max(F.transform(points, lambda p: p["x"])) == F.col("maxx"))
        tight &= (F.array_min(F.transform(points, lambda p: p["y"])) == F.col("miny")) & (F.array_max(F.transform(points, lambda p: p["y"])) == F.col("maxy"))
        found = [
            out(f.where("id = 0"), "id is zero"),
            out(f.where("id > 50000000000"), "id is very large"),
            out(f.groupBy("ftype", "id").count().where("count > 1"), "id comes twice"),
            out(f.where("tile is null"), "no tile"),
            out(f.where((F.col("ftype") == "node") & located & ~F.coalesce(own, F.lit(True))), "node outside its tile"),
            out(f.where(flags[1].isNotNull() & F.col("parents").isNotNull()), "orphan is a member"),
            out(f.where(F.coalesce(flags[0] != "yes", F.lit(False)) | F.coalesce(flags[1] != "yes", F.lit(False))), "synthetic tag is not yes"),
            out(f.where((flags[0].isNotNull() | flags[1].isNotNull()) & F.exists(F.map_keys("tags"), lambda k: ~k.startswith(T.SYNTHETIC))), "synthetic tag beside others"),
            out(f.where(no_bounds), "empty bounds"),
            out(f.where(F.col("ftype").isin("node", "way") & located & ~tight), "bounds are not tight"),
            out(f.where((F.col("ftype") == "node") & F.col("is_area")), "node is an area"),
            out(f.where(((F.col("itype") == "a") != F.col("is_area")) | (~F.col("is_area") & (F.col("itype") != F.substring("ftype", 1, 1)))), "wrong index"),
        ]
        if self.has("checksums"):
            now, then = self.tile_hashes(), self.table("checksums").withColumnsRenamed({"features": "_n", "checksum": "_sum"})
            loaded = then.join(self.table("tiles").select(tiling.tile_name(F.col("zoom"), F.col("col"), F.col("row")).alias("tile")), "tile", "left_semi")
            differ = loaded.join(now, "tile", "full_outer").where("not (features <=> _n and checksum <=> _sum)")
            found.append(differ.select(F.lit("tile").alias("ftype"), F.lit(0).cast("long").alias("id"), F.concat(F.lit("checksum differs: "), F.coalesce("tile", F.lit("none"))).alias("problem")))
        whole = found[0]
        for x in found[1:]:
            whole = whole.unionByName(x)
        return whole

    def save(self, bundle: str, bbox: tuple[float, ...] | None = None, rings: list[area.Ring] | None = None) -> Store:
        """Write the tiles that meet an area (all without one) as a bundle."""
        return self._copy(bundle, self._tiles_in(bbox, rings))

    def _tiles_in(self, bbox: tuple[float, ...] | None, rings: list[area.Ring] | None) -> DataFrame:
        tiles = self.table("tiles")
        box = area.ring_box(area.ring_units(rings)) if rings else area.box_units(bbox) if bbox else None
        if box:
            # A tile of each zoom has its own extent; the root, which all areas need, is always in.
            extent = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - F.col("zoom"))
            x0 = F.col("col").cast("long") * extent - 2**31
            y1 = F.lit(2**31 - 1) - F.col("row").cast("long") * extent
            boxed = tiles.withColumns({"minx": x0, "maxx": x0 + extent - 1, "maxy": y1, "miny": y1 - extent + 1})
            tiles = boxed.where(area.meets_box(box)).select(*tiles.columns)
        return tiles.withColumn("tile", tiling.tile_name(F.col("zoom"), F.col("col"), F.col("row")))

    def _copy(self, to: str, tiles: DataFrame) -> Store:
        other = Store(self.spark, to)
        if other.exists():
            raise StoreError(f"{to} exists")
        names = tiles.select("tile")
        out = lambda df: df.write.option("compression", "zstd")
        out(tiles.drop("tile")).parquet(f"{to}/tiles")
        out(self.table("features").join(names, "tile", "left_semi").sortWithinPartitions("itype", "tile", "hilbert")).partitionBy("itype").parquet(f"{to}/features")
        out(self.table("nodes").join(names, "tile", "left_semi")).parquet(f"{to}/nodes")
        for name in ("catalog", "strings", "indexes", "checksums"):
            out(self.table(name)).parquet(f"{to}/{name}")
        other._write_meta(self.meta())
        return other

    def missing_tiles(self) -> DataFrame:
        """Tiles of the build that are not loaded, without those below another missing one."""
        key = ["zoom", "col", "row"]
        missing = self.table("catalog").join(self.table("tiles").select(*key), key, "left_anti")
        levels = T.parse_zoom_levels(self.meta()["levels"])
        up = lambda c, z: F.call_function("shiftright", F.col(c), F.col("zoom") - z).alias(c)
        above = F.filter(F.array(*(F.struct(F.lit(z).alias("zoom"), up("col", z), up("row", z)) for z in levels)), lambda t: t["zoom"] < F.col("zoom"))
        ancestors = missing.select(*key, F.explode(above).alias("a"))
        hidden = ancestors.join(missing.select(F.struct(*key).alias("a")), "a", "left_semi").select(*key).distinct()
        return missing.join(hidden, key, "left_anti")

    def load(self, bundle_path: str, bbox: tuple[float, ...] | None = None, rings: list[area.Ring] | None = None) -> int:
        """Add a bundle's tiles that are missing, of an area or all; the number of tiles added. A store that does not exist is made of them.

        The bundle must come from the same build, and agree on node ids of ways.
        """
        bundle = Store(self.spark, bundle_path)
        wanted = bundle._tiles_in(bbox, rings)
        if not self.exists():
            bundle._copy(self.path, wanted)
            return wanted.count()
        mine, theirs = self.meta(), bundle.meta()
        if mine["guid"] != theirs["guid"]:
            raise StoreError("the bundle is of another build")
        if mine["waynode_ids"] != theirs["waynode_ids"]:
            raise StoreError("bundle and store differ in node ids of ways")
        new = materialize(wanted.join(self.table("tiles").select("zoom", "col", "row"), ["zoom", "col", "row"], "left_anti"), "new-tiles")
        n = new.count()
        if n:
            names = new.select("tile")
            bundle.table("features").join(names, "tile", "left_semi").sortWithinPartitions("itype", "tile", "hilbert").write.mode("append").partitionBy("itype").parquet(f"{self.path}/features")
            bundle.table("nodes").join(names, "tile", "left_semi").write.mode("append").parquet(f"{self.path}/nodes")
            # Tiles come last: until then nothing counts as loaded.
            new.drop("tile").write.mode("append").parquet(f"{self.path}/tiles")
        return n


    def graph(self) -> Graph:
        """The elements of the store as a graph, each of version 0. Ways need their node ids, so the store must keep them."""
        if self.meta()["waynode_ids"] != "True":
            raise StoreError("the store has no node ids of ways; build it with waynode_ids")
        f = self.table("features")
        real = T.without_synthetic(F.col("tags")).alias("tags")
        one = (F.lit(0).alias("version"), F.lit(False).alias("is_deleted"))
        tagged = f.where("ftype = 'node'").select("id", real)
        nodes = self.table("nodes").select("id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).join(tagged, "id", "left").select("id", *one, "x", "y", "tags")
        kind = lambda t: f.where(F.col("ftype") == t)
        return Graph(nodes, kind("way").select("id", *one, "node_ids", real), kind("relation").select("id", *one, F.col("source_members").alias("members"), real))

    def update(self, changes: DataFrame, path: str, revision: dict[str, str] | None = None) -> Store:
        """The store after changes, written to `path`: the same as a build from the merged elements. The store must be updatable."""
        meta = self.meta()
        if meta["updatable"] != "True":
            raise StoreError("the store was not built to be updated")
        from geoweft.operators import changeset

        before = self.graph()
        eff = materialize(changeset.effective(before, changes), "effective")
        kinds = {f.name: f.type for f in fields(BuildOptions)}
        options = BuildOptions(**{k: (meta[k] == "True") if t == "bool" else int(meta[k]) if t == "int" else meta[k] for k, t in kinds.items()})
        return Store.build(changeset.future(before, eff), path, options, {"guid": meta["guid"], "revision": str(int(meta["revision"]) + 1)} | (revision or {}))


def rebuild(graph: Graph, options: BuildOptions | None = None) -> Store:
    """A store in the shared folder, for queries that need one for a moment."""
    return Store.build(graph, scratch_path(graph.tables["node"].sparkSession, "store"), options)
