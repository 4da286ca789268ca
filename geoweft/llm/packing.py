"""Fixed-capacity containers filled with items, by conflict-constrained best fit.

Items of one container kind are dealt by hash into blocks of a bounded number of items; each block is packed on its own, the
longest items first. Open containers are kept by what they have left; the search starts at the item's size and goes on to the
next larger remainder until a container without a conflict is found, else a new one is opened. Containers carry bitmaps of the
sources and duplicate clusters they hold: a second item of one duplicate cluster is a conflict, and among containers of the
tightest remainder that fits, one without the item's source is taken before others.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a block on average: blocks waste about one container each, and bound a task's memory.
BLOCK_ITEMS = 20_000

PLACED = "container_kind string, container_id string, capacity_tokens long, doc_id long, piece int, first_token long, n_tokens long, slot int, used_tokens long"


class OpenBins:
    """Open containers by remaining room, with a bitmap of the rooms that occur for the successor search.

    Those of one room lie by their bitmap of sources, and of each room it is known how many hold a cluster: a room of which all do is passed at once.
    """

    def __init__(self) -> None:
        self.rooms = 0
        self.by_room: dict[int, dict[int, dict[int, None]]] = {}
        self.sizes: dict[int, int] = defaultdict(int)
        self.holding: dict[tuple[int, int], int] = defaultdict(int)

    def add(self, room: int, bin_no: int, sources: int, clusters: list[int]) -> None:
        self.rooms |= 1 << room
        self.by_room.setdefault(room, {}).setdefault(sources, {})[bin_no] = None
        self.sizes[room] += 1
        for c in clusters:
            self.holding[room, c] += 1

    def remove(self, room: int, bin_no: int, sources: int, clusters: list[int]) -> None:
        held = self.by_room[room]
        del held[sources][bin_no]
        if not held[sources]:
            del held[sources]
        self.sizes[room] -= 1
        if not held:
            del self.by_room[room]
            self.rooms &= ~(1 << room)
        for c in clusters:
            self.holding[room, c] -= 1

    def from_room(self, least: int):
        """Rooms of at least `least` that occur, in ascending order."""
        rest = self.rooms >> least
        at = least
        while rest:
            step = (rest & -rest).bit_length() - 1
            at += step
            yield at
            rest >>= step + 1
            at += 1

    def tightest(self, size: int, source: int, cluster: int, held_clusters: list[int], source_conflict: bool) -> tuple[int, int] | None:
        """Room and number of a container of the least room that takes the item without conflict; one without its source before others, if one may hold it twice."""
        s, c = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        for room in self.from_room(size):
            if c and self.holding.get((room, cluster), 0) == self.sizes[room]:
                continue
            for again in (False,) if source_conflict else (False, True):
                for sources, bins in self.by_room[room].items():
                    if bool(sources & s) == again:
                        for b in bins:
                            if not held_clusters[b] & c:
                                return room, b
        return None


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, source_conflict: bool = False) -> list[int]:
    """The container number of each item; no size exceeds `capacity`. Sources and clusters are small numbers, -1 for none.

    A duplicate cluster is met by its bit in the container's bitmap; the bitmaps number the clusters of the block that have more
    than one item, so other items are never in conflict. With `source_conflict` a second item of one source is a conflict as well.
    """
    open_bins = OpenBins()
    room: list[int] = []
    held_clusters: list[int] = []
    held_sources: list[int] = []
    lists: list[list[int]] = []
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = open_bins.tightest(sizes[i], sources[i], clusters[i], held_clusters, source_conflict)
        if found is None:
            b = len(room)
            room.append(capacity)
            held_clusters.append(0)
            held_sources.append(0)
            lists.append([])
        else:
            b = found[1]
            open_bins.remove(room[b], b, held_sources[b], lists[b])
        room[b] -= sizes[i]
        if clusters[i] >= 0:
            held_clusters[b] |= 1 << clusters[i]
            lists[b].append(clusters[i])
        if sources[i] >= 0:
            held_sources[b] |= 1 << sources[i]
        open_bins.add(room[b], b, held_sources[b], lists[b])
        out[i] = b
    return out


def least_containers(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing of so many items of these sizes has fewer containers: items over half a container are alone, and what is left beside them holds only so much.

    For each least size a: items over capacity - a share a container with no item of a or more; the others over a half have a container
    each, and items from a to a half fill what those leave before they need more. The greatest bound over all a counts.
    """
    n, volume = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    np.add.at(n, sizes, counts)
    np.add.at(volume, sizes, sizes * counts)
    n, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(volume)])  # of sizes below the index
    half, best = capacity // 2, 0
    for a in range(0, half + 1):
        alone, shared = n[capacity + 1] - n[capacity - a + 1], n[capacity - a + 1] - n[half + 1]
        left = shared * capacity - (volume[capacity - a + 1] - volume[half + 1])
        small = volume[half + 1] - volume[a]
        best = max(best, int(alone + shared + max(0, -(-(small - left) // capacity))))
    return best


def _codes(values: list, shared_only: bool = False) -> list[int]:
    """Small numbers for values in order of appearance, -1 for null; with `shared_only` also for values that occur once."""
    count: dict = defaultdict(int)
    for v in values:
        count[v] += 1
    numbers: dict = {}
    return [-1 if v is None or (shared_only and count[v] < 2) else numbers.setdefault(v, len(numbers)) for v in values]


def _pack_block(rows: pd.DataFrame, source_conflict: bool = False) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece", "nth", "n_tokens"], kind="stable")
    kind, block, capacity = rows["container_kind"].iloc[0], int(rows["block"].iloc[0]), int(rows["capacity_tokens"].iloc[0])
    none = lambda s: [None if pd.isna(v) else v for v in s]
    sizes = rows["n_tokens"].tolist()
    placed = best_fit(sizes, _codes(none(rows["source"])), _codes(none(rows["cluster"]), shared_only=True), capacity, source_conflict)
    out = rows.assign(container_id=[f"{kind}-{block}-{b}" for b in placed])
    out["slot"] = out.groupby("container_id").cumcount().astype("int32")
    out["used_tokens"] = out.groupby("container_id")["n_tokens"].transform("sum")
    return out[[c.split()[0] for c in PLACED.split(", ")]]


def pieces(items: DataFrame, containers: DataFrame) -> DataFrame:
    """Items of `doc_id`, `source`, `cluster`, `nth` (of equal rows), `n_tokens`, cut only where they exceed a capacity alone: into whole containers and a rest.

    `containers` (container_kind, capacity_tokens) is read by the driver; it may have at most 1,000 rows. Kinds without a
    positive capacity are left out, as are items of null size; an item of no tokens is a piece of no tokens.
    """
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("long")).where("container_kind is not null and capacity_tokens > 0").distinct().limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1,000 container kinds")
    if not kinds:
        return items.limit(0).select(F.lit("").alias("container_kind"), F.lit(0).cast("long").alias("capacity_tokens"), "doc_id", "source", "cluster", "nth", F.col("n_tokens").alias("whole_tokens"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "n_tokens")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity_tokens")) for k, c in kinds)))
    rows = items.where("n_tokens is not null").select("*", each.alias("_k")).select("doc_id", "source", "cluster", "nth", F.col("n_tokens").alias("whole_tokens"), "_k.*")
    last = F.greatest(F.ceil(F.col("whole_tokens") / F.col("capacity_tokens")), F.lit(1)) - 1
    cut = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_p"))
    start = F.col("_p") * F.col("capacity_tokens")
    size = F.least(F.col("whole_tokens") - start, F.col("capacity_tokens"))
    return cut.select("container_kind", "capacity_tokens", "doc_id", "source", "cluster", "nth", "whole_tokens", F.col("_p").cast("int").alias("piece"), start.alias("first_token"), size.alias("n_tokens"))


def pack(items: DataFrame, containers: DataFrame, block_items: int = BLOCK_ITEMS, source_conflict: bool = False) -> DataFrame:
    """Every piece of every item in a container of every kind: PLACED. `items`: doc_id, source, cluster, n_tokens.

    Full pieces fill a container alone, so only rests and short items are searched for. Blocks are of one kind and about
    `block_items` items, by a hash of the whole item, its number among equal rows and its piece: one document, source or cluster with a third of all rows spreads over all blocks. Where so
    many items of a cluster are in a block that no container is free of it, each opens its own: that room is lost to the conflict.
    Repeated rows are items of their own. `source_conflict` keeps items of one source apart as well, at the price of room.
    """
    blocks = max(1, math.ceil(items.count() / block_items))
    # Repeated rows are numbered, so that each has containers of its own.
    columns = ["doc_id", "source", "cluster", "n_tokens"]
    each = items.groupBy(*columns).agg(F.count("*").alias("_n")).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("nth"))
    cut = pieces(each, containers)
    full = cut.where("n_tokens = capacity_tokens").select(
        "container_kind", F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", "piece", "nth", F.hex(F.hash("source", "cluster", "whole_tokens"))).alias("container_id"), "capacity_tokens", "doc_id", "piece", "first_token", "n_tokens", F.lit(0).alias("slot"), F.col("n_tokens").alias("used_tokens")
    )
    rest = cut.where("n_tokens < capacity_tokens").withColumn("block", F.pmod(F.xxhash64("doc_id", "source", "cluster", "nth", "piece", F.lit(7)), F.lit(blocks)).cast("int"))
    return full.unionByName(rest.groupBy("container_kind", "block").applyInPandas(lambda block: _pack_block(block, source_conflict), PLACED))


def fill_report(placed: DataFrame) -> DataFrame:
    """Per container kind: containers, tokens, the share of the room that is used, and `least`, how many containers any packing of these pieces needs by their sizes.

    A kind has no more sizes than its capacity, so the bound is found on that many rows.
    """
    sizes = placed.groupBy("container_kind", "capacity_tokens", "n_tokens").agg(F.count("*").alias("n"), F.sum(F.when(F.col("slot") == 0, 1).otherwise(0)).alias("opened"))

    def report(rows: pd.DataFrame) -> pd.DataFrame:
        capacity, containers, tokens = int(rows["capacity_tokens"].iloc[0]), int(rows["opened"].sum()), int((rows["n_tokens"] * rows["n"]).sum())
        least = least_containers(rows["n_tokens"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"container_kind": [rows["container_kind"].iloc[0]], "containers": [containers], "tokens": [tokens], "filled": [tokens / (containers * capacity)], "least": [least]})

    return sizes.groupBy("container_kind").applyInPandas(report, "container_kind string, containers long, tokens long, filled double, least long")
