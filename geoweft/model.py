"""The graph of elements: nodes, ways and relations as current, live rows, and schemas of the derived tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.operators.current import current_narrow, current_wide
from geoweft.session import table

MEMBERS = "array<struct<pos:int,type:string,ref:bigint,role:string>>"
TAGS = "map<string,string>"
NODES = f"id long, version int, ts timestamp, lon int, lat int, x int, y int, tile string, is_deleted boolean, tags {TAGS}"
WAYS = f"id long, version int, ts timestamp, node_ids array<bigint>, is_deleted boolean, tags {TAGS}"
RELATIONS = f"id long, version int, ts timestamp, members {MEMBERS}, is_deleted boolean, tags {TAGS}"


def member_type(column: Column) -> Column:
    """node, way or relation by the first letter of a member type, any case; null for others."""
    letter = F.lower(F.substring(column, 1, 1))
    return F.when(letter == "n", "node").when(letter == "w", "way").when(letter == "r", "relation")


class Graph:
    """Elements by type, of which each call names the columns it needs: the rest is never read.

    Rows are those of versioned tables (`nodes`, `ways`, `relations`); of each id the current one is taken, and left out if deleted.
    """

    def __init__(self, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> None:
        self.tables = {"node": nodes, "way": ways, "relation": relations}
        self._known: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What several operators derive from this graph and write down: made on first use."""
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Graph:
        return cls(*(table(spark, folder, t) for t in ("nodes", "ways", "relations")))

    def _rows(self, ftype: str, columns: Sequence[str]) -> DataFrame:
        rows = self.tables[ftype]
        narrow = all(rows.schema[c].dataType.typeName() not in ("map", "array", "string") for c in columns)
        pick = current_narrow if narrow else current_wide
        if "tags" not in columns:
            return pick(rows, columns).where("not is_deleted").select("id", *columns)
        # Maps have no order, so they take part as their sorted entries.
        entries = rows.withColumn("tags", F.array_sort(F.map_entries("tags")))
        return pick(entries, columns).where("not is_deleted").select("id", *columns).withColumn("tags", F.map_from_entries("tags"))

    def ids(self, ftype: str) -> DataFrame:
        """Ids of the current, live elements of a type."""
        return current_narrow(self.tables[ftype], []).where("not is_deleted").select("id")

    def nodes(self, *columns: str) -> DataFrame:
        return self._rows("node", columns or ("x", "y"))

    def located_nodes(self, *columns: str) -> DataFrame:
        """Nodes that have a position: others resolve nothing and are no features."""
        return self._rows("node", tuple(dict.fromkeys((*columns, "x", "y")))).where("x is not null and y is not null")

    def ways(self, *columns: str) -> DataFrame:
        return self._rows("way", columns or ("node_ids",))

    def relations(self, *columns: str) -> DataFrame:
        return self._rows("relation", columns or ("members",))
