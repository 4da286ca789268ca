"""A stream of inserts, updates and deletes onto a table: bucketed copy-on-write.

The base lies in hash buckets of its key, one folder per bucket and generation, and a manifest names the folder in force of each.
Changes are reduced to the deciding one per key before they move, routed to their buckets, and sort-merged with the touched
buckets only. The base moves nowhere: its buckets are read as they lie, sorted, each by the task that gets its changes. Replacement folders are
written beside the old ones and a new manifest is committed at the end: a job that dies leaves the old state, and readers of an old manifest keep
a whole table until `vacuum` removes what no kept manifest names. Buckets that have grown are split where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoweft.buckets import bucket_of, in_bucket_order, read_buckets, write_buckets
from geoweft.session import filesystem, list_names, materialize, numbered_json, partitions, remove, scratch_path, write_json

#: Average bytes of a bucket from which buckets are split.
SPLIT_BYTES = 1 << 29


class BucketedTable:
    """A table in hash buckets of `keys` with a manifest per generation."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], path: str) -> None:
        self.spark, self.keys, self.path = spark, list(keys), path

    @classmethod
    def create(cls, rows: DataFrame, keys: Sequence[str], buckets: int | None = None, path: str | None = None, grouped: bool = False) -> BucketedTable:
        """Write `rows` (one per key) as generation 1. `buckets` is as the session's shuffle partitions unless given.

        `grouped` says that `rows` come from an aggregate on exactly these keys: they lie in their buckets already and are not moved again.
        """
        spark = rows.sparkSession
        self = cls(spark, keys, path or scratch_path(spark, "buckets"))
        n = buckets or partitions(spark)
        placed = rows if grouped and n == partitions(spark) else rows.repartition(n, *keys)
        written = self._write(placed, n, 1)
        self._commit({"generation": 1, "buckets": n, "folders": written, "schema": rows.schema.jsonValue()})
        self._split_large()
        return self

    def _write(self, rows: DataFrame, n: int, generation: int) -> dict[str, str]:
        folder = f"generation={generation}"
        write_buckets(rows.withColumn("_bucket", bucket_of(self.keys, n)), f"{self.path}/{folder}", self.keys, n, ["_bucket"])
        return {x.split("=")[1]: f"{folder}/{x}" for x in list_names(self.spark, f"{self.path}/{folder}") if x.startswith("_bucket=")}

    def _commit(self, manifest: dict) -> None:
        write_json(self.spark, f"{self.path}/manifest-{manifest['generation']}.json", manifest)

    def manifest(self) -> dict:
        return numbered_json(self.spark, self.path, "manifest-")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table in force, or only the given buckets of it."""
        m = self.manifest()
        held = {int(b): f"{self.path}/{f}" for b, f in m["folders"].items() if buckets is None or int(b) in set(buckets)}
        return read_buckets(self.spark, StructType.fromJson(m["schema"]), self.keys, m["buckets"], held)

    def apply(self, deciding: DataFrame, merge, batch: int | None = None) -> list[int]:
        """Merge `deciding` (one row per key) into the touched buckets and commit; the buckets rewritten come back.

        `merge(base, changes)` gets both sides of the touched buckets and returns rows of the base's schema. The bucket
        numbers are all that the driver sees, as many as there are buckets at most. `batch` is recorded in the manifest.
        """
        m = self.manifest()
        n, generation = m["buckets"], m["generation"] + 1
        deciding = materialize(deciding, "deciding")
        touched = sorted(r[0] for r in deciding.select(bucket_of(self.keys, n).alias("b")).distinct().collect())
        mark = {} if batch is None else {"batch": batch}
        if not touched:
            if mark:
                self._commit({**m, **mark, "generation": generation})
            return []
        base = self.read(touched)
        with in_bucket_order(self.spark):
            written = self._write(merge(base, deciding).select(*base.columns), n, generation)
        folders = {b: f for b, f in m["folders"].items() if int(b) not in set(touched)} | written
        self._commit({**m, **mark, "generation": generation, "folders": folders})
        self._split_large()
        return touched

    def bytes(self) -> int:
        """Bytes of the files in force."""
        total = 0
        for f in self.manifest()["folders"].values():
            fs, where = filesystem(self.spark, f"{self.path}/{f}")
            total += fs.getContentSummary(where).getLength()
        return total

    def split(self, factor: int = 2) -> None:
        """Cut each bucket into `factor`, in the task that reads it: a key's bucket of the larger number is among those that its old one becomes."""
        m = self.manifest()
        n, generation = m["buckets"] * factor, m["generation"] + 1
        with in_bucket_order(self.spark):
            written = self._write(self.read(), n, generation)
        self._commit({**m, "generation": generation, "buckets": n, "folders": written})

    def _split_large(self) -> None:
        share = self.bytes() / self.manifest()["buckets"] / SPLIT_BYTES
        if share > 1:
            self.split(1 << (int(share)).bit_length())

    def vacuum(self, keep: int = 1) -> int:
        """Remove manifests but the last `keep`, and all folders that those do not name; how many folders went."""
        names = list_names(self.spark, self.path)
        numbers = sorted(int(x[9:-5]) for x in names if x.startswith("manifest-") and x.endswith(".json"))
        kept = [numbered_json(self.spark, self.path, "manifest-", i) for i in numbers[-max(keep, 1) :]]
        held = {f for m in kept for f in m["folders"].values()}
        newest = max(m["generation"] for m in kept)
        gone = 0
        for g in (x for x in names if x.startswith("generation=") and int(x[11:]) <= newest):
            folders = [f"{g}/{x}" for x in list_names(self.spark, f"{self.path}/{g}") if x.startswith("_bucket=")]
            for f in folders:
                if f not in held:
                    remove(self.spark, f"{self.path}/{f}")
                    gone += 1
            if not any(f in held for f in folders):
                remove(self.spark, f"{self.path}/{g}")
        for i in numbers[: -max(keep, 1)]:
            remove(self.spark, f"{self.path}/manifest-{i}.json")
        return gone


def deciding_changes(changes: DataFrame, keys: Sequence[str], version: str, deletes: str, seq: str, values: Sequence[str] = ()) -> DataFrame:
    """The change that decides each key: greatest version, a delete before others, then the lowest sequence number.

    Changes without a version or with a null in the key are ignored; repeats change nothing, nor does the order of arrival.
    A null sequence number comes last. One partial maximum per key and task goes into the shuffle, so hot keys stay small.
    """
    order = F.struct(F.col(version).alias("v"), F.col(deletes).alias("d"), (-F.coalesce(F.col(seq), F.lit(2**63 - 1))).alias("s"), F.xxhash64(*values) if values else F.lit(0))
    kept = changes.where(" and ".join(f"`{c}` is not null" for c in (*keys, version)))
    row = F.struct(F.col(version).alias("version"), F.col(deletes).alias("is_delete"), F.col(seq).alias("seq"), *values)
    return kept.select(*keys, order.alias("_o"), row.alias("_r")).groupBy(*keys).agg(F.max_by("_r", "_o").alias("_r")).select(*keys, "_r.*")


def merge_versions(keys: Sequence[str], values: Sequence[str] = ()):
    """A merge for `BucketedTable.apply`: a change takes effect if its version, plus 1 for a delete, exceeds the base's (0 without one).

    The base has `version`, `is_deleted`, `seq` (of the change that set the row, null for an original one), `values`. Against a row that a
    change has set, the order of `deciding_changes` holds instead: a change that comes late, or again, in another batch leaves
    what all of them at once would have left. An element that a change decides takes its values (null if deleted) and its seq.
    A change without effect on anything adds no row.
    """

    def merge(base: DataFrame, changes: DataFrame) -> DataFrame:
        b, c = base.alias("b"), changes.alias("c")
        # Plain equality, as changes have no null keys: only so do the base's buckets serve the join.
        joined = b.join(c, [F.col(f"b.{k}") == F.col(f"c.{k}") for k in keys], "full_outer")
        original = F.col("c.version") + F.col("c.is_delete").cast("int") > F.coalesce(F.col("b.version"), F.lit(0))
        same = F.col("c.version") == F.col("b.version")
        sooner = (F.col("c.is_delete") & ~F.col("b.is_deleted")) | ((F.col("c.is_delete") == F.col("b.is_deleted")) & (F.col("c.seq") < F.col("b.seq")))
        effect = F.coalesce(F.when(F.col("b.seq").isNull(), original).otherwise((F.col("c.version") > F.col("b.version")) | (same & sooner)), F.lit(False))
        there = F.col("b.is_deleted").isNotNull() | effect
        pick = lambda name: F.when(effect, F.when(~F.col("c.is_delete"), F.col(f"c.{name}"))).otherwise(F.col(f"b.{name}")).alias(name)
        either = lambda now, name: F.when(effect, F.col(f"c.{now}")).otherwise(F.col(f"b.{name}")).alias(name)
        return joined.where(there).select(
            *(F.coalesce(f"b.{k}", f"c.{k}").alias(k) for k in keys), either("version", "version"), either("is_delete", "is_deleted"), either("seq", "seq"), *(pick(v) for v in values)
        )

    return merge
