"""A change feed as a stream: micro-batches merged into a bucketed table.

Files arrive in a folder; each micro-batch is reduced to its deciding changes and merged copy-on-write. The manifest records
the last batch, so a batch that is delivered again after a failure changes nothing, and late or repeated changes
leave the state that all changes at once would have left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from geoweft.operators import changeset, upsert
from geoweft.sources import osc

SCHEMA = (
    "seq long, ftype string, id long, version int, op string, is_deleted boolean, ts timestamp, lat double, lon double, x int, y int, "
    "refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, tags array<struct<k:string,v:string>>"
)


def state_table(spark: SparkSession, base: DataFrame, path: str, values: tuple[str, ...] = ()) -> upsert.BucketedTable:
    """A table to merge into, from `base` (ftype, id, version, is_deleted, seq, values)."""
    return upsert.BucketedTable.create(base.select(*changeset.KEYS, "version", "is_deleted", "seq", *values), changeset.KEYS, path=path)


def merge_batch(store: upsert.BucketedTable, changes: DataFrame, batch: int, values: tuple[str, ...] = ()) -> bool:
    """Merge one micro-batch; False if the manifest has it already."""
    if store.manifest().get("batch", -1) >= batch:
        return False
    store.apply(changeset.latest(changes, values), upsert.merge_versions(changeset.KEYS, values), batch=batch)
    return True


def follow(spark: SparkSession, folder: str, store: upsert.BucketedTable, checkpoint: str, files_per_batch: int = 8, values: tuple[str, ...] = (), available_now: bool = True) -> StreamingQuery:
    """Start a query that reads change files (Parquet) as they arrive, some per batch, and merges them."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return _start(stream, lambda df, n: df, store, checkpoint, values, available_now)


def follow_files(spark: SparkSession, folder: str, store: upsert.BucketedTable, checkpoint: str, files_per_batch: int = 64, values: tuple[str, ...] = (), available_now: bool = True) -> StreamingQuery:
    """As `follow`, for OSM change files (.osc, .osc.gz) of a replication folder with its folders of sequences.

    Sequence numbers of changes grow with the batch, the file's name and the place in the file.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    stream = stream.option("pathGlobFilter", "*.{osc,osc.gz}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return _start(stream, lambda df, n: osc.parse_files(df, n), store, checkpoint, values, available_now)


def _start(stream: DataFrame, changes: Callable[[DataFrame, int], DataFrame], store: upsert.BucketedTable, checkpoint: str, values: tuple[str, ...], available_now: bool) -> StreamingQuery:
    def each(df: DataFrame, n: int) -> None:
        merge_batch(store, changes(df, n), n, values)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
