"""Files in hash buckets of keys, written and read so that the planner knows: joins and aggregates on the keys then move nothing.

Spark keeps the layout of buckets in its catalog only. So files are written through a table that exists for the moment of writing, and read through a table
whose partitions are the folders that some manifest has named. Such tables hold no data of their own and go with the session.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Partitions that one statement adds to a reading table.
STATEMENT = 500


def bucket_of(keys: Sequence[str], n: int) -> Column:
    """The number of the bucket, as Spark's own bucketing has it."""
    return F.pmod(F.hash(*keys), F.lit(n)).cast("int")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the plans made within; names have `__` for the point."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_bucket_order(spark: SparkSession):
    """Plans made within read each bucket as one task and trust that a bucket of one file is sorted."""
    return settings(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__sources__bucketing__autoBucketedScan__enabled="false")


def write_buckets(rows: DataFrame, path: str, keys: Sequence[str], n: int, folders: Sequence[str] = ()) -> None:
    """Write `rows` in `n` buckets sorted by `keys`, in folders by the columns `folders`. A bucket is one file if its rows come in one task."""
    name = f"geoweft_{uuid.uuid4().hex}"
    out = rows.write.format("parquet").option("path", path)
    try:
        (out.partitionBy(*folders) if folders else out).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    finally:
        rows.sparkSession.sql(f"drop table if exists {name}")


def read_buckets(spark: SparkSession, schema: StructType, keys: Sequence[str], n: int, folders: Mapping[int, str]) -> DataFrame:
    """The rows of numbered folders, each written by `write_buckets` with the same keys and number of buckets."""
    if not folders:
        return spark.createDataFrame([], schema)
    name, part = f"geoweft_{uuid.uuid4().hex}", f"_part_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    held = ", ".join(f"`{k}`" for k in keys)
    at = folders[next(iter(folders))]
    spark.sql(f"create table {name} ({columns}, {part} int) using parquet partitioned by ({part}) clustered by ({held}) sorted by ({held}) into {n} buckets location '{at}'")
    each = [f"partition ({part}={b}) location '{path}'" for b, path in folders.items()]
    for i in range(0, len(each), STATEMENT):
        spark.sql(f"alter table {name} add {' '.join(each[i : i + STATEMENT])}")
    return spark.table(name).select(*(f"`{f.name}`" for f in schema.fields))
