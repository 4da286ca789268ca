"""Attribute-value rows into wide tables, log-structured.

A batch of rows becomes a sparse wide delta: one row per entity, one cell per attribute that the batch has, each cell with the
version that set it. Deltas are written as runs in the same hash buckets of the entity, each sorted by it. Compaction reads the runs bucket by bucket, moves
nothing, and keeps, per cell, the latest version; as that merge is associative and idempotent, late and redelivered batches need no special case.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoweft.buckets import in_bucket_order, read_buckets, write_buckets
from geoweft.session import list_names, numbered_json, partitions, remove, scratch_path, write_json

#: Most columns that a wide table may have; the specification is read by the driver.
MOST_COLUMNS = 2000


@dataclass(frozen=True)
class WideColumn:
    attribute: str
    name: str
    type: str


def wide_columns(spec: DataFrame) -> list[WideColumn]:
    """Columns from rows `k`, `col_name`, `col_type`; at most MOST_COLUMNS, else an error. Incomplete rows are no columns."""
    rows = spec.select("k", "col_name", "col_type").where("k is not null and col_name is not null and col_type is not null").distinct().limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} wide columns")
    return sorted((WideColumn(*r) for r in rows), key=lambda c: (c.name, c.attribute))


def cell_text(value: Column, kind: str) -> Column:
    """The one text form of `value` as a cell of the type `kind`; null where it does not fit. Types: integer, decimal, boolean, date, text."""
    v = F.trim(value)
    if kind == "text":
        return F.when(v != "", v)
    if kind == "integer":
        return F.when(v.rlike(r"\A[+-]?[0-9]+\z"), v.try_cast("long").cast("string"))
    if kind == "decimal":
        whole = F.regexp_replace(F.regexp_extract(v, r"\A[+-]?([0-9]+)", 1), r"\A0+(?=[0-9])", "")
        cents = F.rpad(F.regexp_extract(v, r"\.([0-9]+)\z", 1), 2, "0")
        sign = F.when(v.startswith("-") & ((whole != "0") | (cents != "00")), "-").otherwise("")
        return F.when(v.rlike(r"\A[+-]?[0-9]+(\.[0-9]{1,2})?\z"), F.concat(sign, whole, F.lit("."), cents))
    if kind == "boolean":
        low = F.lower(v)
        return F.when(low.isin("yes", "true", "1"), "true").when(low.isin("no", "false", "0"), "false")
    if kind == "date":
        return F.when(v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~v.startswith("0000"), v.try_cast("date").cast("string"))
    raise ValueError(f"unknown column type {kind!r}")


SQL_TYPES = {"integer": "long", "decimal": "decimal(38,2)", "boolean": "boolean", "date": "date", "text": "string"}


def sparse_delta(rows: DataFrame, keys: Sequence[str], attribute: str, value: str, version: Sequence[str], columns: list[WideColumn], also: Sequence[str] = ()) -> DataFrame:
    """One sparse wide row per entity (and `also`): `keys`, and per column a struct of `version` and the value, null where the batch has none.

    Attributes meet their column trimmed and in lower case; other attributes have no column. Versions compare in order, null lowest;
    on a full tie the greater value is taken, null lowest. Rows with a null key are no entity. Cells keep raw values, even null ones:
    an unusable value still hides older ones. Partial results form before the shuffle, so a hot entity costs one row per task.
    """
    k = F.lower(F.trim(F.col(attribute)))
    wanted = sorted({c.attribute for c in columns})
    cells = F.struct(*(F.col(v) for v in version), F.col(value).alias("_v"))
    kept = rows.where(k.isin(wanted)).where(" and ".join(f"`{c}` is not null" for c in keys)) if wanted else rows.limit(0)
    picked = kept.select(*keys, *also, k.alias("_k"), cells.alias("_cell"))
    if not columns:
        return picked.select(*keys, *also)
    return picked.groupBy(*keys, *also).agg(*(F.max(F.when(F.col("_k") == c.attribute, F.col("_cell"))).alias(c.name) for c in columns))


def merge_runs(runs: DataFrame, keys: Sequence[str], columns: list[WideColumn]) -> DataFrame:
    """Compact rows of several runs: per entity and cell the latest version."""
    if not columns:
        return runs.select(*keys).distinct()
    return runs.groupBy(*keys).agg(*(F.max(c.name).alias(c.name) for c in columns))


class WideLog:
    """A wide table as a log of runs in a folder, with a manifest that names the runs in force and their one number of buckets."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], columns: list[WideColumn], path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.keys, self.columns = spark, list(keys), columns
        self.path = path or scratch_path(spark, "wide")
        self.buckets = buckets or partitions(spark)

    def _manifest(self) -> dict:
        return numbered_json(self.spark, self.path, "manifest-") or {"number": 0, "runs": [], "schema": None, "buckets": self.buckets, "compact": False}

    def _commit(self, was: dict, runs: list[str], schema: StructType, compact: bool = False) -> None:
        held = {f["name"]: f for f in schema.jsonValue()["fields"]}
        fields = [held[c] for c in (*self.keys, *(c.name for c in self.columns))]
        write_json(self.spark, f"{self.path}/manifest-{was['number'] + 1}.json", {"number": was["number"] + 1, "runs": runs, "schema": {"type": "struct", "fields": fields}, "buckets": was["buckets"], "compact": compact})

    def _write(self, run: DataFrame, buckets: int, split: str | None = None) -> list[str]:
        name = f"run-{uuid.uuid4().hex}"
        write_buckets(run, f"{self.path}/{name}", self.keys, buckets, [split] if split else [])
        return [f"{name}/{x}" for x in list_names(self.spark, f"{self.path}/{name}") if "=" in x] if split else [name]

    def append(self, rows: DataFrame, attribute: str, value: str, version: Sequence[str], batch: str | None = None) -> None:
        """Add rows as one sparse delta; with `batch`, a column of few values, as one run per value, all made in a single pass."""
        delta = sparse_delta(rows, self.keys, attribute, value, version, self.columns, [batch] if batch else [])
        was = self._manifest()
        self._commit(was, [*was["runs"], *self._write(delta.repartition(was["buckets"], *self.keys), was["buckets"], batch)], delta.schema)

    def read(self) -> DataFrame:
        """The merged state: `keys` and a versioned cell per column. A single compacted run is that as it lies."""
        manifest = self._manifest()
        if manifest["schema"] is None:
            raise ValueError("the log has no runs")
        runs = {i: f"{self.path}/{r}" for i, r in enumerate(manifest["runs"])}
        whole = read_buckets(self.spark, StructType.fromJson(manifest["schema"]), self.keys, manifest["buckets"], runs)
        return whole if manifest["compact"] else merge_runs(whole, self.keys, self.columns)

    def compact(self) -> None:
        """Replace all runs by one; readers of the former manifest keep their files until `vacuum`."""
        was = self._manifest()
        merged = self.read()
        with in_bucket_order(self.spark):
            runs = self._write(merged, was["buckets"])
        self._commit(was, runs, merged.schema, compact=True)

    def vacuum(self) -> None:
        """Remove the runs and manifests that the one in force does not need."""
        now = self._manifest()
        held = {r.split("/")[0] for r in now["runs"]}
        for x in list_names(self.spark, self.path):
            if (x.startswith("run-") and x not in held) or (x.startswith("manifest-") and x != f"manifest-{now['number']}.json"):
                remove(self.spark, f"{self.path}/{x}")


def typed_wide(state: DataFrame, keys: Sequence[str], columns: list[WideColumn]) -> DataFrame:
    """One row per entity with a typed column each; a value that does not fit its type, or exceeds decimal(38,2), is null."""
    return state.select(*keys, *(cell_text(F.col(f"{c.name}._v"), c.type).try_cast(SQL_TYPES[c.type]).alias(c.name) for c in columns))


def wide_cells(state: DataFrame, keys: Sequence[str], columns: list[WideColumn]) -> DataFrame:
    """One row per cell that is not null: `keys`, `col_name`, `cell`."""
    if not columns:
        return state.select(*keys, F.lit("").alias("col_name"), F.lit("").alias("cell")).limit(0)
    cells = F.array(*(F.struct(F.lit(c.name).alias("col_name"), cell_text(F.col(f"{c.name}._v"), c.type).alias("cell")) for c in columns))
    return state.select(*keys, F.inline(cells)).where("cell is not null")
