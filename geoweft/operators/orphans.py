"""References to records that do not exist, by a dictionary of keys and bitmaps of key ranges and periods.

Distinct references per key and period and one row per parent meet by key and are sorted by it in each task. There every distinct key,
of whatever type, gets the next integer: that is the dictionary, dense, and local to the task, as no key is in two. Each 65,536 numbers are
a range, of which references and parents become compressed bitmaps. References AND-NOT parents, per period, leaves the missing; AND deleted
parents the deleted; AND-NOT the parents known before the period those that may have come late, which the exact times then decide. Surviving bits
are decoded by the range's part of the dictionary and joined to their referring rows. A range holds at most 65,536 keys times the periods, whatever
the data, and a target with a third of all references is one bit a period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions.bitmaps import BITS, Bitmap
from geoweft.session import materialize_counted

#: Period of references whose time is not known, and of parents that count as known from the start.
UNKNOWN = -1
MISSING, DELETED, MAYBE_LATE = 0, 1, 2
#: Survivors up to this number are sent to all tasks; of more, those with more than a HOT_SHARE-th of all references are, which are fewer than HOT_SHARE.
FEW, HOT_SHARE = 200_000, 20_000


def utc_date(micros: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int"))


def month_number(micros: Column) -> Column:
    d = utc_date(micros)
    return F.year(d) * 12 + F.month(d) - 1


def surviving_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref_type, ref_id, period) of references that are missing, deleted or perhaps late, with a code, the parent's first time, and `n`, how often they occur.

    `references`: ref_type, ref_id (of any type that sorts), period (int, UNKNOWN if none), repeats allowed; `parents`: ref_type, ref_id,
    is_deleted, first_us (microseconds of the first known time, null if none), first_period (UNKNOWN if none), one row per key.
    """
    refs = references.groupBy("ref_type", "ref_id", "period").agg(F.count("*").alias("n"))
    side = lambda df, n, period, deleted, first: df.select("ref_type", "ref_id", n.cast("long").alias("n"), period.cast("int").alias("period"), deleted.alias("is_deleted"), first.cast("long").alias("first_us"))
    # A parent is a row of n = 0, and sorts first.
    both = side(parents, F.lit(0), F.col("first_period"), F.col("is_deleted"), F.col("first_us")).unionByName(side(refs, F.col("n"), F.col("period"), F.lit(False), F.lit(None)))
    ordered = both.repartition("ref_type", "ref_id").sortWithinPartitions("ref_type", "ref_id", "n")
    return ordered.mapInArrow(_ranges, f"ref_type string, ref_id {references.schema['ref_id'].dataType.simpleString()}, period int, code int, first_us long, n long")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the keys of sorted rows; hand on one range of BITS numbers at a time."""
    held: list[pa.RecordBatch] = []
    codes: list[np.ndarray] = []
    code, last = -1, None
    for b in batches:
        if not b.num_rows:
            continue
        kind, key = b["ref_type"], b["ref_id"]
        new = np.ones(b.num_rows, bool)
        same = pa.compute.and_(pa.compute.equal(kind.slice(1), kind.slice(0, len(kind) - 1)), pa.compute.equal(key.slice(1), key.slice(0, len(key) - 1)))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
        new[0] = (kind[0].as_py(), key[0].as_py()) != last
        last = (kind[len(kind) - 1].as_py(), key[len(key) - 1].as_py())
        numbers = code + np.cumsum(new)
        code = int(numbers[-1])
        ends = [0, *(np.flatnonzero(numbers[1:] // BITS != numbers[:-1] // BITS) + 1), len(numbers)]
        for i, j in zip(ends, ends[1:]):
            if held and codes[0][0] // BITS != numbers[i] // BITS:
                yield from _one_range(pa.Table.from_batches(held), np.concatenate(codes))
                held, codes = [], []
            held.append(b.slice(i, j - i))
            codes.append(numbers[i:j])
    if held:
        yield from _one_range(pa.Table.from_batches(held), np.concatenate(codes))


def _one_range(rows: pa.Table, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bitmaps of one range: rows sorted by code, of each code the parent first."""
    n = rows["n"].to_numpy()
    parent = n == 0
    if parent.all():
        return
    bit = (codes % BITS).astype(np.uint16)
    # The dictionary of the range: where each of its numbers has a row.
    numbers, where = np.unique(bit, return_index=True)
    period = rows["period"].to_numpy().astype(np.int64)
    own = bit[parent]
    there, gone, since = Bitmap.of(own), Bitmap.of(own[rows["is_deleted"].to_numpy()[parent].astype(bool)]), period[parent]
    known, upto = Bitmap.of(own[since == UNKNOWN]), UNKNOWN
    ref_bit, ref_period, ref_at = bit[~parent], period[~parent], np.flatnonzero(~parent)
    out = []
    for p in np.unique(ref_period):
        mine = ref_period == p
        r = Bitmap.of(ref_bit[mine])
        alive = r & there
        found = [(MISSING, r.and_not(there)), (DELETED, alive & gone)]
        if p != UNKNOWN:
            known |= Bitmap.of(own[(since > upto) & (since < p)])
            upto = p - 1
            found.append((MAYBE_LATE, alive.and_not(gone).and_not(known)))
        for code, bits in found:
            at = bits.positions()
            if len(at):
                # Decoded: the row of each surviving key and period.
                out.append((code, p, at, ref_at[mine][np.searchsorted(ref_bit[mine], at)]))
    if not out:
        return
    at, row = np.concatenate([x[2] for x in out]), pa.array(np.concatenate([x[3] for x in out]))
    code = np.concatenate([np.full(len(x[2]), x[0]) for x in out])
    first = pa.array(where[np.searchsorted(numbers, at)])
    times = pa.compute.if_else(pa.array(code == MAYBE_LATE), rows["first_us"].combine_chunks().take(first), pa.scalar(None, pa.int64()))
    taken = lambda c: rows[c].combine_chunks().take(row)
    periods = pa.array(np.concatenate([np.full(len(x[2]), x[1]) for x in out]).astype(np.int32))
    yield pa.RecordBatch.from_arrays([taken("ref_type"), taken("ref_id"), periods, pa.array(code.astype(np.int32)), times, taken("n")], names=["ref_type", "ref_id", "period", "code", "first_us", "n"])


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """`references` that are missing, deleted or late, with a `reason`; the columns of `references` and that.

    `references`: ref_type, ref_id, ref_us (microseconds of the referring row, may be null), period, and any others; `parents` as for
    `surviving_references`. Late: the parent's first known time is after the referring row's; never where either is null. A null
    ref_id or ref_type is no reference. References are made once and written, as they are looked at twice.
    """
    refs, total = materialize_counted(references.where("ref_id is not null and ref_type is not null"), "references")
    named = surviving_references(refs, parents).withColumnsRenamed({"ref_type": "_t", "ref_id": "_i", "period": "_p", "n": "_n"})
    left, few = materialize_counted(named, "survivors")
    on = (F.col("ref_type") == F.col("_t")) & (F.col("ref_id") == F.col("_i")) & (F.col("period") == F.col("_p"))
    reason = F.when(F.col("code") == MISSING, "missing").when(F.col("code") == DELETED, "deleted").when(F.col("first_us") > F.col("ref_us"), "late")
    decide = lambda joined: joined.withColumn("reason", reason).where("reason is not null").select(*references.columns, "reason")
    if few <= FEW:
        return decide(refs.join(F.broadcast(left), on))
    hot = F.col("_n") > max(1, total // HOT_SHARE)
    rest = refs.join(F.broadcast(left.where(hot)), on, "left_anti").join(left.where(~hot), on)
    return decide(refs.join(F.broadcast(left.where(hot)), on)).unionByName(decide(rest))
