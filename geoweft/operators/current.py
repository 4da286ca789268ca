"""Current rows of versioned elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(name: str | Column) -> Column:
    """A flag of which null means false."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(False))


def current_narrow(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = ("id",)) -> DataFrame:
    """The current row of each id (or `keys`), for columns of fixed width: `id`, `version`, `is_deleted`, `values`, one row per id.

    The greatest version wins; a null version counts below all others. Exact copies count once; where different
    rows share the greatest version, one is taken by a hash of its values, the same one for all columns. Rows without
    id are no elements and are left out. Every aggregate keeps fixed-width state, so the partial sums stay hash based.
    """
    order = F.shiftleft(F.coalesce(F.col("version"), F.lit(-(2**31))).cast("long"), 32) + (
        F.hash(*values, flag("is_deleted")).cast("long") + F.lit(2**31)
    )
    picked = rows.where(F.col("id").isNotNull()).select(*keys, "version", flag("is_deleted").alias("is_deleted"), *values, order.alias("_o"))
    return picked.groupBy(*keys).agg(*(F.max_by(c, "_o").alias(c) for c in ("version", "is_deleted", *values)))


def current_wide(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """As `current_narrow`, for columns of any width (arrays, strings): one sort-based aggregate, partial before the shuffle."""
    order = F.struct(F.coalesce(F.col("version"), F.lit(-(2**31))), F.xxhash64(*values, flag("is_deleted")))
    picked = rows.where(F.col("id").isNotNull()).select(
        "id", order.alias("_o"), F.struct("version", flag("is_deleted").alias("is_deleted"), *values).alias("_r")
    )
    return picked.groupBy("id").agg(F.max_by("_r", "_o").alias("_r")).select("id", "_r.*")
