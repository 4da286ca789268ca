"""Frequency of every distinct term, over all records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F


#: Rows of a record from which it is hot, and the most records that are treated so: others have at most a thousandth of all rows.
HOT_ROWS, MOST_HOT = 100_000, 1_000


def record_stats(rows: DataFrame, record: Sequence[str], counts: Column) -> tuple[int, list[Row]]:
    """The number of records with any row for which `counts` holds, and the keys of hot records, MOST_HOT at most: one pass over the keys."""
    seen = Observation()
    per_record = rows.groupBy(*record).agg(F.count("*").alias("_n"), F.max(counts).alias("_any")).observe(seen, F.count(F.when(F.col("_any"), 1)).alias("n"))
    hot = per_record.where(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n"), *record).limit(MOST_HOT).select(*record).collect()
    return seen.get["n"], hot


def term_counts(rows: DataFrame, record: Sequence[str], position: Sequence[str], terms: Mapping[str, Column], hot: Sequence[Row] = ()) -> DataFrame:
    """`slot`, `term`, `occurrences`, `records`: how often each distinct term occurs, and in how many records.

    `record` names the columns of a record's key, `position` those of a row within it: rows equal in both count once, whichever
    is read (they are redeliveries). `terms` gives per slot an array of terms, repeats and all; null arrays, null terms and empty
    terms count as none. A null in the key is a value like any other.

    Rows move once, by the hash of their record; where they arrive, they are made distinct, terms counted per record, and these
    summed by hash per term, so that the second shuffle has one row per term and task. Rows of `hot` records (a bounded list, see
    `record_stats`) go by record and position and then by record and term instead: no record, and no term, is one task's.
    """
    slim = rows.select(*record, *position, *(a.alias(f"_t_{s}") for s, a in terms.items()))
    if not hot:
        parts = [slim.repartition(*record)]
    else:
        few = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*record).schema).select(*(F.col(c).alias(f"_h_{c}") for c in record)))
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in record))
        parts = [slim.join(few, on, "left_anti").repartition(*record), slim.join(few, on, "left_semi")]
    each = F.array(*(F.struct(F.lit(s).alias("slot"), F.coalesce(F.col(f"_t_{s}"), F.array().cast("array<string>")).alias("terms")) for s in terms))
    found = []
    for part in parts:
        kept = part.dropDuplicates([*record, *position])
        exploded = kept.select(*record, F.explode(each).alias("_s")).select(*record, F.col("_s.slot").alias("slot"), F.explode("_s.terms").alias("term"))
        per_record = exploded.where("term is not null and term <> ''").groupBy("slot", "term", *record).agg(F.count("*").alias("_n"))
        found.append(per_record.select("slot", "term", "_n"))
    return reduce(DataFrame.unionByName, found).groupBy("slot", "term").agg(F.sum("_n").alias("occurrences"), F.count("*").alias("records"))


def mark_terms(counts: DataFrame, all_records: int, rare_below: int, common_share: float) -> DataFrame:
    """`counts` with `mark`: `rare` in fewer than `rare_below` records, `common` in more than `common_share` of `all_records`, else null.
    Where both hold, rare."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(all_records) * F.lit(common_share), "common")
    return counts.withColumn("mark", mark)
