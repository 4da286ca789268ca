"""The string table: usage of strings as keys and values, and the codes of the most used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoweft.functions import tags as T
from geoweft.model import Graph

# Strings that come first in every table, and the sizes of its first two parts.
CORE = ["", "no", "yes", "outer", "inner"]
MIXED, KEYS = 512, 8192


def string_usage(graph: Graph) -> DataFrame:
    """`str`, `key_count`, `value_count`, `total`: uses of each string as a key, and as a value or role, over all current elements. Exact."""
    entries = None
    for rows in (graph.nodes("tags"), graph.ways("tags"), graph.relations("tags")):
        part = rows.select(F.explode("tags").alias("k", "v"))
        entries = part if entries is None else entries.unionByName(part)
    uses = entries.select(F.explode(F.array(F.struct(F.col("k").alias("str"), F.lit(1).alias("as_key")), F.struct(F.col("v").alias("str"), F.lit(0).alias("as_key")))).alias("u")).select("u.*")
    roles = graph.relations("members").select(F.explode("members").alias("m")).select(F.coalesce("m.role", F.lit("")).alias("str"), F.lit(0).alias("as_key"))
    every = uses.unionByName(roles).where("str is not null")
    return every.groupBy("str").agg(F.sum("as_key").alias("key_count"), F.sum(1 - F.col("as_key")).alias("value_count"), F.count("*").alias("total"))


def string_table(usage: DataFrame, min_usage: int = 300, max_strings: int = 32_000, indexed_keys: str = T.INDEXED_KEYS) -> DataFrame:
    """`code`, `str`, `part`: core strings and indexed keys first, then the most used up to 512, then keys up to 8,192, then the rest up to `max_strings`.

    Only strings of at least `min_usage` uses are ranked, ties by the string. The table is a top-k report of at most `max_strings` rows, so its
    ranking takes one task of that many rows per part, after a distributed sort with a limit.
    """
    required = list(dict.fromkeys([*CORE, *T.parse_indexed_keys(indexed_keys)]))
    used = usage.where((F.col("total") >= min_usage) & ~F.col("str").isin(*required))
    n = len(required)
    first = max(0, min(MIXED, max_strings) - n)
    top = used.orderBy(F.desc("total"), "str").limit(max_strings).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("total"), "str")))
    mixed = top.where(F.col("_rank") <= first).select("str", F.lit(1).alias("_part"), F.col("_rank").alias("_at"))
    # Keys that are in the first part are among the top by total, so the first key table of that many plus 8,192 holds all it needs.
    keys = usage.where((F.col("key_count") >= min_usage) & ~F.col("str").isin(*required)).orderBy(F.desc("key_count"), "str").limit(KEYS + MIXED)
    keys = keys.join(mixed.select("str"), "str", "left_anti").withColumn("_at", F.row_number().over(Window.orderBy(F.desc("key_count"), "str")))
    keys = keys.where(F.col("_at") <= max(0, min(KEYS, max_strings) - n - first)).select("str", F.lit(2).alias("_part"), "_at")
    rest = top.where(F.col("_rank") > first).join(keys.select("str"), "str", "left_anti").select("str", F.lit(3).alias("_part"), F.col("_rank").alias("_at"))
    head = usage.sparkSession.createDataFrame([(s, 0, i) for i, s in enumerate(required, 1)], "str string, _part int, _at int")
    every = head.unionByName(mixed).unionByName(keys).unionByName(rest)
    ranked = every.withColumn("code", F.row_number().over(Window.orderBy("_part", "_at")) - 1)
    part = F.element_at(F.array(*map(F.lit, ("required", "mixed", "keys", "rest"))), F.col("_part") + 1)
    return ranked.where(F.col("code") < max_strings).select("code", "str", part.alias("part"))
