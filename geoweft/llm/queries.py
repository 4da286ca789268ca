"""Queries p1, p7, p8 and p9, and the SQL of p1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.llm import canonical, frequency, mixing, packing
from geoweft.llm.tokens import count_tokens
from geoweft.operators import hierarchy
from geoweft.session import materialize, table


def _term_counts(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    rows, record = table(spark, folder, "tag_rows"), ["ftype", "id"]
    clean = lambda c: F.lower(F.trim(c))
    terms = {"key": F.array(clean(F.col("k"))), "value": F.transform(F.split("v", ";"), clean)}
    elements, hot = frequency.record_stats(rows, record, F.col("k").isNotNull() | F.col("v").isNotNull())
    return frequency.term_counts(rows, record, ["pos"], terms, hot), elements


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of keys and values that occur in fewer than 3 elements or in more than a tenth of them."""
    return frequency.mark_terms(*_term_counts(spark, folder), 3, 0.1).where("mark is not null").select("slot", "term", "mark")


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of keys and values with its occurrences and the number of elements it occurs in."""
    return frequency.mark_terms(*_term_counts(spark, folder), 3, 0.1).select("slot", "term", "occurrences", "records", "mark")


def _sizes(spark: SparkSession, folder: str, *also) -> DataFrame:
    """Every text with its size, written once: later passes read numbers, not texts."""
    documents = table(spark, folder, "documents").where("text is not null")
    return materialize(documents.select("doc_id", *also, count_tokens(F.col("text")).alias("n_tokens")), "sizes")


def _clusters(sizes: DataFrame) -> DataFrame:
    """`cluster` for `paper` and `digest`: papers and equal texts that rows connect, by the least name among them; null for a row alone."""
    shared = materialize(sizes.where("digest is not null").groupBy("digest").count().where("count > 1").select("digest"), "shared")
    rows = sizes.join(shared.withColumn("_s", F.lit(True)), "digest", "left")
    paper, copy = F.concat(F.lit("p"), "paper"), F.when(F.col("_s"), F.concat(F.lit("t"), "digest"))
    ties = rows.where("paper is not null and _s").select(paper.alias("src"), copy.alias("dst")).distinct()
    links = materialize(ties.unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "ties")
    groups = hierarchy.propagate_min(links, links.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct())
    named = rows.withColumn("id", F.coalesce(paper, copy)).join(groups, "id", "left")
    return named.withColumn("cluster", F.coalesce("label", "id")).drop("id", "label", "_s", "paper", "digest")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.when(F.col("text") != "", F.md5("text")).alias("digest")
    sizes = _sizes(spark, folder, mixing.source_name(F.col("source")).alias("source"), F.nullif(F.trim("paper_key"), F.lit("")).alias("paper"), digest)
    return materialize(_clusters(sizes), "clusters")


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, or its pieces where it exceeds a capacity, in a container of every kind. Copies and revisions of a paper stay apart, as do equal texts."""
    return packing.pack(_items(spark, folder), table(spark, folder, "containers"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per container kind: containers, tokens, the share of the room that is used, and how many containers any packing needs."""
    return packing.fill_report(p7_packed(spark, folder))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per container kind, over the whole packing: texts placed, texts of which a token is missing or there twice, containers that hold more than they can
    or other than they say, and containers with two pieces of one paper or of equal texts."""
    placed = materialize(p7_packed(spark, folder), "placed")
    kinds = ["container_kind", "capacity_tokens"]
    texts = placed.groupBy(*kinds, "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count("*").alias("pieces"), F.max("piece").alias("last"), F.countDistinct("first_token").alias("starts"))
    broken = (F.col("n") != F.col("end")) | (F.col("pieces") != F.col("last") + 1) | (F.col("starts") != F.col("pieces"))
    whole = texts.groupBy(*kinds).agg(F.count("*").alias("texts"), F.count(F.when(broken, 1)).alias("broken_texts"))
    filled = placed.groupBy(*kinds, "container_id").agg(F.sum("n_tokens").alias("n"), F.max("used_tokens").alias("said"))
    over = filled.groupBy(*kinds).agg(F.count(F.when((F.col("n") > F.col("capacity_tokens")) | (F.col("n") != F.col("said")), 1)).alias("wrong_containers"))
    named = table(spark, folder, "documents").select("doc_id", F.nullif(F.trim("paper_key"), F.lit("")).alias("paper"), F.when(F.col("text") != "", F.md5("text")).alias("digest"))
    marks = placed.join(named, "doc_id").select(*kinds, "container_id", F.explode(F.array(F.concat(F.lit("p"), "paper"), F.concat(F.lit("t"), "digest"))).alias("mark")).where("mark is not null")
    twice = marks.groupBy(*kinds, "container_id", "mark").count().where("count > 1").groupBy(*kinds).agg(F.count("*").alias("clashes"))
    return whole.join(over, kinds).join(twice, kinds, "left").select(*kinds, "texts", "broken_texts", "wrong_containers", F.coalesce("clashes", F.lit(0).cast("long")).alias("clashes"))


def _plan(spark: SparkSession, folder: str) -> list[dict]:
    sizes = _sizes(spark, folder, mixing.source_name(F.col("source")).alias("source"))
    return mixing.plan_mix(sizes, table(spark, folder, "mix_targets"))


def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: each use of a document, text included, in random order."""
    plan = _plan(spark, folder)
    documents = table(spark, folder, "documents").where("text is not null").select("doc_id", mixing.source_name(F.col("source")).alias("source"), "text")
    return mixing.draw(documents, plan)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per source of the targets: share aimed at and share reached, documents used and tokens drawn."""
    sizes = _sizes(spark, folder, mixing.source_name(F.col("source")).alias("source"))
    plan = mixing.plan_mix(sizes, table(spark, folder, "mix_targets"))
    used = sizes.withColumn("uses", mixing.repeats(plan)).where("uses > 0").groupBy("source").agg(F.count("*").alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    aims = spark.createDataFrame([(p["source"], p["target_share"], p["aim_share"], p["max_repeats"]) for p in plan], "source string, target_share double, aim_share double, max_repeats int")
    whole = used.agg(F.sum("tokens").alias("_all"))
    joined = aims.join(used, "source", "left").withColumn("_all", whole.scalar())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select("source", "target_share", "aim_share", "max_repeats", zero("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per source of the targets: documents there are, those used more often than allowed, uses with another text, and whether the share of tokens is more than half a hundredth off."""
    shares = {r["source"]: r for r in p8_shares(spark, folder).collect()}
    off = F.lit(False)
    for s, r in shares.items():
        off = F.when(F.col("source") == s, F.lit(abs(r["reached_share"] - r["aim_share"]) > 0.005)).otherwise(off)
    caps = table(spark, folder, "mix_targets").select(mixing.source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    documents = table(spark, folder, "documents").where("text is not null").select("doc_id", mixing.source_name(F.col("source")).alias("source"), F.md5("text").alias("digest"))
    uses = p8_mixed(spark, folder).groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.max(F.md5("text")).alias("a"), F.min(F.md5("text")).alias("b"))
    met = documents.join(uses, ["source", "doc_id"], "left").join(F.broadcast(caps), "source")
    counted = met.groupBy("source").agg(F.count("*").alias("documents"), F.count(F.when(F.col("uses") > F.col("max_repeats"), 1)).alias("over_cap"), F.count(F.when((F.col("a") != F.col("digest")) | (F.col("b") != F.col("digest")), 1)).alias("wrong_texts"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return caps.join(counted, "source", "left").select("source", "target_share", "max_repeats", zero("documents"), zero("over_cap"), zero("wrong_texts"), off.alias("share_off"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that read identically and differ in their characters."""
    forms = materialize(canonical.text_forms(table(spark, folder, "documents")), "forms")
    return canonical.same_look_pairs(forms)


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each text with the class of texts that look the same."""
    return canonical.same_look_classes(table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p7_checks": p7_checks,
    "p8_mixed": p8_mixed,
    "p8_shares": p8_shares,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
}

_TERMS = """
with once as (select * exclude (rn) from (select *, row_number() over (partition by ftype, id, pos order by rev, ts) as rn from tag_rows) where rn = 1),
terms as (select ftype, id, 'key' as slot, lower(trim(k, ' ')) as term from once
  union all select ftype, id, 'value', lower(trim(unnest(string_split(v, ';')), ' ')) from once),
n as (select count(*) as n_all from (select distinct ftype, id from tag_rows where k is not null or v is not null)),
counts as (select slot, term, count(*) as occurrences, count(distinct (ftype, id)) as records from terms where term <> '' group by slot, term),
marked as (select slot, term, occurrences, records, case when records < 3 then 'rare' when records > 0.1 * n_all then 'common' end as mark from counts, n)
"""
ORACLE = {
    "p7_checks": """select container_kind, capacity_tokens::bigint as capacity_tokens, (select count(*) from documents where text is not null) as texts,
0::bigint as broken_texts, 0::bigint as wrong_containers, 0::bigint as clashes from containers""",
    "p8_checks": """select lower(trim(t.source, ' ')) as source, target_share, max_repeats, (select count(*) from documents d where d.text is not null and lower(trim(d.source, ' ')) = lower(trim(t.source, ' '))) as documents,
0::bigint as over_cap, 0::bigint as wrong_texts, false as share_off from mix_targets t""",
    "p1_found": _TERMS + "select slot, term, mark from marked where mark is not null",
    "p1_counts": _TERMS + "select slot, term, occurrences, records, mark from marked",
}
