"""Parent-child links to full hierarchies, by pointer doubling.

A round joins segments of 2^k links with each other, so segments double and depth d takes log2(d) rounds. Root paths are joined
with the segments of each round; a path never takes a segment that returns to one of its nodes. Links that lie on a cycle keep
segments alive for ever: they are found first, as the strongly connected components of what no trimming removes.
Every round is written to the shared folder; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from geoweft.session import materialize, materialize_counted

#: Jumps are kept to about this many times the links.
JUMPS = 8
#: Rounds of labels along plain links before jumps are made.
LINK_ROUNDS = 2


def distinct_links(links: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct links as `src`, `dst`; a link with a null end is none."""
    return links.select(F.col(parent).alias("src"), F.col(child).alias("dst")).where("src is not null and dst is not null").distinct()


def _double(jumps: DataFrame, n: int, links: int, number: int) -> tuple[DataFrame, int]:
    """Jumps two of `jumps` (`n` of them, from so many `links`) long, those of `jumps` that begin or end at a node which is passed by in this round, and their number.

    A node with i jumps in and o out makes i * o of them. Where one of the two is 1, that is no more than there were. Other nodes share what
    is left of JUMPS times the links in proportion to i + o, and are taken with the chance that keeps them to their share, by a hash of
    the node and the round's `number`: a hub costs no more than its links, the ways beside it double all the same, and where all nodes are
    hubs ways still shorten by a share each round. No jump is lost: what does not grow stays, so each way of links is a way of jumps too.
    """
    a, b = jumps.select("src", F.col("dst").alias("mid")), jumps.select(F.col("src").alias("mid"), "dst")
    degrees = a.groupBy("mid").agg(F.count("*").alias("_i")).join(b.groupBy("mid").agg(F.count("*").alias("_o")), "mid")
    share = min(2.0, max(1 / 64, (JUMPS * links - n) / (2.0 * n)))
    made, room = F.col("_i") * F.col("_o"), (F.col("_i") + F.col("_o")) * F.lit(share)
    chance = F.pmod(F.xxhash64("mid", F.lit(number)), F.lit(1 << 20)) * made < room * (1 << 20)
    nodes = degrees.select("mid", (F.least("_i", "_o") == 1).alias("_one"), chance.alias("_on")).select("mid", (F.col("_one") | F.col("_on")).alias("_on"))
    on, off = nodes.where("_on").select("mid"), nodes.where("not _on").select("mid")
    longer = a.join(on, "mid").join(b, "mid").select("src", "dst")
    held = a.join(off, "mid").select("src", F.col("mid").alias("dst")).unionByName(b.join(off, "mid").select(F.col("mid").alias("src"), "dst"))
    return materialize_counted(longer.unionByName(held).distinct(), "jumps")


def propagate_min(links: DataFrame, labels: DataFrame, names: Sequence[str] = ("label",)) -> DataFrame:
    """For each node (`id`, `names`) the least of each label among its ancestors and itself, along `src` to `dst`; null is no label.

    Jumps double each round but the first LINK_ROUNDS, which end most hierarchies; it ends when no link would change a label, so cycles do no harm.
    """
    jumps, number, n = links, 0, links.count()
    all_links, rounds = n, 0
    while all_links:
        step = (jumps if jumps is links else links.unionByName(jumps)).join(labels.withColumnRenamed("id", "src"), "src")
        best = step.groupBy(F.col("dst").alias("id")).agg(*(F.min(c).alias(f"_b_{c}") for c in names))
        less = lambda c: F.coalesce(F.col(f"_b_{c}") < F.col(c), F.col(f"_b_{c}").isNotNull() & F.col(c).isNull())
        moved = reduce(lambda a, b: a | b, map(less, names))
        seen = Observation()
        new = labels.join(best, "id", "left").select("id", *(F.least(c, f"_b_{c}").alias(c) for c in names), moved.alias("_moved"))
        new = new.observe(seen, F.count(F.when(F.col("_moved"), 1)).alias("n"))
        labels = materialize(new.select("id", *names), "labels")
        if not seen.get["n"]:
            return labels
        rounds += 1
        if n and rounds > LINK_ROUNDS:
            jumps, n = _double(jumps, n, all_links, number)
            number += 1
    return labels


def _nodes(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()


def _within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of which both ends are in `nodes` (`id`)."""
    return links.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def _trim(links: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The links left and their number, from `n`: drop links that cannot be on a cycle: each round drops nodes that lack a jump to or from them.

    It ends when a round drops nothing; what is left holds all cycles, and perhaps ways between them.
    """
    jumps, number, k, all_links = links, 0, n, n
    while n:
        keep = jumps.select(F.col("src").alias("id")).distinct().join(jumps.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        kept, m = materialize_counted(_within(links, keep), "trim")
        if m == n:
            break
        links, n = kept, m
        if n and k:
            # A node dropped here has no jump on, or none to it, so doubling drops its jumps by itself.
            jumps, k = _double(jumps, k, all_links, number)
            number += 1
    return links, n


def cycle_members(links: DataFrame) -> DataFrame:
    """`id` of each node that can be reached from itself, with `root_id`, the least id among those it reaches and that reach it.

    Nodes take the least id that reaches them as colour. The node whose colour is its own id is the least of its component, which
    is what of that colour leads back to it; all colours go at once. What is left is trimmed and goes again, until nothing is.
    """
    links, n = materialize_counted(links, "links")
    out = None
    rest, n = _trim(links, n)
    while n:
        colours = propagate_min(rest, _nodes(rest).withColumn("label", F.col("id")))
        ends = rest.join(colours.select(F.col("id").alias("src"), F.col("label").alias("_a")), "src").join(colours.select(F.col("id").alias("dst"), F.col("label").alias("_b")), "dst")
        inner = materialize(ends.where("_a = _b").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "inner")
        # Backwards from the node that is its own colour: 0 reaches it, 1 does not.
        back = propagate_min(inner, colours.select("id", F.when(F.col("id") == F.col("label"), 0).otherwise(1).alias("label")))
        part = materialize(colours.join(back.where("label = 0").select("id"), "id").select("id", F.col("label").alias("root_id")), "component")
        loops = rest.where("src = dst").select(F.col("src").alias("root_id")).distinct()
        proper = materialize(part.join(part.where("id <> root_id").select("root_id").union(loops).distinct(), "root_id", "left_semi").select("id", "root_id"), "cycles")
        out = proper if out is None else out.unionByName(proper)
        ids = part.select("id")
        rest = rest.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        rest, n = _trim(*materialize_counted(rest, "rest"))
    return out if out is not None else links.select(F.col("src").alias("id"), F.col("src").alias("root_id")).limit(0)


def root_paths(links: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """Every way down from a root that visits no node twice: `root_id`, `id` (its end), `path` (array from root to end).

    Roots have links down and none from above; each is its own way of no links. Round k joins the ways of fewer than 2^k links with
    the segments of exactly 2^k links, so each way is made once. Links that no root reaches (below cycles only) are left out first
    where `cycles` has rows, lest their segments are made for nothing.
    """
    links = materialize(links.select("src", "dst"), "links")
    roots = materialize(links.select("src").distinct().join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_anti"), "roots")
    steps = links.where("src <> dst")
    if cycles is None or cycles.limit(1).count():
        start = _nodes(links).join(roots.select(F.col("src").alias("id"), F.lit(0).alias("_r")), "id", "left")
        reached = propagate_min(steps, start.select("id", F.coalesce("_r", F.lit(1)).alias("label")))
        steps = steps.join(reached.where("label = 0").select(F.col("id").alias("src")), "src", "left_semi")
    paths = roots.select(F.col("src").alias("root_id"), F.col("src").alias("id"), F.array("src").alias("path"))
    segments, n = materialize_counted(steps.select("src", "dst", F.array("src", "dst").alias("seg")), "segments")
    while n:
        tail = segments.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.expr("slice(seg, 2, size(seg) - 1)").alias("_tail"))
        on = F.col("id") == F.col("_at")
        longer = paths.join(tail, on & ~F.arrays_overlap("path", "_tail")).select("root_id", F.col("_to").alias("id"), F.concat("path", "_tail").alias("path"))
        paths = paths.unionByName(materialize(longer, "paths"))
        joined = segments.join(tail, (F.col("dst") == F.col("_at")) & ~F.arrays_overlap("seg", "_tail"))
        segments, n = materialize_counted(joined.select("src", F.col("_to").alias("dst"), F.concat("seg", "_tail").alias("seg")), "segments")
    return paths
