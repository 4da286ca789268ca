"""Sources mixed to target weights by Poisson replication.

Each document has a uniform number from a hash of its key. Inverting the Poisson distribution of a source's rate at that number
gives the document's count, which grows with the rate: copy k appears at the rate where P(X < k) falls to the number. So the tokens that
a rate draws follow from a histogram of tokens over the numbers, and the rate at which they meet the source's target is found on it; the few cells in which
the answer lies are cut finer in further passes. The cap on repeats ends the list of a document's copies.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.session import partitions

#: Most sources that may have a target, and most repeats: both are read by the driver or unrolled in a plan.
MOST_SOURCES, MOST_REPEATS = 1_000, 64
#: Bits by which the passes of the histogram cut the numbers (of 53 bits), all cells in the first, few of them later.
CUTS = (10, 6, 6, 6)
TOP_RATE = 512.0


def source_name(column: Column) -> Column:
    """Sources compare trimmed and in lower case."""
    return F.lower(F.trim(column))


def bits(key: Column, seed: int) -> Column:
    """53 bits from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11)


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return bits(key, seed) / F.lit(float(2**53))


def below(k: int, rate: np.ndarray | float) -> np.ndarray | float:
    """P(X < k) of a Poisson distribution."""
    term, total = np.exp(-np.asarray(rate, dtype=float)), 0.0
    for i in range(k):
        total = total + term
        term = term * rate / (i + 1)
    return total


def plan_mix(sizes: DataFrame, targets: DataFrame, seed: int = 1) -> list[dict]:
    """Per target source: share aimed at, tokens there are, tokens to draw, the Poisson rate and the cap. `sizes`: doc_id, source, n_tokens.

    `targets` (source, target_share, max_repeats) has one row per source; the driver reads it, MOST_SOURCES rows at most. Shares of
    sources without tokens cannot be held: the others share all, in proportion. The mix is as large as the caps allow with every
    share held; the source that ends it has all its copies drawn.
    """
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").distinct().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES or len({r["source"] for r in rows}) < len(rows) or any(r["max_repeats"] > MOST_REPEATS for r in rows):
        raise ValueError(f"targets need one row per source, at most {MOST_SOURCES}, with at most {MOST_REPEATS} repeats")
    caps = {r["source"]: r["max_repeats"] for r in rows}
    share = {r["source"]: float(r["target_share"]) for r in rows}
    # One row per target source, at most MOST_SOURCES.
    known = sizes.where(F.col("source").isin(list(caps)))
    there = {r["source"]: r["n"] or 0 for r in known.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    live = sorted(s for s in caps if there.get(s, 0) > 0)
    whole = sum(share[s] for s in live)
    total = min((caps[s] * there[s] * whole / share[s] for s in live), default=0.0)
    goal = {s: total * share[s] / whole for s in live}
    rate = _rates(known.where(F.col("n_tokens") > 0).select("source", "n_tokens", bits(F.col("doc_id"), seed).alias("u")), goal, {s: caps[s] for s in live}, there)
    return [
        {"source": s, "target_share": share[s], "aim_share": share[s] / whole if s in goal else 0.0, "max_repeats": caps[s], "tokens_there": there.get(s, 0), "tokens_aimed": goal.get(s, 0.0), "rate": rate.get(s, 0.0)}
        for s in sorted(caps)
    ]


class _Drawn:
    """What a rate draws of one source, from cells of its documents' numbers: (first number, last number, tokens), in any order."""

    def __init__(self, cells: list[tuple[int, int, int]], cap: int) -> None:
        held = np.array(sorted(cells), dtype=np.int64).reshape(-1, 3)
        self.low, self.high, self.cap = held[:, 0], held[:, 1], cap
        # Tokens of a cell and of all after it.
        self.after = np.concatenate([np.cumsum(held[::-1, 2])[::-1], [0]])

    def marks(self, rate: float) -> np.ndarray:
        """The numbers from which on documents have 1, 2, ... copies."""
        return np.array([float(below(k, rate)) for k in range(1, self.cap + 1)]) * 2.0**53

    def most(self, rate: float) -> int:
        """Tokens drawn, cells that a mark cuts in full."""
        return int(self.after[np.searchsorted(self.high, self.marks(rate))].sum())

    def least(self, rate: float) -> int:
        """Tokens drawn, cells that a mark cuts not at all."""
        return int(self.after[np.searchsorted(self.low, self.marks(rate))].sum())


def _greatest_rate(tokens, goal: float) -> float:
    """The greatest rate of which `tokens`, which grows with it, is at most `goal`."""
    low, high = 0.0, TOP_RATE
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if tokens(mid) <= goal else (low, mid)
    return low


def _rates(numbers: DataFrame, goal: dict[str, float], caps: dict[str, int], there: dict[str, int]) -> dict[str, float]:
    """The rate per source of which the tokens drawn come closest to its goal from below, to the last cell; infinite where all copies are drawn. `numbers`: source, u, n_tokens.

    A pass has at most as many rows as cells that it cuts, times two to its bits, and cuts only cells in which the answer may lie: about one per copy.
    """
    rate = {s: math.inf for s in goal if goal[s] >= caps[s] * there[s] * (1 - 1e-12)}
    todo = [s for s in goal if s not in rate]
    cells: dict[str, list[tuple[int, int, int]]] = {s: [(0, 2**53 - 1, there[s])] for s in todo}
    cut = [(s, 0) for s in todo]
    narrow = 53
    for step in CUTS:
        if not cut:
            break
        wide, narrow = narrow, narrow - step
        wanted = F.broadcast(numbers.sparkSession.createDataFrame(cut, "source string, _c long"))
        part = numbers.withColumn("_c", F.call_function("shiftright", F.col("u"), F.lit(wide))).join(wanted, ["source", "_c"])
        finer: dict[str, list[tuple[int, int, int]]] = {}
        for s, c, n in part.groupBy("source", F.call_function("shiftright", F.col("u"), F.lit(narrow)).alias("c")).agg(F.sum("n_tokens")).collect():
            finer.setdefault(s, []).append((c << narrow, ((c + 1) << narrow) - 1, n))
        gone = set(cut)
        cut = []
        for s, found in finer.items():
            cells[s] = [x for x in cells[s] if not (x[1] - x[0] + 1 == 1 << wide and (s, x[0] >> wide) in gone)] + found
            drawn = _Drawn(cells[s], caps[s])
            low, high = drawn.marks(_greatest_rate(drawn.least, goal[s])), drawn.marks(_greatest_rate(drawn.most, goal[s]))
            cut += [(s, x[0] >> narrow) for x in found if any(a <= x[1] and b >= x[0] for a, b in zip(low, high))]
    return rate | {s: _greatest_rate(_Drawn(cells[s], caps[s]).most, goal[s]) for s in todo}


def repeats(plan: list[dict], seed: int = 1) -> Column:
    """How often a document is used, from `doc_id` and `source` (in the compared form): the inverse of its source's Poisson distribution."""
    u = uniform(F.col("doc_id"), seed)
    count = F.lit(0)
    for p in plan:
        if p["rate"] == math.inf:
            n = F.lit(p["max_repeats"])
        else:
            n = sum((F.when(u >= float(below(k, p["rate"])), 1).otherwise(0) for k in range(1, p["max_repeats"] + 1)), F.lit(0))
        count = F.when(F.col("source") == p["source"], n).otherwise(count)
    return count


def draw(documents: DataFrame, plan: list[dict], seed: int = 1) -> DataFrame:
    """`documents` (doc_id, source in the compared form, any others), each as often as planned, in a global random order, with `copy`.

    The order is that of a hash of key and copy: as its values are even over their range, the partition follows from the value, without a look at the
    data, and rows are sorted within. No document is looked up again: the count follows from the key and the plan, so texts are read
    once here and move once.
    """
    n = partitions(documents.sparkSession)
    drawn = documents.withColumn("copy", F.explode(F.sequence(F.lit(1), F.nullif(repeats(plan, seed), F.lit(0)))))
    placed = drawn.withColumn("place", F.xxhash64("doc_id", "copy", F.lit(seed + 1)))
    slot = F.call_function("shiftright", (F.call_function("shiftright", F.col("place"), F.lit(32)) + 2**31) * n, F.lit(32)).cast("int")
    return placed.repartitionById(n, slot).sortWithinPartitions("place")
