"""Operators by themselves: triangles, bitmaps, wide logs, bucketed tables and hierarchies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft import buckets
from geoweft.functions.bitmaps import Bitmap
from geoweft.functions.triangles import Hierarchy, clip_boxes, ear_clip, turn
from geoweft.operators import hierarchy, nearby, orphans, upsert, wide
from geoweft.session import materialize

from .conftest import rows


def test_ear_clip_keeps_area():
    shapes = [[(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)], [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]]
    for ring in shapes:
        area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1])))
        assert sum(abs(turn(*t)) for t in ear_clip(ring)) == area
    assert len(ear_clip([(1, 1)])) == 1 and len(ear_clip([(1, 1), (5, 1), (5, 1), (1, 1)])) == 1 and ear_clip([]) == []


def test_hierarchy_is_exact():
    r = np.random.default_rng(1)
    t = r.integers(-60, 60, (300, 7))
    t[:, 0] = np.arange(300) % 40
    t[0, 1:] = [-(2**31), -(2**31), 2**31 - 1, -(2**31), 2**31 - 1, 2**31 - 1]
    x, y = r.integers(-70, 70, 500), r.integers(-70, 70, 500)
    x[0], y[0] = 2**31 - 1, 2**31 - 2
    x[1], y[1] = 2**31 - 2, 2**31 - 1
    want = set()
    for i in range(500):
        for g, ax, ay, bx, by, cx, cy in t.tolist():
            p, a, b, c = (int(x[i]), int(y[i])), (ax, ay), (bx, by), (cx, cy)
            s = (turn(a, b, p), turn(b, c, p), turn(c, a, p))
            boxed = min(ax, bx, cx) <= p[0] <= max(ax, bx, cx) and min(ay, by, cy) <= p[1] <= max(ay, by, cy)
            if boxed and (min(s) >= 0 or max(s) <= 0):
                want.add((i, g))
    tree = Hierarchy(t[:, 1:], t[:, 0])
    for most in (Hierarchy.PAIRS, 40):
        tree.PAIRS = most
        got = [(int(i), int(t[j, 0])) for at, item in tree.pairs(x, y) for i, j in zip(at, item)]
        assert set(got) == want and len(got) == len(want)


def test_boxes_are_clipped_as_rings():
    r = np.random.default_rng(2)
    low = r.integers(-9, 9, (50, 2))
    high = low + r.integers(0, 5, (50, 2))
    flat = clip_boxes(low[:, 0], low[:, 1], high[:, 0], high[:, 1]).tolist()
    for i, ((a, b), (c, d)) in enumerate(zip(low.tolist(), high.tolist())):
        area = sum(abs(turn((t[0], t[1]), (t[2], t[3]), (t[4], t[5]))) for t in flat[2 * i : 2 * i + 2])
        assert area == 2 * (c - a) * (d - b) == sum(abs(turn(*t)) for t in ear_clip([(a, b), (c, b), (c, d), (a, d)]))


def test_inside_split_is_the_same(spark):
    r = random.Random(5)
    boxes = [(i, (a := r.randint(-1000, 1000), b := r.randint(-1000, 1000), a + r.randint(0, 300), b + r.randint(0, 300))) for i in range(200)]
    points = [(i, r.randint(-1100, 1100), r.randint(-1100, 1100)) for i in range(400)]
    p = spark.createDataFrame([*points, (900, None, 1)], "seq long, x int, y int")
    t = nearby.box_triangles(spark.createDataFrame(boxes, "area_id long, bounds struct<minx:int,miny:int,maxx:int,maxy:int>"), "area_id", "bounds")
    want = sorted((i, g) for i, x, y in points for g, (a, b, c, d) in boxes if a <= x <= c and b <= y <= d)
    assert sorted(map(tuple, nearby.inside_pairs(p, "seq", t).collect())) == want
    assert sorted(map(tuple, nearby.inside_pairs(p, "seq", t, broadcast_bound=0, leaf_size=50).collect())) == want


def test_one_answer_whatever_the_size(spark):
    """Repeated keys, boxes and points at one place: each bound and leaf size gives the same rows, one per point row and region."""
    box = lambda i, *b: (i, b)
    boxes = [box(1, 0, 0, 10, 10), box(2, 8, 0, 20, 10)] + [box(100 + i, 4, 4, 6, 6) for i in range(60)]
    points = [(7, 1, 1), (7, 1, 1), (8, 9, 5), (9, 5, 5), (9, 5, 5), (10, 50, 50)]
    p = spark.createDataFrame(points, "seq long, x int, y int")
    t = nearby.box_triangles(spark.createDataFrame(boxes, "area_id long, bounds struct<minx:int,miny:int,maxx:int,maxy:int>"), "area_id", "bounds")
    want = sorted((s, i) for s, x, y in points for i, (a, b, c, d) in boxes if a <= x <= c and b <= y <= d)
    near = sorted((s, q) for s, x, y in points for q, u, v in points if (x - u) ** 2 + (y - v) ** 2 <= 36)
    for few in ({}, {"broadcast_bound": 0, "leaf_size": 8}):
        assert sorted(map(tuple, nearby.inside_pairs(p, "seq", t, **few).collect())) == want
        assert sorted((x.p.seq, x.s.seq) for x in nearby.near_pairs(p, ["seq"], p, ["seq"], 6, **few).collect()) == near


@pytest.mark.parametrize("n, m", [(50, 60), (30_000, 50), (30_000, 40_000)])
def test_bitmaps(n, m):
    r = np.random.default_rng(n + m)
    a, b = r.integers(0, 65_536, n), r.integers(0, 65_536, m)
    A, B = Bitmap.of(a), Bitmap.of(b)
    sa, sb = set(a.tolist()), set(b.tolist())
    for got, want in ((A | B, sa | sb), (A & B, sa & sb), (A.and_not(B), sa - sb), (B.and_not(A), sb - sa)):
        assert set(got.positions().tolist()) == want and len(got) == len(want)
    assert (A.at is None) == (len(sa) > 4096)


@pytest.mark.parametrize("few, share", [(orphans.FEW, orphans.HOT_SHARE), (0, 4)])
def test_orphans_with_keys_of_text_and_a_hot_target(spark, monkeypatch, few, share):
    """Any kind of key is numbered; one missing target has a third of all references; both ways of decoding give the same rows."""
    monkeypatch.setattr(orphans, "FEW", few), monkeypatch.setattr(orphans, "HOT_SHARE", share)
    r = random.Random(11)
    parents = {f"k{i:05d}é": (r.random() < 0.2, r.choice([None, r.randrange(10**6)])) for i in range(0, 3000, 2)}
    refs = [(s, "gone" if s % 3 == 0 else f"k{r.randrange(3000):05d}é", r.choice([None, r.randrange(10**6)])) for s in range(3000)] + [(9, None, 1)]
    period = lambda us: orphans.UNKNOWN if us is None else us // 10**5
    p = spark.createDataFrame([("t", k, d, us, period(us)) for k, (d, us) in parents.items()], "ref_type string, ref_id string, is_deleted boolean, first_us long, first_period int")
    q = spark.createDataFrame([(s, "t", k, us, period(us)) for s, k, us in refs], "src long, ref_type string, ref_id string, ref_us long, period int")

    def reason(k, us):
        if k not in parents:
            return "missing"
        gone, first = parents[k]
        return "deleted" if gone else "late" if first is not None and us is not None and first > us else None

    want = sorted(((s, k, x) for s, k, us in refs if k is not None and (x := reason(k, us))), key=str)
    assert rows(orphans.orphan_references(q, p).select("src", "ref_id", "reason")) == want


def test_wide_log_compacts(spark):
    cols = [wide.WideColumn("a", "a", "integer"), wide.WideColumn("b", "b", "text")]
    r = random.Random(2)
    data = [(r.randrange(9), r.choice(["a", "b", "c"]), str(r.randrange(99)), r.randrange(5), r.randrange(9)) for _ in range(300)] + [(None, "a", "1", 1, 1)]
    df = spark.createDataFrame(data, "id long, k string, v string, rev int, pos int")
    log = wide.WideLog(spark, ["id"], cols)
    for i in range(3):
        log.append(df.where(f"id % 3 = {i} or rev = {i}"), "k", "v", ["rev", "pos"])
    log.append(df.where("rev > 2"), "k", "v", ["rev", "pos"], batch="rev")
    want = {}
    for i, k, v, rev, pos in data:
        if i is not None and k != "c":
            want[i, k] = max(want.get((i, k), (-1, -1, "")), (rev, pos, v))
    for _ in range(2):
        got = {(r["id"], c): tuple(r[c]) for r in log.read().collect() for c in ("a", "b") if r[c] is not None}
        assert got == want
        log.compact()


def test_batches_in_any_order_leave_one_state(spark):
    r = random.Random(7)
    base = [(i, r.randint(1, 4), r.random() < 0.2, None, "base") for i in range(12)]
    ch = [(i, r.randint(0, 6), r.random() < 0.3, s, f"c{s}") for s, i in enumerate(r.choices(range(16), k=60))]
    schema = "id long, version int, is_deleted boolean, seq long, v string"

    def state(batches):
        t = upsert.BucketedTable.create(spark.createDataFrame(base, schema), ["id"], 3)
        for n, b in enumerate(batches):
            deciding = upsert.deciding_changes(spark.createDataFrame(b, schema), ["id"], "version", "is_deleted", "seq", ["v"])
            t.apply(deciding, upsert.merge_versions(["id"], ["v"]), batch=n)
        return rows(t.read()), t.manifest()

    once, _ = state([ch])
    shuffled = ch + ch[:20]
    r.shuffle(shuffled)
    parts, manifest = state([shuffled[:25], shuffled[25:50], shuffled[50:]])
    assert parts == once and manifest["batch"] == 2
    touched = upsert.BucketedTable.create(spark.createDataFrame(base, schema), ["id"], 8)
    before = touched.manifest()["folders"]
    one = upsert.deciding_changes(spark.createDataFrame([(3, 9, False, 1, "x")], schema), ["id"], "version", "is_deleted", "seq", ["v"])
    changed = touched.apply(one, upsert.merge_versions(["id"], ["v"]))
    after = touched.manifest()["folders"]
    assert len(changed) == 1 and sum(before[b] != after[b] for b in before) == 1


def test_buckets_split_and_vacuum_and_stay_where_they_are(spark):
    schema = "id long, version int, is_deleted boolean, seq long, v string"
    base = [(i, 1, False, None, "x") for i in range(200)] + [(None, 1, False, None, "null key")]
    change = lambda *ids: upsert.deciding_changes(spark.createDataFrame([(i, 2, False, 1, "y") for i in ids], schema), ["id"], "version", "is_deleted", "seq", ["v"])
    t = upsert.BucketedTable.create(spark.createDataFrame(base, schema), ["id"], 4)
    t.apply(change(*range(0, 300, 3)), upsert.merge_versions(["id"], ["v"]))
    want = rows(t.read())
    assert len(want) == 201 + 33 and sum(x[4] == "y" for x in want) == 100
    t.split(4)
    assert rows(t.read()) == want and t.manifest()["buckets"] == 16
    t.apply(change(1), upsert.merge_versions(["id"], ["v"]))
    assert sum(x[4] == "y" for x in rows(t.read())) == 101
    assert t.vacuum() > 0 and sum(x[4] == "y" for x in rows(t.read())) == 101 and t.vacuum() == 0
    with buckets.in_bucket_order(spark):
        deciding = materialize(change(5, 6), "deciding")
        plan = upsert.merge_versions(["id"], ["v"])(t.read(), deciding)._jdf.queryExecution().executedPlan().toString()
    base_side = plan[plan.index("SortMergeJoin") :].split("BatchScan")[0]
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Bucketed: true" in base_side
    with pytest.raises(Exception):
        t._commit(t.manifest())


def test_long_chain_and_ring(spark):
    chain = [(i, i + 1) for i in range(40)]
    ring = [(100 + i, 100 + (i + 1) % 7) for i in range(7)]
    links = spark.createDataFrame(chain + ring + [(103, 200), (200, 201)], "src long, dst long")
    cycles = hierarchy.cycle_members(links)
    assert sorted(map(tuple, cycles.collect())) == [(100 + i, 100) for i in range(7)]
    paths = hierarchy.root_paths(links, cycles)
    assert {r["id"]: len(r["path"]) - 1 for r in paths.collect()} == {i: i for i in range(41)}


def test_rounds_are_logarithmic_beside_hubs(spark, monkeypatch):
    """A chain of a thousand links, alone, with a hub on it, and with a hub of no other link to it beside it: as many rounds, within a few."""
    doubled = []
    double = hierarchy._double
    monkeypatch.setattr(hierarchy, "_double", lambda *a: doubled.append(a) or double(*a))
    chain = [(i, i + 1) for i in range(1000)]
    hub = lambda at: [(5000 + i, at) for i in range(60)] + [(at, 6000 + i) for i in range(60)]
    for more in ([], hub(500), hub(9000)):
        links = spark.createDataFrame(chain + more, "src long, dst long")
        nodes = hierarchy._nodes(links)
        doubled.clear()
        got = {x.id: x.label for x in hierarchy.propagate_min(links, nodes.withColumn("label", F.col("id"))).collect()}
        assert got[1000] == 0 and got.get(6059, 0) == (0 if more[:1] == [(5000, 500)] else 5000 if more else 0) and len(doubled) <= 14
        doubled.clear()
        assert hierarchy._trim(links, len(chain) + len(more))[1] == 0 and len(doubled) <= 14


def test_labels_in_dense_layers(spark):
    """Every node of a layer to every one of the next: jumps stay few, labels are exact, rounds fewer than layers."""
    wide, deep = 12, 30
    links = spark.createDataFrame([(100 * k + i, 100 * (k + 1) + j) for k in range(deep) for i in range(wide) for j in range(wide)], "src long, dst long")
    labels = hierarchy.propagate_min(links, hierarchy._nodes(links).withColumn("label", F.col("id")))
    assert {x.label for x in labels.where(f"id >= {100 * deep}").collect()} == {0}
    jumps, n, all_links = links, links.count(), links.count()
    for k in range(6):
        jumps, n = hierarchy._double(jumps, n, all_links, k)
        assert n <= 12 * all_links
