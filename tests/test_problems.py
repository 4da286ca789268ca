"""p2 to p6 on small tables: nulls, ties, repeats, empty tables, clashing columns, and brute force on random ones."""

import datetime
import random

import pytest

from geoweft.plans import problems

from .conftest import rows

T0 = datetime.datetime(2024, 1, 15)
CLASH = ("_p", "p", "s", "_c", "_o", "_r", "k2", "src", "dst", "label", "leaf", "_bucket", "rng", "version2", "seq2")


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_empty_tables(folder, spark, name):
    assert problems.QUERIES[name](spark, folder()).count() == 0


def node(i, version=1, x=None, y=None, **more):
    return {"id": i, "version": version, "x": x, "y": y, "ts": T0, **more}


def change(seq, i, x, y, ftype="node", **more):
    return {"seq": seq, "ftype": ftype, "id": i, "x": x, "y": y, "version": 2, "op": "modify", **more}


def test_p2_edges(folder, spark):
    top = 2**31 - 1
    d = folder(
        CLASH,
        nodes=[node(1, 1, 0, 0), node(1, 2, 10_000, 0), node(2, 1, 120, 160), node(3, 1, 200, 0), node(4, 1, 201, 0), node(5, 1, 0, 0, is_deleted=True), node(6, 1, None, 0), node(7, 1, -top - 1, 5), node(2, 1, 120, 160)],
        changes=[change(1, 9, 0, 0), change(1, 9, 0, 0), change(2, 2, 120, 160), change(3, 9, None, 0), change(4, 9, 0, 0, is_deleted=True), change(5, 9, 0, 0, op=" Delete "), change(6, 9, top, 5), change(7, 9, 0, 0, ftype="way"), change(8, None, 0, 0)],
        load_areas=[
            {"area_id": 1, "bounds": (0, 0, 10, 10)},
            {"area_id": 2, "bounds": (0, 0, 0, 0)},
            {"area_id": 3, "bounds": (5, 5, 4, 4)},
            {"area_id": 4, "bounds": (top, 0, -top - 1, 9)},
            {"area_id": 5, "bounds": None},
            {"area_id": 6, "bounds": (None, 0, 1, 1)},
            {"area_id": 7, "bounds": (0, -5, 200, 0)},
        ],
    )
    got = rows(problems.p2_found(spark, d))
    near = {(s, o) for k, s, o in got if k == "near"}
    assert near == {(1, 2), (1, 3), (2, 3), (2, 4), (6, 7), (8, 2), (8, 3)}
    assert {(s, o) for k, s, o in got if k == "inside"} == {(1, 1), (1, 2), (1, 7), (6, 4), (8, 1), (8, 2), (8, 7)}
    assert len(got) == len(set(got))


def test_p2_brute_force(folder, spark):
    r = random.Random(3)
    at = lambda: (r.choice([-(2**31), 0, 2**31 - 1]) + r.randint(-700, 700) + 2**31) % 2**32 - 2**31
    nodes = [node(i, 1, at(), r.randint(-400, 400)) for i in range(150)]
    changes = [change(s, r.randrange(200), at(), r.randint(-400, 400)) for s in range(120)]
    want = set()
    for c in changes:
        for n in nodes:
            dx = abs(c["x"] - n["x"])
            if n["id"] != c["id"] and min(dx, 2**32 - dx) ** 2 + (c["y"] - n["y"]) ** 2 <= 40_000:
                want.add((c["seq"], n["id"]))
    got = [(s, o) for k, s, o in rows(problems.p2_found(spark, folder(nodes=nodes, changes=changes))) if k == "near"]
    assert set(got) == want and len(got) == len(want)


COLUMNS = [{"k": k, "col_name": k, "col_type": t} for k, t in (("n", "integer"), ("d", "decimal"), ("b", "boolean"), ("day", "date"), ("t", "text"))]
CASES = [
    ("n", "+007", "7"), ("n", " -0 ", "0"), ("n", "9223372036854775808", None), ("n", "-9223372036854775808", "-9223372036854775808"), ("n", "1.0", None), ("n", "12\n", None), ("n", "", None), ("n", "٣", None), ("n", "0000000000000000000000012", "12"),
    ("d", "+03.5", "3.50"), ("d", "-0.00", "0.00"), ("d", "7", "7.00"), ("d", "007.25", "7.25"), ("d", "1.", None), ("d", ".5", None), ("d", "1.234", None), ("d", "-" + "9" * 60 + ".1", "-" + "9" * 60 + ".10"),
    ("b", " YES ", "true"), ("b", "0", "false"), ("b", "No", "false"), ("b", "on", None),
    ("day", "2024-02-29", "2024-02-29"), ("day", "2023-02-29", None), ("day", "2024-2-9", None), ("day", "0000-01-01", None), ("day", "2024-01-01 ", "2024-01-01"), ("day", "2024-01-01T", None),
    ("t", "  a b ", "a b"), ("t", "   ", None), ("t", "\t", "\t"), ("t", None, None),
]


def test_p3_cells(folder, spark):
    tag_rows = [{"ftype": "node", "id": i, "pos": 0, "k": f" {k.upper()} ", "v": v, "rev": 1, "ts": T0} for i, (k, v, _) in enumerate(CASES)]
    got = {i: (c, v) for _, i, c, v in rows(problems.p3_found(spark, folder(CLASH, tag_rows=tag_rows, tag_columns=COLUMNS)))}
    for i, (k, v, want) in enumerate(CASES):
        assert got.get(i) == (None if want is None else (k, want)), (k, v)


def test_p3_latest(folder, spark):
    row = lambda pos, v, rev, k="t", ts=T0: {"ftype": "way", "id": 1, "pos": pos, "k": k, "v": v, "rev": rev, "ts": ts}
    late = datetime.datetime(2020, 5, 1)
    d = folder(tag_rows=[row(0, "old", 1), row(9, "older", 1, ts=late), row(1, "new", 2, ts=late), row(2, "newest", 2), row(2, "newest", 2), row(0, "x", 3, "other"), row(3, "7", 5, "n"), row(4, None, 5, "n", None)], tag_columns=COLUMNS)
    assert rows(problems.p3_found(spark, d)) == [("way", 1, "t", "newest")]
    wide = problems.p3_wide(spark, d).collect()[0].asDict()
    assert wide["t"] == "newest" and wide["n"] is None and wide["id"] == 1


def test_p4_rules(folder, spark):
    c = lambda seq, i, version, ftype="node", **more: {"seq": seq, "ftype": ftype, "id": i, "version": version, "op": "modify", **more}
    d = folder(
        CLASH,
        nodes=[node(1, 3, 0, 0), node(2, 3, 0, 0), node(3, 3, 0, 0), node(4, 3, 0, 0), node(5, 3, 0, 0, is_deleted=True), node(5, 2, 0, 0), node(7, 3, 0, 0)],
        changes=[
            c(1, 1, 4), c(2, 1, 4), c(2, 1, 4), c(9, 1, 3),
            c(3, 2, 3),
            c(4, 3, 3, op="delete"), c(5, 3, 3),
            c(6, 4, None),
            c(7, 5, 4, is_deleted=True), c(8, 5, 4),
            c(10, 6, 1), c(11, 7, 5), c(12, 7, 4, op="DELETE "),
            c(20, 1, 1, "way", refs=[1]), c(21, 2, 1, "way", refs=[1, 2]), c(22, 3, 1, "way", refs=None), c(23, 1, 1, "relation", members=[]), c(24, 2, 1, "relation", members=[("n", 1, None)]),
            c(25, None, 1), c(30, 8, 0, op="delete"), c(31, 9, 0),
        ],
    )
    got = {(f, i): (s, o) for f, i, s, o in rows(problems.p4_found(spark, d))}
    assert got == {
        ("node", 1): (1, "live"), ("node", 3): (4, "deleted"), ("node", 5): (7, "deleted"), ("node", 6): (10, "live"), ("node", 7): (11, "live"), ("node", 8): (30, "deleted"),
        ("way", 1): (20, "deleted"), ("way", 2): (21, "live"), ("way", 3): (22, "deleted"), ("relation", 1): (23, "deleted"), ("relation", 2): (24, "live"),
    }
    state = {(r["ftype"], r["id"]): (r["version"], r["outcome"], r["seq"]) for r in problems.p4_state(spark, d).collect()}
    assert state[("node", 2)] == (3, "live", None) and state[("node", 4)] == (3, "live", None) and ("node", 9) not in state


def test_p5_reasons(folder, spark):
    later, before = T0 + datetime.timedelta(days=1), T0 - datetime.timedelta(days=400)
    m = lambda t, r: (0, t, r, None)
    d = folder(
        CLASH,
        nodes=[node(1), node(2, is_deleted=True), node(3, ts=later), node(4, ts=None), node(5, 1, ts=before), node(5, 2, ts=later), node(6, 2, ts=later), {**node(6, 1), "ts": None}, node(70_000, is_deleted=True), {"id": 8, "version": 1, "ts": before, "is_deleted": True}],
        ways=[
            {"id": 1, "version": 1, "ts": T0, "node_ids": [1, 2, 3, 4, 5, 6, 7, 7, None, 70_000]},
            {"id": 2, "version": 1, "ts": T0, "node_ids": [99], "is_deleted": True},
            {"id": 3, "version": 1, "ts": T0, "node_ids": [99]},
            {"id": 3, "version": 2, "ts": None, "node_ids": [3, -5]},
            {"id": 4, "version": 1, "ts": T0, "node_ids": None},
        ],
        relations=[{"id": 1, "version": 1, "ts": T0, "members": [m("W", 2), m("way", 2), m("r", 1), m("Relation", 9), m("N", 8), m("x", 1), m(None, 1), m("n", None)]}, {"id": 2, "version": 1, "ts": T0, "members": []}],
    )
    got = rows(problems.p5_found(spark, d))
    month = "2024-01"
    assert got == sorted(
        [
            ("ways", month, 1, "node", 2, "deleted"), ("ways", month, 1, "node", 3, "late"), ("ways", month, 1, "node", 6, "late"), ("ways", month, 1, "node", 7, "missing"), ("ways", month, 1, "node", 70_000, "deleted"),
            ("ways", "unknown", 3, "node", -5, "missing"),
            ("relations", month, 1, "way", 2, "deleted"), ("relations", month, 1, "relation", 9, "missing"), ("relations", month, 1, "node", 8, "deleted"),
        ],
        key=str,
    )


def _brute_hierarchy(links):
    down = {}
    for a, b in links:
        down.setdefault(a, set()).add(b)
    into = {b for _, b in links}
    out = set()
    for r in set(down) - into:
        stack = [(r,)]
        while stack:
            p = stack.pop()
            out.add(("tree", r, p[-1], len(p) - 1, "/".join(map(str, p))))
            stack += [(*p, x) for x in down.get(p[-1], ()) if x not in p]

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for x in down.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    every = {a: reach(a) for a in down}
    for a in down:
        if a in every[a]:
            out.add(("cycle", min(b for b in every[a] if a in every.get(b, ())), a, 0, ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_p6_brute_force(folder, spark, seed):
    r = random.Random(seed)
    ids = range(1, 26)
    links = {(a, b) for a in ids for b in ids if r.random() < 0.035 or b == a + 1 and a < 9}
    links |= {(20, 20)}
    rel = [{"id": i, "version": 1, "members": [(p, r.choice(["r", "R", "relation"]), b, None) for p, b in enumerate(sorted(b for a, b in links if a == i))] + [(90, "r", 999, None), (91, "n", 5, None), (92, "r", None, None)]} for i in ids]
    rel += [{"id": 30, "version": 1, "members": [(0, "r", 1, None)]}, {"id": 30, "version": 2, "members": [(0, "r", 1, None)], "is_deleted": True}, {"id": 31, "version": 1, "members": None}]
    got = rows(problems.p6_found(spark, folder(relations=rel)))
    assert got == _brute_hierarchy(links)


def test_hot_groups(folder, spark):
    """A third of all rows in one place, element, target and parent: results stay whole."""
    m = lambda p, t, i: (p, t, i, None)
    d = folder(
        nodes=[node(i, 1, 7 if i % 3 == 0 else 10_000 * i, 7) for i in range(1, 91)],
        ways=[{"id": i, "version": 1, "ts": T0, "node_ids": [999 if i % 3 == 0 else i, i]} for i in range(1, 91)],
        relations=[{"id": 1, "version": 1, "ts": T0, "members": [m(i, "r", i) for i in range(2, 42)]}] + [{"id": i, "version": 1, "ts": T0, "members": [m(0, "n", 1)]} for i in range(2, 42)],
        changes=[change(s, 3 if s % 3 == 0 else 200 + s, 7 if s % 3 == 0 else -5000 * s, 7, **{"version": s + 2}) for s in range(90)],
        tag_rows=[{"ftype": "node", "id": 1 if p % 3 == 0 else p, "pos": p, "k": "n", "v": str(p), "rev": 1, "ts": T0} for p in range(90)],
        tag_columns=COLUMNS,
    )
    assert sum(k == "near" for k, *_ in rows(problems.p2_found(spark, d))) == 30 * 29
    cells = {i: v for _, i, _, v in rows(problems.p3_found(spark, d))}
    assert cells[1] == "87" and len(cells) == 60
    assert {(i, s) for _, i, s, _ in rows(problems.p4_found(spark, d)) if i == 3} == {(3, 87)}
    assert sum(r == "missing" and i == 999 for *_, i, r in rows(problems.p5_found(spark, d))) == 30
    assert sum(k == "tree" for k, *_ in rows(problems.p6_found(spark, d))) == 41
