"""p1, p7, p8 and p9: brute force on random rows, invariants, edge cases."""

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.llm import canonical, frequency, mixing, packing, queries
from geoweft.llm.tokens import LONG_BLANK, VOCABULARIES, VOCABULARY, encoding, token_count

from ..conftest import rows

CLASH = ("_s", "term", "slot", "_n", "mark", "records", "form", "raw", "raw_a", "cluster2", "copy", "place", "u", "n_tokens", "block", "uses", "rate")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(folder, spark, name):
    queries.QUERIES[name](spark, folder()).count()


def test_p1_brute_force(folder, spark):
    r = random.Random(4)
    words = ["Yes ", "no", " a;b", "b;;B ; a", "", " ", ";", None, "É", "é", "x;x;x", "\tq"]
    tag_rows = [{"ftype": r.choice(["node", "way", None]), "id": r.choice([*range(25), None]), "pos": p, "k": r.choice(["name", " Name", "NAME ", f"k{r.randrange(9)}", None, ""]), "v": r.choice(words), "rev": 1} for p in range(200)]
    tag_rows += tag_rows[:60]
    uses, elements, every = Counter(), defaultdict(set), set()
    for t in {(t["ftype"], t["id"], t["pos"]): t for t in tag_rows}.values():
        e = (t["ftype"], t["id"])
        if t["k"] is not None or t["v"] is not None:
            every.add(e)
        found = [("key", t["k"])] if t["k"] is not None else []
        found += [("value", x) for x in t["v"].split(";")] if t["v"] is not None else []
        for slot, x in found:
            x = x.strip(" ").lower()
            if x:
                uses[slot, x] += 1
                elements[slot, x].add(e)
    mark = lambda k: "rare" if len(elements[k]) < 3 else "common" if len(elements[k]) * 10 > len(every) else None
    d = folder(CLASH, tag_rows=tag_rows)
    assert {(x.slot, x.term): (x.occurrences, x.records, x.mark) for x in queries.p1_counts(spark, d).collect()} == {k: (n, len(elements[k]), mark(k)) for k, n in uses.items()}
    assert rows(queries.p1_found(spark, d)) == sorted(((*k, mark(k)) for k in uses if mark(k)), key=str)


def test_hot_records_count_the_same(folder, spark, monkeypatch):
    r = random.Random(12)
    tag_rows = [{"ftype": r.choice(["node", None]), "id": 1 if p % 3 == 0 else r.choice([*range(9), None]), "pos": p, "k": r.choice(["a", "B ", None]), "v": r.choice(["x;y", "z", None, "x;x"]), "rev": 1} for p in range(400)]
    d = folder(CLASH, tag_rows=tag_rows + tag_rows[::5])
    want = rows(queries.p1_counts(spark, d))
    monkeypatch.setattr(frequency, "HOT_ROWS", 20)
    assert frequency.record_stats(spark.read.parquet(f"{d}/tag_rows.parquet"), ["ftype", "id"], F.lit(True))[1]
    assert rows(queries.p1_counts(spark, d)) == want and sum(x[2] for x in want) > 400


SAME = [
    ("ﬁne ﬂow oﬀer", "fine flow offer"), ("ｆｕｌｌ　ｗｉｄｔｈ１２！", "full width12!"), ("café über", "café über"), ("a​b‌c‍d⁠e﻿f­g", "abcdefg"), ("x y z w v", "x y z w v"),
    ("раss СОRЕ іѕ јоу", "pass CORE is joy"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ ο", "ABEZHIKMNOPTYX o"), ("K Å Ω", "K Å Ω"), ("ё й", "ё й"), ("é", "e​́"), ("ﾊﾞﾃﾞ", "バデ"), ("각", "각"), ("a\r\nb", "a\nb"), ("ĳ ǆ", "ij dž"),
    ("q̣̇", "q̣̇"), ("x️", "x"), ("", "​"),
]
DIFFERENT = [("x²", "x2"), ("ø", "o"), ("e", "é"), ("A", "a"), ("a  b", "a b"), ("½", "1/2"), ("ſ", "s"), ("™", "TM"), ("٣", "3"), ("a\nb", "a b"), ("1", "l"), ("0", "O"), ("в", "b"), ("a", "ª"), ("—", "-"), ("ß", "ss"), ("‮ab", "ab")]


def test_canonical_forms():
    for a, b in SAME:
        assert canonical.canonical_text(a) == canonical.canonical_text(b), (a, b)
    for a, b in DIFFERENT:
        assert canonical.canonical_text(a) != canonical.canonical_text(b), (a, b)
    assert canonical.canonical_text(None) is None
    t, r = canonical.transducer(), random.Random(1)
    pool = "".join(x for p in SAME + DIFFERENT for x in p) + "́̈​ abc\x00\x0b\r"
    for _ in range(600):
        s = "".join(r.choice(pool) for _ in range(r.randint(0, 12)))
        once = t(s)
        assert t(once) == once and unicodedata.is_normalized("NFC", once)
        assert t("plain " + s + " text") == "plain " + once + " text" or s[:1] and canonical.transducer().follows.match(s)
    long = "naïve ﬁeld " * 100_000
    assert t(long) == "naïve field " * 100_000


def test_every_entry_of_the_mapping_is_found_everywhere():
    """Recall over generated variants of each entry: alone, within words, beside marks, hidden characters and other entries."""
    t, r = canonical.transducer(), random.Random(5)
    alike = canonical.look_alikes()
    entries = sorted(t.table.items())
    assert len(entries) > 5000
    found = tried = 0
    for key, form in entries:
        other, other_form = r.choice(entries)
        for spelled, plain in ((key, form), (f"ab{key}cd", f"ab{form}cd"), (f"{key}\u200b\u0301z", f"{form}\u0301z"), (f"x{key} {other}{key}", f"x{form} {other_form}{form}"), (unicodedata.normalize("NFD", key) + "n", form + "n")):
            tried += 1
            found += t(spelled) == t(plain)
    assert found >= 0.99 * tried, (found, tried)
    for pair in ("ПΠ", "ГΓ", "ФΦ", "օo", "ոn", "ᎪA", "ᏃZ", "ᎳW", "ⲞO", "ꓐB"):
        assert t(pair[0]) == t(pair[1]) and t(f"q{pair[0]}\u0301") == t(f"q{pair[1]}\u0301")
    for _ in range(3000):
        cluster = r.choice("aeЕоᎪﾊｅ") + "".join(r.choice("\u0301\u0323\u200b\u0302\uff9e") for _ in range(r.randint(0, 4)))
        assert t(cluster) == canonical.formed(cluster, alike)


def test_conflicts_are_refused(monkeypatch):
    monkeypatch.setattr(canonical, "SCRIPTS", (("а", "a"), ("а", "o")))
    with pytest.raises(ValueError):
        canonical.look_alikes()
    monkeypatch.setattr(canonical, "SCRIPTS", (("а", "ο"), ("ο", "o")))
    with pytest.raises(ValueError):
        canonical.look_alikes()


def test_p9_pairs(folder, spark):
    r = random.Random(9)
    texts = ["fine", "ﬁne", "fi​ne", None, "", "​", "Fine", "finé", "finé", "ｆine"]
    docs = [{"doc_id": i, "text": r.choice(texts)} for i in range(60)]
    d = folder(CLASH, documents=docs)
    form = {x["doc_id"]: canonical.canonical_text(x["text"]) for x in docs}
    raw = {x["doc_id"]: x["text"] for x in docs}
    want = sorted(((a, b) for a in form for b in form if a < b and form[a] is not None and form[a] == form[b] and raw[a] != raw[b]), key=str)
    assert rows(queries.p9_found(spark, d)) == want
    classes = {x.doc_id: x.class_id for x in queries.p9_classes(spark, d).collect()}
    assert classes == {i: min(j for j in form if form[j] == f) for i, f in form.items() if f is not None}


def test_token_counts():
    import os

    e = encoding(os.path.join(VOCABULARIES, VOCABULARY))
    for text in ("", "two words", "x" * 50_000, "a" + "\n" * (LONG_BLANK - 2), "é✓" * 1000):
        assert token_count(e, text) == len(e.encode_ordinary(text))
    assert token_count(e, "a" + " " * 1_000_000 + "b") > 1000
    short = "a" + " " * (LONG_BLANK - 10) + "b c"
    pieces = sum(len(e._encode_single_piece(p)) for p in __import__("geoweft.llm.tokens", fromlist=["_pieces"])._pieces().findall(short))
    assert pieces == token_count(e, short)


def test_a_hot_document_spreads_over_all_blocks(spark):
    """Sixty thousand equal rows of one document, and rows of one cluster: every block has its share, each row is placed once."""
    items = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("cluster"), F.lit(5).cast("long").alias("n_tokens"))
    kinds = spark.createDataFrame([("k", 50)], "container_kind string, capacity_tokens int")
    placed = packing.pack(items, kinds, block_items=300)
    per_block = Counter(x.container_id.split("-")[1] for x in placed.where("doc_id = 1").collect())
    assert placed.count() == 3000 and len(per_block) == 10 and sum(per_block.values()) == 1000 and max(per_block.values()) < 200
    strict = packing.pack(items, kinds, 300, source_conflict=True)
    assert strict.count() == 3000 == strict.select("container_id").distinct().count()


def test_the_bound_holds():
    r = random.Random(8)
    for _ in range(60):
        capacity = r.choice([9, 10, 31])
        sizes = [r.randint(0, capacity) for _ in range(r.randint(1, 8))]
        bins: list[int] = []

        def fewest(i, bins):
            if i == len(sizes):
                return len(bins)
            best = 99
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= capacity:
                    bins[b] += sizes[i]
                    best = min(best, fewest(i + 1, bins))
                    bins[b] -= sizes[i]
            return min(best, fewest(i + 1, [*bins, sizes[i]]))

        least = packing.least_containers(np.array(sizes), np.ones(len(sizes), np.int64), capacity)
        assert least <= fewest(0, bins) and least >= -(-sum(sizes) // capacity)


def test_best_fit_is_tight():
    r = random.Random(3)
    for capacity in (10, 1000):
        sizes = [r.randint(0, capacity - 1) for _ in range(400)]
        clusters = [r.choice([-1, -1, -1, *range(30)]) for _ in sizes]
        sources = [r.choice([-1, 0, 1, 2]) for _ in sizes]
        placed = packing.best_fit(sizes, sources, clusters, capacity)
        fill, held = defaultdict(int), defaultdict(list)
        for s, c, b in zip(sizes, clusters, placed):
            fill[b] += s
            held[b] += [c] if c >= 0 else []
        assert max(fill.values()) <= capacity and all(len(x) == len(set(x)) for x in held.values())
        assert len(fill) <= max(-(-sum(sizes) // capacity) * 1.03 + 2, max(Counter(c for c in clusters if c >= 0).values()))


def test_p7_places_everything_once(folder, spark):
    r = random.Random(6)
    docs = [{"doc_id": i, "text": None if i % 17 == 0 else "" if i % 19 == 0 else "word " * r.choice([1, 20, 90, 300]), "source": r.choice([" A", "a", "b", None]), "paper_key": r.choice([f"P{i % 7}", None, " "])} for i in range(150)]
    docs += docs[1:3]
    kinds = [{"container_kind": "s", "capacity_tokens": 64}, {"container_kind": "m", "capacity_tokens": 256}, {"container_kind": "bad", "capacity_tokens": 0}, {"container_kind": None, "capacity_tokens": 5}]
    d = folder(CLASH, documents=docs, containers=kinds)
    import os

    e = encoding(os.path.join(VOCABULARIES, VOCABULARY))
    size = {x["doc_id"]: token_count(e, x["text"]) for x in docs if x["text"] is not None}
    copies = Counter(x["doc_id"] for x in docs if x["text"] is not None)
    got = queries.p7_packed(spark, d).collect()
    for kind, cap in (("s", 64), ("m", 256)):
        mine = [x for x in got if x.container_kind == kind]
        used, per_doc, papers = defaultdict(int), defaultdict(list), defaultdict(list)
        paper = {x["doc_id"]: (x["paper_key"] or "").strip() for x in docs}
        for x in mine:
            used[x.container_id] += x.n_tokens
            per_doc[x.doc_id].append((x.first_token, x.n_tokens))
            if paper[x.doc_id]:
                papers[x.container_id].append(paper[x.doc_id])
        assert all(used[x.container_id] == x.used_tokens <= cap for x in mine)
        assert all(len(p) == len(set(p)) for p in papers.values())
        for i, n in size.items():
            want = sorted((s, min(cap, n - s)) for s in range(0, max(n, 1), cap)) * copies[i]
            assert sorted(per_doc[i]) == sorted(want)
    assert {x.container_kind for x in got} == {"s", "m"}
    whole = {x.container_kind: x for x in queries.p7_fill(spark, d).collect()}
    assert whole["m"].tokens == sum(size[i] * n for i, n in copies.items())


def _tail_rates(u, k):
    """The rate at which a Poisson count with the uniform number `u` reaches `k`: where P(X < k) falls to u. By bisection."""
    low, high = np.zeros(len(u)), np.full(len(u), mixing.TOP_RATE)
    for _ in range(60):
        mid = (low + high) / 2
        more = mixing.below(k, mid) > u
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    return high


def test_rates_from_cells(spark):
    """The rate found on cells draws as many tokens as one found on all documents, and no more than asked for."""
    r = np.random.default_rng(3)
    docs = [(int(i), "s" if i % 3 else "t", int(n)) for i, n in enumerate(r.integers(1, 900, 5000))]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    u = {x.doc_id: x.u for x in sizes.select("doc_id", mixing.uniform(F.col("doc_id"), 1).alias("u")).collect()}
    plan = {p["source"]: p for p in mixing.plan_mix(sizes, spark.createDataFrame([("s", 0.3, 4), ("t", 0.7, 3)], "source string, target_share double, max_repeats int"))}
    drawn = lambda rate: sum(n * sum(u[i] >= float(mixing.below(k, rate)) for k in range(1, 5)) for i, s, n in docs if s == "s")
    goal, rate = plan["s"]["tokens_aimed"], plan["s"]["rate"]
    assert plan["t"]["rate"] == float("inf") and goal - 900 <= drawn(rate) <= goal


def test_poisson_inversion():
    rate = 1.7
    u = np.random.default_rng(1).random(20_000)
    counts = sum((_tail_rates(u, k) <= rate).astype(int) for k in range(1, 12))
    assert abs(counts.mean() - rate) < 0.03 and abs(counts.var() - rate) < 0.08
    assert np.array_equal(_tail_rates(u[:500], 2) <= rate, u[:500] >= mixing.below(2, rate))


def test_p8_shares_and_caps(folder, spark):
    r = random.Random(8)
    names = ["big", " BIG", "mid", "small", "unlisted", None]
    docs = [{"doc_id": i, "text": "tok " * r.randint(0, 60) if i % 23 else None, "source": r.choices(names, [60, 10, 20, 4, 5, 1])[0]} for i in range(3000)]
    targets = [{"source": "Big ", "target_share": 0.5, "max_repeats": 1}, {"source": "mid", "target_share": 0.3, "max_repeats": 2}, {"source": "small", "target_share": 0.1, "max_repeats": 4}, {"source": "nobody", "target_share": 0.1, "max_repeats": 3}]
    d = folder(CLASH, documents=docs, mix_targets=targets)
    got = {x.source: x for x in queries.p8_shares(spark, d).collect()}
    assert got["nobody"].tokens == 0 and got["nobody"].aim_share == 0
    for s in ("big", "mid", "small"):
        assert abs(got[s].reached_share - got[s].aim_share) < 0.003 and got[s].most_uses <= got[s].max_repeats, got[s]
    assert any(got[s].most_uses == got[s].max_repeats for s in ("big", "mid", "small"))
    drawn = queries.p8_mixed(spark, d).collect()
    uses = Counter(x.doc_id for x in drawn)
    cap = {"big": 1, "mid": 2, "small": 4}
    text = {x["doc_id"]: x["text"] for x in docs}
    assert all(n <= cap[x.source] for x in drawn for n in [uses[x.doc_id]]) and all(x.text == text[x.doc_id] is not None for x in drawn)
    assert sum(got[s].documents for s in cap) == len(uses)
    assert rows(queries.p8_mixed(spark, d).drop("text")) == sorted((tuple(x)[:2] + tuple(x)[3:] for x in drawn), key=str)
    places = [x.place for x in drawn]
    assert places == sorted(places)


def test_mix_targets_are_checked(spark):
    sizes = spark.createDataFrame([(1, "a", 5)], "doc_id long, source string, n_tokens long")
    for bad in ([("a", 0.5, 1), ("A ", 0.5, 2)], [("a", 0.5, 1000)]):
        with pytest.raises(ValueError):
            mixing.plan_mix(sizes, spark.createDataFrame(bad, "source string, target_share double, max_repeats int"))
    plan = mixing.plan_mix(sizes, spark.createDataFrame([("a", 0.5, 3)], "source string, target_share double, max_repeats int"))
    assert plan[0]["tokens_aimed"] == 15 and sizes.select(mixing.repeats(plan).alias("n")).collect()[0].n == 3


def test_hot_groups(folder, spark):
    """A third of all rows in one term, one cluster, one source and one text."""
    docs = [{"doc_id": i, "text": "same text" if i % 3 == 0 else f"text {i}", "source": "hot" if i % 3 == 0 else f"s{i % 5}", "paper_key": "P" if i % 3 == 0 else None} for i in range(300)]
    docs.append({"doc_id": 999, "text": "same​ text"})
    d = folder(documents=docs, containers=[{"container_kind": "c", "capacity_tokens": 16}], tag_rows=[{"ftype": "node", "id": i // 3, "pos": i, "k": "name", "v": "yes" if i % 3 == 0 else str(i)} for i in range(300)])
    assert queries.p9_found(spark, d).count() == 100
    packed = queries.p7_packed(spark, d)
    assert packed.count() == 301 and packed.where("doc_id % 3 = 0 and doc_id < 999").select("container_id").distinct().count() == 100
    assert ("value", "yes", "common") in rows(queries.p1_found(spark, d))
    assert queries.p1_counts(spark, d).where(F.col("term") == "name").collect()[0].occurrences == 300


def test_equal_texts_of_other_papers_stay_apart(spark, folder):
    doc = lambda i, text, paper: {"doc_id": i, "text": text, "source": "s", "paper_key": paper}
    docs = [doc(1, "same words", "a"), doc(2, "same words", "b"), doc(3, "another", "a"), doc(4, "more", "b"), doc(5, "same words", None), doc(6, "alone", None), doc(7, "", None), doc(8, "", None)]
    d = folder(documents=docs, containers=[{"container_kind": "k", "capacity_tokens": 1000}])
    placed = {x.doc_id: x.container_id for x in queries.p7_packed(spark, d).collect()}
    assert len(placed) == 8 and len({placed[i] for i in range(1, 6)}) == 5 and len(set(placed.values())) == 5
