"""The Jaccard join against brute force, on groups within and beyond a block."""

import random

import pytest
from llm import jaccard
from llm.graph import components
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of, jaccard_brute, odd_rows, with_clashes


def check(spark, rows, **options):
    got = jaccard.jaccard_classes(with_clashes(docs_of(spark, rows)), **options).collect()
    expected = jaccard_brute(rows)
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, class_id={c}, n_links={n})" for (i, _), (c, n) in zip(rows, (expected[k] for k in range(len(rows))), strict=True))


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return out


@pytest.fixture(scope="module")
def near():
    rng = random.Random(6)
    rows = []
    for g in range(25):
        base = [f"g{g}w{k}" for k in range(rng.choice([1, 4, 5, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 3, 9])):
            rows.append(" ".join(changed(rng, base, rng.choice([0, 0, 1, 2, 4, len(base) // 30]))))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark, near):
    check(spark, near)


def test_odd_rows(spark):
    check(spark, odd_rows())


def test_hot_group_in_many_blocks(spark, near, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 7)
    rng = random.Random(8)
    base = [f"h{k}" for k in range(150)]
    hot = [(1000 + i, " ".join(changed(rng, base, rng.choice([0, 1, 2, 3, 4])))) for i in range(90)]
    check(spark, near + hot)


def test_joins_instead_of_broadcasts(spark, near, monkeypatch):
    monkeypatch.setattr(jaccard, "broadcast_if_few", lambda df: df)
    check(spark, near)


def test_pairs(spark, near):
    pairs, membership = jaccard.jaccard_pairs(docs_of(spark, near))
    got = pairs.collect()
    node = {r.doc_id: r.node for r in membership.collect()}
    expected = jaccard_brute(near)
    copies = {}
    for n in node.values():
        copies[n] = copies.get(n, 0) + 1
    links = {n: c - 1 for n, c in copies.items()}
    for r in got:
        assert r.similarity >= 0.8
        links[r.a] += copies[r.b]
        links[r.b] += copies[r.a]
    assert all(links[node[i]] == expected[i][1] for i, _ in near if i in node)


def test_one_of_each_class_stays(spark, near):
    docs = with_clashes(docs_of(spark, near + [(500, "same id"), (500, "same id"), (None, "x"), (None, "x")]))
    kept = jaccard.keep_one_each(docs)
    assert kept.columns == docs.columns
    expected = sorted({str(c) for c, _ in jaccard_brute(near).values()} | {"500"}) + ["None", "None"]
    assert sorted(str(r.doc_id) for r in kept.collect() if r.doc_id is not None) + ["None", "None"] == expected
    assert kept.where("doc_id is null").count() == 2


def test_empty_table(spark):
    assert jaccard.jaccard_classes(docs_of(spark, [])).count() == 0
    assert jaccard.keep_one_each(docs_of(spark, [])).count() == 0


def test_depth_meets_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        d = jaccard.matched_depth(threshold)
        assert 1 - (1 - threshold**d) ** jaccard.TREES >= jaccard.RECALL
        assert d == jaccard.DEPTH or 1 - (1 - threshold ** (d + 1)) ** jaccard.TREES < jaccard.RECALL


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges, expected = [], {}
    for g in range(12):
        ids = rng.sample(range(g * 1000, g * 1000 + 1000), 40)
        edges += list(zip(ids, ids[1:])) if g % 2 else [(ids[0], x) for x in ids[1:]]
        expected |= {x: min(ids) for x in ids if x != min(ids)}
    frame = spark.createDataFrame([(a, b) for a, b in edges], "a long, b long").repartition(5)
    got = components(frame)
    assert {r.a: r.b for r in got.collect()} == expected
    assert components(frame.where(F.lit(False))).count() == 0


def test_one_id_under_two_texts_is_judged_by_text(spark):
    t1, t2 = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    near = t1.replace("a29", "zz")
    rows = [(3, t1), (5, t1), (5, t2), (5, near), (2, t2 + " end"), (7, t1.replace(" ", "  ")), (7, t1), (8, None), (8, ""), (None, t1), (5, t1)]
    left = jaccard.keep_one_each(docs_of(spark, rows)).collect()
    # (5, t2) is near (2, t2 end); the class of t1 keeps (3, t1).
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id and r.text) == [(2, t2 + " end"), (3, t1)]
    assert [r.text for r in left if r.doc_id is None] == [t1] and sum(r.doc_id == 8 for r in left) == 2
    alone = jaccard.keep_one_each(docs_of(spark, [(3, t1), (5, t1), (5, t2), (5, t2)])).collect()
    assert sorted((r.doc_id, r.text) for r in alone) == [(3, t1), (5, t2)]
