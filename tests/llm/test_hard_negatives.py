"""Hard negatives against plain integer products."""

import random

import numpy as np
import pytest
from llm import hard_negatives as H
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, is_anchor, k=5, m=10):
    ok = lambda v: v is not None and all(x is not None and abs(x) < 16384 for x in v)
    held = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and ok(v)]
    out = []
    for n, (i, a, y) in enumerate(held):
        if not is_anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(a, b)), j, z) for o, (j, b, z) in enumerate(held) if o != n and len(b) == len(a)]
        for p, j, _ in sorted((s, j, 0) for s, j, z in scored if z == y)[:k]:
            inside = sorted((s, q) for s, q, z in scored if z != y and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(i, j, r, q, -p, -s) for r, (s, q) in enumerate(inside[:m], 1)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "dim", "ints", "found", "block", "score")}).repartition(4)
    out = H.hard_negatives(H.prepared(df), F.col("vec_id") % 10 == 0, **kw).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out)


def vectors(seed, n, d, spread=0.3, ties=False):
    rnd = random.Random(seed)
    draw = (lambda: rnd.choice([-0.25, 0.0, 0.25])) if ties else (lambda: rnd.gauss(0.1, spread))
    return [(i, [draw() for _ in range(d)], rnd.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("d,ties,spread", [(64, False, 0.3), (13, False, 90.0), (4, True, 0), (1, False, 3.0)])
def test_equals_brute_force(spark, d, ties, spread):
    rows = vectors(1, 200, d, spread, ties)
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []


@pytest.mark.parametrize("broadcast_bytes", [H.BROADCAST_BYTES, 0])
def test_odd_rows(spark, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(H, "LANE_ROWS", 40)
    rows = vectors(2, 120, 8) + [
        (None, [0.1] * 8, 1), (300, None, 1), (310, [0.1] * 8, None), (320, [None] + [0.1] * 7, 1), (330, [float("nan")] * 8, 1),
        (340, [float("inf")] * 8, 1), (350, [1e300] * 8, 1), (360, [], 1), (370, [], 2), (380, [0.1] * 5, 1), (381, [0.1] * 5, 1), (382, [0.05] * 5, 2),
        (390, [0.2] * 8, 2), (390, [0.2] * 8, 2), (391, [0.2] * 8, 0), (-10, [0.15] * 8, 1), (400, [16000.0] * 8, 1), (401, [9000.0] * 8, 2), (402, [15000.0] * 8, 1),
    ]
    assert found(spark, rows, broadcast_bytes=broadcast_bytes) == brute(rows, lambda i: i % 10 == 0)


def test_empty_tables_and_anchors_without_positives(spark):
    assert found(spark, []) == []
    assert found(spark, [(10, [1.0], 1), (11, [0.5], 2)]) == []


def test_many_equal_rows_keep_the_smaller_ids(spark):
    rows = [(k, [0.5, 0.5], 1) for k in range(300)] + [(1000 + k, [0.4, 0.3], 2) for k in range(9000)]
    got = [r for r in found(spark, rows) if r[0] == 0]
    assert [r[1] for r in got[::10]] == [1, 2, 3, 4, 5] and [r[3] for r in got[:10]] == list(range(1000, 1010))


def test_looked_up_sums_are_products():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-300, 300, (7, 21)), rng.integers(-5000, 5000, (4100, 21))
    assert (H.looked_up(H.subset_sums(a, np.int64), H.bit_planes(b)) == a @ b.T).all()
