"""Block matching and greedy selection against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockcount import scale
from stockcount.operators import absorb, blockmatch, detections, greedy, identify, knn

D = 6


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-10)[:, None]


def vectors(seed, n):
    return np.random.default_rng(seed).normal(size=(n, D)).astype("float32")


def frame(spark, names, rows, types):
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


@pytest.mark.parametrize("broadcast_bytes", [100_000_000, 0])
def test_topk_equals_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(blockmatch, "QUERY_ROWS", 7)
    monkeypatch.setattr(blockmatch, "REF_ROWS", 5)
    q, r = vectors(1, 40), vectors(2, 90)
    r[10] = r[50]  # equal similarity under two labels
    labels = [f"L{i % 23:02d}" for i in range(90)]
    queries = frame(spark, ["crop_id", "embedding"], [(i, v.tolist()) for i, v in enumerate(q)], ["long", "array<float>"])
    refs = frame(
        spark, ["ean", "embedding"], [(lab, v.tolist()) for lab, v in zip(labels, r)], ["string", "array<float>"]
    ).repartition(4)
    got = {}
    for row in knn.search(queries, refs, k=4, broadcast_bytes=broadcast_bytes).collect():
        got.setdefault(row.crop_id, []).append((row["rank"], row.ean, row.similitud))
    sims = unit(q.astype("float64")) @ unit(r.astype("float64")).T
    for i in range(40):
        best = {}
        for lab, s in zip(labels, sims[i]):
            best[lab] = max(best.get(lab, -9), s)
        want = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:4]
        have = sorted(got[i])
        assert [h[1] for h in have] == [w[0] for w in want]
        assert [h[2] for h in have] == pytest.approx([w[1] for w in want])


def test_zero_query_and_wrong_size_find_nothing(spark):
    queries = frame(spark, ["crop_id", "embedding"], [(1, [0.0] * D), (2, [1.0] * (D + 1)), (3, [1.0] * D)], ["long", "array<float>"])
    refs = frame(spark, ["ean", "embedding"], [("A", [1.0] * D)], ["string", "array<float>"])
    assert [r.crop_id for r in knn.search(queries, refs, dimension=D).collect()] == [3]
    prompts = refs.withColumnRenamed("ean", "categoria")
    found = {r.crop_id: (r.categoria, r.similitud, r.detectada) for r in knn.classify_packaging(queries.filter("crop_id <> 2"), prompts).collect()}
    assert found[1] == ("A", 0.0, "otro") and found[3][2] == "A"


def test_missing_category_searches_everything(spark):
    rows = [("A", "Lata", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), ("B", "bolsa", [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    refs = frame(spark, ["ean", "categoria", "embedding"], rows, ["string", "string", "array<float>"])
    crops = [(1, "LATA", [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (2, "frasco", [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (3, None, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    q = frame(spark, ["crop_id", "categoria", "embedding"], crops, ["long", "string", "array<float>"])
    got = {r.crop_id: r.ean for r in knn.search_in_category(q, refs, k=1).collect()}
    assert got == {1: "A", 2: "B", 3: "B"}


def sequential(vecs, order, close):
    kept = []
    for i in order:
        if not any(close(vecs[i], vecs[j]) for j in kept):
            kept.append(i)
    return set(kept)


@pytest.mark.parametrize("prefix", [512, 6])
def test_greedy_equals_sequential(spark, prefix):
    rng = np.random.default_rng(3)
    # Few directions with small noise: dense groups of near copies, plus exact copies and zero vectors.
    base = rng.normal(size=(12, D))
    vecs = (base[rng.integers(0, 12, 150)] + 0.25 * rng.normal(size=(150, D))).astype("float32")
    vecs[20:60] = vecs[3]
    vecs[70] = vecs[71] = 0
    scope = ["hot" if i % 3 else "cold" for i in range(150)]
    rows = [(scope[i], i, float(i // 50), i, vecs[i].tolist()) for i in range(150)]
    types = ["string", "long", "double", "long", "array<float>"]
    items = frame(spark, ["scope", "key", "o1", "o2", "vec"], rows, types).repartition(4)
    solid = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x)) > 0
    kept = greedy.greedy_keep(items, 0.95, comparable=solid, prefix=prefix)
    u = unit(vecs.astype("float64"))
    want = set()
    for s in ("hot", "cold"):
        want |= sequential(u, [i for i in range(150) if scope[i] == s], lambda a, b: a @ b >= 0.95)
    assert {r.key for r in kept.collect()} == want


@pytest.mark.parametrize("prefix", [512, 5])
def test_suppression_equals_sequential(spark, monkeypatch, prefix):
    monkeypatch.setattr(greedy.greedy_keep, "__defaults__", (*greedy.greedy_keep.__defaults__[:-1], prefix))
    rng = np.random.default_rng(8)
    rows = []
    for i in range(200):
        x, y = int(rng.integers(0, 120)), int(rng.integers(0, 80))
        rows.append((i, 0, i % 2, x, y, x + 40, y + 30, round(float(rng.random()), 1)))
    rows.append((200, 0, 0, 5, 5, 5, 40, 0.99))
    names = ["box_id", "video_id", "frame_idx", "x1", "y1", "x2", "y2", "conf"]
    df = frame(spark, names, rows, ["long"] * 7 + ["double"])
    kept = {r.box_id for r in detections.suppress_overlaps(df, "box_id", 0.5).collect()}
    from tests.test_tracking import iou

    want = set()
    for f in (0, 1):
        mine = [r for r in rows if r[2] == f]
        order = [r[0] for r in sorted(mine, key=lambda r: (-r[7], r[0]))]
        want |= sequential({r[0]: r[3:7] for r in mine}, order, lambda a, b: iou(a, b) > 0.5)
    assert kept == want


def test_absorb_outcomes(spark):
    a, b = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    near_a = [1.0, 0.05, 0.0, 0.0, 0.0, 0.0]
    rows = [
        (1, "X", 1, True, near_a),  # close to the stored reference
        (2, "X", 2, True, b),  # new
        (3, "X", 3, True, b),  # copy of the previous one
        (4, "X", 4, False, b),  # file missing
        (5, "BAD", 5, True, a),  # unknown code
        (6, "Y", 6, True, a),  # product without references
        (7, "X", 7, True, None),  # embedding failed
    ]
    crops = frame(spark, ["crop_id", "ean", "seq", "existe", "embedding"], rows, ["long", "string", "long", "boolean", "array<float>"])
    refs = frame(spark, ["ref_id", "ean", "embedding", "categoria"], [("r1", "X", a, None)], ["string", "string", "array<float>", "string"])
    valid = spark.createDataFrame([("X",), ("Y",)], "ean string")
    result = absorb.outcomes(crops, refs, valid)
    got = {r.crop_id: r.resultado for r in result.collect()}
    assert got == {
        1: "duplicado", 2: "copiado", 3: "duplicado", 4: "crop_faltante", 5: "ean_invalido", 6: "copiado", 7: "copiado"
    }
    s = absorb.summary(result).first()
    assert (s.copiados, s.errores, s.dedup_skipped, s.invalid_ean) == (3, 2, 2, 1)
    dry = {r.crop_id: r.resultado for r in absorb.outcomes(crops, refs, valid, dry_run=True).collect()}
    assert dry[5] == dry[1] == dry[3] == "copiado" and dry[4] == "crop_faltante"
    products = frame(spark, ["ean", "categoria", "descripcion"], [("X", "lata", "Equis"), ("Y", "bolsa", "Ye")], ["string"] * 3)
    renewed, _ = absorb.apply(crops, refs, products, valid)
    assert {(r.ean, r.ref_id, r.categoria, r.descripcion) for r in renewed.collect()} == {
        ("X", "r1", "lata", "Equis"), ("X", "crop-2", "lata", "Equis"), ("Y", "crop-6", "bolsa", "Ye")
    }


def test_identify_keeps_crops_that_find_nothing(spark):
    a, b = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    rows = [(1, a, None), (2, [0.0] * D, None), (3, None, None), (4, b, "LATA"), (5, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0], "")]
    crops = frame(spark, ["crop_id", "embedding", "forzada"], rows, ["long", "array<float>", "string"])
    refs = frame(spark, ["ean", "categoria", "embedding"], [("A", "Lata", a), ("B", "bolsa", b)], ["string", "string", "array<float>"])
    prompts = frame(spark, ["categoria", "embedding"], [("lata", a), ("bolsa", b)], ["string", "array<float>"])
    products = spark.createDataFrame([("A", "Uno")], "ean string, descripcion string")
    got = {r.crop_id: (r.status, r.ean, r.detectada, r.n_candidatos, r.descripcion) for r in identify.identify(crops, refs, prompts, products).collect()}
    assert got == {
        1: ("matched", "A", "lata", 1, "Uno"),
        2: ("unknown", "UNKNOWN", "otro", 0, ""),
        3: ("unknown", "UNKNOWN", "", 0, ""),
        4: ("unknown", "UNKNOWN", "LATA", 1, ""),
        5: ("unknown", "UNKNOWN", "otro", 2, ""),
    }
    empty = identify.identify(crops.drop("forzada"), refs.limit(0)).collect()
    assert {(r.status, r.n_candidatos) for r in empty} == {("unknown", 0)} and len(empty) == 5


@pytest.mark.parametrize("few", [4096, 1])
def test_classification_with_few_and_many_categories(spark, monkeypatch, few):
    monkeypatch.setattr(knn, "FEW_CATEGORIES", few)
    q, p = vectors(5, 30), vectors(6, 8)
    crops = frame(spark, ["crop_id", "embedding"], [(i, v.tolist()) for i, v in enumerate(q)], ["long", "array<float>"])
    prompts = frame(spark, ["categoria", "embedding"], [(f"c{i % 4}", v.tolist()) for i, v in enumerate(p)], ["string", "array<float>"])
    got = {r.crop_id: r.detectada for r in knn.tag_packaging(crops, prompts).collect()}
    u = unit(p.astype("float64"))
    centers = unit(np.stack([u[i::4].mean(axis=0) for i in range(4)]))
    sims = unit(q.astype("float64")) @ centers.T
    assert got == {i: (f"c{s.argmax()}" if s.max() >= 0.15 else "otro") for i, s in enumerate(sims)}


def test_a_crowded_frame_is_settled_in_one_pass_whatever_its_keys(spark, monkeypatch):
    def rounds(*args, **kw):
        raise AssertionError("no rounds for a frame of this size")

    monkeypatch.setattr(greedy, "with_earlier_partner", rounds)
    from tests.test_tracking import iou

    rng = np.random.default_rng(4)
    low, extent = rng.integers(0, 200, (1400, 2)), rng.integers(2, 90, (1400, 2))
    # Both frames use the same keys.
    rows = [(i % 700, 0, i // 700, *map(int, low[i]), *map(int, low[i] + extent[i]), i % 97 / 100) for i in range(1400)]
    df = frame(spark, ["box_id", "video_id", "frame_idx", "x1", "y1", "x2", "y2", "conf"], rows, ["long"] * 7 + ["double"])
    got = {r.box_id for r in detections.suppress_overlaps(df, "box_id", 0.5).collect()}
    want = set()
    for f in (0, 1):
        mine = {r[0]: r[3:7] for r in rows if r[2] == f}
        order = [r[0] for r in sorted((r for r in rows if r[2] == f), key=lambda r: (-r[7], r[0]))]
        want |= sequential(mine, order, lambda a, b: iou(a, b) > 0.5)
    assert got == want


@pytest.mark.parametrize("tagged", [False, True])
def test_a_query_leaves_a_task_with_k_rows_however_many_blocks_it_meets(spark, monkeypatch, tagged):
    monkeypatch.setattr(blockmatch, "REF_ROWS", 5)
    q, r = vectors(3, 12), vectors(4, 90)
    queries = frame(spark, ["scope", "key", "vec"], [("*", i, v.tolist()) for i, v in enumerate(q)], ["string", "long", "array<float>"])
    queries = queries.withColumn("tag", F.lit("t")) if tagged else queries
    named = [("*", None if i % 23 == 0 else f"L{i % 23:02d}", v.tolist()) for i, v in enumerate(r)]
    refs = frame(spark, ["scope", "label", "vec"], named, ["string", "string", "array<float>"]).coalesce(1)
    hits = blockmatch.block_hits(queries, refs, 4).collect()
    sims = unit(q.astype("float64")) @ unit(r.astype("float64")).T
    for i in range(12):
        best = {}
        for (_, lab, _), s in zip(named, sims[i]):
            best[lab] = max(best.get(lab, -9), s)
        want = sorted(best.items(), key=lambda kv: -kv[1])[:4]
        have = sorted(((h.label, h.sim) for h in hits if h.key == i), key=lambda kv: -kv[1])
        assert [h[0] for h in have] == [w[0] for w in want]
        assert [h[1] for h in have] == pytest.approx([w[1] for w in want])
    # Eighteen blocks; four rows of each before.
    assert len(hits) == 12 * 4


def test_floats_travel_as_floats(spark):
    rows = [("*", i, v.tolist()) for i, v in enumerate(vectors(5, 50))]
    single, double = (frame(spark, ["scope", "key", "vec"], rows, ["string", "long", f"array<{t}>"]) for t in ("float", "double"))
    assert blockmatch.packed_bytes(single) == 50 * D * 4 and blockmatch.packed_bytes(double) == 50 * D * 8
    assert {len(r.mat) for r in blockmatch._pack(single.coalesce(1), 100, True, True).collect()} == {50 * D * 4}


def test_references_are_copied_to_few_lanes_but_for_many_queries(spark, monkeypatch):
    monkeypatch.setattr(blockmatch, "LANE_QUERIES", 4)
    monkeypatch.setattr(blockmatch, "QUERY_ROWS", 5)
    monkeypatch.setattr(blockmatch, "REF_ROWS", 7)
    few = max(blockmatch.FEW_LANES, 2 * spark.sparkContext.defaultParallelism)
    # Scope a has many queries and references, b many queries for two references, c few queries, d none, e no references.
    q = [("a" if i < 400 else "b" if i < 800 else "c" if i < 806 else "e", i, v.tolist()) for i, v in enumerate(vectors(6, 810))]
    r = [("a" if i < 200 else "b" if i < 202 else "c" if i < 210 else "d", f"L{i % 30:02d}", v.tolist()) for i, v in enumerate(vectors(7, 215))]
    queries = frame(spark, ["scope", "key", "vec"], q, ["string", "long", "array<float>"])
    refs = frame(spark, ["scope", "label", "vec"], r, ["string", "string", "array<float>"])
    # 100 copies of the references of a before.
    assert dict(map(tuple, blockmatch._lanes(queries, refs).collect())) == {"a": few, "b": max(few, 50), "c": 2}
    spread, sent = (
        {(h.key, h.label, round(h.sim, 9), h["rank"]) for h in blockmatch.best_labels(queries, refs, 3, broadcast_bytes=b).collect()} for b in (0, 10**8)
    )
    assert spread == sent and len({key for key, *_ in spread}) == 806


def test_rows_of_other_keys_are_left_out_before_wide_rows_are_moved(spark):
    keys = spark.range(3000).selectExpr("concat_ws('/', id % 7, id) as crop_id")
    rows = spark.range(40_000).selectExpr("if(id = 5, null, concat_ws('/', id % 7, id)) as crop_id", "id", "array(id, null) as v")
    kept = scale.among(rows, keys, "crop_id", max_rows=100)
    assert kept.columns == rows.columns
    assert {r.id for r in kept.collect()} >= set(range(3000)) - {5} and kept.count() < 4000
    assert scale.among(rows, keys, "crop_id").count() == 40_000
    assert scale.among(rows, keys.limit(0), "crop_id", max_rows=-1).count() == 0


def test_long_tables_are_kept_in_columns(spark):
    rows = spark.range(20_000).selectExpr("concat('crop/', id) as crop_id", "array(struct(1 as rank, 'EAN' as ean, 0.5D as s), null) as top", "id % 2 = 0 as yes")
    kept = scale.stored(rows.unionByName(rows.limit(1).selectExpr("null as crop_id", "null as top", "null as yes")))
    assert kept.dtypes == rows.dtypes
    assert kept.exceptAll(rows).count() == 1 and rows.exceptAll(kept).count() == 0
    # A checkpoint keeps whole rows; columns are read one by one.
    assert len(kept.inputFiles()) > 0


def test_identified_boxes_are_kept_in_columns_and_halves_follow_the_doubtful(spark, monkeypatch):
    boxes = spark.createDataFrame(
        [(f"{i}/x", *(v.tolist() for v in vectors(30 + i, 3)), 0, 0, 300, 100, 400, 400, 0.1) for i in range(60)],
        "crop_id string, full_vec array<float>, left_vec array<float>, right_vec array<float>, x1 int, y1 int, x2 int, y2 int, frame_w int, frame_h int, conf double",
    )
    refs = spark.createDataFrame([(f"L{i}", "lata", v.tolist()) for i, v in enumerate(vectors(9, 4))], "ean string, categoria string, embedding array<float>")
    moved, among = [], scale.among

    def few(df, keys, key):
        moved.append(among(df, keys, key, max_rows=-1))
        return moved[-1]

    want = {r.crop_id: r for r in identify.identify_boxes(boxes, refs, None).collect()}
    monkeypatch.setattr(identify, "among", few)
    have = {r.crop_id: r for r in identify.identify_boxes(boxes, refs, None).collect()}
    assert have == want and len(want) == 60
    # Whole boxes are moved for the doubtful ones alone.
    assert 0 < moved[0].count() < 60
