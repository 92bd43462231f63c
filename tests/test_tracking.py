"""The split tracker against a plain frame-by-frame model."""

import random

import pytest
from pyspark.sql import functions as F

from stockcount.operators import tracking as T

SCHEMA = "video_id long, frame_idx long, det_idx long, x1 long, y1 long, x2 long, y2 long, conf double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def model(rows, last_frame, thr=0.4, max_age=15, gate=0.55):
    """Visits every frame, also the empty ones, and ages tracks by one each time."""
    by_frame = {}
    for v, f, d, *box, conf in rows:
        by_frame.setdefault((v, f), []).append((d, tuple(box), conf))
    out, ended = set(), {}
    for v in {r[0] for r in rows}:
        tracks, next_id = {}, 1
        for f in range(last_frame + 1):
            dets = sorted(by_frame.get((v, f), []))
            for t in tracks.values():
                t["miss"] += 1
                t["age"] += 1
            pairs = [(iou(b, t["box"]), i, tid) for i, (_, b, _) in enumerate(dets) for tid, t in tracks.items()]
            pairs.sort(key=lambda p: p[0], reverse=True)
            used_d, used_t = {}, set()
            for s, i, tid in pairs:
                if s < thr:
                    break
                if i in used_d or tid in used_t:
                    continue
                used_d[i] = tid
                used_t.add(tid)
                tracks[tid].update(box=dets[i][1], miss=0)
                tracks[tid]["hits"] += 1
            for i, (_, b, conf) in enumerate(dets):
                if i not in used_d and conf >= gate:
                    tracks[next_id] = {"box": b, "miss": 0, "hits": 1, "age": 1}
                    used_d[i] = next_id
                    next_id += 1
            for i, tid in used_d.items():
                out.add((v, f, dets[i][0], tid, tracks[tid]["hits"], tracks[tid]["age"]))
            for tid in [t for t, s in tracks.items() if s["miss"] > max_age]:
                ended[(v, tid)] = ("ended_in_update", f)
                del tracks[tid]
        for tid in tracks:
            ended[(v, tid)] = ("video_end", None)
    return out, ended


def crowd(seed, videos=3, frames=260, objects=9):
    """Moving boxes that cross and overlap, with pauses and spurious boxes."""
    rnd = random.Random(seed)
    rows = []
    for v in range(videos):
        pos = [(rnd.randrange(0, 600), rnd.randrange(0, 200)) for _ in range(objects)]
        on = [True] * objects
        for f in range(frames):
            if 90 <= f < 108 + v or 170 <= f < 186:
                continue
            d = 0
            for o in range(objects):
                if rnd.random() < 0.06:
                    on[o] = not on[o]
                x, y = pos[o]
                pos[o] = (max(0, x + rnd.randrange(-9, 10)), max(0, y + rnd.randrange(-5, 6)))
                if on[o] and rnd.random() < 0.8:
                    x, y = pos[o]
                    rows.append((v, f, d, x, y, x + 60, y + 50, round(rnd.random(), 2)))
                    d += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("lane_boxes", [20_000, 40])
def test_equals_model(spark, seed, lane_boxes):
    rows = crowd(seed)
    expected, ended = model(rows, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = T.track_assign(df, lane_boxes=lane_boxes)
    found = {
        (r.video_id, r.frame_idx, r.det_idx, r.track_id, r.hits, r.age)
        for r in got.collect()
    }
    assert found == expected
    frames = spark.range(3).select(
        F.col("id").alias("video_id"), F.expr("explode(sequence(0L, 300L))").alias("frame_idx")
    )
    life = {(r.video_id, r.track_id): (r.ended_reason, r.end_frame) for r in T.track_lifecycle(got, frames).collect()}
    assert life == ended


def dense(seed, frames=240, objects=14, size=60, low=False, still=False):
    """One video whose boxes overlap in every frame, without a pause."""
    rnd = random.Random(seed)
    pos, rows = [(rnd.randrange(0, 120), rnd.randrange(0, 60)) for _ in range(objects)], []
    for f in range(frames):
        d = 0
        for o in range(objects):
            if not still:
                x, y = pos[o]
                pos[o] = (min(150, max(0, x + rnd.randrange(-14, 15))), min(80, max(0, y + rnd.randrange(-8, 9))))
            if rnd.random() < 0.8:
                x, y = pos[o]
                # Objects that are never sure extend tracks only, so a guess may lack them.
                conf = 0.6 if low and f < 20 else 0.3 if low else round(rnd.random(), 2)
                rows.append((0, f, d, x, y, x + size, y + size - 10, conf))
                d += 1
    return rows


@pytest.mark.parametrize("kind", [{}, {"low": True}, {"still": True}, {"size": 120}])
def test_chunks_of_a_crowd_equal_the_model(spark, kind):
    rows = dense(5, **kind)
    expected, _ = model(rows, 240)
    got = T.track_assign(spark.createDataFrame(rows, SCHEMA).repartition(4), chunk_boxes=600)
    assert {(r.video_id, r.frame_idx, r.det_idx, r.track_id, r.hits, r.age) for r in got.collect()} == expected


def test_chunks_are_bounded(spark):
    df = spark.createDataFrame(dense(6), SCHEMA)
    corners = T.corner_parts(df, 16)
    chunks = T.time_chunks(corners, 200)
    per_cell = corners.groupBy("video_id", "segment", "lane", "cell").agg(F.sum("boxes").alias("n"))
    most = per_cell.agg(F.max("n")).first()[0]
    sizes = chunks.join(per_cell, ["video_id", "segment", "lane", "cell"]).groupBy("chunk").agg(F.sum("n").alias("n"), F.count_if(~F.col("warm")).alias("own")).collect()
    assert len(sizes) > 8 and all(r.own > 0 and r.n <= 200 + 8 * most for r in sizes)
    assert T.time_chunks(corners, 10_000).isEmpty()


def test_gap_of_sixteen_continues_and_seventeen_does_not(spark):
    rows = [(0, f, 0, 10, 10, 70, 60, 0.9) for f in (0, 16, 33)] + [(0, 40, 0, 400, 10, 470, 60, 0.54)]
    got = {(r.frame_idx, r.track_id) for r in T.track_assign(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(0, 1), (16, 1), (33, 2)}


def test_low_confidence_extends_but_never_creates(spark):
    rows = [(0, 0, 0, 0, 0, 60, 60, 0.54), (0, 1, 0, 0, 0, 60, 60, 0.55), (0, 2, 0, 0, 0, 60, 60, 0.1)]
    got = {(r.frame_idx, r.track_id, r.hits, r.track_valid) for r in T.track_assign(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1, 1, False), (2, 1, 2, False)}


def test_touching_boxes_are_separate_islands(spark):
    rows = [(0, 0, 0, 0, 0, 50, 50, 0.9), (0, 0, 1, 50, 0, 100, 50, 0.9), (0, 1, 0, 49, 0, 99, 50, 0.9)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = T.independent_parts(df, 16, lane_boxes=1)
    assert parts.count() == 3
    ids = {(r.frame_idx, r.det_idx): r.track_id for r in T.track_assign(df, lane_boxes=1).collect()}
    assert ids == {(0, 0): 1, (0, 1): 2, (1, 0): 2}


def test_debug_marks_untracked_boxes_and_empty_frames(spark):
    rows = [(0, 0, 0, 0, 0, 60, 60, 0.9), (0, 0, 1, 200, 0, 260, 60, 0.2)]
    df = spark.createDataFrame(rows, SCHEMA)
    frames = spark.createDataFrame([(0, 0), (0, 1)], "video_id long, frame_idx long")
    out = {(r.frame_idx, r.det_idx): (r.track_id, r.track_state, r.track_valid) for r in T.track_debug(df, T.track_assign(df), frames).collect()}
    assert out == {(0, 0): (1, "ACTIVE", "NO"), (0, 1): (-1, "NO_TRACK", "NO"), (1, -1): (-1, "NO_DETECTIONS", "N/A")}
    assert T.track_debug(df, T.track_assign(df)).count() == 2


def test_sessions_of_known_objects(spark):
    rows = [(0, f, 0, 0, 0, 60, 60, 0.9) for f in (0, 16, 40)]
    got = {(r.first_frame, r.last_frame, r.hits) for r in T.gap_sessions(spark.createDataFrame(rows, SCHEMA), F.lit(1)).collect()}
    assert got == {(0, 16, 2), (40, 40, 1)}


def test_iou_is_symmetric_and_bounded(spark):
    rnd = random.Random(5)
    box = lambda: [a := rnd.randrange(50), b := rnd.randrange(50), a + rnd.randrange(40), b + rnd.randrange(40)]
    rows = [tuple(box() + box()) for _ in range(300)]
    names = [f"{p}{c}" for p in ("a_", "b_") for c in ("x1", "y1", "x2", "y2")]
    from stockcount.functions import geometry as geo

    df = spark.createDataFrame(rows, names).select("*", geo.iou("a_", "b_").alias("p"), geo.iou("b_", "a_").alias("q"))
    for r in df.collect():
        assert r.p == r.q and 0.0 <= r.p <= 1.0
        assert r.p == pytest.approx(iou(r[0:4], r[4:8]))


def test_a_frame_step_looks_at_neighbours_only_and_finds_every_pair(monkeypatch):
    import numpy as np

    rng = random.Random(5)
    far = [(x, y, x + rng.choice([3, 40, 60]), y + rng.choice([5, 90])) for x, y in ((rng.randrange(3000), rng.randrange(30_000)) for _ in range(3000))]
    a, b = np.array([*far, (1, 1, 1, 5)], dtype="float64"), np.array([*[(x + 7, y - 5, u + 9, v) for x, y, u, v in far], (np.nan, 0, 5, 5)])
    monkeypatch.setattr(T, "PAIRS_AT_ONCE", 500)
    looked = [p for di, ti in T._neighbours(a, b) for p in zip(di.tolist(), ti.tolist())]
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    assert {tuple(p) for p in np.argwhere((w > 0) & (h > 0) & (a[:, 2] > a[:, 0])[:, None]).tolist()} <= set(looked)
    assert len(set(looked)) == len(looked) < len(a) * len(b) / 100


def test_short_chunks_share_a_warm_up(spark):
    """Chunks of one cell are linked in runs, so that boxes are read about twice and not once for each chunk they warm."""
    from stockcount.operators import crowd

    rows = dense(7, frames=17 * 40, objects=4)
    df = spark.createDataFrame(rows, SCHEMA)
    chunks = T.time_chunks(T.corner_parts(df, 16), 20).collect()
    assert len({r.chunk for r in chunks}) == 40 and len(chunks) <= 2 * 40
    runs = sorted({(r.run, r.chunk) for r in chunks if not r.warm})
    assert sorted({r for r, _ in runs}) == list(range(7)) and [r for r, _ in runs] == sorted(c // crowd.WARM_CELLS for _, c in runs)
    long = T.time_chunks(T.corner_parts(df, 16), 600).collect()
    assert all(r.run == r.chunk for r in long)
    expected, _ = model(rows, 17 * 40)
    got = T.track_assign(df.repartition(4), chunk_boxes=20)
    assert {(r.video_id, r.frame_idx, r.det_idx, r.track_id, r.hits, r.age) for r in got.collect()} == expected


@pytest.mark.parametrize("gap", [0, 100])
def test_a_frame_step_finds_the_same_pairs_without_arrays(monkeypatch, gap):
    """Near pairs by cells in Python and by arrays: same links and ties, also where boxes are crowded, empty or not a number."""
    rnd = random.Random(8)
    frames = []
    for f in range(60):
        at = [(rnd.randrange(20) * gap + rnd.randrange(30), rnd.randrange(9) * gap + rnd.randrange(30)) for _ in range(40)]
        boxes = [(x, y, x + rnd.choice([0, 40, 60]), y + rnd.choice([30, 50])) for x, y in at] + [(5.0, float("nan"), 45.0, 50.0)] * (f % 3 == 0)
        frames.append((f, list(range(len(boxes))), boxes, [rnd.random() for _ in boxes]))

    def linked(limit):
        monkeypatch.setattr(T, "NEAR_TRACKS", limit)
        ties, tracks, out = [], [], []
        step = T.frame_step(T.DEFAULTS, ties)
        for frame in frames:
            tracks, dead, links = step(tracks, *frame)
            out += [(f, d, *t[4:7]) for f, d, t in links] + [(-1, *t[4:]) for t in dead]
        return out, [(x[4:6], y[4:6]) for x, y in ties]

    assert linked(1000) == linked(0)
