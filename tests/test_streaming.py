"""Live tracker: late boxes, ends, and equality with the batch tracker on crossing boxes."""

from stockcount.operators import tracking as T
from stockcount.streaming import live
from tests.test_tracking import SCHEMA, crowd


def feed(spark, tmp_path, slices):
    replay = live.Replay(spark, str(tmp_path), SCHEMA)
    for i, rows in enumerate(slices):
        replay.feed(spark.createDataFrame(rows, SCHEMA), i)
        replay.run_to_table(live.track_stream(replay.stream()), idle_batches=False)
    return replay.result()


def test_stream_equals_batch(spark, tmp_path):
    rows = crowd(7, videos=2, frames=120, objects=6)
    cuts = [0, 37, 80, 120]
    slices = [[r for r in rows if a <= r[1] < b] for a, b in zip(cuts, cuts[1:])]
    out = feed(spark, tmp_path, slices)
    links = {(r.video_id, r.frame_idx, r.det_idx, r.track_id, r.hits, r.age) for r in out.filter("kind = 'link'").collect()}
    batch = T.track_assign(spark.createDataFrame(rows, SCHEMA)).collect()
    assert links == {(r.video_id, r.frame_idx, r.det_idx, r.track_id, r.hits, r.age) for r in batch}


def test_late_boxes_and_ends(spark, tmp_path):
    box = (0, 0, 60, 60, 0.9)
    slices = [[(0, 0, 0, *box), (0, 5, 0, *box)], [(0, 3, 0, *box), (0, 22, 0, *box)]]
    # A passed frame reaches the tracker, which sets it aside.
    out = feed(spark, tmp_path, slices).collect()
    assert [(r.frame_idx, r.track_id) for r in out if r.kind == "late"] == [(3, -1)]
    assert [(r.frame_idx, r.track_id, r.hits) for r in out if r.kind == "end"] == [(21, 1, 2)]
    assert sorted((r.frame_idx, r.track_id) for r in out if r.kind == "link") == [(0, 1), (5, 1), (22, 2)]


def test_a_lagging_video_loses_nothing(spark, tmp_path):
    rows = crowd(3, videos=2, frames=60, objects=4)
    first, second = ([r for r in rows if r[0] == v] for v in (0, 1))
    half = [r for r in second if r[1] < 30]
    late = [r for r in second if r[1] == 10]
    out = feed(spark, tmp_path, [first, half, [r for r in second if r[1] >= 30] + late]).collect()
    links = {(r.video_id, r.frame_idx, r.det_idx, r.track_id) for r in out if r.kind == "link"}
    batch = T.track_assign(spark.createDataFrame(rows, SCHEMA)).collect()
    assert links == {(r.video_id, r.frame_idx, r.det_idx, r.track_id) for r in batch}
    # Every box offered is linked, set aside as late, or was left unlinked by the batch tracker as well.
    assert sum(r.kind == "late" for r in out) == len(late)
    assert len(links) + (len(rows) - len(batch)) == len(rows)
