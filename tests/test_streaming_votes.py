"""Live votes: tracks out of step, pauses, and votes for what was closed before."""

import datetime as dt

from pyspark.sql import functions as F

from stockcount.operators import votes as V
from stockcount.streaming import live

SCHEMA = "track_id long, sku string, sim double, ts timestamp, event_id long"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HOUR = 3_600_000


def vote(track, minute, event, sku="A", sim=0.9):
    return (track, sku, sim, START + dt.timedelta(minutes=minute), event)


def feed(spark, tmp_path, slices):
    """An empty slice comes last: a track silent for a slice is closed."""
    replay = live.Replay(spark, str(tmp_path), SCHEMA)
    for i, rows in enumerate([*slices, []]):
        replay.feed(spark.createDataFrame(rows, SCHEMA), i)
        replay.run_to_table(live.vote_decisions(replay.stream(), HOUR, idle_ms=1), idle_batches=False)
    return replay.result().collect()


def test_lagging_tracks_lose_no_votes(spark, tmp_path):
    # Odd tracks arrive whole, hours ahead, before the even ones begin.
    rows = [vote(t, 10 * k + 300 * (t % 2), 100 * t + k, "AB"[k % 3 == 0], 0.5 + 0.01 * k) for t in range(8) for k in range(20)]
    odd, even = ([r for r in rows if r[0] % 2 == x] for x in (1, 0))
    early = START + dt.timedelta(minutes=95)
    out = feed(spark, tmp_path, [odd, [r for r in even if r[3] < early], [r for r in even if r[3] >= early]])
    table = spark.createDataFrame(rows, SCHEMA).withColumn("frame_idx", F.col("event_id"))
    expected = {tuple(r) for r in V.track_decisions(table).collect()}
    assert {tuple(r)[: len(next(iter(expected)))] for r in out if r.kind == "decision"} == expected
    assert len(out) == len(expected) == 8 and sum(r.frames_validos for r in out) == len(rows)


def test_late_votes_are_rows_and_a_pause_closes(spark, tmp_path):
    first = [vote(1, 0, 0), vote(1, 5, 1), vote(1, 200, 2, "B")]  # the pause closes what came before it
    late = [vote(1, 3, 3), vote(1, 210, 4, "B"), (1, "A", 0.9, None, 5)]
    out = feed(spark, tmp_path, [first, late])
    assert [(r.kind, r.frames_validos) for r in out if r.kind == "decision"] == [("decision", 2)] * 2
    assert sorted((r.event_id, r.ts is None) for r in out if r.kind == "late") == [(3, False), (5, True)]
    assert sum(r.frames_validos for r in out) + sum(r.kind == "late" for r in out) == len(first + late)


SESSION_SCHEMA = "entity long, sku string, sim double, ts timestamp, event_id long"


def sessions(spark, tmp_path, slices, **kw):
    replay = live.Replay(spark, str(tmp_path), SESSION_SCHEMA)
    for i, rows in enumerate([*slices, []]):
        replay.feed(spark.createDataFrame(rows, SESSION_SCHEMA), i)
        replay.run_to_table(live.session_stream(replay.stream(), HOUR, idle_ms=1, **kw), idle_batches=False)
    return replay


def test_sessions_of_lagging_entities_equal_those_of_the_table(spark, tmp_path):
    rows = [vote(e, 25 * k * (1 + k % 3) + 3000 * (e % 2), 100 * e + k, ["A", "UNKNOWN"][k % 4 == 0], 0.2 + 0.01 * k) for e in range(8) for k in range(30)]
    odd, even = ([r for r in rows if r[0] % 2 == x] for x in (1, 0))
    out = sessions(spark, tmp_path, [odd, even]).result()
    columns = ["entity", "desde", "hasta", "frames_seen", "frames_scored", "sim_sum"]
    batch = live.vote_sessions(spark.createDataFrame(rows, SESSION_SCHEMA), "60 minutes")
    got = sorted(tuple(r) for r in out.filter("kind = 'session'").select(columns).collect())
    assert got == sorted(tuple(r) for r in batch.select(columns).collect())
    assert out.filter("kind = 'late'").count() == 0 and sum(r[3] for r in got) == len(rows)


def test_late_votes_of_sessions_are_rows(spark, tmp_path):
    first = [vote(1, 0, 0), vote(1, 5, 1), vote(1, 200, 2)]
    late = [vote(1, 3, 3), vote(1, 100, 4), vote(1, 210, 5), (1, "A", 0.9, None, 6)]
    out = sessions(spark, tmp_path, [first, late]).result().collect()
    # The second slice finds the session of minute 200 open or, if its timer came first, closed.
    assert {r.event_id for r in out if r.kind == "late"} >= {3, 4, 6}
    assert sum(r.frames_seen for r in out) + sum(r.kind == "late" for r in out) == len(first + late)


def test_closed_entities_leave_the_state(spark, tmp_path):
    import time

    rows = [vote(e, 0, e) for e in range(300)]
    replay = sessions(spark, tmp_path, [rows], remember_ms=1)
    time.sleep(0.1)
    for i in (5, 6):
        replay.feed(spark.createDataFrame([vote(1000 + i, 0, i)], SESSION_SCHEMA), i)
        replay.run_to_table(live.session_stream(replay.stream(), HOUR, idle_ms=1, remember_ms=1), idle_batches=False)
    assert replay.result().filter("kind = 'session'").count() >= 300
    assert replay.progress[-1]["stateOperators"][0]["numRowsTotal"] < 30


def test_review_records_of_lagging_runs_come_out_once(spark, tmp_path):
    schema = "crop_id string, decision string, run_id long, ts timestamp"
    rows = [(f"c{r}_{k}", "unknown", r, START + dt.timedelta(hours=24 * (r % 2), minutes=k)) for r in range(4) for k in range(20)]
    replay = live.Replay(spark, str(tmp_path), schema)
    for i, part in enumerate([[r for r in rows if r[2] % 2] * 2, [r for r in rows if r[2] % 2 == 0], rows]):
        replay.feed(spark.createDataFrame(part, schema), i)
        replay.run_to_table(live.review_stream(replay.stream()), idle_batches=False)
    assert sorted(r.crop_id for r in replay.result().collect()) == sorted(r[0] for r in rows)


def test_a_batch_takes_many_keys_in_one_call(spark, tmp_path):
    # 300 entities, tracks or crops in 8 groups; there was a state row and a call for each before.
    rows = [vote(e, 10 * k, 10 * e + k) for e in range(300) for k in range(2)]
    crops = [(f"c{e}", "unknown", e, START) for e in range(300)]
    review = "crop_id string, decision string, run_id long, ts timestamp"
    streams = {
        "sessions": (SESSION_SCHEMA, rows, lambda s: live.session_stream(s, HOUR, groups=8)),
        "votes": (SCHEMA, rows, lambda s: live.vote_decisions(s, HOUR, groups=8)),
        "review": (review, crops, lambda s: live.review_stream(s, groups=8)),
    }
    for name, (schema, data, stream) in streams.items():
        replay = live.Replay(spark, str(tmp_path / name), schema)
        replay.feed(spark.createDataFrame(data, schema), 0)
        replay.run_to_table(stream(replay.stream()), idle_batches=False)
        assert sum(p["stateOperators"][0]["numRowsTotal"] for p in replay.progress[-1:]) <= 4 * 8


def test_keys_of_a_group_are_closed_one_by_one(spark, tmp_path):
    # All in one group: only what is silent for a slice is closed by time, and null keys are a key of their own.
    first, second = [vote(1, 0, 0), vote(2, 0, 1), vote(None, 0, 2)], [vote(2, 5, 3), vote(None, 90, 4)]
    replay = live.Replay(spark, str(tmp_path), SESSION_SCHEMA)
    seen = []
    for i, rows in enumerate([first, second, []]):
        replay.feed(spark.createDataFrame(rows, SESSION_SCHEMA), i)
        replay.run_to_table(live.session_stream(replay.stream(), HOUR, idle_ms=1, groups=1), idle_batches=False)
        seen.append(sorted((r.entity or 0, r.frames_seen) for r in replay.result().collect() if r.kind == "session"))
    assert seen == [[], [(0, 1), (1, 1)], [(0, 1), (0, 1), (1, 1), (2, 2)]]
