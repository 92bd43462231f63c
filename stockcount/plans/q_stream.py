"""Streaming replays of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockcount.plans.q_runs import METRICS_SQL
from stockcount.plans.q_track import _DECISION_SQL, _ISLANDS_SQL
from stockcount.plans.registry import query
from stockcount.scale import shared_dir
from stockcount.sources import views
from stockcount.sources.tables import table
from stockcount.streaming import live

_SLICES = 2
_FRAMES = 720
_PAUSE = 24 * 3_600_000


def _replay(spark, name, schema):
    return live.Replay(spark, f"{shared_dir(spark)}/replay-{name}-{uuid.uuid4().hex}", schema)


def _ts(spark_sql: str) -> str:
    return f"timestamp_seconds({spark_sql})"


def _slices(df, order: str, span: int):
    """Equal ranges of ``order``; together they cover every row."""
    step = -(-span // _SLICES)
    for i in range(_SLICES):
        low = F.lit(True) if i == 0 else F.col(order) >= i * step
        high = F.lit(True) if i == _SLICES - 1 else F.col(order) < (i + 1) * step
        yield i, df.filter(low & high)


_BOXES = "video_id long, frame_idx long, det_idx long, x1 long, y1 long, x2 long, y2 long, conf double"


def _boxes(spark, sf):
    return views.detections(spark, sf).select("video_id", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "conf")


@query(_ISLANDS_SQL + "SELECT video_id, frame_idx, det_idx, track_id, birth_frame, hits, age FROM assigned")
def stream_track_assign(spark, sf):
    replay = _replay(spark, "tracks", _BOXES)
    for i, part in _slices(_boxes(spark, sf), "frame_idx", _FRAMES):
        replay.feed(part, i)
        replay.run_to_table(live.track_stream(replay.stream()), idle_batches=False)
    return replay.result().filter("kind = 'link'").drop("kind")


@query(
    _ISLANDS_SQL
    + """SELECT 'link' AS kind, count(*)::BIGINT AS boxes, count(DISTINCT (video_id, track_id))::BIGINT AS tracks FROM assigned
UNION ALL SELECT 'offered', count(*)::BIGINT, NULL FROM fx_detections UNION ALL SELECT 'late', 0, 0"""
)
def stream_track_lag(spark, sf):
    """Videos out of step: odd ones arrive whole before the even ones begin. Nothing may be lost or late."""
    boxes = _boxes(spark, sf)
    replay = _replay(spark, "lag", _BOXES)
    for i, odd in enumerate((1, 0)):
        for j, part in _slices(boxes.filter(F.col("video_id") % 2 == odd), "frame_idx", _FRAMES):
            replay.feed(part, i * _SLICES + j)
            replay.run_to_table(live.track_stream(replay.stream()), idle_batches=False)
    out = replay.result()
    track = F.struct("video_id", "track_id")
    linked, late = F.col("kind") == "link", F.col("kind") == "late"
    n = out.agg(
        F.count_if(linked).alias("l"), F.count_distinct(F.when(linked, track)).alias("t"), F.count_if(late).alias("x")
    ).crossJoin(boxes.agg(F.count(F.lit(1)).alias("o")))
    return n.selectExpr("stack(3, 'link', l, t, 'offered', o, cast(null as bigint), 'late', x, 0L) as (kind, boxes, tracks)")


_SESSIONS_SQL = """WITH v AS (
  SELECT user_id AS entity, ts, event_id, CASE WHEN event_type <> 'error' AND least(value / 100.0, 1.0) >= 0.30 THEN least(value / 100.0, 1.0) END AS sim
  FROM events),
m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts, event_id) < INTERVAL 16 HOUR THEN 0 ELSE 1 END AS brk FROM v),
s AS (SELECT *, sum(brk) OVER (PARTITION BY entity ORDER BY ts, event_id) AS n FROM m),
g AS (SELECT entity, n, min(ts) AS desde, max(ts) + INTERVAL 16 HOUR AS hasta, count(*)::BIGINT AS frames_seen, count(sim)::BIGINT AS frames_scored,
             coalesce(sum(sim::DECIMAL(18, 6)), 0)::DOUBLE AS sim_sum FROM s GROUP BY 1, 2)
"""


def _session_rows(spark, sf, slices):
    replay = _replay(spark, "sessions", "entity long, sku string, sim double, ts timestamp, event_id long")
    for i, part in enumerate(slices):
        replay.feed(part.select("entity", "sku", "sim", "ts", "event_id"), i)
        replay.run_to_table(live.session_stream(replay.stream(), 16 * 3_600_000, idle_ms=1), idle_batches=False)
    return replay.result()


@query(
    _SESSIONS_SQL
    + """SELECT entity, epoch_us(desde) AS desde, epoch_us(hasta) AS hasta, frames_seen, frames_scored, round(sim_sum, 4) AS sim_sum
FROM g WHERE hasta <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def stream_vote_sessions(spark, sf):
    """Sessions closed while their votes arrive. An entity silent for a whole slice is closed by its own timer; the last slice is empty."""
    rows = views_votes_with_time(spark, sf)
    out = _session_rows(spark, sf, [*[part for _, part in _slices(rows, "hour", _FRAMES)], rows.limit(0)])
    end = rows.agg((F.unix_micros(F.max("ts")) - 3_600_000_000).alias("_end"))
    closed = out.filter("kind = 'session'").crossJoin(F.broadcast(end)).filter(F.unix_micros("hasta") <= F.col("_end"))
    return closed.select(
        "entity",
        F.unix_micros("desde").alias("desde"),
        F.unix_micros("hasta").alias("hasta"),
        "frames_seen",
        "frames_scored",
        F.round("sim_sum", 4).alias("sim_sum"),
    )


@query(
    _SESSIONS_SQL
    + """SELECT 'session' AS kind, count(*)::BIGINT AS filas, sum(frames_seen)::BIGINT AS votos, sum(frames_scored)::BIGINT AS puntuados FROM g
UNION ALL SELECT 'late', 0, 0, 0 UNION ALL SELECT 'offered', count(*)::BIGINT, count(*)::BIGINT, NULL FROM events"""
)
def stream_vote_lag(spark, sf):
    """Entities out of step: odd ones arrive whole before the even ones begin. Every vote is in a session, none is late."""
    rows = views_votes_with_time(spark, sf)
    halves = [part for odd in (1, 0) for _, part in _slices(rows.filter(F.col("entity") % 2 == odd), "hour", 4 * _FRAMES)]
    out = _session_rows(spark, sf, [*halves, rows.limit(0)])
    closed, late = F.col("kind") == "session", F.col("kind") == "late"
    n = out.agg(
        F.count_if(closed).alias("s"), F.sum("frames_seen").alias("v"), F.sum("frames_scored").alias("p"), F.count_if(late).alias("l")
    ).crossJoin(rows.agg(F.count(F.lit(1)).alias("o")))
    return n.selectExpr("stack(3, 'session', s, v, p, 'late', l, l, l, 'offered', o, o, cast(null as bigint)) as (kind, filas, votos, puntuados)")


@query(
    _DECISION_SQL
    + """SELECT * FROM decisions WHERE track_id IN (
  SELECT user_id * 100 + day(ts) FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)"""
)
def stream_track_decisions(spark, sf):
    """Tracks decided while their votes arrive; those still open at the end of the stream are not out yet.

    A track that is silent for a whole slice is closed, by its own processing-time timer. The last slice is empty.
    """
    rows = views_votes_with_time(spark, sf)
    replay = _replay(spark, "decisions", "track_id long, sku string, sim double, ts timestamp, event_id long")
    for i, part in [*_slices(rows, "hour", _FRAMES), (_SLICES, rows.limit(0))]:
        replay.feed(part.select("track_id", "sku", "sim", "ts", "event_id"), i)
        replay.run_to_table(live.vote_decisions(replay.stream(), _PAUSE, idle_ms=1), idle_batches=False)
    end = rows.agg((F.unix_millis(F.max("ts")) - 3_600_000).alias("_end"))
    out = replay.result().crossJoin(F.broadcast(end)).filter(F.col("last_ms") + _PAUSE <= F.col("_end"))
    return out.filter("kind = 'decision'").drop("kind", "last_ms", "ts", "event_id", "_end")


def views_votes_with_time(spark, sf):
    """Votes with an event time; a timestamp without zone cannot carry a watermark."""
    micros = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)"
    return table(spark, sf, "events").selectExpr(
        "user_id as entity",
        "user_id * 100 + dayofmonth(ts) as track_id",
        "event_id",
        "case when event_type = 'error' then 'UNKNOWN' else event_type end as sku",
        "least(value / 100.0D, 1.0D) as sim",
        f"timestamp_micros({micros}) as ts",
        f"({micros} div 1000000 - 1704067200) div 3600 as hour",
    )


def _reviewed(spark, sf, slices):
    replay = _replay(spark, "review", "crop_id string, decision string, run_id long, ts timestamp")
    for i, part in enumerate(slices):
        replay.feed(part.select("crop_id", "decision", "run_id", "ts"), i)
        replay.run_to_table(live.review_stream(replay.stream()), idle_batches=False)
    return replay.result().select("crop_id", "decision", "run_id")


def _offered(spark, sf):
    """Pending records, each twice."""
    return views.review(spark, sf).filter("status = 'pending'").selectExpr(
        "crop_id", "decision", "run_id", "idx", _ts("1704067200 + idx") + " as ts", "explode(array(1, 2)) as copia"
    )


@query("SELECT crop_id, decision, run_id FROM fx_review WHERE status = 'pending'")
def stream_review_enqueue(spark, sf):
    offered = _offered(spark, sf)
    span = 1 + (offered.agg(F.max("idx")).first()[0] or 0)
    return _reviewed(spark, sf, [part for _, part in _slices(offered, "idx", span)])


@query("SELECT crop_id, decision, run_id FROM fx_review WHERE status = 'pending'")
def stream_review_lag(spark, sf):
    """Runs out of step: odd ones arrive whole, then even ones, then all once more. Every crop comes out once."""
    offered = _offered(spark, sf)
    odd = F.col("run_id") % 2 == 1
    return _reviewed(spark, sf, [offered.filter(odd), offered.filter(~odd), offered.filter("copia = 2")])


@query(
    """SELECT video_id, ean, max(n) AS cantidad FROM (
  SELECT video_id, frame_idx, sku_pred AS ean, count(*)::BIGINT AS n FROM fx_detections GROUP BY 1, 2, 3) GROUP BY 1, 2"""
)
def stream_inventory(spark, sf):
    boxes = views.detections(spark, sf).selectExpr("video_id", "frame_idx", "sku_pred as ean", "obj_id")
    replay = _replay(spark, "inventory", "video_id long, frame_idx long, ean string")
    for i, part in _slices(boxes, "obj_id", 1500):
        replay.feed(part.drop("obj_id"), i)
        live.refresh_frame_counts(
            replay.stream(), f"{replay.root}/counts", f"{replay.root}/checkpoint"
        ).awaitTermination()
    return live.refreshed_inventory(spark, f"{replay.root}/counts")


@query(METRICS_SQL)
def stream_metrics(spark, sf):
    """Metrics of runs kept up per micro-batch; every batch is delivered twice, as after a failure, and counts once."""
    records = views.review(spark, sf).select("run_id", "decision", "idx")
    replay = _replay(spark, "metrics", "run_id long, decision string")
    span = 1 + (records.agg(F.max("idx")).first()[0] or 0)
    write = live.partial_writer(live.run_counts, f"{replay.root}/runs")

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    for i, part in _slices(records, "idx", span):
        replay.feed(part.drop("idx"), i)
        live.refresh(replay.stream(), twice, f"{replay.root}/checkpoint").awaitTermination()
    return live.refreshed_metrics(spark, f"{replay.root}/runs", F.col("run_id") % 5)
