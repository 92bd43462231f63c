"""Queries on tracks and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockcount.operators import tracking, votes
from stockcount.plans.registry import query
from stockcount.sources import views

_OPEN_GATE = tracking.TrackerSettings(min_conf_create=0.0)

_VOTE_SQL = """
WITH per_sku AS (
  SELECT track_id, sku, count(*)::BIGINT AS votes, sum(round(sim, 4))::DOUBLE AS sim_sum, min(frame_idx) AS first_frame
  FROM fx_votes WHERE sku <> 'UNKNOWN' AND round(sim, 4) >= 0.30 GROUP BY 1, 2),
seen AS (SELECT track_id, count(*)::BIGINT AS frames_seen FROM fx_votes GROUP BY 1),
scored AS (SELECT track_id, sum(votes)::BIGINT AS frames_scored FROM per_sku GROUP BY 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, first_frame, sku) AS rank FROM per_sku),
tallies AS (
  SELECT s.track_id, s.frames_seen, coalesce(c.frames_scored, 0) AS frames_scored,
         r.sku AS top_sku, r.votes AS top_votes, r.sim_sum AS top_sim_sum
  FROM seen s LEFT JOIN scored c USING (track_id) LEFT JOIN ranked r ON r.track_id = s.track_id AND r.rank = 1)
"""


def _accepted(frames: int, conf: float, sim: float, high: float) -> str:
    return (
        f"(frames_scored >= {frames} AND top_votes / frames_scored >= {conf}::DOUBLE "
        f"AND top_sim_sum / top_votes >= {sim}::DOUBLE) OR top_sim_sum / top_votes >= {high}::DOUBLE"
    )


_DECISION_SQL = (
    _VOTE_SQL
    + f""", decisions AS (
  SELECT track_id, CASE WHEN {_accepted(2, 0.55, 0.26, 0.88)} THEN top_sku ELSE 'UNKNOWN' END AS final_sku,
         coalesce(printf('%.4f', top_votes / frames_scored)::DOUBLE, 0.0::DOUBLE) AS confidence,
         coalesce(printf('%.4f', top_sim_sum / top_votes)::DOUBLE, 0.0::DOUBLE) AS avg_sim,
         frames_seen AS frames_validos, frames_scored
  FROM tallies)
"""
)


@query(
    _DECISION_SQL
    + "SELECT final_sku AS ean, count(*)::BIGINT AS cantidad FROM decisions WHERE final_sku <> 'UNKNOWN' GROUP BY 1"
)
def inventory_by_track(spark, sf):
    from stockcount.operators.inventory import inventory_by_track as count_units

    return count_units(votes.track_decisions(views.votes(spark, sf)))


@query(_VOTE_SQL + "SELECT track_id, sku, votes, round(sim_sum, 6) AS sim_sum, first_frame FROM per_sku")
def track_votes(spark, sf):
    return votes.track_votes(views.numbered_votes(spark, sf)).withColumn("sim_sum", F.round("sim_sum", 6))


@query(_DECISION_SQL + "SELECT * FROM decisions")
def track_decisions(spark, sf):
    return votes.track_decisions(views.votes(spark, sf))


@query(
    _VOTE_SQL
    + """SELECT track_id, rank::INTEGER AS rank, sku, votes, printf('%.4f', sim_sum / votes)::DOUBLE AS avg_sim,
         printf('%.4f', votes / frames_scored)::DOUBLE AS confidence
  FROM ranked JOIN scored USING (track_id) WHERE rank <= 5"""
)
def track_top_matches(spark, sf):
    return votes.track_top_matches(views.votes(spark, sf))


@query(
    _VOTE_SQL
    + f""", outcomes AS (
  SELECT 'SHELF_STRICT' AS profile, coalesce({_accepted(3, 0.60, 0.28, 0.90)}, false) AS ok FROM tallies
  UNION ALL SELECT 'WAREHOUSE_LENIENT', coalesce({_accepted(2, 0.50, 0.25, 0.90)}, false) FROM tallies
  UNION ALL SELECT 'WAREHOUSE_BALANCED', coalesce({_accepted(2, 0.55, 0.26, 0.88)}, false) FROM tallies)
SELECT profile, count(*)::BIGINT AS total_tracks, count_if(ok)::BIGINT AS matched, count_if(NOT ok)::BIGINT AS unknown
FROM outcomes GROUP BY 1"""
)
def track_profile_compare(spark, sf):
    return votes.compare_profiles(views.votes(spark, sf))


@query(
    _DECISION_SQL
    + """SELECT count(*)::BIGINT AS total_tracks, count_if(final_sku <> 'UNKNOWN')::BIGINT AS matched,
       count_if(final_sku = 'UNKNOWN')::BIGINT AS unknown,
       printf('%.4f', count_if(final_sku <> 'UNKNOWN') / count(*))::DOUBLE AS match_rate FROM decisions"""
)
def track_summary(spark, sf):
    return votes.track_summary(votes.track_decisions(views.votes(spark, sf)))


@query(
    _DECISION_SQL
    + """SELECT d.track_id, d.final_sku, p.sku, p.votes, r.rank::INTEGER AS rank FROM decisions d
JOIN per_sku p USING (track_id) LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.track_id = d.track_id AND r.sku = p.sku"""
)
def track_summary_documents(spark, sf):
    """The nested documents of the summary, laid out per vote with its place among the alternatives."""
    numbered = views.votes(spark, sf)
    docs = votes.track_summary_documents(numbered, votes.track_decisions(numbered))
    flat = docs.select("track_id", "final_sku", F.explode("votes").alias("sku", "votes"), "top_matches")
    place = F.array_position(F.transform("top_matches", lambda m: m["sku"]), F.col("sku"))
    return flat.select("track_id", "final_sku", "sku", "votes", F.nullif(place, F.lit(0)).cast("int").alias("rank"))


# The boxes of the fixture carry object identities and never overlap between objects, so linking them
# must give back the sessions of each object broken at gaps of more than 16 frames.
_ISLANDS_SQL = """
WITH marked AS (
  SELECT video_id, obj_id, frame_idx, det_idx, conf,
         CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id, obj_id ORDER BY frame_idx) <= 16
              THEN 0 ELSE 1 END AS brk
  FROM fx_detections),
islands AS (
  SELECT *, sum(brk) OVER (PARTITION BY video_id, obj_id ORDER BY frame_idx) AS island FROM marked),
gated AS (
  SELECT *, min(CASE WHEN conf >= 0.55 THEN frame_idx END) OVER (PARTITION BY video_id, obj_id, island) AS born
  FROM islands),
members AS (SELECT * FROM gated WHERE frame_idx >= born),
births AS (
  SELECT video_id, obj_id, island, born,
         row_number() OVER (PARTITION BY video_id ORDER BY born, det_idx) AS track_id
  FROM members WHERE frame_idx = born),
assigned AS (
  SELECT m.video_id, m.frame_idx, m.det_idx, b.track_id, m.born AS birth_frame,
         row_number() OVER (PARTITION BY m.video_id, m.obj_id, m.island ORDER BY m.frame_idx) AS hits,
         m.frame_idx - m.born + 1 AS age
  FROM members m JOIN births b USING (video_id, obj_id, island)),
lifecycle AS (
  SELECT a.video_id, a.track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*)::BIGINT AS hits
  FROM assigned a GROUP BY 1, 2),
ended AS (
  SELECT *, CASE WHEN last_frame + 16 <= (SELECT max(frame_idx) FROM fx_detections) THEN last_frame + 16 END AS end_frame,
         CASE WHEN last_frame + 16 <= (SELECT max(frame_idx) FROM fx_detections) THEN 'ended_in_update' ELSE 'video_end' END AS ended_reason
  FROM lifecycle)
"""


@query(
    _ISLANDS_SQL
    + """SELECT video_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*)::BIGINT AS hits
FROM islands GROUP BY video_id, obj_id, island"""
)
def track_sessions(spark, sf):
    linked = tracking.link_detections(views.detections(spark, sf), _OPEN_GATE)
    return (
        linked.groupBy("video_id", "birth_frame", "birth_det")
        .agg(
            F.min("frame_idx").alias("first_frame"),
            F.max("frame_idx").alias("last_frame"),
            F.count(F.lit(1)).alias("hits"),
        )
        .drop("birth_frame", "birth_det")
    )


@query(_ISLANDS_SQL + "SELECT *, hits >= 3 AS track_valid FROM assigned")
def track_assign(spark, sf):
    return tracking.track_assign(views.detections(spark, sf))


@query(_ISLANDS_SQL + "SELECT *, hits >= 3 AS track_valid FROM assigned")
def track_assign_chunks(spark, sf):
    """Every video in chunks of time of about fifty boxes, linked side by side."""
    return tracking.track_assign(views.detections(spark, sf), chunk_boxes=50)


@query(_ISLANDS_SQL + "SELECT * FROM ended")
def track_lifecycle(spark, sf):
    assigned = tracking.track_assign(views.detections(spark, sf))
    return tracking.track_lifecycle(assigned, views.frames(spark, sf))


@query(
    _ISLANDS_SQL
    + """SELECT d.video_id, d.frame_idx, d.det_idx, coalesce(a.track_id, -1) AS track_id, d.x1 AS bbox_x1,
       d.y1 AS bbox_y1, d.x2 AS bbox_x2, d.y2 AS bbox_y2, d.conf AS confianza,
       CASE WHEN a.track_id IS NULL THEN 'NO_TRACK' ELSE 'ACTIVE' END AS track_state,
       coalesce(a.hits, 0) AS track_hits, coalesce(a.age, 0) AS track_age,
       CASE WHEN a.hits >= 3 THEN 'YES' ELSE 'NO' END AS track_valid
FROM fx_detections d LEFT JOIN assigned a USING (video_id, frame_idx, det_idx)"""
)
def track_debug(spark, sf):
    boxes = views.detections(spark, sf)
    return tracking.track_debug(boxes, tracking.track_assign(boxes))


@query(
    _ISLANDS_SQL
    + """, active AS (
  SELECT video_id, frame_idx, count(*)::BIGINT AS tracks, count_if(hits >= 3)::BIGINT AS valid FROM assigned GROUP BY 1, 2)
SELECT f.video_id, f.frame_idx, coalesce(a.tracks, 0) AS tracks, coalesce(a.valid, 0) AS valid,
       (SELECT count(*) FROM ended e WHERE e.video_id = f.video_id AND e.end_frame <= f.frame_idx)::BIGINT AS decisions
FROM fx_frames f LEFT JOIN active a USING (video_id, frame_idx)"""
)
def frame_track_stats(spark, sf):
    frames = views.frames(spark, sf)
    assigned = tracking.track_assign(views.detections(spark, sf))
    return tracking.frame_track_stats(assigned, tracking.track_lifecycle(assigned, frames), frames)


@query(
    """
WITH p AS (
  SELECT a.video_id, a.frame_idx, a.det_idx, b.det_idx AS prev_det_idx,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
  FROM fx_detections a JOIN fx_detections b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx + 1)
SELECT video_id, frame_idx, det_idx, prev_det_idx, round(i / (s - i), 6) AS iou
FROM p WHERE i > 0 AND i / (s - i) >= 0.4"""
)
def iou_pairs(spark, sf):
    return tracking.iou_candidates(views.detections(spark, sf)).withColumn("iou", F.round("iou", 6))
