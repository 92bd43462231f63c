"""The whole way from boxes with embeddings to counted stock, for any number of videos at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockcount.functions.decision import VoteProfile
from stockcount.operators import detections as det
from stockcount.operators import identify as ident
from stockcount.operators import inventory, tracking, votes
from stockcount.scale import cut


@dataclass(frozen=True)
class Outcome:
    """Results of one processing run; each table covers all videos."""

    assigned: DataFrame
    identified: DataFrame
    decisions: DataFrame
    by_track: DataFrame
    by_frame: DataFrame
    review: DataFrame
    totals: DataFrame


def process_videos(
    boxes: DataFrame,
    frames: DataFrame,
    refs: DataFrame,
    prompts: DataFrame | None = None,
    settings: tracking.TrackerSettings = tracking.DEFAULTS,
    profile: VoteProfile | str = votes.BALANCED,
    run_id: Column | None = None,
    stamp: Column | None = None,
) -> Outcome:
    """Filter, link, identify once, vote, count.

    ``boxes`` has the box columns, frame_w, frame_h, conf and ``embedding``; with ``left_vec`` and
    ``right_vec`` doubtful wide boxes are split and the better half may decide. Each box is identified
    once; votes, frame counts and the review queue read the stored result.
    """
    kept = det.tracking_filter(boxes)
    assigned = tracking.track_assign(kept, settings)
    key = F.concat_ws("/", "video_id", "frame_idx", "det_idx").alias("crop_id")
    place = ["video_id", "frame_idx", "det_idx"]
    usable = det.crop_rects(kept)
    if {"left_vec", "right_vec"} <= set(boxes.columns):
        shape = ["left_vec", "right_vec", "x1", "y1", "x2", "y2", "frame_w", "frame_h", "conf"]
        found = ident.identify_boxes(usable.select(key, F.col("embedding").alias("full_vec"), *shape), refs, prompts)
    else:
        found = ident.identify(usable.select(key, "embedding"), refs, prompts)
    result = cut(found.select("crop_id", "detectada", "status", "ean", "confianza", "top_matches"))
    parts = F.split("crop_id", "/")
    located = result.withColumns({c: F.get(parts, F.lit(i)).cast("long") for i, c in enumerate(place)})
    ballots = assigned.join(located, place).select(
        F.struct("video_id", "track_id").alias("track_id"),
        F.col("ean").alias("sku"),
        F.col("confianza").alias("sim"),
        "frame_idx",
    )
    decided = votes.track_decisions(ballots, profile).select("track_id.*", "final_sku", "confidence", "avg_sim", "frames_validos", "frames_scored")
    life = tracking.track_lifecycle(assigned, frames, settings).select("video_id", "track_id", "ended_reason")
    # A track none of whose boxes could be cropped has no votes but was still decided: UNKNOWN.
    decided = life.join(decided, ["video_id", "track_id"], "left").na.fill("UNKNOWN", ["final_sku"]).na.fill(0)
    return Outcome(
        assigned=assigned,
        identified=located,
        decisions=decided,
        by_track=inventory.inventory_by_track(decided, ("video_id",)),
        by_frame=inventory.inventory_by_frame(located),
        review=ident.review_records(
            located, F.lit("run") if run_id is None else run_id, F.lit(None).cast("string") if stamp is None else stamp
        ),
        totals=inventory.run_totals(frames, located),
    )
