"""Frame-to-frame linking of boxes by overlap, and everything derived from the links.

The link of one video is sequential, but boxes that can never overlap, or lie further apart in time
than a track survives, do not influence each other. The video is therefore cut, first at gaps in
time longer than a track's life, then into islands of boxes whose x- and y-extents never meet.
Each part runs on its own, reads its boxes as a sorted stream and holds only its live tracks, and
the result equals that of the uncut video. A part that is still large is linked in chunks of time (``crowd``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockcount.functions import geometry as geo
from stockcount.operators.crowd import CHUNK_BOXES, PART, link_chunks, time_chunks
from stockcount.scale import compact, cut, numbered, running_sum

FRAME_BUCKET = 4096
LANE_BOXES = 20_000
CELL_PX = 256


@dataclass(frozen=True)
class TrackerSettings:
    """Default limits of the tracker."""

    iou: float = 0.4
    max_age: int = 15
    min_hits: int = 3
    min_conf_create: float = 0.55

    def __post_init__(self) -> None:
        # Boxes that don't touch are told apart by where they lie, so an overlap must be asked for.
        if not 0 < self.iou <= 1:
            raise ValueError("iou must be over 0 and at most 1")

    @property
    def reach(self) -> int:
        """Longest frame distance a track can bridge: expiry is tested after matching."""
        return self.max_age + 1


DEFAULTS = TrackerSettings()


def iou_candidates(detections: DataFrame, threshold: float = DEFAULTS.iou, cell: int = CELL_PX) -> DataFrame:
    """Pairs of boxes in consecutive frames of a video that overlap enough to be one track.

    Boxes meet only in the grid cells they touch, and a pair counts in the cell that holds the corner
    of its intersection, hence once.
    """
    cols = ["det_idx", "x1", "y1", "x2", "y2"]

    def gridded(frame: Column, prefix: str) -> DataFrame:
        def cells(low: str, high: str) -> Column:
            start = F.floor(F.col(low) / F.lit(cell))
            return F.sequence(start, F.greatest(start, F.floor((F.col(high) - 1) / F.lit(cell))))

        boxes = detections.withColumn("cx", F.explode(cells("x1", "x2"))).withColumn("cy", F.explode(cells("y1", "y2")))
        return boxes.select("video_id", frame.alias("frame_idx"), "cx", "cy", *[F.col(c).alias(prefix + c) for c in cols])

    now, prev = gridded(F.col("frame_idx"), "a_"), gridded(F.col("frame_idx") + 1, "b_")
    corner_x = F.floor(F.greatest("a_x1", "b_x1") / F.lit(cell))
    corner_y = F.floor(F.greatest("a_y1", "b_y1") / F.lit(cell))
    pairs = now.join(prev, ["video_id", "frame_idx", "cx", "cy"]).filter(
        (F.col("cx") == corner_x) & (F.col("cy") == corner_y)
    )
    return pairs.withColumn("iou", geo.iou("a_", "b_")).filter(F.col("iou") >= threshold).select(
        "video_id",
        "frame_idx",
        F.col("a_det_idx").alias("det_idx"),
        F.col("b_det_idx").alias("prev_det_idx"),
        "iou",
    )


def position_spans(detections: DataFrame, reach: int) -> DataFrame:
    """Distinct box corners per video and cell of ``reach`` + 1 frames, with their furthest extent.

    Inside a cell no two frames are further apart than a track can bridge, so cuts in time only
    occur between cells. The reduction combines on the map side; everything that decides how a video
    is split is computed from this table, not from the boxes.
    """
    cell = F.floor(F.col("frame_idx") / F.lit(reach + 1)).alias("cell")
    return detections.groupBy("video_id", cell, "x1", "y1").agg(
        F.max("x2").alias("x2"),
        F.max("y2").alias("y2"),
        F.min("frame_idx").alias("first"),
        F.max("frame_idx").alias("last"),
        F.count(F.lit(1)).alias("boxes"),
    )


def time_segments(spans: DataFrame, reach: int) -> DataFrame:
    """(video_id, cell, segment): segment is the first frame after the last gap wider than ``reach``."""
    order = Window.partitionBy("video_id").orderBy("cell")
    cells = spans.groupBy("video_id", "cell").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    gap = F.col("first") - F.lag("last").over(order)
    return (
        cells.withColumn("start", F.when(gap.isNull() | (gap > reach), F.col("first")))
        .withColumn("segment", F.max("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select("video_id", "cell", "segment")
    )


def _islands(spans: DataFrame, keys: list[str], low: str, high: str, name: str) -> DataFrame:
    """Adds ``name``: the first coordinate of the island of intervals [low, high) the box lies in.

    Intervals are reduced to one per start coordinate before the sweep, so a sweep is no longer than
    a frame is wide.
    """
    order = Window.partitionBy(*keys).orderBy(low)
    swept = (
        spans.groupBy(*keys, low)
        .agg(F.max(high).alias("reach"))
        .withColumn("covered", F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("head", F.when(F.col("covered").isNull() | (F.col(low) >= F.col("covered")), F.col(low)))
        .withColumn(name, F.max("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return spans.join(swept.select(*keys, low, name), [*keys, low])


def corner_parts(detections: DataFrame, reach: int, lane_boxes: int = LANE_BOXES) -> DataFrame:
    """video_id, cell, x1, y1, boxes with the ``segment`` and ``lane`` of each corner.

    Islands are hashed to lanes; a segment gets one lane per ``lane_boxes`` boxes.
    """
    spans = cut(position_spans(detections, reach))
    segments = time_segments(spans, reach)
    sizes = (
        spans.groupBy("video_id", "cell")
        .agg(F.sum("boxes").alias("boxes"))
        .join(segments, ["video_id", "cell"])
        .groupBy("video_id", "segment")
        .agg(F.ceil(F.sum("boxes") / F.lit(lane_boxes)).alias("lanes"))
    )
    split = spans.join(segments, ["video_id", "cell"])
    split = _islands(split, ["video_id", "segment"], "x1", "x2", "island_x")
    split = _islands(split, ["video_id", "segment", "island_x"], "y1", "y2", "island_y")
    lane = F.pmod(F.xxhash64("island_x", "island_y"), F.col("lanes")).cast("int")
    return split.join(sizes, ["video_id", "segment"]).select(
        "video_id", "cell", "x1", "y1", "segment", lane.alias("lane"), "boxes"
    )


def _in_parts(detections: DataFrame, corners: DataFrame, reach: int) -> DataFrame:
    cell = F.floor(F.col("frame_idx") / F.lit(reach + 1))
    return detections.withColumn("cell", cell).join(corners.drop("boxes"), ["video_id", "cell", "x1", "y1"])


def independent_parts(detections: DataFrame, reach: int, lane_boxes: int = LANE_BOXES) -> DataFrame:
    """Adds ``segment`` and ``lane``: boxes in different (video, segment, lane) never share a track."""
    return _in_parts(detections, corner_parts(detections, reach, lane_boxes), reach).drop("cell")


_LINKED = (
    "video_id long, frame_idx long, det_idx long, birth_frame long, birth_det long, hits long, age long"
)


#: Pairs of a box and a track that are looked at together.
PAIRS_AT_ONCE = 1_000_000
#: Tracks, and tracks near a box, up to which arrays cost more than they save.
NEAR_TRACKS, NEAR_EACH = 1000, 4


def _neighbours(a, b):
    """Numbers of the rows of ``a`` and ``b`` (four corners each) that may overlap, in runs of bounded length.

    Corners lie in cells as large as the largest extent, so that rows of ``b`` that overlap a row of ``a`` begin in one of the
    nine cells around its own. Cells of a column follow each other in the order, so three ranges hold them. Rows without extent overlap nothing.
    """
    import numpy as np

    whole = [np.flatnonzero(np.isfinite(m).all(axis=1) & (m[:, 2] > m[:, 0]) & (m[:, 3] > m[:, 1])) for m in (a, b)]
    if not len(whole[0]) or not len(whole[1]):
        return
    a, b = a[whole[0]], b[whole[1]]
    both = np.concatenate([a, b])
    low, cell = both[:, :2].min(axis=0), (both[:, 2:] - both[:, :2]).max(axis=0)
    # The span in cells is bounded, so that the number of a cell is exact.
    cell = np.maximum(cell, (both[:, :2].max(axis=0) - low) / 1e6)
    at, of = (np.floor((m[:, :2] - low) / cell).astype("int64") + 1 for m in (a, b))
    rows = int(max(at[:, 1].max(), of[:, 1].max())) + 2
    order = np.argsort(of[:, 0] * rows + of[:, 1], kind="stable")
    cells = (of[:, 0] * rows + of[:, 1])[order]
    middle = np.concatenate([(at[:, 0] + x) * rows + at[:, 1] for x in (-1, 0, 1)])
    begin, end = np.searchsorted(cells, middle - 1, side="left"), np.searchsorted(cells, middle + 1, side="right")
    who, n = np.tile(np.arange(len(a)), 3), end - begin
    sums = np.cumsum(n)
    first = 0
    while first < len(who):
        done = sums[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sums, done + PAIRS_AT_ONCE, side="right")))
        k = n[first:last]
        inside = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        yield whole[0][np.repeat(who[first:last], k)], whole[1][order[np.repeat(begin[first:last], k) + inside]]
        first = last


def frame_step(settings: TrackerSettings, ties: list[tuple] | None = None):
    """Task-side advance of the live tracks by the boxes of one frame.

    ``ties`` collects the pairs of free tracks that overlapped a box alike, of which the earlier one in order got it.

    Live tracks are lists in order of birth: four corners, birth frame, birth box, hits, last matched
    frame. The step returns the live tracks, those that expired before the frame, and one tuple
    (frame, box, track) per linked box.
    """
    threshold, reach, gate = settings.iou, settings.reach, settings.min_conf_create
    # Frames for which arrays are taken at once, after one that was crowded.
    crowded = 0

    def few_pairs(boxes, tracks):
        found = []
        for d, (ax1, ay1, ax2, ay2) in enumerate(boxes):
            for t, trk in enumerate(tracks):
                w = min(ax2, trk[2]) - max(ax1, trk[0])
                h = min(ay2, trk[3]) - max(ay1, trk[1])
                if w > 0 and h > 0:
                    inter = w * h
                    union = (ax2 - ax1) * (ay2 - ay1) + (trk[2] - trk[0]) * (trk[3] - trk[1]) - inter
                    if union > 0 and inter / union >= threshold:
                        found.append((inter / union, d, t))
        return found

    def near_pairs(boxes, tracks):
        """Pairs by cells as in ``_neighbours``, without arrays: a frame of some boxes costs less so. None if too many lie close."""
        wide = max(max([b[2] - b[0] for b in boxes]), max([t[2] - t[0] for t in tracks]))
        high = max(max([b[3] - b[1] for b in boxes]), max([t[3] - t[1] for t in tracks]))
        if not (0 < wide < 1e9 and 0 < high < 1e9):
            return None
        cells: dict[tuple, list] = {}
        for t, trk in enumerate(tracks):
            at = (trk[0] // wide, trk[1] // high)
            if at in cells:
                cells[at].append(t)
            else:
                cells[at] = [t]
        found, left = [], NEAR_EACH * len(boxes)
        for d, (ax1, ay1, ax2, ay2) in enumerate(boxes):
            if not (ax2 > ax1 and ay2 > ay1):
                continue
            x, y = ax1 // wide, ay1 // high
            near = []
            for i in (x - 1, x, x + 1):
                for j in (y - 1, y, y + 1):
                    if (i, j) in cells:
                        near += cells[i, j]
            left -= len(near)
            if left < 0:
                return None
            near.sort()
            for t in near:
                bx1, by1, bx2, by2 = tracks[t][:4]
                if bx1 < ax2 and ax1 < bx2 and by1 < ay2 and ay1 < by2 and bx2 > bx1 and by2 > by1:
                    inter = ((ax2 if ax2 < bx2 else bx2) - (ax1 if ax1 > bx1 else bx1)) * ((ay2 if ay2 < by2 else by2) - (ay1 if ay1 > by1 else by1))
                    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
                    if union > 0 and inter / union >= threshold:
                        found.append((inter / union, d, t))
        return found

    def many_pairs(boxes, tracks):
        import numpy as np

        a = np.array(boxes, dtype="float64")
        b = np.array([trk[:4] for trk in tracks], dtype="float64")
        found = []
        for di, ti in _neighbours(a, b):
            w = np.minimum(a[di, 2], b[ti, 2]) - np.maximum(a[di, 0], b[ti, 0])
            h = np.minimum(a[di, 3], b[ti, 3]) - np.maximum(a[di, 1], b[ti, 1])
            inter = np.where((w > 0) & (h > 0), w * h, 0.0)
            union = (a[di, 2] - a[di, 0]) * (a[di, 3] - a[di, 1]) + (b[ti, 2] - b[ti, 0]) * (b[ti, 3] - b[ti, 1]) - inter
            iou = np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1.0), 0.0)
            close = (inter > 0) & (iou >= threshold)
            found += zip(iou[close].tolist(), di[close].tolist(), ti[close].tolist())
        # In order of boxes, then of tracks.
        found.sort(key=lambda p: p[1:])
        return found

    def pairs_of(boxes, tracks):
        nonlocal crowded
        if len(boxes) * len(tracks) <= 64:
            return few_pairs(boxes, tracks)
        if len(tracks) <= NEAR_TRACKS and not crowded:
            pairs = near_pairs(boxes, tracks)
            if pairs is not None:
                return pairs
            crowded = 16
        crowded = max(0, crowded - 1)
        return many_pairs(boxes, tracks)

    def advance(tracks, frame, dets, boxes, confs):
        dead = [trk for trk in tracks if frame - trk[7] > reach]
        if dead:
            tracks = [trk for trk in tracks if frame - trk[7] <= reach]
        owner = [None] * len(dets)
        if tracks:
            pairs = pairs_of(boxes, tracks)
            # The sort is stable: equal overlaps keep the order of boxes, then of tracks.
            pairs.sort(key=lambda p: -p[0])
            taken = set()
            for n, (overlap, d, t) in enumerate(pairs):
                if owner[d] is None and t not in taken:
                    owner[d] = tracks[t]
                    taken.add(t)
                    while ties is not None and (n := n + 1) < len(pairs) and pairs[n][:2] == (overlap, d):
                        if pairs[n][2] not in taken:
                            ties.append((tracks[t], tracks[pairs[n][2]]))
        linked = []
        for d, trk in enumerate(owner):
            if trk is not None:
                trk[:4] = boxes[d]
                trk[6] += 1
                trk[7] = frame
            elif confs[d] >= gate:
                trk = [*boxes[d], frame, dets[d], 1, frame]
                tracks.append(trk)
            else:
                continue
            linked.append((frame, dets[d], trk))
        return tracks, dead, linked

    return advance


def _linker(settings: TrackerSettings):
    advance = frame_step(settings)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        tracks = []
        pending = None
        last_done = None

        def run(pdf, out):
            nonlocal last_done, tracks
            if len(pdf) == 0:
                return
            frames = pdf["frame_idx"].to_numpy()
            if (last_done is not None and frames[0] <= last_done) or (np.diff(frames) < 0).any():
                raise ValueError("boxes of one part must arrive ordered by frame")
            dets = pdf["det_idx"].tolist()
            boxes = list(zip(*(pdf[c].tolist() for c in ("x1", "y1", "x2", "y2"))))
            confs = pdf["conf"].tolist()
            cuts = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                frame = int(frames[a])
                tracks, _, linked = advance(tracks, frame, dets[a:b], boxes[a:b], confs[a:b])
                out.extend((frame, det, t[4], t[5], t[6], frame - t[4] + 1) for _, det, t in linked)
            last_done = frames[-1]

        def emit(out, video):
            rows = np.array(out, dtype="int64")
            result = pd.DataFrame(
                rows, columns=["frame_idx", "det_idx", "birth_frame", "birth_det", "hits", "age"]
            )
            result.insert(0, "video_id", video)
            return result

        for pdf in batches:
            if len(pdf) == 0:
                continue
            if pending is not None:
                pdf = pd.concat([pending, pdf], ignore_index=True)
            # The last frame may continue in the next batch.
            done = (pdf["frame_idx"] < pdf["frame_idx"].iloc[-1]).to_numpy()
            pending = pdf[~done]
            out = []
            run(pdf[done], out)
            if out:
                yield emit(out, pdf["video_id"].iloc[0])
        if pending is not None:
            out = []
            run(pending, out)
            if out:
                yield emit(out, pending["video_id"].iloc[0])

    return link


def link_detections(
    detections: DataFrame, settings: TrackerSettings = DEFAULTS, lane_boxes: int = LANE_BOXES, chunk_boxes: int = CHUNK_BOXES
) -> DataFrame:
    """One row per box that belongs to a track: the track's birth (frame, box), hits and age so far."""
    slim = detections.select("video_id", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "conf")
    corners = corner_parts(slim, settings.reach, lane_boxes)
    chunks = time_chunks(corners, chunk_boxes)
    parts = _in_parts(slim, corners, settings.reach)
    crowded = None
    if not chunks.isEmpty():
        which = compact(chunks.select(*PART).distinct())
        # Read again in every round.
        crowded = link_chunks(cut(parts.join(which, PART, "left_semi")), chunks, settings)
        parts = parts.join(which, PART, "left_anti")
    # A fixed number of partitions keeps the kernel spread even when the rows are few bytes.
    tasks = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = parts.drop("cell").repartition(tasks, *PART).sortWithinPartitions(*PART, "frame_idx", "det_idx")
    linked = ordered.groupBy(*PART).applyInPandas(_linker(settings), _LINKED)
    return linked if crowded is None else linked.unionByName(crowded)


def track_assign(
    detections: DataFrame, settings: TrackerSettings = DEFAULTS, lane_boxes: int = LANE_BOXES, chunk_boxes: int = CHUNK_BOXES
) -> DataFrame:
    """Links with track ids, numbered per video from 1 in order of birth."""
    # Read three times below; the grouped kernel must run once.
    linked = cut(link_detections(detections, settings, lane_boxes, chunk_boxes))
    births = linked.filter(F.col("hits") == 1).select("video_id", "birth_frame", "birth_det")
    ids = numbered(
        births,
        ["video_id"],
        F.floor(F.col("birth_frame") / F.lit(FRAME_BUCKET)),
        [F.col("birth_frame"), F.col("birth_det")],
        "track_id",
    )
    return linked.join(ids, ["video_id", "birth_frame", "birth_det"]).select(
        "video_id",
        "frame_idx",
        "det_idx",
        F.col("track_id").cast("long").alias("track_id"),
        "birth_frame",
        "hits",
        "age",
        (F.col("hits") >= settings.min_hits).alias("track_valid"),
    )


def track_lifecycle(assigned: DataFrame, frames: DataFrame, settings: TrackerSettings = DEFAULTS) -> DataFrame:
    """First and last frame of each track, when it ended and why.

    A track ends inside the video if the frame in which it expires was processed; otherwise the
    final flush ends it.
    """
    tracks = assigned.groupBy("video_id", "track_id").agg(
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
        F.count(F.lit(1)).alias("hits"),
    )
    last = frames.groupBy("video_id").agg(F.max("frame_idx").alias("video_last"))
    expiry = F.col("last_frame") + F.lit(settings.reach)
    inside = expiry <= F.col("video_last")
    return tracks.join(last, "video_id").select(
        "video_id",
        "track_id",
        "first_frame",
        "last_frame",
        "hits",
        F.when(inside, expiry).alias("end_frame"),
        F.when(inside, F.lit("ended_in_update")).otherwise(F.lit("video_end")).alias("ended_reason"),
    )


def track_debug(
    detections: DataFrame,
    assigned: DataFrame,
    frames: DataFrame | None = None,
) -> DataFrame:
    """Every filtered box with its track, or -1 and NO_TRACK.

    With ``frames`` given, processed frames without any box add one NO_DETECTIONS row each.
    """
    track = F.coalesce(F.col("track_id"), F.lit(-1).cast("long"))
    has = F.col("track_id").isNotNull()
    rows = detections.join(assigned, ["video_id", "frame_idx", "det_idx"], "left").select(
        "video_id",
        "frame_idx",
        "det_idx",
        track.alias("track_id"),
        F.col("x1").alias("bbox_x1"),
        F.col("y1").alias("bbox_y1"),
        F.col("x2").alias("bbox_x2"),
        F.col("y2").alias("bbox_y2"),
        F.col("conf").alias("confianza"),
        F.when(has, F.lit("ACTIVE")).otherwise(F.lit("NO_TRACK")).alias("track_state"),
        F.coalesce(F.col("hits"), F.lit(0).cast("long")).alias("track_hits"),
        F.coalesce(F.col("age"), F.lit(0).cast("long")).alias("track_age"),
        F.when(has & F.col("track_valid"), F.lit("YES")).otherwise(F.lit("NO")).alias("track_valid"),
    )
    if frames is None:
        return rows
    empty = frames.select("video_id", "frame_idx").join(
        detections.select("video_id", "frame_idx").distinct(), ["video_id", "frame_idx"], "left_anti"
    )
    marker = {
        "det_idx": -1,
        "track_id": -1,
        "bbox_x1": 0,
        "bbox_y1": 0,
        "bbox_x2": 0,
        "bbox_y2": 0,
        "confianza": 0.0,
        "track_state": "NO_DETECTIONS",
        "track_hits": 0,
        "track_age": 0,
        "track_valid": "N/A",
    }
    types = dict(rows.dtypes)
    return rows.unionByName(
        empty.select("video_id", "frame_idx", *[F.lit(v).cast(types[c]).alias(c) for c, v in marker.items()])
    )


def frame_track_stats(
    assigned: DataFrame, lifecycle: DataFrame, frames: DataFrame, settings: TrackerSettings = DEFAULTS
) -> DataFrame:
    """Per processed frame: matched tracks, valid ones among them, decisions taken so far."""
    active = assigned.groupBy("video_id", "frame_idx").agg(
        F.count(F.lit(1)).alias("tracks"), F.count_if("track_valid").alias("valid")
    )
    ended = (
        lifecycle.filter(F.col("end_frame").isNotNull())
        .groupBy("video_id", F.col("end_frame").alias("frame_idx"))
        .agg(F.count(F.lit(1)).alias("ended"))
    )
    keys = ["video_id", "frame_idx"]
    joined = (
        frames.select(*keys)
        .join(active, keys, "left")
        .join(ended, keys, "left")
        .na.fill(0, ["tracks", "valid", "ended"])
    )
    bucket = F.floor(F.col("frame_idx") / F.lit(FRAME_BUCKET))
    return running_sum(joined, ["video_id"], bucket, F.col("frame_idx"), "ended", "decisions").select(
        *keys, "tracks", "valid", F.col("decisions").cast("long").alias("decisions")
    )


def gap_sessions(detections: DataFrame, entity: Column, reach: int = DEFAULTS.reach) -> DataFrame:
    """Sessions of an entity broken by frame gaps, for sources that carry object identities already."""
    rows = detections.select("video_id", entity.alias("entity"), "frame_idx")
    order = Window.partitionBy("video_id", "entity").orderBy("frame_idx")
    marked = rows.withColumn("prev", F.lag("frame_idx").over(order)).withColumn(
        "start", F.when(F.col("prev").isNull() | (F.col("frame_idx") - F.col("prev") > reach), F.col("frame_idx"))
    )
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("first_frame", F.max("start").over(running))
        .groupBy("video_id", "entity", "first_frame")
        .agg(F.max("frame_idx").alias("last_frame"), F.count(F.lit(1)).alias("hits"))
    )
