"""Box filters, crop rectangles and per-frame selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockcount.functions import geometry as geo
from stockcount.operators.greedy import greedy_keep


def confident(detections: DataFrame, min_conf: float = 0.25) -> DataFrame:
    return detections.filter(F.col("conf") >= min_conf)


def geometric_filter(detections: DataFrame) -> DataFrame:
    """Boxes of plausible size and shape, extents floored at one pixel."""
    bw, bh = geo.floored_width().cast("double"), geo.floored_height().cast("double")
    ratio = bw * bh / (F.col("frame_w") * F.col("frame_h")).cast("double")
    aspect = bw / bh
    return detections.filter(
        ratio.between(geo.MIN_AREA_RATIO, geo.MAX_AREA_RATIO) & aspect.between(geo.MIN_ASPECT, geo.MAX_ASPECT)
    )


def tracking_filter(
    detections: DataFrame, min_rel: float = geo.MIN_AREA_RATIO, max_rel: float = geo.TRACK_MAX_REL_AREA
) -> DataFrame:
    """Boxes fit for tracking: no noise, no shelf-wide groups at the border, no panoramic rows."""
    rel = geo.rel_area()
    border = (
        (F.col("x1") <= geo.BORDER_PX)
        | (F.col("y1") <= geo.BORDER_PX)
        | (F.col("x2") >= F.col("frame_w") - geo.BORDER_PX)
        | (F.col("y2") >= F.col("frame_h") - geo.BORDER_PX)
    )
    aspect = F.when(geo.height() > 0, geo.width().cast("double") / geo.height().cast("double")).otherwise(F.lit(0.0))
    return detections.filter(
        rel.between(min_rel, max_rel)
        & ~(border & (rel > geo.BORDER_REL_AREA))
        & ~((aspect > geo.PANORAMA_ASPECT) & (rel > geo.PANORAMA_REL_AREA))
    )


def in_roi(detections: DataFrame, roi: tuple[float, float, float, float]) -> DataFrame:
    """Boxes whose centre lies in the region of interest, with their place relative to its corner.

    The normalised region becomes pixels by truncation; an empty region means the whole frame.
    """
    x1 = F.greatest(F.lit(0), (F.lit(roi[0]) * F.col("frame_w")).cast("int"))
    y1 = F.greatest(F.lit(0), (F.lit(roi[1]) * F.col("frame_h")).cast("int"))
    x2 = F.least(F.col("frame_w"), (F.lit(roi[2]) * F.col("frame_w")).cast("int"))
    y2 = F.least(F.col("frame_h"), (F.lit(roi[3]) * F.col("frame_h")).cast("int"))
    valid = (x2 > x1) & (y2 > y1)
    ox, oy = F.when(valid, x1).otherwise(F.lit(0)), F.when(valid, y1).otherwise(F.lit(0))
    # Twice the centre keeps the comparison in integers.
    cx, cy = F.col("x1") + F.col("x2"), F.col("y1") + F.col("y2")
    inside = (cx >= x1 * 2) & (cx < x2 * 2) & (cy >= y1 * 2) & (cy < y2 * 2)
    return detections.filter(~valid | inside).withColumns(
        {"roi_x1": F.col("x1") - ox, "roi_y1": F.col("y1") - oy, "roi_x2": F.col("x2") - ox, "roi_y2": F.col("y2") - oy}
    )


def shift_boxes(detections: DataFrame, ox: int, oy: int) -> DataFrame:
    """Boxes found inside a clipped region, moved back to frame coordinates."""
    return detections.withColumns(
        {"x1": F.col("x1") + ox, "y1": F.col("y1") + oy, "x2": F.col("x2") + ox, "y2": F.col("y2") + oy}
    )


def uncapped_padding(detections: DataFrame) -> DataFrame:
    """Boxes grown by the dynamic padding as the detector crops them, empty results dropped."""
    pad = geo.dynamic_padding()
    box = geo.padded_box(F.col("padding"))
    return (
        detections.withColumn("padding", pad)
        .withColumns({f"padded_{k}": v for k, v in box.items()})
        .filter((F.col("padded_x2") > F.col("padded_x1")) & (F.col("padded_y2") > F.col("padded_y1")))
    )


def crop_rects(detections: DataFrame) -> DataFrame:
    """Padded and inner rectangles of every usable box; degenerate boxes are dropped."""
    usable = detections.filter((geo.width() > 2) & (geo.height() > 2))
    padded = usable.withColumn("pad", geo.capped_padding(geo.dynamic_padding())).withColumns(
        {f"p_{k}": v for k, v in geo.padded_box(F.col("pad")).items()}
    )
    inner = padded.filter((F.col("p_x2") > F.col("p_x1")) & (F.col("p_y2") > F.col("p_y1"))).withColumns(
        {f"i_{k}": v for k, v in geo.inner_box("p_").items()}
    )
    clipped = inner.withColumns(
        {
            "i_x1": F.greatest(F.lit(0), F.col("i_x1")),
            "i_y1": F.greatest(F.lit(0), F.col("i_y1")),
            "i_x2": F.least(F.col("frame_w"), F.col("i_x2")),
            "i_y2": F.least(F.col("frame_h"), F.col("i_y2")),
        }
    )
    return clipped.filter((F.col("i_x2") > F.col("i_x1")) & (F.col("i_y2") > F.col("i_y1")))


def split_rects(boxes: DataFrame) -> DataFrame:
    """Left and right half of every box, cut at the integer middle (at least one pixel)."""
    mid = F.col("x1") + F.greatest(F.lit(1), F.shiftright(geo.width(), 1))
    halves = F.array(
        F.struct(F.lit("L").alias("side"), F.col("x1").alias("hx1"), mid.alias("hx2")),
        F.struct(F.lit("R").alias("side"), mid.alias("hx1"), F.col("x2").alias("hx2")),
    )
    return boxes.withColumn("half", F.explode(halves)).select(
        *boxes.columns, F.col("half.side").alias("side"), F.col("half.hx1").alias("hx1"), F.col("half.hx2").alias("hx2")
    )


def top_per_frame(detections: DataFrame, limit: int = 300, tie: str = "det_idx") -> DataFrame:
    """At most ``limit`` boxes per frame, most confident first."""
    order = Window.partitionBy("video_id", "frame_idx").orderBy(F.desc("conf"), F.asc(tie))
    return detections.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def suppress_overlaps(detections: DataFrame, key: str, iou: float = 0.55) -> DataFrame:
    """Non-maximum suppression per frame: a box falls to a more confident kept box it overlaps.

    ``key`` is a number unique over the table. Boxes of equal confidence are taken in order of ``key``.
    """
    corners = ["x1", "y1", "x2", "y2"]
    items = detections.select(
        F.concat_ws("/", "video_id", "frame_idx").alias("scope"),
        F.col(key).alias("key"),
        (-F.col("conf")).cast("double").alias("o1"),
        F.col(key).cast("long").alias("o2"),
        F.array(*[F.col(c).cast("double") for c in corners]).alias("vec"),
        ((geo.width() > 0) & (geo.height() > 0)).alias("solid"),
    )
    kept = greedy_keep(items, iou, score="iou", strict=True, comparable=F.col("solid"))
    return detections.join(kept.withColumnRenamed("key", key), key, "left_semi")
