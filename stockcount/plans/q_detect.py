"""Queries on raw boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockcount.functions import geometry as geo
from stockcount.functions import labels
from stockcount.functions.numbers import decimals
from stockcount.operators import detections as det
from stockcount.operators import tracking
from stockcount.plans.registry import query
from stockcount.sources import views

_KEYS = ("l_orderkey", "l_linenumber", "video_id", "frame_idx")
_BOX = ("x1", "y1", "x2", "y2")


@query("SELECT video_id, frame_idx, det_idx, obj_id, conf FROM fx_detections WHERE conf >= 0.25")
def det_conf_filter(spark, sf):
    return det.confident(views.detections(spark, sf)).select("video_id", "frame_idx", "det_idx", "obj_id", "conf")


@query(
    """WITH r AS (
  SELECT *, greatest(1, x2 - x1) AS bw, greatest(1, y2 - y1) AS bh FROM fx_raw_boxes)
SELECT l_orderkey, l_linenumber, video_id, frame_idx, x1, y1, x2, y2 FROM r
WHERE bw * bh / (frame_w * frame_h)::DOUBLE BETWEEN 0.002::DOUBLE AND 0.90::DOUBLE
  AND bw / bh BETWEEN 0.10::DOUBLE AND 10"""
)
def det_post_filter(spark, sf):
    return det.geometric_filter(views.raw_boxes(spark, sf)).select(*_KEYS, *_BOX)


@query(
    """WITH r AS (
  SELECT *, greatest(1, (x2 - x1) * (y2 - y1)) / (frame_w * frame_h)::DOUBLE AS rel,
         (x1 <= 8 OR y1 <= 8 OR x2 >= frame_w - 8 OR y2 >= frame_h - 8) AS border,
         CASE WHEN y2 > y1 THEN (x2 - x1) / (y2 - y1) ELSE 0 END AS aspect
  FROM fx_raw_boxes)
SELECT l_orderkey, l_linenumber, video_id, frame_idx, x1, y1, x2, y2 FROM r
WHERE rel >= 0.002::DOUBLE AND rel <= 0.25 AND NOT (border AND rel > 0.12::DOUBLE)
  AND NOT (aspect > 3.2::DOUBLE AND rel > 0.10::DOUBLE)"""
)
def det_area_filter(spark, sf):
    return det.tracking_filter(views.raw_boxes(spark, sf)).select(*_KEYS, *_BOX)


@query(
    """SELECT l_orderkey, l_linenumber, x1 - 96 AS roi_x1, y1 - 108 AS roi_y1, x2 - 96 AS roi_x2, y2 - 108 AS roi_y2
FROM fx_raw_boxes
WHERE (x1 + x2) / 2 >= 96 AND (x1 + x2) / 2 < 1824 AND (y1 + y2) / 2 >= 108 AND (y1 + y2) / 2 < 1058"""
)
def det_roi(spark, sf):
    boxes = det.in_roi(views.raw_boxes(spark, sf), (0.05, 0.10, 0.95, 0.98))
    return boxes.select("l_orderkey", "l_linenumber", "roi_x1", "roi_y1", "roi_x2", "roi_y2")


_CROP_SQL = """WITH u AS (
  SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM fx_raw_boxes WHERE x2 - x1 > 2 AND y2 - y1 > 2),
p AS (
  SELECT *, greatest(0, least(greatest(4, least(trunc(greatest(w, h) * 0.06::DOUBLE)::INTEGER, 80)),
                              trunc(least(w, h) * 0.08::DOUBLE)::INTEGER)) AS pad FROM u),
q AS (
  SELECT *, greatest(0, x1 - pad) AS p_x1, greatest(0, y1 - pad) AS p_y1,
         least(frame_w, x2 + pad) AS p_x2, least(frame_h, y2 + pad) AS p_y2 FROM p),
s AS (
  SELECT *, greatest(1, trunc((p_x2 - p_x1) * 0.75::DOUBLE)::BIGINT) AS iw,
         greatest(1, trunc((p_y2 - p_y1) * 0.75::DOUBLE)::BIGINT) AS ih FROM q WHERE p_x2 > p_x1 AND p_y2 > p_y1),
t AS (
  SELECT *, p_x1 + (p_x2 - p_x1) // 2 - iw // 2 AS a, p_y1 + (p_y2 - p_y1) // 2 - ih // 2 AS b FROM s),
crops AS (
  SELECT *, greatest(0, a) AS i_x1, greatest(0, b) AS i_y1, least(frame_w, a + iw) AS i_x2, least(frame_h, b + ih) AS i_y2
  FROM t)
"""


@query(
    _CROP_SQL
    + """SELECT l_orderkey, l_linenumber, pad, p_x1, p_y1, p_x2, p_y2, i_x1, i_y1, i_x2, i_y2
FROM crops WHERE i_x2 > i_x1 AND i_y2 > i_y1"""
)
def crop_rects(spark, sf):
    rects = det.crop_rects(views.raw_boxes(spark, sf))
    names = [f"{p}_{c}" for p in ("p", "i") for c in _BOX]
    return rects.select("l_orderkey", "l_linenumber", "pad", *names)


@query(
    """SELECT l_orderkey, l_linenumber, x2 - x1 AS w, y2 - y1 AS h FROM fx_raw_boxes
WHERE y2 > y1 AND (x2 - x1) / (y2 - y1) > 0.85::DOUBLE"""
)
def wide_boxes(spark, sf):
    boxes = views.raw_boxes(spark, sf).filter(geo.is_wide())
    return boxes.select("l_orderkey", "l_linenumber", geo.width().alias("w"), geo.height().alias("h"))


@query(
    """WITH m AS (
  SELECT *, x1 + greatest(1, (x2 - x1) // 2) AS mid FROM fx_raw_boxes
  WHERE y2 > y1 AND (x2 - x1) / (y2 - y1) > 0.85::DOUBLE)
SELECT l_orderkey, l_linenumber, 'L' AS side, x1 AS hx1, mid AS hx2 FROM m
UNION ALL SELECT l_orderkey, l_linenumber, 'R', mid, x2 FROM m"""
)
def split_rects(spark, sf):
    halves = det.split_rects(views.raw_boxes(spark, sf).filter(geo.is_wide()))
    return halves.select("l_orderkey", "l_linenumber", "side", "hx1", "hx2")


def _quality_sql(roi: bool) -> str:
    edge = "0"
    if roi:
        edge = (
            "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - least(abs(x1 / frame_w - 0.05::DOUBLE), "
            "abs(y1 / frame_h - 0.1::DOUBLE), abs(x2 / frame_w - 0.95::DOUBLE), abs(y2 / frame_h - 0.98::DOUBLE)) "
            "/ 0.05::DOUBLE))"
        )
    return f"""least(1.0::DOUBLE, greatest(0.0::DOUBLE,
    0.4::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (bw / bh - 1) / 0.5::DOUBLE))
    + 0.2::DOUBLE * least(1.0::DOUBLE, (bw * bh) / (frame_w * frame_h) / 0.15::DOUBLE)
    + 0.3::DOUBLE * (1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, conf))) + 0.1::DOUBLE * {edge}))"""


@query(
    f"""WITH r AS (
  SELECT *, greatest(1, x2 - x1)::DOUBLE AS bw, greatest(1, y2 - y1)::DOUBLE AS bh FROM fx_raw_boxes)
SELECT l_orderkey, l_linenumber, round({_quality_sql(False)}, 9) AS quality, round({_quality_sql(True)}, 9) AS quality_roi
FROM r"""
)
def bbox_quality(spark, sf):
    return views.raw_boxes(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        F.round(geo.mixed_score(), 9).alias("quality"),
        F.round(geo.mixed_score(roi=(0.05, 0.10, 0.95, 0.98)), 9).alias("quality_roi"),
    )


@query(
    """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY conf DESC, l_orderkey, l_linenumber) AS rank
  FROM fx_raw_boxes)
SELECT video_id, frame_idx, rank::INTEGER AS rank, l_orderkey, l_linenumber, conf FROM r WHERE rank <= 5"""
)
def det_topk_per_frame(spark, sf):
    boxes = views.raw_boxes(spark, sf).withColumn("tie", F.struct("l_orderkey", "l_linenumber"))
    top = det.top_per_frame(boxes, limit=5, tie="tie")
    return top.select("video_id", "frame_idx", "rank", "l_orderkey", "l_linenumber", "conf")


# Frame by frame the boxes in order of confidence, each against those kept so far.
@query(
    """WITH RECURSIVE b AS (SELECT *, l_orderkey * 10 + l_linenumber AS box_id FROM fx_raw_boxes WHERE conf >= 0.25),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY conf DESC, box_id) AS r FROM b WHERE x2 > x1 AND y2 > y1),
g AS (
  SELECT DISTINCT video_id, frame_idx, 0::BIGINT AS r, []::STRUCT(id BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[] AS kept FROM o
  UNION ALL
  SELECT g.video_id, g.frame_idx, o.r, CASE WHEN len(list_filter(g.kept, lambda k:
      greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1))
      > 0.55::DOUBLE * ((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1)
        - greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1))))) = 0
    THEN list_append(g.kept, {'id': o.box_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}) ELSE g.kept END
  FROM g JOIN o ON o.video_id = g.video_id AND o.frame_idx = g.frame_idx AND o.r = g.r + 1),
won AS (
  SELECT unnest(list_transform(kept, lambda k: k.id)) AS box_id FROM (
    SELECT kept FROM g QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY r DESC) = 1))
SELECT video_id, frame_idx, box_id, conf, x1, y1, x2, y2 FROM b WHERE x2 <= x1 OR y2 <= y1 OR box_id IN (SELECT box_id FROM won)"""
)
def det_nms(spark, sf):
    boxes = det.confident(views.raw_boxes(spark, sf)).withColumn(
        "box_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")
    )
    return det.suppress_overlaps(boxes, "box_id").select("video_id", "frame_idx", "box_id", "conf", *_BOX)


@query(
    """WITH a AS (
  SELECT video_id, frame_idx, det_idx, CASE WHEN obj_id % 2 = 0 THEN obj_id END AS track_id FROM fx_detections)
SELECT video_id, frame_idx, det_idx,
       CASE WHEN track_id IS NULL THEN printf('frame_%05d_det_%03d', frame_idx, det_idx)
            ELSE printf('frame_%05d_track_%d_det_%03d', frame_idx, track_id, det_idx) END AS crop_id FROM a"""
)
def crop_ids(spark, sf):
    boxes = views.detections(spark, sf)
    track = F.when(F.col("obj_id") % 2 == 0, F.col("obj_id"))
    crop = labels.crop_id(F.col("frame_idx"), F.col("det_idx"), track)
    return boxes.select("video_id", "frame_idx", "det_idx", crop.alias("crop_id"))


@query(
    """WITH i AS (
  SELECT d.video_id, d.frame_idx, d.det_idx, d.conf, CASE WHEN p.ean % 4 = 0 THEN 'UNKNOWN' ELSE p.ean::VARCHAR END AS ean,
         CASE WHEN p.ean % 3 = 0 THEN NULL ELSE p.descripcion END AS descripcion
  FROM fx_detections d JOIN fx_products p ON p.ean = d.obj_id),
t AS (
  SELECT *, trim(ean || ' ' || substring(coalesce(descripcion, ''), 1, 30)) AS one,
         trim(ean || ' ' || substring(coalesce(descripcion, ''), 1, 18)) AS half FROM i)
SELECT video_id, frame_idx, det_idx,
       CASE WHEN ean = 'UNKNOWN' THEN printf('UNKNOWN (%.2f)', conf) ELSE one END AS label,
       CASE WHEN ean = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'L:' || half || ' | R:UNKNOWN' END AS pair_label
FROM t"""
)
def sku_labels(spark, sf):
    named = views.products(spark, sf).selectExpr(
        "ean as obj_id",
        "if(ean % 4 = 0, 'UNKNOWN', cast(ean as string)) as ean",
        "if(ean % 3 = 0, null, descripcion) as descripcion",
    )
    boxes = views.detections(spark, sf).join(named, "obj_id")
    nothing = F.lit(None).cast("string")
    return boxes.select(
        "video_id",
        "frame_idx",
        "det_idx",
        labels.sku_label(F.col("ean"), F.col("descripcion"), F.col("conf")).alias("label"),
        labels.pair_label(F.col("ean"), F.col("descripcion"), F.lit("UNKNOWN"), nothing).alias("pair_label"),
    )


@query(
    """SELECT seq, content_type, CASE split_part(content_type, ';', 1)
  WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/jpg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'image/webp' THEN 'webp'
  WHEN 'image/gif' THEN 'gif' WHEN 'image/bmp' THEN 'bmp' WHEN 'image/tiff' THEN 'tiff' ELSE 'jpg' END AS ext
FROM fx_images"""
)
def image_ext(spark, sf):
    return views.images(spark, sf).select(
        "seq", "content_type", labels.media_extension(F.col("content_type")).alias("ext")
    )


@query(
    """SELECT k AS k, count(*)::BIGINT AS eventos, round(sum(value), 4)::DOUBLE AS total
FROM (SELECT (json_extract(props, '$.k'))::BIGINT AS k, value FROM events) GROUP BY 1"""
)
def json_props(spark, sf):
    from stockcount.sources.tables import table

    parsed = table(spark, sf, "events").select(F.from_json("props", "k long").alias("p"), "value")
    return parsed.groupBy(F.col("p.k").alias("k")).agg(
        F.count(F.lit(1)).alias("eventos"), decimals(F.sum("value"), 4).alias("total")
    )
