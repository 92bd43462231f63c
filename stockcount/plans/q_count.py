"""Counting queries over identified boxes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockcount.operators import inventory, votes
from stockcount.plans.q_track import _DECISION_SQL
from stockcount.plans.registry import query
from stockcount.scale import shared_dir
from stockcount.sources import stores, views


def _identified(spark, sf):
    return views.detections(spark, sf).select("video_id", "frame_idx", "det_idx", F.col("sku_pred").alias("ean"))


_FRAME_SQL = """WITH per_frame AS (
  SELECT video_id, frame_idx, sku_pred AS ean, count(*)::BIGINT AS cantidad FROM fx_detections GROUP BY 1, 2, 3)
"""


@query(_FRAME_SQL + "SELECT * FROM per_frame")
def frame_counts(spark, sf):
    return inventory.frame_counts(_identified(spark, sf))


@query("SELECT video_id, sku_pred AS ean, count(*)::BIGINT AS cantidad_raw FROM fx_detections GROUP BY 1, 2")
def raw_counts(spark, sf):
    return inventory.raw_counts(_identified(spark, sf))


@query(_FRAME_SQL + "SELECT video_id, ean, max(cantidad) AS cantidad FROM per_frame GROUP BY 1, 2")
def inventory_by_frame(spark, sf):
    return inventory.inventory_by_frame(_identified(spark, sf))


@query(
    _DECISION_SQL
    + """, per_frame AS (
  SELECT video_id, frame_idx, sku_pred AS ean, count(*)::BIGINT AS n FROM fx_detections GROUP BY 1, 2, 3),
f AS (SELECT ean, sum(n)::BIGINT AS por_frame FROM (SELECT video_id, ean, max(n) AS n FROM per_frame GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT final_sku AS ean, count(*)::BIGINT AS por_track FROM decisions WHERE final_sku <> 'UNKNOWN' GROUP BY 1)
SELECT ean, coalesce(por_track, 0) AS por_track, coalesce(por_frame, 0) AS por_frame,
       coalesce(por_track, 0) - coalesce(por_frame, 0) AS diferencia
FROM t FULL JOIN f USING (ean)"""
)
def inventory_compare(spark, sf):
    by_track = inventory.inventory_by_track(votes.track_decisions(views.votes(spark, sf)))
    by_frame = (
        inventory.inventory_by_frame(_identified(spark, sf)).groupBy("ean").agg(F.sum("cantidad").alias("cantidad"))
    )
    return inventory.compare_inventories(by_track, by_frame)


@query(
    """SELECT f.video_id, f.n AS frames_procesados, coalesce(d.fp, 0) AS frames_con_producto,
       coalesce(d.n, 0) AS total_detecciones, coalesce(d.skus, 0) AS skus_identificados
FROM (SELECT video_id, count(*)::BIGINT AS n FROM fx_frames GROUP BY 1) f
LEFT JOIN (SELECT video_id, count(DISTINCT frame_idx)::BIGINT AS fp, count(*)::BIGINT AS n,
                  count(DISTINCT CASE WHEN sku_pred <> 'UNKNOWN' THEN sku_pred END)::BIGINT AS skus
           FROM fx_detections GROUP BY 1) d USING (video_id)"""
)
def run_totals(spark, sf):
    return inventory.run_totals(views.frames(spark, sf), _identified(spark, sf))


@query("SELECT sku_pred AS ean, max(n) AS cantidad, '2024-02-01' AS fecha FROM (SELECT video_id, frame_idx, sku_pred, count(*)::BIGINT AS n FROM fx_detections GROUP BY 1, 2, 3) GROUP BY 1")
def inventory_report(spark, sf):
    """The report of all videos, the most seen in one frame, written with a header and read back."""
    units = inventory.inventory_by_frame(_identified(spark, sf)).groupBy("ean").agg(F.max("cantidad").alias("cantidad"))
    place = f"{shared_dir(spark)}/inventory-{uuid.uuid4().hex}"
    stores.write_inventory(units, place, "2024-02-01")
    return stores.read_inventory(spark, place)
