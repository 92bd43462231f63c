"""Counting: per frame, per run and per track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockcount.functions.labels import UNKNOWN


def frame_counts(identified: DataFrame) -> DataFrame:
    """Boxes per video, frame and product; UNKNOWN is a product like any other here."""
    return identified.groupBy("video_id", "frame_idx", "ean").agg(F.count(F.lit(1)).alias("cantidad"))


def raw_counts(identified: DataFrame) -> DataFrame:
    return identified.groupBy("video_id", "ean").agg(F.count(F.lit(1)).alias("cantidad_raw"))


def inventory_by_frame(identified: DataFrame) -> DataFrame:
    """Largest number of boxes of a product seen in one frame of a video."""
    return frame_counts(identified).groupBy("video_id", "ean").agg(F.max("cantidad").alias("cantidad"))


def inventory_by_track(decisions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One unit per decided track, UNKNOWN excluded."""
    return (
        decisions.filter(F.col("final_sku") != UNKNOWN)
        .groupBy(*keys, F.col("final_sku").alias("ean"))
        .agg(F.count(F.lit(1)).alias("cantidad"))
    )


def compare_inventories(by_track: DataFrame, by_frame: DataFrame, keys: tuple[str, ...] = ("ean",)) -> DataFrame:
    """Both counts side by side; a product missing on one side counts 0 there."""
    t = by_track.select(*keys, F.col("cantidad").alias("por_track"))
    f = by_frame.select(*keys, F.col("cantidad").alias("por_frame"))
    zero = F.lit(0).cast("long")
    return t.join(f, list(keys), "full_outer").select(
        *keys,
        F.coalesce("por_track", zero).alias("por_track"),
        F.coalesce("por_frame", zero).alias("por_frame"),
        (F.coalesce("por_track", zero) - F.coalesce("por_frame", zero)).alias("diferencia"),
    )


def run_totals(frames: DataFrame, identified: DataFrame) -> DataFrame:
    """Per video: frames, frames with a product, boxes and distinct known products."""
    boxes = identified.groupBy("video_id").agg(
        F.count_distinct("frame_idx").alias("frames_con_producto"),
        F.count(F.lit(1)).alias("total_detecciones"),
        F.count_distinct(F.when(F.col("ean") != UNKNOWN, F.col("ean"))).alias("skus_identificados"),
    )
    totals = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames_procesados"))
    return totals.join(boxes, "video_id", "left").na.fill(
        0, ["frames_con_producto", "total_detecciones", "skus_identificados"]
    )


def name_products(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Adds the product description, empty when the code is not in the catalogue."""
    names = products.select("ean", F.col("descripcion").alias("nombre"))
    return inventory.join(names, "ean", "left").withColumn("nombre", F.coalesce("nombre", F.lit("")))
