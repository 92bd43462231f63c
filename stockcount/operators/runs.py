"""Run history: registration, detail, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockcount.functions.labels import UNKNOWN, VIDEO_SUFFIXES, suffix
from stockcount.functions.numbers import decimals
from stockcount.operators.inventory import inventory_by_frame, raw_counts, run_totals
from stockcount.scale import numbered


def _mean(col: str) -> Column:
    """Mean that does not depend on the order of summation: the sum is taken in decimals."""
    return F.sum(F.col(col).cast("decimal(18,6)")).cast("double") / F.count(col)


def list_videos(files: DataFrame) -> DataFrame:
    return files.filter(suffix(F.col("video_file")).isin(*VIDEO_SUFFIXES))


def latest(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("fecha"), F.desc("id")).limit(limit)


def latest_per_video(runs: DataFrame) -> DataFrame:
    return runs.groupBy("video_nombre").agg(F.max(F.struct("fecha", "id")).alias("u")).select(
        "video_nombre", F.col("u.id").alias("id"), F.col("u.fecha").alias("fecha")
    )


def history(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Runs with the number of their items and the units in them; runs without items stay."""
    per_run = items.groupBy(F.col("ejecucion_id").alias("id")).agg(
        F.count(F.lit(1)).alias("productos_distintos"), F.sum("cantidad_dedup").alias("total_unidades_dedup")
    )
    return runs.join(per_run, "id", "left").na.fill(0, ["productos_distintos"])


def sku_stats(eans: DataFrame, items: DataFrame) -> DataFrame:
    """Detection statistics per requested product; one never detected has count 0 and nulls."""
    stats = items.groupBy("ean").agg(
        F.count(F.lit(1)).alias("veces_detectado"),
        decimals(F.avg("cantidad_dedup"), 1).alias("promedio_unidades"),
        F.max("cantidad_dedup").alias("max_unidades"),
        F.min("cantidad_dedup").alias("min_unidades"),
        decimals(_mean("confianza_promedio"), 4).alias("confianza_media"),
    )
    return eans.select("ean").join(stats, "ean", "left").na.fill(0, ["veces_detectado"])


def detail(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items of runs with the description and packaging of their product."""
    info = products.select("ean", "descripcion", F.col("packaging_type_id").alias("packaging_type"))
    return items.join(info, "ean")


def run_detail(run_id: int, runs: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """One run with its items nested, largest quantity first."""
    rows = detail(items.filter(F.col("ejecucion_id") == run_id), products)
    entry = F.struct(
        (-F.col("cantidad_dedup")).alias("o"), "ean", "descripcion", "packaging_type", "cantidad_dedup",
        "cantidad_raw", "confianza_promedio", "tracking_id",
    )
    nested = rows.groupBy(F.col("ejecucion_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("d"))
    return (
        runs.filter(F.col("id") == run_id)
        .join(nested, "id", "left")
        .withColumn("detecciones", F.transform("d", lambda e: e.dropFields("o")))
        .drop("d")
    )


def register_runs(
    identified: DataFrame, frames: DataFrame, existing: DataFrame, fecha: Column, similarity: str = "conf"
) -> tuple[DataFrame, DataFrame]:
    """Run rows and item rows of newly processed videos.

    Ids continue after the largest existing one in order of the video. Items are the per-frame
    inventory without UNKNOWN, with raw counts and the mean similarity.
    """
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0]
    totals = run_totals(frames, identified)
    ids = numbered(totals.select("video_id"), [], F.floor(F.col("video_id") / F.lit(4096)), [F.col("video_id")], "n")
    ids = ids.select("video_id", (F.col("n") + F.lit(last)).cast("long").alias("ejecucion_id"))
    run_rows = totals.join(ids, "video_id").select(
        F.col("ejecucion_id").alias("id"), "video_id", fecha.alias("fecha"), "frames_procesados",
        "frames_con_producto", "total_detecciones", "skus_identificados",
    )
    known = identified.filter(F.col("ean") != UNKNOWN)
    means = known.groupBy("video_id", "ean").agg(_mean(similarity).alias("m"))
    item_rows = (
        inventory_by_frame(known)
        .join(raw_counts(known), ["video_id", "ean"])
        .join(means, ["video_id", "ean"])
        .join(ids, "video_id")
        .select(
            "ejecucion_id", "ean", F.col("cantidad").alias("cantidad_dedup"), "cantidad_raw",
            decimals("m", 4).alias("confianza_promedio"),
        )
    )
    return run_rows, item_rows


def metrics_trend(metrics: DataFrame, series: str, order: str, columns: list[str]) -> DataFrame:
    """Adds the change of each metric against the previous run of the same series."""
    w = Window.partitionBy(series).orderBy(order)
    return metrics.withColumns({f"delta_{c}": decimals(F.col(c) - F.lag(c).over(w), 4) for c in columns})
