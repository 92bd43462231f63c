"""Frame sampling and video quality from per-frame metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockcount.functions.numbers import decimals
from stockcount.scale import numbered

# Fallback frame rate, smallest sampling rate, and the quality limits.
FALLBACK_FPS = 30.0
MIN_RATE = 0.0001
DARK, BRIGHT = 100.0, 200.0
LOW_CONTRAST = 30.0
BLURRED = 100.0


def sampling_step(rate: float, mode: str = "round") -> Column:
    """Distance between sampled frames: ``round`` is half-even, ``floor`` truncates."""
    fps = F.col("fps").cast("double")
    if mode == "floor":
        exact = F.when((fps <= 0) | F.lit(rate <= 0), F.lit(1.0)).otherwise(fps / F.lit(rate if rate > 0 else 1.0))
        return F.greatest(F.lit(1), F.floor(exact).cast("int"))
    usable = F.when(F.coalesce(fps, F.lit(0.0)) <= 0, F.lit(FALLBACK_FPS)).otherwise(fps)
    return F.greatest(F.lit(1), F.rint(usable / F.lit(max(MIN_RATE, rate))).cast("int"))


def sample_frames(frames: DataFrame, rate: float = 1.0) -> DataFrame:
    """Every step-th frame, renumbered from 0, with its time in seconds."""
    fps = F.when(F.coalesce("fps", F.lit(0.0)) <= 0, F.lit(FALLBACK_FPS)).otherwise(F.col("fps"))
    stepped = frames.withColumn("step", sampling_step(rate)).filter(F.col("frame_idx") % F.col("step") == 0)
    return stepped.withColumn("out_idx", F.expr("frame_idx div step")).withColumn("t_sec", F.col("frame_idx") / fps)


def export_list(frames: DataFrame, rate: float = 1.0, min_sharpness: float | None = BLURRED, extension: str = "jpg") -> DataFrame:
    """Frames to export and their file names; the number counts kept frames only."""
    kept = frames.withColumn("step", sampling_step(rate, "floor")).filter(F.col("idx") % F.col("step") == 0)
    if min_sharpness is not None:
        kept = kept.filter(F.col("sharpness") >= min_sharpness)
    ranked = numbered(kept, ["video_id"], F.floor(F.col("idx") / F.lit(65_536)), [F.col("idx")], "n")
    t = F.when(F.col("fps") > 0, F.col("idx") / F.col("fps")).otherwise(F.lit(0.0))
    name = F.format_string(f"frame_%04d_t%.2fs.{extension}", F.col("n") - 1, decimals(t, 2))
    return ranked.withColumn("archivo", name).drop("n")


def video_quality(frames: DataFrame) -> DataFrame:
    """Mean brightness, contrast and sharpness over five positions of each video, with verdicts.

    Positions are the first, the three quarters and the last frame; in a short video the same frame
    counts as often as it is named.
    """
    n = F.col("n")
    places = F.array(F.lit(0).cast("long"), F.expr("n div 4"), F.expr("n div 2"), F.expr("3 * n div 4"), n - 1)
    wanted = (
        frames.groupBy("video_id")
        .agg((F.max("idx") + 1).alias("n"))
        .select("video_id", F.explode(places).alias("idx"))
    )
    means = (
        wanted.join(frames, ["video_id", "idx"])
        .groupBy("video_id")
        .agg(
            F.avg("brightness").alias("brillo"),
            F.avg("contrast").alias("contraste"),
            F.avg("sharpness").alias("nitidez"),
            F.max("width").alias("width"),
            F.max("height").alias("height"),
        )
    )
    return means.select(
        "video_id",
        "brillo",
        "contraste",
        "nitidez",
        F.when(F.col("brillo") < DARK, "bajo").when(F.col("brillo") > BRIGHT, "alto").otherwise("adecuado").alias("luz"),
        (F.col("contraste") < LOW_CONTRAST).alias("contraste_bajo"),
        (F.col("nitidez") < BLURRED).alias("borroso"),
        F.when(F.col("height") > F.col("width"), "vertical").otherwise("horizontal").alias("orientacion"),
    )
