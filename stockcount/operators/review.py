"""Review records: flattening, edits, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockcount.functions.labels import UNKNOWN

# Review states and the code of a crop that is not a product.
PENDING, LABELED, SKIPPED, DISCARDED = "pending", "labeled", "skipped", "discarded"
NOT_A_PRODUCT = "DESCARTED"


def canonical_status(status: Column, assigned: Column) -> Column:
    """One vocabulary for both review tools: ``reviewed`` is labeled, or discarded for a non-product."""
    reviewed = status == "reviewed"
    return (
        F.when(reviewed & (assigned == NOT_A_PRODUCT), F.lit(DISCARDED))
        .when(reviewed, F.lit(LABELED))
        .otherwise(F.coalesce(status, F.lit(PENDING)))
    )


def review_items(records: DataFrame, existing_crops: DataFrame | None = None) -> DataFrame:
    """Flat review list with the fallbacks for missing identifiers, predictions and crop paths.

    ``records`` needs a position column ``idx``. With ``existing_crops`` (column crop_path) a recorded
    path that is not among them is replaced by the default one.
    """
    def filled(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    crop_id = F.coalesce(filled("crop_id"), filled("id"), F.concat(F.lit("item_"), F.col("idx").cast("string")))
    decision = F.coalesce(filled("decision"), F.lit("unknown"))
    state = F.coalesce(F.col("review.status"), F.lit(PENDING))
    sku = F.col("sku_identification")
    numbered = F.filter(F.array(sku["top1"], sku["top2"], sku["top3"]), lambda m: m.isNotNull())
    folder = F.when(decision == "unknown", "unknown").otherwise("ambiguous")
    flat = records.select(
        "idx",
        crop_id.alias("crop_id"),
        F.when(state.isin(LABELED, SKIPPED), state).otherwise(decision).alias("status"),
        F.coalesce(F.nullif(sku["top1"]["ean"], F.lit("")), filled("predicted_ean"), F.lit(UNKNOWN)).alias("predicted_ean"),
        F.coalesce(sku["top_matches"], numbered, F.array().cast(records.schema["sku_identification"].dataType["top_matches"].dataType)).alias("top_matches"),
        F.coalesce(F.col("paths.crop"), F.col("crop_path")).alias("_path"),
        F.concat_ws("/", F.lit("learning"), folder, F.concat(crop_id, F.lit(".jpg"))).alias("_default"),
    )
    if existing_crops is not None:
        found = existing_crops.select(F.col("crop_path").alias("_path"), F.lit(True).alias("_found")).distinct()
        flat = flat.join(found, "_path", "left").withColumn("_path", F.when(F.col("_found"), F.col("_path")))
    return flat.withColumn("crop_path", F.coalesce("_path", "_default")).select(
        "idx", "crop_id", "status", "predicted_ean", "top_matches", "crop_path"
    )


def apply_actions(records: DataFrame, actions: DataFrame) -> DataFrame:
    """Review state after the actions; the latest action of a crop decides.

    ``records`` has crop_id, status, assigned_ean; ``actions`` has crop_id, at, action (set_ean, skip,
    discard) and ean. The prediction in ``decision`` is kept next to the review state.
    """
    last = actions.groupBy("crop_id").agg(F.max_by(F.struct("action", "ean", "at"), "at").alias("a"))
    action = F.col("a.action")
    status = (
        F.when(action == "set_ean", LABELED).when(action == "skip", SKIPPED).when(action == "discard", DISCARDED)
    )
    ean = F.when(action == "set_ean", F.col("a.ean")).when(action == "discard", F.lit(NOT_A_PRODUCT))
    return (
        records.join(last, "crop_id", "left")
        .withColumn("reviewed_at", F.col("a.at"))
        .withColumn("assigned_ean", F.when(action.isin("set_ean", "discard"), ean).otherwise(F.col("assigned_ean")))
        .withColumn("status", F.coalesce(status, F.col("status")))
        .drop("a")
    )


def pending(records: DataFrame, decision: str | None = None) -> DataFrame:
    rows = records.filter(F.col("status") == PENDING)
    return rows if decision is None else rows.filter(F.col("decision") == decision)


def progress(records: DataFrame) -> DataFrame:
    """Total, labeled, skipped and pending per run; what is neither labeled nor skipped is pending."""
    return records.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == LABELED).alias("labeled"),
        F.count_if(F.col("status") == SKIPPED).alias("skipped"),
        F.count_if(~F.col("status").isin(LABELED, SKIPPED)).alias("pending"),
    )


def run_summary(records: DataFrame) -> DataFrame:
    """Doubtful crops per run, by kind, with their shares."""
    total = F.count(F.lit(1))
    unknown = F.count_if(F.col("decision") == "unknown")
    ambiguous = F.count_if(F.col("decision") == "ambiguous")
    return records.groupBy("run_id").agg(
        total.alias("total_crops_saved"), unknown.alias("unknown_count"), ambiguous.alias("ambiguous_count")
    )


def next_pending(records: DataFrame, positions: DataFrame) -> DataFrame:
    """Per run the first open item after the current position, wrapping to the start."""
    open_items = records.filter(~F.col("status").isin(LABELED, SKIPPED))
    key = F.struct((F.col("idx") <= F.col("actual")).alias("wrapped"), "idx")
    return (
        open_items.join(positions.select("run_id", "actual"), "run_id")
        .groupBy("run_id")
        .agg(F.min(key).alias("k"))
        .select("run_id", F.col("k.idx").alias("siguiente"), F.col("k.wrapped").alias("desde_inicio"))
    )


def mark_reviewed(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Review queue with the given ids marked."""
    marks = done.select("id", F.lit(True).alias("_done")).distinct()
    return (
        queue.join(marks, "id", "left")
        .withColumn("revisado", F.col("revisado") | F.col("_done").isNotNull())
        .drop("_done")
    )


def latest_pending(queue: DataFrame, limit: int = 50) -> DataFrame:
    return queue.filter(~F.col("revisado")).orderBy(F.desc("fecha_creacion"), F.desc("id")).limit(limit)
