"""Persistent tables: embedding catalogue, review log, metrics history, inventories and track files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockcount.scale import compact, cut

REVIEW_SCHEMA = """
crop_id string, id string, timestamp string, execution_id string,
detection struct<yolo_conf: double, bbox: array<int>>,
packaging struct<predicted: string>,
sku_identification struct<
  decision: string, confianza: double,
  top_matches: array<struct<ean: string, similitud: double, descripcion: string>>,
  top1: struct<ean: string, similitud: double, descripcion: string>,
  top2: struct<ean: string, similitud: double, descripcion: string>,
  top3: struct<ean: string, similitud: double, descripcion: string>>,
decision string, predicted_ean string, frame_path string, frame_idx long, crop_path string,
paths struct<crop: string, frame: string>,
review struct<
  action: string, status: string, assigned_ean: string, reviewed_at: string, reviewer: string, notes: string>
"""

METRICS_SCHEMA = "timestamp string, execution_id string, video_name string, metrics map<string, double>"


def write_refs(refs: DataFrame, path: str, replace_all: bool = True) -> None:
    """Embedding catalogue partitioned by category, so that a category search prunes directories.

    With ``replace_all`` the whole catalogue is replaced, otherwise only the products in ``refs``.
    """
    if replace_all:
        _write_categories(refs, path, "static")
    else:
        update_refs(refs, path)


def _write_categories(refs: DataFrame, path: str, mode: str) -> None:
    refs.write.partitionBy("categoria").mode("overwrite").option("partitionOverwriteMode", mode).parquet(path)


def update_refs(fresh: DataFrame, path: str) -> None:
    """Replaces the references of the products in ``fresh`` and keeps those of all others.

    Only the categories that hold or receive such a product are written again. What stays of them is
    checkpointed first, because the same folders are overwritten; a category that loses its last product
    keeps a row without product, which reading leaves out.
    """
    spark = fresh.sparkSession
    fresh = cut(fresh)
    stored = spark.read.parquet(path)
    codes = compact(fresh.select("ean").distinct())
    held = stored.join(codes, "ean", "left_semi").select("categoria")
    touched = compact(cut(held.unionByName(fresh.select("categoria")).distinct()))
    stays = stored.join(touched, stored["categoria"].eqNullSafe(touched["categoria"]), "left_semi").join(codes, "ean", "left_anti")
    rows = cut(stays.filter("ean is not null").select(*fresh.columns).unionByName(fresh))
    used = rows.select("categoria").distinct()
    emptied = touched.join(used, touched["categoria"].eqNullSafe(used["categoria"]), "left_anti")
    blank = emptied.select(*[F.col(c) if c == "categoria" else F.lit(None).cast(t).alias(c) for c, t in fresh.dtypes])
    _write_categories(rows.unionByName(blank), path, "dynamic")


def read_refs(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    refs = spark.read.parquet(path).filter("ean is not null")
    return refs if categories is None else refs.filter(F.col("categoria").isin(categories))


def refs_index(refs: DataFrame) -> DataFrame:
    """Per product: category and number of embeddings."""
    return refs.groupBy("ean", "categoria").agg(F.count(F.lit(1)).alias("n_embeddings"))


def parse_review_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Review records from JSON lines; blank and corrupt lines are dropped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    record = F.from_json(col, REVIEW_SCHEMA + ", _corrupt string", options)
    return (
        lines.filter(F.trim(col) != "")
        .withColumn("record", record)
        .filter(F.col("record").isNotNull() & F.col("record._corrupt").isNull())
        .withColumn("record", F.col("record").dropFields("_corrupt"))
    )


def read_review_log(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """Review records from a folder of JSON lines."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    return parse_review_lines(lines).select("record.*")


def append_review_log(records: DataFrame, path: str) -> None:
    """Appends records, one folder per run."""
    records.withColumn("run", F.col("execution_id")).write.mode("append").partitionBy("run").json(path)


def append_metrics(metrics: DataFrame, history: str, per_run: str | None = None) -> None:
    """Appends to the global history and, if asked, to a folder per run."""
    metrics.write.mode("append").json(history)
    if per_run is not None:
        metrics.withColumn("run", F.col("execution_id")).write.mode("append").partitionBy("run").json(per_run)


def read_metrics(spark: SparkSession, history: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(history)


def write_inventory(inventory: DataFrame, path: str, fecha: str) -> None:
    """Inventory report: EAN, Cantidad, Fecha with a header."""
    inventory.select(F.col("ean").alias("EAN"), F.col("cantidad").alias("Cantidad"), F.lit(fecha).alias("Fecha")).write.mode(
        "overwrite"
    ).csv(path, header=True)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema("EAN string, Cantidad long, Fecha string")
        .csv(path, header=True)
        .select(F.col("EAN").alias("ean"), F.col("Cantidad").alias("cantidad"), F.col("Fecha").alias("fecha"))
    )


def append_track_debug(debug: DataFrame, path: str) -> None:
    """Per-box track rows as CSV, one folder per video."""
    debug.write.mode("append").partitionBy("video_id").csv(path, header=True)


def write_track_summary(documents: DataFrame, path: str) -> None:
    """Nested track documents, one JSON object per track."""
    documents.write.mode("overwrite").json(path)
