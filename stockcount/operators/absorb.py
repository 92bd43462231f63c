"""Absorbing reviewed crops into the catalogue of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockcount.functions import vectors as vec
from stockcount.operators.greedy import greedy_keep
from stockcount.operators.knn import nearest_own_reference
from stockcount.operators.review import LABELED, NOT_A_PRODUCT
from stockcount.scale import compact, cut, numbered

# Similarity from which a crop counts as a copy.
DUPLICATE_SIM = 0.95

# Products with their descriptions that are broadcast.
INFO_ROWS = 100_000

COPIED, INVALID, MISSING, DUPLICATE = "copiado", "ean_invalido", "crop_faltante", "duplicado"


def candidates(records: DataFrame, only: str | None = None) -> DataFrame:
    """Labelled crops with a usable product code."""
    ean = F.col("assigned_ean").cast("string")
    rows = records.filter(F.col("status").isin("reviewed", LABELED) & ean.isNotNull() & ~ean.isin("", NOT_A_PRODUCT))
    return rows if only is None else rows.filter(ean == only)


def _of_products(table: DataFrame, crops: DataFrame) -> DataFrame:
    """The rows of ``table`` whose product one of the crops has.

    A product table grows with the catalogue, and Spark may broadcast it whole on the size of its files; codes of crops are narrow.
    """
    return table.join(compact(cut(crops.select("ean").distinct())), "ean", "left_semi")


def known_codes(crops: DataFrame, valid: DataFrame | None) -> DataFrame:
    """Crops whose code is valid; without a list of valid codes every code is."""
    return crops if valid is None else crops.join(valid.select("ean").distinct(), "ean", "left_semi")


def near_existing(crops: DataFrame, refs: DataFrame, threshold: float = DUPLICATE_SIM) -> DataFrame:
    """Crops with their similarity to the product's references (-1 without any) and the verdict."""
    sims = nearest_own_reference(crops, refs)
    joined = crops.join(sims, "crop_id", "left").withColumn("max_sim", F.coalesce("max_sim", F.lit(-1.0)))
    return joined.withColumn("duplicado", F.col("max_sim") >= threshold)


def dedup_greedy(crops: DataFrame, refs: DataFrame, threshold: float = DUPLICATE_SIM, prefix: int = 512) -> DataFrame:
    """Ids of the accepted crops: unlike every reference and every crop accepted earlier.

    ``crops`` has crop_id, ean, embedding and ``seq``, the order in which crops are offered.
    """
    fresh = near_existing(crops, refs, threshold).filter(~F.col("duplicado"))
    items = fresh.select(
        F.col("ean").alias("scope"),
        F.col("crop_id").alias("key"),
        F.lit(0.0).alias("o1"),
        F.col("seq").cast("long").alias("o2"),
        F.col("embedding").alias("vec"),
    )
    solid = vec.norm(F.col("vec")) >= vec.NORM_FLOOR
    return greedy_keep(items, threshold, comparable=solid, prefix=prefix).select(F.col("key").alias("crop_id"))


def outcomes(
    crops: DataFrame,
    refs: DataFrame,
    valid: DataFrame | None = None,
    threshold: float = DUPLICATE_SIM,
    dry_run: bool = False,
    dedup: bool = True,
) -> DataFrame:
    """What happens to each labelled crop: copied, invalid code, missing file or duplicate.

    ``crops`` has crop_id, ean, seq, existe and embedding. A dry run neither validates codes nor
    removes duplicates. A crop whose embedding failed is copied.
    """
    rows = crops
    if valid is None or dry_run:
        rows = rows.withColumn("valido", F.lit(True))
    else:
        codes = _of_products(valid.select("ean"), crops).distinct().withColumn("valido", F.lit(True))
        rows = rows.join(compact(cut(codes)), "ean", "left").withColumn("valido", F.coalesce("valido", F.lit(False)))
    if dry_run or not dedup:
        kept = None
    else:
        usable = rows.filter(F.col("valido") & F.col("existe") & F.col("embedding").isNotNull())
        kept = dedup_greedy(usable, refs, threshold).withColumn("aceptado", F.lit(True))
    base = rows.select("crop_id", "ean", "seq", "valido", "existe", F.col("embedding").isNull().alias("sin_vector"))
    if kept is None:
        base = base.withColumn("aceptado", F.lit(True))
    else:
        base = base.join(kept, "crop_id", "left")
    outcome = (
        F.when(~F.col("valido"), INVALID)
        .when(~F.col("existe"), MISSING)
        .when(F.col("sin_vector") | F.col("aceptado"), COPIED)
        .otherwise(DUPLICATE)
    )
    return base.select("crop_id", "ean", "seq", outcome.alias("resultado"))


def summary(result: DataFrame) -> DataFrame:
    """Counters of one absorb run; invalid codes and missing files are both errors."""
    r = F.col("resultado")
    return result.agg(
        F.count_if(r == COPIED).alias("copiados"),
        F.count_if(r.isin(INVALID, MISSING)).alias("errores"),
        F.count_if(r == DUPLICATE).alias("dedup_skipped"),
        F.count_if(r == INVALID).alias("invalid_ean"),
    )


def target_names(crops: DataFrame, extension: str = ".jpg") -> DataFrame:
    """Collision-free file names per product, in order of ``seq``.

    Underscores become dashes. A name that is taken gets ``_abs1``, the next one a further ``_abs2``
    on top of it, and so on.
    """
    based = crops.withColumn("base", F.replace(F.col("crop_id"), F.lit("_"), F.lit("-")))
    ranked = numbered(based, ["ean", "base"], F.floor(F.col("seq") / F.lit(100_000)), [F.col("seq")], "n")
    steps = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda j: F.concat(F.lit("_abs"), j.cast("string")))
    tail = F.when(F.col("n") > 1, F.array_join(steps, "")).otherwise(F.lit(""))
    return ranked.withColumn("destino", F.concat("base", tail, F.lit(extension))).drop("base", "n")


def apply(
    crops: DataFrame, refs: DataFrame, products: DataFrame, valid: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """References after absorbing, and the outcome per crop.

    Category and description of affected products come from the product table, so that they stay
    reachable by category search. ``products`` has ean, categoria, descripcion.
    """
    result = cut(outcomes(crops, refs, valid, **options))
    copied = result.filter(F.col("resultado") == COPIED)
    info = compact(cut(_of_products(products.select("ean", "categoria", "descripcion"), copied)), INFO_ROWS)
    added = (
        crops.filter(F.col("embedding").isNotNull())
        .join(copied.select("crop_id"), "crop_id", "left_semi")
        .select("ean", F.concat(F.lit("crop-"), F.col("crop_id").cast("string")).alias("ref_id"), "embedding")
        .join(info, "ean", "left")
    )
    old = refs.withColumn("ref_id", F.col("ref_id").cast("string")).drop("descripcion")
    renewed = (
        old.join(info.withColumnRenamed("categoria", "_categoria"), "ean", "left")
        .withColumn("categoria", F.coalesce("_categoria", "categoria"))
        .select("ean", "ref_id", "embedding", "categoria", "descripcion")
    )
    return renewed.unionByName(added), result
