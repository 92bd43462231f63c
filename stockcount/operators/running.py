"""Product statistics kept up from deliveries of run items, instead of from the whole history.

The state has one row per product: number of detections, sums of units and confidences, largest and smallest number of
units and how often each occurs. Deliveries merge by adding; sums are integers or decimals, so their order doesn't matter.
A retraction subtracts. A product whose largest or smallest number loses its last occurrence has these two recomputed from
the history, which is read for such products only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockcount.functions.numbers import decimals
from stockcount.scale import compact, cut

#: Rows of a delivery that one task combines; nearly each may be a group of its own there.
TASK_ROWS = 500_000

_SUMS = ["veces", "unidades", "con_unidades", "confianza", "con_confianza"]


def partials(items: DataFrame) -> DataFrame:
    """The state of a delivery by itself: ean, veces, unidades, confianza, con_confianza, mayor, n_mayor, menor, n_menor."""
    slim = items.select("ean", "cantidad_dedup", "confianza_promedio")
    # Files may be few and dense: rows are dealt out evenly before they are combined, whatever products they are of.
    tasks = -(-items.count() // TASK_ROWS)
    if tasks > 1:
        slim = items.withColumn("_h", F.xxhash64(*items.columns)).select("_h", *slim.columns).repartition(tasks, "_h").drop("_h")
    per_size = slim.groupBy("ean", "cantidad_dedup").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("confianza_promedio").cast("decimal(18,6)")).alias("c"),
        F.count("confianza_promedio").alias("nc"),
    )
    known = F.struct(F.col("cantidad_dedup").alias("u"), F.col("n").alias("n"))
    known = F.when(F.col("cantidad_dedup").isNotNull(), known)
    zero = F.lit(0).cast("decimal(38,6)")
    return per_size.groupBy("ean").agg(
        F.sum("n").alias("veces"),
        F.coalesce(F.sum(F.col("cantidad_dedup").cast("long") * F.col("n")), F.lit(0)).alias("unidades"),
        F.coalesce(F.sum("c").cast("decimal(38,6)"), zero).alias("confianza"),
        F.sum("nc").alias("con_confianza"),
        F.max(known).alias("mayor"),
        F.min(known).alias("menor"),
        F.sum(F.when(F.col("cantidad_dedup").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("con_unidades"),
    ).select(
        "ean", *_SUMS,
        F.col("mayor.u").alias("mayor"), F.coalesce("mayor.n", F.lit(0)).alias("n_mayor"),
        F.col("menor.u").alias("menor"), F.coalesce("menor.n", F.lit(0)).alias("n_menor"),
    )


def merged(state: DataFrame, delivery: DataFrame) -> DataFrame:
    """The state with another one added."""
    both = state.unionByName(delivery)
    joined = both.join(both.groupBy("ean").agg(F.max("mayor").alias("_mayor"), F.min("menor").alias("_menor")), "ean")
    at = lambda side: F.coalesce(F.sum(F.when(F.col(side) == F.col(f"_{side}"), F.col(f"n_{side}"))), F.lit(0)).alias(f"n_{side}")
    types = dict(state.dtypes)
    return joined.groupBy("ean").agg(
        *[F.sum(c).cast(types[c]).alias(c) for c in _SUMS],
        F.max("_mayor").alias("mayor"), at("mayor"), F.min("_menor").alias("menor"), at("menor"),
    ).select(state.columns)


def retracted(state: DataFrame, withdrawn: DataFrame, remaining: DataFrame) -> DataFrame:
    """The state without the items of ``withdrawn``; ``remaining`` is the history after the retraction.

    Only products whose largest or smallest number may have changed are looked up in it; products without items go.
    """
    away = partials(withdrawn)
    names = {c: f"_{c}" for c in away.columns if c != "ean"}
    met = state.join(away.withColumnsRenamed(names), "ean", "left")
    types = dict(state.dtypes)
    less = lambda c: (F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))).cast(types[c]).alias(c)
    same = lambda s: F.when(F.col(s) == F.col(f"_{s}"), F.col(f"_n_{s}")).otherwise(F.lit(0))
    left = cut(met.select("ean", *[less(c) for c in _SUMS], *[c for s in ("mayor", "menor") for c in (F.col(s), (F.col(f"n_{s}") - same(s)).alias(f"n_{s}"))]).filter("veces > 0"))
    open_ = F.col("mayor").isNotNull() & ((F.col("n_mayor") <= 0) | (F.col("n_menor") <= 0))
    doubtful = compact(left.filter(open_).select("ean"))
    again = partials(remaining.join(doubtful, "ean", "left_semi")).select(state.columns)
    return left.join(doubtful, "ean", "left_anti").select(state.columns).unionByName(again)


def stats_of(state: DataFrame, eans: DataFrame) -> DataFrame:
    """What ``runs.sku_stats`` gives, from the state."""
    units = F.col("unidades").cast("double") / F.nullif(F.col("con_unidades"), F.lit(0))
    mean = F.col("confianza").cast("double") / F.nullif(F.col("con_confianza"), F.lit(0))
    rows = state.select(
        "ean", F.col("veces").alias("veces_detectado"), decimals(units, 1).alias("promedio_unidades"),
        F.col("mayor").alias("max_unidades"), F.col("menor").alias("min_unidades"), decimals(mean, 4).alias("confianza_media"),
    )
    return eans.select("ean").join(rows, "ean", "left").na.fill(0, ["veces_detectado"])
