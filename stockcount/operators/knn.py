"""Reference catalogue of embeddings: search, centroids, classification and upkeep."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockcount.functions import vectors as vec
from stockcount.operators.blockmatch import WHOLE, best_labels, best_score, block_hits
from stockcount.scale import compact

# Below this similarity a crop has no packaging category.
MIN_CATEGORY_SIM = 0.15
NO_CATEGORY = "otro"

# Category tables up to this number of rows travel to the tasks.
FEW_CATEGORIES = 4096


def usable(df: DataFrame, dimension: int | None, col: str = "embedding") -> DataFrame:
    """Rows with a vector of the expected size; size mismatches find nothing."""
    return df.filter(F.col(col).isNotNull()) if dimension is None else df.filter(F.size(col) == dimension)


def common_size(refs: DataFrame) -> int | None:
    """The vector size that most references have; the smaller one of equals. A small aggregation."""
    sizes = refs.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count()
    found = sizes.orderBy(F.desc("count"), "d").first()
    return found["d"] if found else None


def mean_vectors(refs: DataFrame, key: str) -> DataFrame:
    """Mean of the normalised vectors per key, combined on the map side."""
    unit = array_to_vector(vec.normalize(F.col("embedding")))
    return refs.groupBy(key).agg(Summarizer.mean(unit).alias("m")).select(key, vector_to_array("m").alias("mean"))


def centroids(refs: DataFrame, key: str = "ean") -> DataFrame:
    """Renormalised mean of the normalised reference vectors."""
    return mean_vectors(refs, key).select(key, vec.normalize(F.col("mean")).alias("centroid"))


def search(queries: DataFrame, refs: DataFrame, k: int = 3, dimension: int | None = None, **kw) -> DataFrame:
    """The ``k`` products most similar to each crop over the whole catalogue.

    Vectors of another size than ``dimension`` (the common one of the references if not given) match nothing.
    """
    dimension = dimension or common_size(refs)
    refs = usable(refs, dimension)
    q = usable(queries, dimension).select(F.lit(WHOLE).alias("scope"), F.col("crop_id").alias("key"), F.col("embedding").alias("vec"))
    r = refs.select(F.lit(WHOLE).alias("scope"), F.col("ean").alias("label"), F.col("embedding").alias("vec"))
    return _named(best_labels(q, r, k, **kw))


def _named(hits: DataFrame) -> DataFrame:
    tag = ["tag"] if "tag" in hits.columns else []
    return hits.select(
        F.col("key").alias("crop_id"), "rank", F.col("label").alias("ean"), F.col("sim").alias("similitud"), *tag
    )


def search_in_category(
    queries: DataFrame, refs: DataFrame, k: int = 3, dimension: int | None = None, **kw
) -> DataFrame:
    """Search restricted to the crop's ``categoria``; the whole catalogue when that category is empty.

    The catalogue is offered once under each category and once as a whole, so that restricted and
    fallback crops go through one join on the scope. Crops with a column ``tag`` keep it and appear
    with a null product when nothing is found.
    """
    dimension = dimension or common_size(refs)
    refs = usable(refs, dimension)
    category = F.lower("categoria")
    known = refs.select(category.alias("known")).filter("known <> ''").distinct()
    # The crops carry their vectors: keep them in place as long as the categories are few.
    known = compact(known, FEW_CATEGORIES)
    tag = ["tag"] if "tag" in queries.columns else []
    q = queries if tag else usable(queries, dimension)
    good = F.col("embedding") if dimension is None else F.when(F.size("embedding") == dimension, F.col("embedding"))
    q = q.join(known, F.lower(q["categoria"]) == known["known"], "left").select(
        F.coalesce("known", F.lit(WHOLE)).alias("scope"), F.col("crop_id").alias("key"), good.alias("vec"), *tag
    )
    r = refs.select(
        F.explode(F.array(F.coalesce(category, F.lit("")), F.lit(WHOLE))).alias("scope"),
        F.col("ean").alias("label"),
        F.col("embedding").alias("vec"),
    )
    return _named(best_labels(q, r, k, **kw))


def search_detailed(queries: DataFrame, refs: DataFrame, k: int = 3, dimension: int | None = None) -> DataFrame:
    """Best ``k`` products by centroid, with the maximum and mean similarity to their references.

    Vectors of another size than ``dimension`` (the common one if not given) match nothing.
    """
    dimension = dimension or common_size(refs)
    queries, refs = usable(queries, dimension), usable(refs, dimension)
    means = mean_vectors(refs, "ean")
    by_center = means.select(
        F.lit(WHOLE).alias("scope"), F.col("ean").alias("label"), vec.normalize(F.col("mean")).alias("vec")
    )
    q = queries.select(F.lit(WHOLE).alias("scope"), F.col("crop_id").alias("key"), F.col("embedding").alias("vec"))
    top = best_labels(q, by_center, k).select(
        F.col("key").alias("crop_id"), F.col("label").alias("ean"), "rank", F.col("sim").alias("similitud_centroide")
    )
    pairs = top.join(queries, "crop_id")
    # The mean of dot products is the dot product with the mean.
    scored = pairs.join(means, "ean").withColumn(
        "similitud_mean", vec.dot(vec.normalize(F.col("embedding")), F.col("mean"))
    )
    within = block_hits(
        pairs.select(F.col("ean").alias("scope"), F.col("crop_id").alias("key"), F.col("embedding").alias("vec")),
        refs.select(F.col("ean").alias("scope"), F.col("ean").alias("label"), F.col("embedding").alias("vec")),
        1,
    )
    best = within.groupBy(F.col("key").alias("crop_id"), F.col("label").alias("ean")).agg(
        F.max("sim").alias("similitud_max")
    )
    return scored.join(best, ["crop_id", "ean"]).select(
        "crop_id", "rank", "ean", "similitud_centroide", "similitud_max", "similitud_mean"
    )


def classify_packaging(
    queries: DataFrame, prompts: DataFrame, k: int = 1, min_sim: float = MIN_CATEGORY_SIM, dimension: int | None = None
) -> DataFrame:
    """Packaging category per crop from per-category prompt centroids.

    Columns crop_id, rank, categoria, similitud, detectada; ``detectada`` is ``otro`` below the
    minimum. A zero vector gets the first category with similarity 0, a vector of another size than the
    prompts' none at all.
    """
    dimension = dimension or common_size(prompts)
    queries, prompts = usable(queries, dimension), usable(prompts, dimension)
    q = queries.select(F.lit(WHOLE).alias("scope"), F.col("crop_id").alias("key"), F.col("embedding").alias("vec"))
    r = centroids(prompts, "categoria").select(
        F.lit(WHOLE).alias("scope"), F.col("categoria").alias("label"), F.col("centroid").alias("vec")
    )
    found = best_labels(q, r, k).select(
        F.col("key").alias("crop_id"), "rank", F.col("label").alias("categoria"), F.col("sim").alias("similitud")
    )
    zero = queries.filter(vec.norm(F.col("embedding")) < vec.NORM_FLOOR).select("crop_id", F.lit(1).alias("one"))
    first = prompts.agg(F.min("categoria").alias("categoria"), F.lit(1).alias("one"))
    blank = zero.join(first, "one").select("crop_id", F.lit(1).alias("rank"), "categoria", F.lit(0.0).alias("similitud"))
    named = F.when(F.col("similitud") < min_sim, F.lit(NO_CATEGORY)).otherwise(F.col("categoria"))
    return found.unionByName(blank).withColumn("detectada", named)


def tag_packaging(crops: DataFrame, prompts: DataFrame, skip: Column | None = None, min_sim: float = MIN_CATEGORY_SIM) -> DataFrame:
    """Adds ``detectada`` to each crop row in place; ``skip`` marks rows that need none.

    The category centroids are few: after a check of their number they travel to the tasks and each
    row is classified where it lies, without moving vectors. With more of them the crops are matched
    like against any other catalogue. On both ways a vector of another size than the prompts' gets null.
    """
    size = common_size(prompts)
    prompts = usable(prompts, size)
    few = centroids(prompts, "categoria").limit(FEW_CATEGORIES + 1)
    rows = few.collect()
    wanted = F.col("embedding") if skip is None else F.when(~skip, F.col("embedding"))
    if not rows:
        return crops.withColumn("detectada", F.lit(NO_CATEGORY))
    if len(rows) > FEW_CATEGORIES:
        open_crops = crops.select("crop_id", wanted.alias("embedding")).filter(F.col("embedding").isNotNull())
        found = classify_packaging(open_crops, prompts, 1, min_sim, size).select("crop_id", "detectada")
        return crops.join(found, "crop_id", "left")
    return crops.withColumn("detectada", _classifier(rows, crops, min_sim)(wanted))


def _classifier(rows: list, crops: DataFrame, min_sim: float):
    rows = sorted(rows, key=lambda r: r["categoria"])
    table = crops.sparkSession.sparkContext.broadcast(
        ([r["categoria"] for r in rows], [list(r["centroid"]) for r in rows])
    )
    none = NO_CATEGORY

    @F.pandas_udf("string")
    def classify(vecs: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        names, centers = np.array(table.value[0], dtype=object), np.array(table.value[1])
        out = np.full(len(vecs), None, dtype=object)
        live = vecs.notna().to_numpy() & (vecs.map(lambda v: 0 if v is None else len(v)) == centers.shape[1]).to_numpy()
        if live.any():
            m = np.stack(vecs[live].to_numpy()).astype("float64")
            norms = np.linalg.norm(m, axis=1)
            sims = (m / np.maximum(norms, 1e-10)[:, None]) @ centers.T
            best = sims.argmax(axis=1)
            close = (sims[np.arange(len(m)), best] >= min_sim) & (norms >= 1e-10)
            out[live] = np.where(close, names[best], none)
        return pd.Series(out)

    return classify


def wrong_dimension(refs: DataFrame, dimension: int) -> DataFrame:
    """Products with vectors of another size than expected, and how many."""
    return (
        refs.filter(F.size("embedding") != dimension)
        .groupBy("ean", F.size("embedding").cast("long").alias("dimension"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def replace_refs(refs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Full replacement of the references of every product in ``fresh``."""
    return refs.join(fresh.select("ean").distinct(), "ean", "left_anti").select(refs.columns).unionByName(fresh)


def remove_refs(refs: DataFrame, eans: DataFrame) -> DataFrame:
    return refs.join(eans.select("ean").distinct(), "ean", "left_anti").select(refs.columns)


def has_refs(eans: DataFrame, refs: DataFrame) -> DataFrame:
    """The codes of ``eans`` that the catalogue knows."""
    return eans.join(refs.select("ean").distinct(), "ean", "left_semi")


def nearest_own_reference(crops: DataFrame, refs: DataFrame) -> DataFrame:
    """Highest similarity of each crop to the references of its own product: crop_id, max_sim."""
    q = crops.select(F.col("ean").alias("scope"), F.col("crop_id").alias("key"), F.col("embedding").alias("vec"))
    r = refs.select(F.col("ean").alias("scope"), F.col("embedding").alias("vec"))
    return best_score(q, r).select(F.col("key").alias("crop_id"), F.col("sim").alias("max_sim"))
