"""Benchmark passages inside documents.

A document is long and a test item short, so their resemblance is near zero even if the item is wholly inside.
The search therefore asks for containment: how much of the item's set of five-word shingles the document holds.
Every item keeps a bottom-k MinHash sketch, the smallest hashes of its shingles. Under one hash
function a document's own sketch of the same hash range holds such a hash exactly if it holds the shingle, so
the share of an item's sketch found in a document estimates the containment without bias whatever the two
sizes are. Items are partitioned by size in powers of two; each partition has the hash range its sketches
reach, and a document is sketched with the widest range any partition needs, so long items cost few hashes.
Documents that hold enough of a sketch are verified on the texts by exact shingle containment.

An item of fewer than five words has one shingle, all its words; documents are also cut to that width then.

Defined cases: items or documents without words match nothing; repeated items and repeated documents are
reported once per id and text; ids may be null; further columns stay untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from stockcount.scale import cut

from llm.text import broadcast_if_few, grams, hashed, private, words

WIDTH = 5
#: Least sketch hashes of an item, and the chance at which one held to the threshold may be missed.
SKETCH, MISSED = 16, 1e-4
#: Bytes of item shingles that may be broadcast.
ITEM_BYTES = 32_000_000


def sketch_rule(threshold: float) -> tuple[int, int]:
    """Hashes of a sketch, and how many of them must be found when the sketch is a part of the item.

    Both follow from the threshold: of an item held to it, fewer are found with a chance of at most ``MISSED`` (6 of 16 at
    0.8). Low thresholds take longer sketches. A sketch that is the whole item is held to the threshold itself.
    """
    size = SKETCH if threshold >= 1 else max(SKETCH, math.ceil(math.log(MISSED) / math.log(1 - threshold)))
    tail, hits = 0.0, 0
    while hits < size and (tail := tail + math.comb(size, hits) * threshold**hits * (1 - threshold) ** (size - hits)) <= MISSED:
        hits += 1
    return size, max(1, hits)


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, width, shingles (distinct texts), n_item; items with words only."""
    w = private(items, "item_id", "text").distinct().withColumn("_w", words(F.col("text"))).where(F.size("_w") > 0)
    size = F.least(F.lit(width), F.size("_w"))
    w = w.withColumn("width", size)
    starts = F.sequence(F.lit(1), F.size("_w") - F.col("width") + 1)
    shingles = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("_w", i, F.col("width")), " ")))
    return w.select("item_id", "width", shingles.alias("shingles")).withColumn("n_item", F.size("shingles"))


def item_sketches(shingled: DataFrame, threshold: float) -> DataFrame:
    """item_id, width, partition, reach, hash, needed, a row per sketch hash."""
    word_hashes = lambda s: F.transform(F.split(s, " "), lambda x: F.xxhash64(x))
    # The same hash a document's shingle gets from its words' hashes.
    chained = lambda h, n: F.xxhash64(*[F.get(h, k) for k in range(n)])
    by_width = lambda s: F.coalesce(*[F.when(F.col("width") == n, chained(word_hashes(s), n)) for n in range(1, WIDTH + 1)])
    ranked = shingled.withColumn("_hashes", F.sort_array(F.array_distinct(F.transform("shingles", by_width))))
    size, hits = sketch_rule(threshold)
    needed = F.when(F.col("n_item") <= size, F.ceil(F.col("n_item") * threshold - 1e-9)).otherwise(F.lit(hits))
    sketch = ranked.select(
        "item_id",
        "width",
        F.floor(F.log2("n_item")).cast("int").alias("partition"),
        F.slice("_hashes", 1, size).alias("_sketch"),
        needed.cast("long").alias("needed"),
    )
    return sketch.select("item_id", "width", "partition", "needed", F.explode("_sketch").alias("hash"))


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """_doc, _text_hash, item_id of documents that hold enough of an item's sketch."""
    reach = sketch.groupBy("width", "partition").agg(F.max("hash").alias("reach"))
    widest = {r["width"]: r["reach"] for r in reach.groupBy("width").agg(F.max("reach").alias("reach")).collect()}
    slim = docs.select("doc_id", F.xxhash64("text").alias("_text"), hashed(words(F.col("text"))).alias("_h"))
    found = None
    few = broadcast_if_few(sketch.select("item_id", "width", "hash", "needed"))
    for width, far in sorted(widest.items()):
        g = slim.select("doc_id", "_text", F.explode(F.array_distinct(grams_of(width))).alias("hash")).where(F.col("hash") <= far)
        hit = g.join(few.where(F.col("width") == width), "hash").select("doc_id", "_text", "item_id", "needed")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return docs.select("doc_id", F.xxhash64("text").alias("_text"), F.lit(None).cast("long").alias("item_id")).limit(0)
    return (
        found.groupBy("doc_id", "_text", "item_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"))
        .where("n >= needed")
        .select("doc_id", "_text", "item_id")
    )


def grams_of(width: int) -> Column:
    return grams("_h", width) if width > 1 else F.transform("_h", lambda x: F.xxhash64(x))


def _holding(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """doc_id, text_hash, item_id, n_shared, n_item of every text and item at or over the threshold."""
    docs = private(docs, "doc_id", "text")
    shingled = cut(item_shingles(items))
    near = cut(candidates(docs, item_sketches(shingled, threshold)).distinct())
    right = broadcast_if_few(near.withColumnsRenamed({"doc_id": "_doc", "_text": "text_hash"}))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("text_hash"))
    norm = F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")).alias("_norm")
    texts = docs.join(right, same).select("doc_id", "text_hash", "item_id", norm)
    pairs = texts.join(_broadcast_if_small(shingled.withColumnRenamed("item_id", "_item")), F.col("item_id").eqNullSafe(F.col("_item")))
    held = F.size(F.filter("shingles", lambda s: F.contains(F.col("_norm"), F.concat(F.lit(" "), s, F.lit(" ")))))
    counted = pairs.select("doc_id", "text_hash", "item_id", held.cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"))
    return counted.distinct().where(F.col("n_shared") / F.col("n_item") >= threshold)


def _broadcast_if_small(shingled: DataFrame) -> DataFrame:
    """Item texts are wide: their bytes are summed before they travel."""
    total = shingled.agg(F.sum(F.aggregate("shingles", F.lit(0), lambda n, s: n + F.octet_length(s) + 16))).first()[0] or 0
    return F.broadcast(shingled) if total <= ITEM_BYTES else shingled


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every pair at or over the threshold."""
    found = _holding(docs, items, threshold).drop("text_hash").distinct()
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; another text of the same id stays."""
    bad = cut(_holding(docs, items, threshold).select(F.col("doc_id").alias("_bad"), "text_hash").distinct())
    few = broadcast_if_few(bad)
    return docs.join(few, docs["doc_id"].eqNullSafe(few["_bad"]) & (F.xxhash64(docs["text"]) == few["text_hash"]), "left_anti")
