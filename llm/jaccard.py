"""Documents whose sets of five-word shingles resemble each other (Jaccard), by MinHash labels in fixed bands.

1. A task turns texts into shingle hashes and from them into ``TREES`` labels, each the hash of a band of MinHash
   values. Texts of the same words are one node from here on. The bands are as long as a pair exactly at the threshold
   still shares one with the wanted probability: 40 bands of 8 values at 0.8. No forest of prefix trees is built, see README.
2. Nodes that share a label are tied to the least of them, which gives a line per node instead of pairs,
   and the ties join into clusters. All candidate pairs lie inside clusters.
3. Every cluster is verified exactly on the shingle sets. A cluster beyond a block's size is cut into blocks and
   each pair of blocks is a cell of its own, so no task holds a whole hot cluster. A cell multiplies incidence
   matrices and returns only what each node gains: the weight of its links and the least node it is tied to.
   ``jaccard_pairs`` returns the verified pairs between nodes instead.

64-bit hashes stand for shingles and nodes.

Defined cases: a text of one to four words has one shingle, all its words; a text without words is linked to
nothing; rows without an id are returned unlinked; repeated rows are copies of each other; equal ids with
other texts are other documents; further columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from stockcount.scale import cut

from llm.batches import Words, mixed, slices
from llm.graph import components
from llm.text import broadcast_if_few, private

WIDTH = 5
THRESHOLD = 0.8
TREES = 40
DEPTH = 16
RECALL = 0.999
#: Nodes and shingles of a block; a cell holds two blocks.
BLOCK_NODES = 256
BLOCK_SHINGLES = 400_000
#: Bytes of text worked on at once.
AT_ONCE = 2_000_000


def matched_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest band at which a pair at the threshold shares one of ``trees`` with probability ``recall``; ``depth`` at most."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """Per text a 64-bit hash of its words in order (0 without words) and its sorted distinct shingle hashes."""
    words = Words(texts)
    by_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words.distinct), dtype=np.uint64, count=len(words.distinct))
    h = by_word[words.codes]
    run = np.zeros(len(h), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            run[: len(h) - k] = run[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
        run = mixed(run)
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if a == b:
            yield 0, run[:0]
            continue
        node = xxhash.xxh3_64_intdigest(h[a:b].tobytes())
        full = np.unique(run[a : b - width + 1]) if b - a >= width else np.array([node], dtype=np.uint64)
        yield node, full


def _labels(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray, depth: int) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        part = low[at : at + 2048, None] * factors
        part += shifts
        np.minimum(least, part.min(axis=0), out=least)
    with np.errstate(over="ignore"):
        paths = least.reshape(-1, depth).astype(np.uint64)
        label = np.arange(1, len(paths) + 1, dtype=np.uint64)
        for k in range(depth):
            label = mixed(label ^ paths[:, k] * np.uint64(0x9E3779B97F4A7C15))
    return label.view(np.int64)


def sketched(docs: DataFrame, threshold: float, width: int, trees: int) -> DataFrame:
    """doc_id, text_hash, node, n (shingles), labels (a path label per tree)."""
    depth = matched_depth(threshold, trees)
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, most=AT_ONCE):
            nodes, sizes, labels = [], [], []
            for node, shingles in shingle_sets(texts, width):
                nodes.append(node)
                sizes.append(len(shingles))
                labels.append(_labels(shingles, factors, shifts, depth) if len(shingles) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("text_hash"),
                    pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(sizes, dtype=np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum([len(x) for x in labels])]).astype(np.int32)),
                        pa.array(np.concatenate(labels)),
                    ),
                ],
                ["doc_id", "text_hash", "node", "n", "labels"],
            )

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return hashed.mapInArrow(task, "doc_id long, text_hash long, node long, n long, labels array<long>")


def clusters(nodes: DataFrame) -> DataFrame:
    """node, cluster of nodes that share a prefix with another; nodes: node, labels."""
    paths = cut(nodes.select("node", F.explode("labels").alias("label")))
    shared = paths.groupBy("label").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last")
    ties = paths.join(shared.select("label", "head"), "label").where("node <> head")
    tied = components(ties.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())
    heads = tied.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct()
    return tied.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(heads)


def cells(member: DataFrame) -> DataFrame:
    """node, copies, cluster, i, j, block: each node in the cells it belongs to; member: node, cluster, n, copies."""
    sizes = member.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("node") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    sized = member.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(
        "node", "copies", "cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )


def _linked(cell: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (first < second) at or over the threshold, and their Jaccard similarity."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in cell["shingles"]]
    n = np.array([len(x) for x in sets], dtype=np.float64)
    owner = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(code)
    # A shingle that one set holds adds nothing to an intersection.
    common = held[code] > 1
    order = np.argsort(code[common], kind="stable")
    code, owner = code[common][order], owner[common][order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    column = np.cumsum(np.diff(code, prepend=-1) != 0) - 1
    shared = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for at in range(0, len(starts), 4096):
        a, b = starts[at], starts[at + 4096] if at + 4096 < len(starts) else len(code)
        part = np.zeros((len(sets), min(4096, len(starts) - at)), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        shared += part @ part.T
    similar = shared / (n[:, None] + n[None, :] - shared)
    block = cell["block"].to_numpy()
    if cell["i"].iloc[0] != cell["j"].iloc[0]:
        similar[block[:, None] == block[None, :]] = 0
    x, y = np.nonzero(np.triu(similar >= threshold - 1e-12, 1))
    return x, y, similar[x, y]


def _cells_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole cells out of a task's rows, which arrive sorted by cell; holds one cell."""
    rest: list[pd.DataFrame] = []
    key = ["cluster", "i", "j"]
    for frame in frames:
        for _, part in frame.groupby(key, sort=False):
            if rest and tuple(rest[-1][key].iloc[0]) != tuple(part[key].iloc[0]):
                yield pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(part)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _verified(docs: DataFrame, sketch: DataFrame, threshold: float, width: int, pairs: bool) -> DataFrame:
    nodes = cut(sketch.where("n > 0").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.min("doc_id").alias("at"), F.first("labels").alias("labels")
    ))
    near = clusters(nodes.select("node", "labels"))
    member = cut(near.join(nodes.select("node", "copies", "n", "at"), "node"))
    dealt = cells(member.select("node", "cluster", "n", "copies"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, most=AT_ONCE):
            found = list(shingle_sets(texts, width))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([x for x, _ in found], dtype=np.uint64).view(np.int64)), pa.array([y.tobytes() for _, y in found], pa.binary())],
                ["node", "shingles"],
            )

    wanted = broadcast_if_few(member.select(F.col("at").alias("doc_id")).distinct())
    held = docs.join(wanted, "doc_id").select("text").mapInArrow(sets, "node long, shingles binary")
    once = held.groupBy("node").agg(F.first("shingles").alias("shingles"))
    filled = dealt.join(once, "node")
    ordered = filled.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")

    def gains(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells_of(frames):
            x, y, _ = _linked(cell, threshold)
            if len(x) == 0:
                continue
            node, copies = cell["node"].to_numpy(), cell["copies"].to_numpy()
            weight = np.bincount(x, copies[y], len(node)) + np.bincount(y, copies[x], len(node))
            head = node.copy()
            while True:
                before = head.copy()
                np.minimum.at(head, x, head[y])
                np.minimum.at(head, y, head[x])
                if (before == head).all():
                    break
            on = weight > 0
            yield pd.DataFrame({"node": node[on], "links": weight[on].astype(np.int64), "head": head[on]})

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells_of(frames):
            x, y, s = _linked(cell, threshold)
            node = cell["node"].to_numpy()
            yield pd.DataFrame({"a": node[x], "b": node[y], "similarity": s})

    if pairs:
        return ordered.mapInPandas(listed, "a long, b long, similarity double")
    return ordered.mapInPandas(gains, "node long, links long, head long")


def _sketch(docs: DataFrame, threshold: float, width: int, trees: int) -> tuple[DataFrame, DataFrame]:
    known = private(docs, "doc_id", "text").where("doc_id is not null")
    return known, cut(sketched(known, threshold, width, trees))


def _classes(sketch: DataFrame, found: DataFrame) -> DataFrame:
    """node, class_id, n_links, keep_id, keep_hash of nodes with words; keep_id and keep_hash name the row that stands for the class."""
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b"))
    nodes = sketch.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
    whole = cut(
        nodes.join(links, "node", "left")
        .join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"), "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    least = whole.groupBy("root").agg(F.min("first").alias("kept"))
    return cut(whole.join(least, "root").select("node", F.col("kept.doc_id").alias("class_id"), "n_links", F.col("kept.text_hash").alias("keep_hash")))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES) -> DataFrame:
    """doc_id, class_id, n_links per row of ``docs``.

    class_id is the least document id reached over links; n_links counts the other rows at or over the threshold.
    """
    known, sketch = _sketch(docs, threshold, width, trees)
    classes = _classes(sketch, cut(_verified(known, sketch, threshold, width, pairs=False)))
    by_node = broadcast_if_few(classes.drop("keep_hash"))
    alone = sketch.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    lost = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    linked = sketch.where("n > 0").select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", "n_links")
    return linked.unionByName(alone).unionByName(lost)


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) between distinct texts, and the membership (doc_id, node) that a and b refer to."""
    known, sketch = _sketch(docs, threshold, width, trees)
    pairs = _verified(known, sketch, threshold, width, pairs=True)
    return pairs, sketch.where("n > 0").select("doc_id", "node")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One text of every class, that of the least id; of repeated rows one stays. Rows without an id stay.

    What goes is told by id and text, so another text of the same id is judged by its own class.
    """
    known, sketch = _sketch(docs, THRESHOLD, WIDTH, TREES)
    classes = _classes(sketch, cut(_verified(known, sketch, THRESHOLD, WIDTH, pairs=False)))
    held = sketch.where("n > 0").select("doc_id", "text_hash", "node").join(broadcast_if_few(classes), "node")
    other = (F.col("doc_id") != F.col("class_id")) | (F.col("text_hash") != F.col("keep_hash"))
    gone = held.where(other).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    few = broadcast_if_few(cut(gone))
    left = docs.join(few, (docs["doc_id"] == few["_gone"]) & (F.xxhash64(docs["text"]) == few["_hash"]), "left_anti")
    again = cut(sketch.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return left
    few = broadcast_if_few(again)
    once = left.join(few, left["doc_id"] == few["_again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(few, left["doc_id"] == few["_again"], "left_anti").unionByName(once)
