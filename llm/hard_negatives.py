"""Hard negatives of anchor vectors, by full exact integer scores from precomputed subset sums (Four Russians).

1. Components become integers, and the integers of a block of candidates become bit planes in two's complement: one
   byte holds a bit of each of eight dimensions.
2. For a block of anchors and each group of eight dimensions a table holds the sum of the anchors' components over
   every subset of the eight, 256 rows. A candidate's byte is the place of its subset, so a plane adds one looked-up row for each
   group, and planes are added up by doubling from the highest, which counts negatively.
3. Anchors meet the candidates of their own label first, which gives their positives, then all candidates, for the
   negatives in the window of each positive. Every anchor meets every candidate in blocks; tasks keep the best of
   what they have seen, and these meet in a small ranking. No score is estimated and no candidate is left out.

Anchor blocks are broadcast if their summed bytes allow; beyond, candidates are dealt to lanes of a fixed number of rows, and
anchors copied to each lane.

Defined cases: rows without vec_id, label or vector, or with a null or non-finite component take no part, nor do those with
a component of 16,384 or more in size, whose scores might leave 64 bits; vectors of different sizes never meet;
repeated rows are rows of their own (an anchor's copy is another row); ties go to the smaller vec_id; an anchor without
positives, or a positive without negatives, has no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from stockcount.scale import cut

from llm.text import broadcast_if_few

LARGEST = float(1 << 14)
GROUP = 8
#: Anchors of a block, candidates of a block, and candidates scored at once.
ANCHORS, CANDIDATES, AT_ONCE = 64, 8192, 2048
BROADCAST_BYTES = 64_000_000
LANE_ROWS = 1_000_000
#: Lists of best rows a task holds before it hands them on.
HELD = 200_000
POSITIVES, NEGATIVES = 5, 10


def prepared(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, label, dim, ints of the rows that take part."""
    known = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < LARGEST), F.lit(False)))
    known = known.where("vec_id is not null and label is not null and x is not null").where(sound)
    ints = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("int"))
    return known.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("x").alias("dim"), ints.alias("ints"))


def bit_planes(ints: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of a (rows, dimensions) matrix; the last plane is that of the sign."""
    n, d = ints.shape
    widest = int(max(ints.max(initial=0), ~ints.min(initial=0), 0))
    planes = widest.bit_length() + 1
    out = np.empty((planes, -(-d // GROUP), n), dtype=np.uint8)
    for j in range(planes):
        out[j] = np.packbits(((ints >> j) & 1).astype(np.uint8), axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """(groups, 256, anchors): sums of each subset of eight components of each anchor."""
    a, d = anchors.shape
    groups = -(-d // GROUP)
    full = np.zeros((a, groups * GROUP), dtype=dtype)
    full[:, :d] = anchors
    parts = full.T.reshape(groups, GROUP, a)
    sums = np.zeros((groups, 1 << GROUP, a), dtype=dtype)
    for i in range(GROUP):
        sums[:, 1 << i : 2 << i] = sums[:, : 1 << i] + parts[:, i, None, :]
    return sums


def looked_up(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, candidates) scores: the planes' looked-up sums, doubled from plane to plane."""
    n = planes.shape[2]
    out = np.empty((sums.shape[2], n), dtype=sums.dtype)
    for at in range(0, n, AT_ONCE):
        part = planes[:, :, at : at + AT_ONCE]
        total = np.zeros((part.shape[2], sums.shape[2]), dtype=sums.dtype)
        one = np.empty_like(total)
        for j in range(len(part) - 1, -1, -1):
            total += total
            for g in range(len(sums)):
                np.take(sums[g], part[j, g], axis=0, out=one, mode="clip")
                if j == len(part) - 1:
                    total -= one
                else:
                    total += one
        out[:, at : at + AT_ONCE] = total.T
    return out


def _flat(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def _parts(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batch's rows for each value of the keys."""
    values = pd.DataFrame({k: batch.column(k).to_numpy(zero_copy_only=False) for k in keys})
    for key, at in values.groupby(keys, sort=False).indices.items():
        yield key if isinstance(key, tuple) else (key,), batch.take(pa.array(at))


CANDIDATE = "dim int, c_label long, n int, planes int, bits binary, c_rows binary, c_ids binary, c_labels binary"
ANCHOR = "dim int, a_label long, block long, size int, ints binary, a_rows binary, a_ids binary, a_labels binary, windows binary"


def candidate_blocks(rows: DataFrame, by_label: bool) -> DataFrame:
    """Bit planes of up to CANDIDATES rows of one size (and one label)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, part in _parts(batch, ["dim", "label"] if by_label else ["dim"]):
                for at in range(0, part.num_rows, CANDIDATES):
                    piece = part.slice(at, CANDIDATES)
                    planes = bit_planes(_flat(piece.column("ints"), key[0]))
                    numbers = [piece.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("row", "vec_id", "label")]
                    row = [key[0], key[1] if by_label else None, piece.num_rows, len(planes), planes.tobytes(), *numbers]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    names = ["dim", "c_label", "n", "planes", "bits", "c_rows", "c_ids", "c_labels"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return rows.select("row", "vec_id", "label", "dim", "ints").mapInArrow(task, CANDIDATE)


def anchor_blocks(anchors: DataFrame, by_label: bool) -> DataFrame:
    """Integers of up to ANCHORS rows of one size (and one label), with the windows of their positives if there are any."""
    found = "found" in anchors.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, part in _parts(batch, ["dim", "label"] if by_label else ["dim"]):
                for at in range(0, part.num_rows, ANCHORS):
                    piece = part.slice(at, ANCHORS)
                    numbers = [piece.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("row", "vec_id", "label")]
                    windows = None
                    if found:
                        sides = [(k, p["rank"], p["id"], p["score"]) for k, ps in enumerate(piece.column("found").to_pylist()) for p in ps]
                        windows = np.array(sides, dtype=np.int64).tobytes()
                    first = int(np.frombuffer(numbers[0], np.int64)[0])
                    row = [key[0], key[1] if by_label else None, first, piece.num_rows, _flat(piece.column("ints"), key[0]).astype(np.int64).tobytes(), *numbers, windows]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    names = ["dim", "a_label", "block", "size", "ints", "a_rows", "a_ids", "a_labels", "windows"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    wanted = ["row", "vec_id", "label", "dim", "ints"] + ["found"] * found
    return anchors.select(*wanted).mapInArrow(task, ANCHOR)


def _meet(candidates: DataFrame, anchors: DataFrame, same: list[Column], rows: int, broadcast_bytes: int) -> DataFrame:
    """Each anchor block with each candidate block it may meet."""
    blocks = cut(anchors)
    size = blocks.agg(F.sum(F.octet_length("ints"))).first()[0] or 0
    right = blocks.withColumnRenamed("dim", "a_dim")
    on = (F.col("dim") == F.col("a_dim")) & same[0] if same else F.col("dim") == F.col("a_dim")
    if size <= broadcast_bytes:
        return candidates.join(F.broadcast(right), on)
    lanes = -(-rows // LANE_ROWS)
    left = candidates.withColumn("lane", F.pmod(F.xxhash64("c_rows"), F.lit(lanes)))
    copies = right.withColumn("a_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return left.join(copies, on & (F.col("lane") == F.col("a_lane")))


class _Scorer:
    """Scores of joined blocks; remembers the last anchor tables."""

    def __init__(self) -> None:
        self.tables: dict[tuple, np.ndarray] = {}

    def scores(self, r) -> np.ndarray:
        groups = -(-r.dim // GROUP)
        planes = np.frombuffer(r.bits, np.uint8).reshape(r.planes, groups, r.n)
        ints = np.frombuffer(r.ints, np.int64).reshape(r.size, r.dim)
        narrow = int(np.abs(ints).max(initial=0)) * (r.dim << r.planes) < 1 << 31
        key = (r.dim, r.block, narrow)
        if key not in self.tables:
            if len(self.tables) >= 64:
                self.tables.clear()
            self.tables[key] = subset_sums(ints, np.int32 if narrow else np.int64)
        return looked_up(self.tables[key], planes)


class _Best:
    """The best (score, id) for each key: higher scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.found = k, {}

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        have = self.found.get(key, [])
        if len(have) == self.k:
            near = scores >= -have[-1][0]
            scores, ids = scores[near], ids[near]
        if len(scores) > self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[near], ids[near]
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
        if len(scores):
            self.found[key] = sorted(have + list(zip((-scores).tolist(), ids.tolist(), strict=True)))[: self.k]

    def rows(self) -> Iterator[tuple]:
        for key, best in self.found.items():
            for score, id_ in best:
                yield *key, id_, -score
        self.found = {}


def _positives(k: int):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, best = _Scorer(), _Best(k)
        names = ["row", "vec_id", "id", "score"]
        for frame in frames:
            for r in frame.itertuples(index=False):
                scores = scorer.scores(r)
                c_rows, c_ids = np.frombuffer(r.c_rows, np.int64), np.frombuffer(r.c_ids, np.int64)
                for row, vec_id, own in zip(np.frombuffer(r.a_rows, np.int64).tolist(), np.frombuffer(r.a_ids, np.int64).tolist(), scores, strict=True):
                    other = c_rows != row
                    best.add((row, vec_id), own[other].astype(np.int64), c_ids[other])
            if len(best.found) > HELD:
                yield pd.DataFrame(list(best.rows()), columns=names)
        yield pd.DataFrame(list(best.rows()), columns=names).astype("int64")

    return task


def _negatives(k: int, least: int, most: int):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, best = _Scorer(), _Best(k)
        names = ["row", "vec_id", "nth", "positive_id", "positive_score", "id", "score"]
        for frame in frames:
            for r in frame.itertuples(index=False):
                scores = scorer.scores(r)
                c_ids, c_labels = np.frombuffer(r.c_ids, np.int64), np.frombuffer(r.c_labels, np.int64)
                rows, ids = np.frombuffer(r.a_rows, np.int64).tolist(), np.frombuffer(r.a_ids, np.int64).tolist()
                labels = np.frombuffer(r.a_labels, np.int64)
                at, own, own_ids = -1, None, None
                for a, nth, positive, score in np.frombuffer(r.windows, np.int64).reshape(-1, 4).tolist():
                    if a != at:
                        other = c_labels != labels[a]
                        at, own, own_ids = a, scores[a][other].astype(np.int64), c_ids[other]
                    inside = (own >= -(-least * score // 100)) & (own <= most * score // 100)
                    best.add((rows[a], ids[a], nth, positive, score), own[inside], own_ids[inside])
            if len(best.found) > HELD:
                yield pd.DataFrame(list(best.rows()), columns=names)
        yield pd.DataFrame(list(best.rows()), columns=names).astype("int64")

    return task


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = 30,
    most: int = 90,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` as ``prepared`` returns them. A negative's score lies between ``least`` and ``most`` hundredths of its positive's.
    """
    rows = cut(rows)
    n = rows.count()
    anchors = rows.where(is_anchor)
    pairs = _meet(candidate_blocks(rows, True), anchor_blocks(anchors, True), [F.col("c_label") == F.col("a_label")], n, broadcast_bytes)
    near = pairs.mapInPandas(_positives(positives), "row long, vec_id long, id long, score long")
    by_score = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    found = near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= positives)
    found = cut(found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found")))
    with_found = anchors.join(broadcast_if_few(found), "row")
    pairs = _meet(candidate_blocks(rows, False), anchor_blocks(with_found, False), [], n, broadcast_bytes)
    far = pairs.mapInPandas(
        _negatives(negatives, least, most), "row long, vec_id long, nth long, positive_id long, positive_score long, id long, score long"
    )
    order = Window.partitionBy("row", "nth").orderBy(F.desc("score"), "id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
