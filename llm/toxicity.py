"""Toxicity by a factorization machine over hashed terms.

Terms of a word are the word in lower case and its beginnings of four to six letters, hashed to ``BUCKETS``. All labelled rows
are counted in Spark: for every bucket, how many documents hold it and how many of these are toxic. Every bucket whose
share of toxic documents stands out becomes a feature, however many these are; ``BUCKETS`` bounds the model. On them a
factorization machine is fitted,

    logit = w0 + sum of w_i + sum over pairs of <v_i, v_j>,

whose pair term learns that two terms weigh more together than apart. It is fitted on the driver on a sample of at
most ``MOST_ROWS`` labelled rows (the first by a hash of the id), which carry feature numbers only.

Defined cases: null or empty text scores as a text without features; labels without a value and documents
without a label train nothing; several labels for one document count as toxic if one is; without labelled rows,
or with one class only, the score is the smoothed share of toxic rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from stockcount.scale import cut

from llm.batches import Words, slices
from llm.text import broadcast_if_few, hash_bound

BUCKETS = 1 << 20
#: Bound of the rows the machine is fitted on.
MOST_ROWS = 20_000
BATCH = 2_000
#: Held terms whose vectors are worked on at once.
PART = 250_000
RANK = 8
STANDS_OUT = 3.0
BEGINNINGS = (4, 5, 6)
REMEMBERED = 300_000
_EDGES = regex.compile(r"^[^\p{L}]+|[^\p{L}]+$")
_terms: dict[str, tuple[int, ...]] = {}


def terms(word: str) -> tuple[int, ...]:
    """Buckets of a word's terms; none for a word without letters."""
    found = _terms.get(word)
    if found is None:
        low = word.lower()
        bare = low if low.isalpha() else _EDGES.sub("", low)
        parts = {f"w{bare}"} | {f"b{bare[:n]}" for n in BEGINNINGS if len(bare) >= n} if bare else ()
        found = tuple([xxhash.xxh32_intdigest(p) & (BUCKETS - 1) for p in parts])
        if len(_terms) >= REMEMBERED:
            _terms.clear()
        _terms[word] = found
    return found


def held_terms(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, each once, as two arrays sorted by text; with ``chosen`` (a number for each bucket, or
    -1) the numbers of chosen buckets instead."""
    words = Words(texts)
    each = [terms(w) for w in words.distinct]
    sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
    flat = np.fromiter((t for x in each for t in x), dtype=np.int64, count=int(sizes.sum()))
    if chosen is not None:
        flat = chosen[flat]
        sizes = np.bincount(np.repeat(np.arange(len(each)), sizes)[flat >= 0], minlength=len(each))
        flat = flat[flat >= 0]
    starts = np.cumsum(sizes) - sizes
    n = sizes[words.codes]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[words.codes] - (ends - n), n)
    owner = np.repeat(np.repeat(np.arange(len(words.sizes)), words.sizes), n)
    both = np.unique(owner * BUCKETS + flat[at])
    return both // BUCKETS, both % BUCKETS


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of documents with a label."""
    one = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.select("doc_id", "text").join(broadcast_if_few(cut(one)), "doc_id")


def term_counts(rows: DataFrame) -> DataFrame:
    """bucket, n, toxic over all rows; bucket -1 has the totals. A task emits a bucket once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        all_n = all_bad = 0
        for part, texts in slices(batches):
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)
            owner, bucket = held_terms(texts)
            n += np.bincount(bucket, minlength=BUCKETS)
            bad += np.bincount(bucket[toxic[owner] > 0], minlength=BUCKETS)
            all_n, all_bad = all_n + len(toxic), all_bad + int((toxic > 0).sum())
        at = np.flatnonzero(n)
        for a in range(0, len(at), 100_000):
            own = at[a : a + 100_000]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(own), "n": pa.array(n[own]), "toxic": pa.array(bad[own])})
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1]), "n": pa.array([all_n]), "toxic": pa.array([all_bad])})

    counted = rows.select("text", "toxic").mapInArrow(task, "bucket long, n long, toxic long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def choose(counts: DataFrame) -> tuple[np.ndarray, float]:
    """All buckets that stand out, in order, and the smoothed share of toxic rows."""
    total = counts.where("bucket = -1").first()
    n, bad = (total["n"], total["toxic"]) if total else (0, 0)
    share = (bad + 1) / (n + 2)
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    got = counts.where((F.col("bucket") >= 0) & (F.col("n") >= 3) & (F.abs(z) > STANDS_OUT)).select("bucket").toArrow()
    return np.sort(got.column("bucket").to_numpy()), share


def _parts(owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of whole rows with at most ``PART`` entries together (or one row); owner is sorted."""
    a = 0
    while a < len(owner):
        b = len(owner)
        if b - a > PART:
            b = int(np.searchsorted(owner, owner[a + PART]))
            b = b if b > a else int(np.searchsorted(owner, owner[a], side="right"))
        yield a, b
        a = b


def _sums(model: dict, owner: np.ndarray, feature: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The logit of each row and the sum of its vectors; owner is sorted."""
    out, sums = np.full(texts, model["w0"], dtype=np.float64), np.zeros((texts, RANK), dtype=np.float32)
    alone = model["w"] - 0.5 * (model["v"] * model["v"]).sum(1)
    for a, b in _parts(owner):
        at = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        rows = owner[a:b][at]
        sums[rows] = np.add.reduceat(model["v"][feature[a:b]], at, axis=0)
        out[rows] += np.add.reduceat(alone[feature[a:b]], at)
    return out + 0.5 * (sums * sums).sum(1), sums


def _logits(model: dict, owner: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
    """owner is sorted."""
    return _sums(model, owner, feature, texts)[0]


def train(owner: np.ndarray, feature: np.ndarray, y: np.ndarray, features: int, steps: int = 250) -> dict:
    """Fits the machine by Adam in batches of ``BATCH`` rows, at least ``steps`` steps in whole rounds over the rows.

    owner (sorted) and feature list which row holds which feature.
    """
    rng = np.random.default_rng(5)
    p0 = (y.sum() + 1) / (len(y) + 2)
    w0 = np.array(np.log(p0 / (1 - p0)), dtype=np.float32)
    model = {"w0": w0, "w": np.zeros(features, np.float32), "v": rng.normal(0, 0.05, (features, RANK)).astype(np.float32)}
    if features == 0 or len(owner) == 0 or y.min() == y.max():
        return model
    batches = range(0, len(y), BATCH)
    m = {k: np.zeros_like(model[k]) for k in model}
    s2 = {k: np.zeros_like(model[k]) for k in model}
    for step in range(1, -(-steps // len(batches)) * len(batches) + 1):
        first = batches[(step - 1) % len(batches)]
        target = y[first : first + BATCH]
        a, b = np.searchsorted(owner, [first, first + len(target)])
        for k, grad in _gradient(model, owner[a:b] - first, feature[a:b], target).items():
            m[k] *= 0.9
            m[k] += 0.1 * grad
            s2[k] *= 0.99
            s2[k] += 0.01 * grad * grad
            model[k] -= 0.05 / (1 - 0.9**step) * m[k] / (np.sqrt(s2[k] / (1 - 0.99**step)) + 1e-8)
    return model


def _gradient(model: dict, owner: np.ndarray, feature: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean logistic loss over some rows, with a small pull of all weights to 0."""
    logits, sums = _sums(model, owner, feature, len(y))
    g = ((1 / (1 + np.exp(-logits)) - y) / len(y)).astype(np.float32)
    gv, gw = 1e-4 * model["v"], 1e-5 * model["w"]
    pulled = g[:, None] * sums
    for a, b in _parts(owner):
        order = np.argsort(feature[a:b], kind="stable")
        held, row = feature[a:b][order], owner[a:b][order]
        starts = np.flatnonzero(np.diff(held, prepend=-1))
        used = held[starts]
        own = np.add.reduceat(g[row], starts)
        gv[used] += np.add.reduceat(pulled[row], starts, axis=0) - own[:, None] * model["v"][used]
        gw[used] += own
    return {"w0": g.sum(), "w": gw, "v": gv}


def _numbered(buckets: np.ndarray) -> np.ndarray:
    number = np.full(BUCKETS, -1, dtype=np.int64)
    number[buckets] = np.arange(len(buckets))
    return number


def fit(rows: DataFrame, most_rows: int = MOST_ROWS) -> dict:
    """The model from labelled rows: doc_id, text, toxic."""
    buckets, share = choose(cut(term_counts(rows)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered(buckets)
        for part, texts in slices(batches):
            owner, feature = held_terms(texts, number)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("draw"), part.column("doc_id"), part.column("toxic"), lists], ["draw", "doc_id", "toxic", "features"])

    draw = F.xxhash64("doc_id", F.lit(9))
    n, least = rows.agg(F.count(F.lit(1)), F.coalesce(F.min(draw), F.lit(0).cast("long"))).first()
    some = rows.select(draw.alias("draw"), "doc_id", "text", "toxic").where(F.col("draw") <= F.lit(hash_bound(n, 6 * most_rows // 5, least)).cast("long"))
    # Features are made where the rows lie, in many tasks; only they meet for the exact number of rows.
    made = some.mapInArrow(task, "draw long, doc_id long, toxic int, features array<int>")
    got = made.orderBy("draw", "doc_id").limit(most_rows).select("toxic", "features").toArrow()
    lists = got.column("features").chunks
    sizes = np.concatenate([np.zeros(0, np.int64), *[pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]]).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    feature = np.concatenate([np.zeros(0, np.int32), *[x.flatten().to_numpy() for x in lists]])
    y = (got.column("toxic").to_numpy() > 0).astype(np.float64)
    del got, lists
    model = train(owner, feature, y, len(buckets)) if len(y) else {"w0": float(np.log(share / (1 - share))), "w": np.zeros(len(buckets)), "v": np.zeros((len(buckets), RANK))}
    return model | {"buckets": buckets}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered(model["buckets"])
        for rows, texts in slices(batches):
            owner, feature = held_terms(texts, number)
            p = 1 / (1 + np.exp(-_logits(model, owner, feature, len(texts))))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, score double")


def train_and_score(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """Fits on labelled rows that are not held out and scores all: doc_id, held_out, score, predicted.

    held_out is an expression on doc_id.
    """
    model = fit(labelled(docs, labels).where(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
