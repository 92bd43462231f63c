"""Language of a text by error-correcting output codes.

Every language has a codeword of bits, and one binary classifier on hashed character n-grams (one to three
characters of the lower-cased text, all of it) predicts each bit. A text's language is the one whose codeword costs the least
logistic loss, each bit weighted by how well its classifier does on the training rows; errors in a few bits are
outvoted by the others. If the runner-up comes close the prediction is flagged as ambiguous.

The classifiers are fitted on the driver from a sample of labelled rows: at most ``PER_LANGUAGE`` rows per language and
``MOST_ROWS`` in all, the first ones by a hash of id and text. Prediction needs the text alone.

Defined cases: null text or a text without a letter is ``und`` with score 0; with a single language in the
training rows all other texts get it with score 1; with none all are ``und``; rows without an id may be
trained on; repeated rows are predicted each; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.batches import slices
from llm.text import hash_bound

#: Bounds of the training sample.
PER_LANGUAGE, MOST_ROWS = 400, 2_000
#: Buckets for the n-grams of each order.
BUCKETS = 4096
ORDERS = (1, 2, 3)
LETTER = regex.compile(r"\p{L}")
NONE = "und"
#: A prediction whose runner-up has more than this share of its probability is ambiguous.
CLOSE = 0.5
_NOT_LETTERS = np.array([c for c in range(128) if not chr(c).isalpha()], dtype=np.uint32)


def features(texts: list[str]) -> np.ndarray:
    """A row per text: roots of n-gram counts, scaled to length 1 for each order."""
    out = np.zeros((len(texts), BUCKETS * len(ORDERS)), dtype=np.float32)
    plain = np.arange(128, dtype=np.uint32)
    plain[_NOT_LETTERS] = 32
    for k, text in enumerate(texts):
        c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = np.where(c < 128, plain[np.minimum(c, 127)], c)
        h = np.zeros(len(c), dtype=np.uint32)
        for o in ORDERS:
            h = h[: len(c) - o + 1] * np.uint32(0x01000193) + c[o - 1 :]
            at = (h * np.uint32(0x9E3779B1)) >> np.uint32(20)
            n = np.sqrt(np.bincount(at, minlength=BUCKETS).astype(np.float32))
            out[k, (o - 1) * BUCKETS : o * BUCKETS] = n / max(np.sqrt((n * n).sum()), 1e-9)
    return out


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all ways to split few languages in two, else far apart random words."""
    if languages <= 5:
        splits = range(1, 1 << max(languages - 1, 0))
        return np.array([[1 if s >> k & 1 else -1 for s in splits] for k in range(languages)], dtype=np.float32).reshape(languages, -1)
    bits, rng = 10 * (languages - 1).bit_length(), np.random.default_rng(11)
    tries = [rng.choice(np.array([-1, 1], dtype=np.float32), (languages, bits)) for _ in range(50)]
    apart = lambda m: ((bits - m @ m.T) / 2 + np.eye(languages) * bits).min()
    best = max(tries, key=apart)
    return best[:, np.abs(best.sum(axis=0)) < languages]


def train(x: np.ndarray, labels: np.ndarray, rounds: int = 120) -> dict:
    """Logistic classifiers for all bits at once by gradient steps with momentum; x: rows of ``features``."""
    names = np.unique(labels)
    code = codewords(len(names))
    y = code[np.searchsorted(names, labels)]
    share = 1.0 / np.bincount(np.searchsorted(names, labels))[np.searchsorted(names, labels)]
    share = (share / share.sum())[:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    for _ in range(rounds):
        g = -y * share / (1 + np.exp(y * (x @ w + b)))
        vw = 0.9 * vw - 8.0 * (x.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 8.0 * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((y * (x @ w + b)) > 0).mean(axis=0)
    weight = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
    return {"names": names.tolist(), "code": code, "w": w, "b": b, "weight": (weight / weight.sum() * len(weight)).astype(np.float32)}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its probability (0 to 1) and that of the runner-up, for rows of ``features``."""
    margin = (x @ model["w"] + model["b"])[:, None, :] * model["code"][None]
    loss = (np.logaddexp(0, -margin) * model["weight"]).sum(axis=2)
    p = np.exp(loss.min(axis=1, keepdims=True) - loss)
    p /= p.sum(axis=1, keepdims=True)
    order = np.argsort(-p, axis=1, kind="stable")
    rows = np.arange(len(x))
    second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(x))
    return order[:, 0], p[rows, order[:, 0]], second


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_ROWS) -> DataFrame:
    """lang, text of the training sample; labelled: doc_id, text, lang."""
    usable = labelled.where("lang is not null and text is not null")
    draw = F.xxhash64("doc_id", "text", F.lit(3))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least")).collect()  # one row per language
    if not sizes:
        return usable.select("lang", "text").limit(0)
    each = max(1, min(per_language, most // len(sizes)))
    upto = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(hash_bound(r["n"], 2 * (each + 20), r["least"])).cast("long")) for r in sizes])
    first = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id", F.xxhash64("text")))
    return usable.where(draw <= upto).withColumn("_n", first).where(F.col("_n") <= each).select("lang", "text")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_ROWS) -> dict | None:
    """The model, or None without usable rows. Workers make the features; the driver holds the sample's."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            keep = [k for k, t in enumerate(texts.to_pylist()) if LETTER.search(t)]
            x = features([texts[k].as_py() for k in keep]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([rows.column("lang").take(pa.array(keep, pa.int64())), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = sample(labelled, per_language, most).mapInArrow(task, "lang string, x binary").orderBy("lang", "x").toArrow()
    if got.num_rows == 0:
        return None
    x = np.stack([np.frombuffer(r.as_py(), dtype=np.float16) for r in got.column("x")]).astype(np.float32)
    return train(x, np.array(got.column("lang").to_pylist()))


def predicted(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, runner_up (its probability), ambiguous."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            all_texts = texts.to_pylist()
            known = [k for k, t in enumerate(all_texts) if model and LETTER.search(t)]
            name, score, second = [NONE] * len(all_texts), np.zeros(len(all_texts)), np.zeros(len(all_texts))
            for at in range(0, len(known), 512):
                part = known[at : at + 512]
                best, p, q = decode(model, features([all_texts[k] for k in part]))
                score[part], second[part] = p, q
                for k, i in zip(part, best, strict=True):
                    name[k] = model["names"][i]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(name, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(second), pa.array(second > CLOSE * score)],
                ["doc_id", "lang_pred", "score", "runner_up", "ambiguous"],
            )

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, lang_pred string, score double, runner_up double, ambiguous boolean")


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """Fits on the rows that are not held out and predicts all rows: doc_id, held_out, lang_pred, score, ambiguous.

    held_out is an expression on doc_id.
    """
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predicted(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
