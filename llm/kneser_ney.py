"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark, read from mapped files.

Counting. A task turns its texts into 64-bit word hashes and its word pairs into distinct pairs with counts, and
packs these by bucket into binary blocks: left hashes once with run lengths, right hashes, counts. A bucket is chosen by the left
word and a part of the right word, so the most frequent word's pairs are spread over at least ``SALT`` buckets, more with more of them. One task per bucket merges its
blocks, writes the bucket's pairs as two files, sorted 64-bit pair hashes and their counts, and emits per word
what the pairs add to its statistics; these meet in a second aggregation and are written as sorted tables too.

Model. With c the counts, n1 n2 n3 the numbers of words seen once, twice, more often after h, and N(w) the number
of words seen before w:

    p(w | h) = (c(h w) - D(c(h w))) / c(h) + (D1 n1(h) + D2 n2(h) + D3 n3(h)) / c(h) * p(w)
    p(w)     = (N(w) - E(N(w))) / sum of N + (E1 t1 + E2 t2 + E3 t3) / sum of N / (V + 1)

The discounts D and E are the usual ones from counts of counts. A word never seen has the uniform share alone; a word h
never seen on the left leaves p(w). Texts begin after a mark that is only ever on the left.

Scoring. Workers map the files (numpy memmap) of a local or mounted shared folder; on other stores a worker reads
a bucket's file into memory when it is first asked for.

Word hashes stand for words; two words of one hash would share their statistics. The order of the model is 2.

Defined cases: null or empty text is the end mark alone; without training rows every token has the uniform
probability of one unknown word; repeated rows count each time; further columns don't matter.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from stockcount.scale import shared_dir

from llm.batches import Words, mixed, slices
from llm.files import opened
from llm.text import LOWER, UPPER

#: Least number of parts over which the pairs of one left word are spread; it grows with the buckets.
SALT = 8
#: Bytes of text a bucket's pairs come from, about.
BUCKET_BYTES = 24_000_000
#: Hashes of the two marks; words' hashes are those of their UTF-8 bytes.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
STATS = ["n1", "n2", "n3", "left", "before", "count"]


def _folded(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, byte by byte; other letters keep their case."""
    offsets, data = texts.buffers()[1], texts.buffers()[2]
    if data is None:
        return texts
    low = FOLD[np.frombuffer(data, dtype=np.uint8)]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(low)], offset=texts.offset)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text ending with the end mark, and the bounds of the texts."""
    words = Words(_folded(texts))
    by_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words.distinct), dtype=np.uint64, count=len(words.distinct))
    bounds = words.bounds + np.arange(len(words.bounds))
    out = np.full(bounds[-1], END, dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[bounds[1:] - 1] = False
    out[inner] = by_word[words.codes]
    return out, bounds


def _lefts(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    left = np.empty_like(tokens)
    left[1:] = tokens[:-1]
    left[bounds[:-1]] = START
    return left


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def bucket_of(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        part = (right >> np.uint64(7)) % np.uint64(max(SALT, buckets // 8))
        return (mixed(left + part * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(buckets)).astype(np.int64)


def _summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs sorted by left and right, with summed counts."""
    order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    new = np.ones(len(left), dtype=bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    return left[at], right[at], np.add.reduceat(counts, at) if len(at) else counts


def _packed(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    at = np.flatnonzero(np.diff(left, prepend=~left[:1]) != 0)
    runs = np.diff(np.append(at, len(left)))
    many = np.flatnonzero(counts > 1)
    return {
        "lefts": left[at].tobytes(),
        "runs": runs.astype("<u4").tobytes(),
        "rights": right.tobytes(),
        "many": many.astype("<u4").tobytes() + counts[many].astype("<u8").tobytes(),
    }


def _unpacked(block: pd.Series | dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left = np.repeat(np.frombuffer(block["lefts"], "<u8"), np.frombuffer(block["runs"], "<u4"))
    right = np.frombuffer(block["rights"], "<u8")
    counts, many = np.ones(len(right), dtype=np.int64), block["many"]
    n = len(many) // 12
    counts[np.frombuffer(many, "<u4", n)] = np.frombuffer(many, "<u8", n, 4 * n)
    return left, right, counts


def pair_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket and a block of pairs; about one block per task and bucket, of bounded size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            left, right, counts = _summed(*[np.concatenate(x) for x in zip(*held, strict=True)])
            bucket = bucket_of(left, right, buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                if ends[b] < ends[b + 1]:
                    own = order[ends[b] : ends[b + 1]]
                    block = _packed(left[own], right[own], counts[own])
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in block.items()})
            held.clear()

        tokens_held = 0
        for _, texts in slices(batches):
            tokens, bounds = token_hashes(texts)
            held.append(_summed(_lefts(tokens, bounds), tokens, np.ones(len(tokens), dtype=np.int64)))
            tokens_held += len(held[-1][0])
            if tokens_held > 5_000_000:
                yield from emit()
                tokens_held = 0
        if held:
            yield from emit()

    return docs.select("text").mapInArrow(task, "bucket int, lefts binary, runs binary, rights binary, many binary")


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each, after a byte that says how many."""
    most = int(counts.max()) if len(counts) else 0
    size = next(n for n in (1, 2, 4, 8) if most < 1 << 8 * n)
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _rows(block: bytes, n: int) -> list[np.ndarray]:
    """The arrays of n counts that ``_narrow`` made, one after the other."""
    out, at = [], 0
    while at < len(block):
        out.append(np.frombuffer(block, f"<u{block[at]}", n, at + 1))
        at += 1 + block[at] * n
    return out


def _write(folder: str, name: str, array: np.ndarray) -> None:
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")


def _mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    system, root = opened(folder)
    if isinstance(system, fs.LocalFileSystem):
        try:
            return np.memmap(f"{root}/{name}", dtype=dtype, mode="r")
        except ValueError:  # an empty file can't be mapped
            return np.zeros(0, dtype)
    with system.open_input_stream(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def merge_pairs(blocks: DataFrame, folder: str, parts: int) -> DataFrame:
    """Writes each bucket's sorted pairs; emits what they add to the statistics of words, by part of the words.

    Rows: part, at (first row of the statistics they add to), words, stats; and for each bucket one row of part
    -1 that has in ``info`` its bucket, file and numbers of pairs seen once to four times.
    """

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        blocks_of = [_unpacked(b) for b in frame.to_dict("records")]
        left, right, counts = _summed(*[np.concatenate(x) for x in zip(*blocks_of, strict=True)])
        del blocks_of
        bucket = int(frame["bucket"].iloc[0])
        keys = pair_hash(left, right)
        order = np.argsort(keys)
        numbers = _narrow(counts[order])
        file = f"pairs-{bucket:06d}-{uuid.uuid4().hex}-{numbers[0]}"  # the last part: bytes of a count
        _write(folder, f"{file}.key", keys[order])
        _write(folder, f"{file}.num", np.frombuffer(numbers, np.uint8, offset=1))
        del keys, order
        seen = np.bincount(np.minimum(counts, 5), minlength=6)
        out = [(-1, 0, b"", b"", json.dumps({"bucket": bucket, "file": file} | {f"c{k}": int(seen[k]) for k in (1, 2, 3, 4)}))]
        kinds = np.minimum(counts, 3)
        word, where = np.unique(left, return_inverse=True)
        lefts = [np.bincount(where, kinds == k, len(word)) for k in (1, 2, 3)] + [np.bincount(where, counts, len(word))]
        other, where = np.unique(right, return_inverse=True)
        rights = [np.bincount(where, minlength=len(other)), np.bincount(where, counts, len(other))]
        for words, at, stats in ((word, 0, lefts), (other, 4, rights)):
            ends = np.searchsorted(_part(words, parts), np.arange(parts + 1))
            for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if a < b:
                    out.append((p, at, words[a:b].tobytes(), b"".join(_narrow(x[a:b]) for x in stats), ""))
        return pd.DataFrame(out, columns=["part", "at", "words", "stats", "info"])

    return blocks.groupBy("bucket").applyInPandas(merge, "part int, at int, words binary, stats binary, info string")


def merge_words(rows: DataFrame, folder: str) -> DataFrame:
    """Sums the statistics of each part's words and writes them; emits part and info (of a part, or of a bucket)."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        if part < 0:
            return frame[["part", "info"]]
        words = [np.frombuffer(x, "<u8") for x in frame["words"]]
        word, where = np.unique(np.concatenate(words), return_inverse=True)
        table, done = np.zeros((6, len(word)), dtype=np.int64), 0
        for w, at, stats in zip(words, frame["at"], frame["stats"], strict=True):
            own = where[done : done + len(w)]
            done += len(w)
            for k, row in enumerate(_rows(stats, len(w))):
                table[at + k, own] += row.astype(np.int64)
        file = f"words-{part:06d}-{uuid.uuid4().hex}"
        _write(folder, f"{file}.key", word)
        for name, row in zip(STATS, table.astype("<i8"), strict=True):
            _write(folder, f"{file}.{name}", row)
        before = table[4]
        seen = np.bincount(np.minimum(before, 5), minlength=6)
        info = {"file": file, "types": (table[5] > 0).sum(), "tokens": table[5].sum(), "pairs": before.sum(), "more": (before > 2).sum()}
        info |= {f"c{k}": seen[k] for k in (1, 2, 3, 4)}
        return pd.DataFrame({"part": [part], "info": [json.dumps({k: v if k == "file" else int(v) for k, v in info.items()})]})

    return rows.groupBy("part").applyInPandas(merge, "part int, info string")


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    return (words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def discounts(c1: float, c2: float, c3: float, c4: float) -> list[float]:
    """D for counts 1, 2 and more; fixed ones where the counts of counts don't allow the estimate."""
    usual = [0.5, 1.0, 1.5]
    if min(c1, c2, c3, c4) <= 0:
        return usual
    y = c1 / (c1 + 2 * c2)
    found = [1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3]
    return [d if 0 <= d <= k else u for k, d, u in zip((1, 2, 3), found, usual, strict=True)]


def fit(docs: DataFrame, folder: str | None = None) -> dict:
    """Counts the model of all ``docs`` and returns what scoring needs: places of files and a few totals."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/ngrams-{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    parts = max(2, buckets // 4)
    # A row for each bucket and each part of the words. A task that runs again writes files of new names and equal content.
    found = merge_words(merge_pairs(pair_blocks(docs, buckets), folder, parts), folder).collect()
    pairs = [json.loads(r["info"]) for r in found if r["part"] < 0]
    words = {r["part"]: json.loads(r["info"]) for r in found if r["part"] >= 0}
    total = lambda rows, name: sum(r[name] for r in rows)
    return {
        "folder": folder, "buckets": buckets, "parts": parts,
        "pair_files": {r["bucket"]: r["file"] for r in pairs}, "word_files": {p: r["file"] for p, r in words.items()},
        "types": total(words.values(), "types"), "tokens": total(words.values(), "tokens"), "pairs": total(words.values(), "pairs"),
        "d": discounts(*[float(total(pairs, f"c{k}")) for k in (1, 2, 3, 4)]),
        "e": discounts(*[float(total(words.values(), f"c{k}")) for k in (1, 2, 3, 4)]),
        "t": [total(words.values(), "c1"), total(words.values(), "c2"), total(words.values(), "more")],
    }


class Model:
    """Probabilities from mapped files; one for each worker and model."""

    _own: dict[str, Model] = {}

    def __init__(self, m: dict) -> None:
        self.m = m
        self.files: dict[tuple, np.ndarray] = {}
        self.rest = 1.0 if not m["pairs"] else sum(e * t for e, t in zip(m["e"], m["t"], strict=True)) / m["pairs"]

    @classmethod
    def of(cls, m: dict) -> Model:
        if m["folder"] not in cls._own:
            cls._own.clear()
            cls._own[m["folder"]] = cls(m)
        return cls._own[m["folder"]]

    def _file(self, name: str, dtype: str) -> np.ndarray:
        if name not in self.files:
            self.files[name] = _mapped(self.m["folder"], name, dtype)
        return self.files[name]

    def _found(self, sorted_keys: np.ndarray, files: dict, groups: np.ndarray, columns: list[str]) -> dict[str, np.ndarray]:
        """Columns of the given keys (0 where absent); each key's file is that of its group."""
        out = {c: np.zeros(len(sorted_keys), dtype=np.int64) for c in columns}
        order = np.argsort(groups, kind="stable")
        own = groups[order]
        for g in np.unique(own):
            if int(g) not in files:
                continue
            at = order[np.searchsorted(own, g) : np.searchsorted(own, g, side="right")]
            stem = files[int(g)]
            keys, wanted = self._file(f"{stem}.key", "<u8"), sorted_keys[at]
            place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            hit = keys[place] == wanted if len(keys) else np.zeros(len(wanted), bool)
            for c in columns:
                dtype = f"<u{stem.rsplit('-', 1)[1]}" if c == "num" else "<i8"
                out[c][at[hit]] = self._file(f"{stem}.{c}", dtype)[place[hit]]
        return out

    def words(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        return self._found(hashes, self.m["word_files"], _part(hashes, self.m["parts"]), STATS)

    def score(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of each token after the one before it, and its count in training."""
        m, left = self.m, _lefts(tokens, bounds)
        distinct, code = np.unique(np.concatenate([tokens, np.array([START])]), return_inverse=True)
        w = self.words(distinct)
        right_code = code[:-1]
        left_code = np.empty_like(right_code)
        left_code[1:] = right_code[:-1]
        left_code[bounds[:-1]] = code[-1]
        d, e = np.array([0.0, *m["d"]]), np.array([0.0, *m["e"]])
        before = w["before"]
        low = (before - e[np.minimum(before, 3)]) / max(m["pairs"], 1) + self.rest / (m["types"] + 1)
        pairs = pair_hash(left, tokens)
        pair, first, back = np.unique(pairs, return_index=True, return_inverse=True)
        seen = self._found(pair, m["pair_files"], bucket_of(left[first], tokens[first], m["buckets"]), ["num"])["num"][back]
        total = w["left"][left_code]
        gamma = (d[1] * w["n1"] + d[2] * w["n2"] + d[3] * w["n3"])[left_code]
        with np.errstate(divide="ignore", invalid="ignore"):
            high = np.where(total > 0, (seen - d[np.minimum(seen, 3)]) / total, 0.0)
            share = np.where(total > 0, gamma / total, 1.0)
        return np.log10(high + share * low[right_code]), w["count"][right_code]


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    n, v = model["tokens"], model["types"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(model)
        for rows, texts in slices(batches):
            tokens, bounds = token_hashes(texts)
            logs, counts = own.score(tokens, bounds)
            base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
            per_text = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has a token
            size = np.diff(bounds)
            score = per_text(logs)
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(per_text((counts > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(size), n, dtype=np.int64)), "base_score": pa.array(per_text(base)),
                "score": pa.array(score), "perplexity": pa.array(10 ** (-score / size)),
            })

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select("doc_id", "text").mapInArrow(task, schema)


def held_out_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; -1 without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def train_and_score(docs: DataFrame, folds: int = 10, fold: int = 0) -> DataFrame:
    """Trains on the rows outside the fold and scores all: held_out beside the columns of ``scored``."""
    in_fold = held_out_fold(F.col("doc_id"), folds) == fold
    return scored(docs, fit(docs.where(~in_fold).select("text"))).withColumn("held_out", in_fold)
