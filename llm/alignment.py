"""Alignment of the tokens that two tokenizers make of a text, and how often tokens are linked over the corpus.

Byte offsets at which a token of A and one of B end cut a text into groups. A range of bytes sees the tokens that
end in it and yields a fragment: an open head up to its first common end, closed groups, and an open tail after its
last one. Fragments of neighbouring ranges compose: the left tail and the right head become a group. Composition
is associative, and a range without tokens is its identity, so fragments may be composed in any tree.

- Both tokenizers work on their own on what a single space begins, if no white space is around: no token crosses such a
  place. The smallest ranges are these units; each distinct one of a slice of texts is tokenized and aligned once.
- A text of up to ``LONG`` bytes is composed of the fragments of its units, which have no open ends, inside one task.
- A longer text is cut at units into segments, which spread over tasks. Each yields the fragments of its byte ranges of
  ``RANGE`` bytes. Closed groups stay as they are; only open ends go up a tree of ``FAN`` fragments at a time, in rounds.
  At last the groups of a text pass through one task in order, as a stream, for the digest alone.

The number of documents that hold a pair of ids linked is counted over partial counts of tasks. Counts of a checked
number of pairs are a file that workers read; beyond it links are joined with the counts.

Defined cases: null and empty texts, and those whose token bytes differ from the text in either tokenizer, have no tokens:
zeros and an empty digest; strings of special tokens inside a text are plain text; repeated rows are documents of their
own; ids may be null; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from stockcount.scale import cut, fits

from llm.batches import slices
from llm.files import opened
from llm.records import new_folder
from llm.text import broadcast_if_few, private
from llm.tokens import byte_alphabet

#: Bytes beyond which a text is spread over tasks, of a segment and of a range.
LONG, SEGMENT, RANGE = 65_536, 32_768, 4_096
FAN = 8
#: Units that go to the tokenizers in one run, bytes of text worked on at once, pairs a task counts before handing them on, pairs of a table of counts that workers read.
RUN = 1024
AT_ONCE, COUNTED, FEW_PAIRS = 1_500_000, 2_000_000, 8_000_000

Ids = tuple[int, ...]
Group = tuple[Ids, Ids]
NOTHING: Group = ((), ())


class Fragment(NamedTuple):
    """Tokens that end in a range of bytes. Without a common end all are in ``head`` and there is no tail."""

    head: Group = NOTHING
    closed: tuple[Group, ...] = ()
    tail: Group | None = None


def joined(x: Group, y: Group) -> Group:
    return (x[0] + y[0], x[1] + y[1])


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if x.tail is None:
        return Fragment(joined(x.head, y.head), y.closed, y.tail)
    if y.tail is None:
        return Fragment(x.head, x.closed, joined(x.tail, y.head))
    return Fragment(x.head, (*x.closed, joined(x.tail, y.head), *y.closed), y.tail)


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[bool, list[np.ndarray]]:
    """The fragment of the tokens of one range, with the byte offsets at which they end: whether there is a common end, then ids
    of head and tail (A's and B's each), ids of the closed groups one after the other, and the numbers of ids in each."""
    ends = np.intersect1d(a_ends, b_ends)
    if len(ends) == 0:
        return False, [a, b, *[a[:0]] * 6]
    p, q = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1
    return True, [a[: p[0]], b[: q[0]], a[p[-1] :], b[q[-1] :], a[p[0] : p[-1]], b[q[0] : q[-1]], np.diff(p), np.diff(q)]


def groups_of(whole: Fragment) -> list[Group]:
    """The groups of a whole text."""
    last = [whole.tail] if whole.tail not in (None, NOTHING) else []
    return [g for g in [whole.head, *whole.closed, *last] if g != NOTHING]


def unit_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Offsets in UTF-8 data at which a unit begins: where texts begin, and at single spaces between solid characters.

    Solid are printable ASCII and characters of the ranges that hold no white space; others are not asked about.
    """
    lead2, lead3, lead4 = (data >= 0xC3) & (data <= 0xDF), (data >= 0xE4) & (data <= 0xED), (data >= 0xF0) & (data <= 0xF4)
    plain = (data > 0x20) & (data < 0x7F)
    after = np.append((plain | lead2 | lead3 | lead4)[1:], False)
    before = np.zeros(len(data), dtype=bool)
    for back, kind in ((1, plain), (2, lead2), (3, lead3), (4, lead4)):
        before[back:] |= kind[:-back] if len(data) > back else False
    starts = (data == 0x20) & after & before
    starts[firsts] = True
    return np.flatnonzero(starts)


class Units(NamedTuple):
    """Aligned units. Ids and linked pairs are one after the other, with the bounds of each unit's; those of a unit that is not
    ``sound``, because a tokenizer does not give its bytes back, are none."""

    sound: np.ndarray
    a: np.ndarray
    a_bounds: np.ndarray
    b: np.ndarray
    b_bounds: np.ndarray
    n_groups: np.ndarray
    pairs: np.ndarray
    pair_bounds: np.ndarray
    texts: list[str]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` numbers."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _reordered(sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the members of groups of the given sizes when the groups are put into another order."""
    return _spans((np.cumsum(sizes) - sizes)[order], sizes[order])


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class _Entries:
    """Bytes of a vocabulary's entries, and their numbers as text with what follows inside a group and at its end."""

    def __init__(self, entries: list[bytes], last: str) -> None:
        self.sizes = np.array([len(x) for x in entries], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        numbers = range(len(entries))
        self.inside, self.last = (np.array([f"{i}{x}" for i in numbers], dtype=object) for x in (",", last))

    def tokens(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and how many each unit has."""
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.int64, int(n.sum())), n

    def given_back(self, ids: np.ndarray, n: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which units' tokens are the unit's bytes."""
        bounds = _bounds(n)
        same = _summed(self.sizes[ids], bounds) == sizes
        of_same = np.repeat(same, n)
        ids = ids[of_same]
        ours = self.data[_spans(self.starts[ids], self.sizes[ids])]
        theirs = data[np.repeat(same, sizes)]
        unit = np.repeat(np.flatnonzero(same), sizes[same])
        same[unit[ours != theirs]] = False
        return same


class Aligner:
    """Both tokenizers; one for each worker and pair of vocabulary files."""

    _own: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        special = self.a.get_added_tokens_decoder()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.of_a = _Entries([c.encode() if i in special else bytes(byte_of[x] for x in c) for i, c in enumerate(entries)], "|")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.of_b = _Entries([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], ";")
        # No piece may go on after white space, or units would not stand alone.
        self.alone = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size = len(pieces)

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._own:
            cls._own[path_a, path_b] = cls(path_a, path_b)
        return cls._own[path_a, path_b]

    def encoded(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids of A and how many each run of bytes has, the same of B, and whether both give the run's bytes back."""
        runs = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        texts, sizes = runs.to_pylist(), np.diff(bounds)
        a, n_a = self.of_a.tokens([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        b, n_b = self.of_b.tokens(self.b.encode([t[1:] for t in texts], num_threads=1) if texts else [])
        held = data[bounds[0] : bounds[-1]]
        return a, n_a, b, n_b, self.of_a.given_back(a, n_a, held, sizes) & self.of_b.given_back(b, n_b, held, sizes)

    def aligned(self, distinct: pa.Array) -> Units:
        """The given units, each of which begins with a space.

        Neighbours go to the tokenizers in one run, as long as a unit may begin where they meet. A run that does not come back
        whole is taken apart into its units.
        """
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)[: offsets[-1]]
        sizes, each = np.diff(offsets), np.arange(len(distinct))
        safe = np.zeros(len(data) + 1, dtype=bool)
        if self.alone and len(data):
            safe[unit_starts(data, np.array([0]))] = True
        heads = np.flatnonzero(~safe[offsets[:-1]] | (each % RUN == 0))
        a, n_a, b, n_b, whole = self.encoded(data, offsets[np.append(heads, len(distinct))])
        sound = np.repeat(whole, np.diff(np.append(heads, len(distinct))))
        if not whole.all():
            apart = each[~sound]
            units = pc.take(distinct, pa.array(apart))
            held = np.frombuffer(units.buffers()[2], np.uint8)
            c, n_c, d, n_d, single = self.encoded(held, np.frombuffer(units.buffers()[1], np.int64)[: len(units) + 1])
            # Sound runs and units in the order of their first unit.
            order = np.argsort(np.concatenate([heads[whole], apart[single]]), kind="stable")
            merge = lambda x, n, y, m: np.concatenate([x[np.repeat(whole, n)], y[np.repeat(single, m)]])[_reordered(np.concatenate([n[whole], m[single]]), order)]
            a, b = merge(a, n_a, c, n_c), merge(b, n_b, d, n_d)
            sound[apart] = single
        ends = np.cumsum(np.where(sound, sizes, 0))
        # Offsets run over all sound units: each unit's end is a common one.
        a_ends, b_ends = np.cumsum(self.of_a.sizes[a]), np.cumsum(self.of_b.sizes[b])
        n_a, n_b = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (a_ends, b_ends))
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_last, b_last = np.searchsorted(a_ends, common) + 1, np.searchsorted(b_ends, common) + 1
        g_a, g_b = np.diff(a_last, prepend=0), np.diff(b_last, prepend=0)
        n_groups = np.diff(np.searchsorted(common, ends, "right"), prepend=0)
        n_links = _summed(g_a * g_b, _bounds(n_groups))
        pairs, shown = self.linked(a, b, g_a, g_b), self.shown(a, b, g_a, g_b)
        bounds = _bounds(n_a + n_b).tolist()
        texts = ["".join(shown[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return Units(sound, a, _bounds(n_a), b, _bounds(n_b), n_groups, pairs, _bounds(n_links), texts)

    def linked(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The pairs of each group of ``n`` ids of A and ``m`` of B, as one number a pair."""
        links = n * m
        group = np.repeat(np.arange(len(n)), links)
        nth = _spans(np.zeros(len(n), dtype=np.int64), links)
        return a[(np.cumsum(n) - n)[group] + nth // m[group]] * self.size + b[(np.cumsum(m) - m)[group] + nth % m[group]]

    def shown(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[str]:
        """Ids as text, group by group: A's, the last with a bar, then B's, the last with a semicolon."""
        out = np.empty(len(a) + len(b), dtype=object)
        a_last, b_last = np.cumsum(n), np.cumsum(m)
        at_a, at_b = np.arange(len(a)) + np.repeat(b_last - m, n), np.arange(len(b)) + np.repeat(a_last, m)
        out[at_a], out[at_b] = self.of_a.inside[a], self.of_b.inside[b]
        out[at_a[a_last - 1]], out[at_b[b_last - 1]] = self.of_a.last[a[a_last - 1]], self.of_b.last[b[b_last - 1]]
        return out.tolist()

    def split(self, texts: pa.Array) -> tuple[Units, np.ndarray, np.ndarray]:
        """Distinct units of texts that each begin with a space, codes of all units, and bounds of each text's units."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]
        starts = unit_starts(data, offsets[:-1]) if self.alone else offsets[:-1]
        bounds = np.append(starts, offsets[-1])
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), texts.buffers()[2]])
        coded = units.dictionary_encode()
        return self.aligned(coded.dictionary), coded.indices.to_numpy(), np.searchsorted(starts, offsets)


def spaced(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))


def _gathered(flat: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the coded units one after the other, and how many each has."""
    n = np.diff(bounds)[codes]
    return flat[_spans(bounds[codes], n)], n


def _summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def short_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """SUMMARY of each row, with its distinct linked pairs and how often it holds each (pairs, times)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        for rows, texts in slices(batches, most=AT_ONCE):
            held = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
            # An empty text is a single space here.
            units, codes, bounds = aligner.split(spaced(texts))
            sound = held & (_summed(~units.sound[codes], bounds) == 0)
            numbers = [np.diff(units.a_bounds), np.diff(units.b_bounds), units.n_groups, np.diff(units.pair_bounds)]
            sums = [np.where(sound, _summed(x[codes], bounds), 0) for x in numbers]
            digests, listed = [], codes.tolist()
            for good, x, y in zip(sound.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                whole = "".join([units.texts[c] for c in listed[x:y]])[:-1] if good else ""
                digests.append(sha256(whole.encode()).hexdigest() if good else "")
            good = np.repeat(sound, np.diff(bounds))
            flat, n = _gathered(units.pairs, units.pair_bounds, codes[good])
            owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[good]
            keyed, times = np.unique(np.repeat(owner, n) << 32 | flat, return_counts=True)
            ends = np.searchsorted(keyed, np.arange(len(texts) + 1) << 32).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").cast(pa.int64()),
                    *[pa.array(x, pa.int64()) for x in sums],
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keyed & 0xFFFFFFFF, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(times, pa.int32())),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return docs.select("doc_id", "text").mapInArrow(task, f"{SUMMARY}, pairs array<int>, times array<int>")


def segments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key (of the row), doc_id, start, piece: long texts, with a space before, cut at units every SEGMENT bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, key = Aligner.of(path_a, path_b).alone, TaskContext.get().partitionId() << 33
        for rows, texts in slices(batches, most=AT_ONCE):
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                raw = b" " + text.as_py().encode()
                starts = unit_starts(np.frombuffer(raw, np.uint8), np.array([0])) if alone else np.array([0])
                at = np.unique(np.searchsorted(starts, np.arange(0, len(raw), SEGMENT)))
                cuts = starts[at[at < len(starts)]].tolist()
                for some in range(0, len(cuts), 64):
                    part = cuts[some : some + 64]
                    ends = [*cuts[some + 1 : some + 64], *([cuts[some + 64]] if some + 64 < len(cuts) else [len(raw)])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(part), pa.int64()), pa.array([doc_id] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array([raw[a:b] for a, b in zip(part, ends, strict=True)], pa.binary())],
                        ["key", "doc_id", "start", "piece"],
                    )
                key += 1

    return docs.select("doc_id", "text").mapInArrow(task, "key long, doc_id long, start long, piece binary")


FRAGMENT = "key long, at long, sound boolean, closing boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, a array<int>, b array<int>, n_a array<int>, n_b array<int>"


def range_fragments(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """FRAGMENT rows: the fragment of each byte range of a segment; closed groups are ids and sizes, one after the other."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner.of(path_a, path_b)
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                units, codes, _ = aligner.split(pa.array([r.piece], pa.large_binary()))
                if not units.sound.all():
                    out.append((r.key, r.start, False, False, *[[]] * 8))
                    continue
                a, _ = _gathered(units.a, units.a_bounds, codes)
                b, _ = _gathered(units.b, units.b_bounds, codes)
                a_ends, b_ends = r.start + np.cumsum(aligner.of_a.sizes[a]), r.start + np.cumsum(aligner.of_b.sizes[b])
                last = r.start + len(r.piece)
                # A range holds the tokens that end after its first byte's offset, up to the next range's.
                for low in [r.start, *range((r.start // RANGE + 1) * RANGE, last, RANGE)]:
                    high = min((low // RANGE + 1) * RANGE, last)
                    (i, j), (k, m) = np.searchsorted(a_ends, [low, high], "right"), np.searchsorted(b_ends, [low, high], "right")
                    closing, parts = fragment(a[i:j], a_ends[i:j], b[k:m], b_ends[k:m])
                    out.append((r.key, low, True, closing, *parts))
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in FRAGMENT.split(", ")]
    return pieces.select("key", "start", "piece").mapInPandas(task, FRAGMENT)


OPEN = "key long, no long, closing boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, tail_at long"


def _folded(frame: pd.DataFrame) -> pd.DataFrame:
    """Composes the open ends of neighbouring fragments: one row of open ends, and a row for each group that closes."""
    ids = lambda x: tuple(np.asarray(x, dtype=np.int64).tolist())
    whole, tail_at, rows = Fragment(), 0, []
    for r in frame.sort_values("no").itertuples(index=False):
        part = Fragment((ids(r.head_a), ids(r.head_b)), (), (ids(r.tail_a), ids(r.tail_b)) if r.closing else None)
        whole = compose(whole, part)
        rows += [(tail_at, *g) for g in whole.closed]
        whole = whole._replace(closed=())
        if r.closing:
            tail_at = r.tail_at
    key, no = int(frame["key"].iloc[0]), int(frame["no"].iloc[0]) // FAN
    tail = whole.tail or NOTHING
    out = [(key, no, whole.tail is not None, *whole.head, *tail, tail_at, False)]
    out += [(key, no, True, a, b, (), (), at, True) for at, a, b in rows]
    return pd.DataFrame(out, columns=[*[c.split()[0] for c in OPEN.split(", ")], "group"])


def composed(fragments: DataFrame) -> DataFrame:
    """key, at, part, a, b, n_a, n_b: the groups of each text in the order of (at, part), from fragments of sound texts."""
    order = Window.partitionBy("key").orderBy("at")
    one = lambda a, b: [F.col(a).alias("a"), F.col(b).alias("b"), F.array(F.size(a)).alias("n_a"), F.array(F.size(b)).alias("n_b")]
    found = fragments.where("size(n_a) > 0").select("key", "at", F.lit(1).alias("part"), "a", "b", "n_a", "n_b")
    now = cut(
        fragments.select("key", (F.row_number().over(order) - 1).cast("long").alias("no"), "closing", "head_a", "head_b", "tail_a", "tail_b", F.col("at").alias("tail_at"))
    )
    while (now.agg(F.max("no")).first()[0] or 0) > 0:
        out = cut(now.groupBy("key", F.floor(F.col("no") / FAN).alias("_up")).applyInPandas(lambda _, x: _folded(x), f"{OPEN}, group boolean"))
        met = out.where("group").select("key", F.col("tail_at").alias("at"), F.lit(2).alias("part"), *one("head_a", "head_b"))
        found = found.unionByName(met)
        now = out.where("not group").drop("group")
    first = now.where("size(head_a) > 0").select("key", F.lit(0).cast("long").alias("at"), F.lit(0).alias("part"), *one("head_a", "head_b"))
    last = now.where("size(tail_a) > 0 or size(tail_b) > 0").select("key", F.col("tail_at").alias("at"), F.lit(2).alias("part"), *one("tail_a", "tail_b"))
    return found.unionByName(first).unionByName(last)


def _numbers(r) -> list[np.ndarray]:
    """Ids of A and B of a row of groups, and how many of each a group has."""
    return [np.asarray(x, dtype=np.int64) for x in (r.a, r.b, r.n_a, r.n_b)]


def digests(groups: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key and the numbers of SUMMARY: each text's groups pass in order; nothing but sums and the digest is held."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, key, done, state, sums = Aligner.of(path_a, path_b), None, [], None, None
        names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.key != key:
                    if state:
                        done.append((key, *sums.tolist(), state.hexdigest()))
                    key, state, sums = r.key, sha256(), np.zeros(4, dtype=np.int64)
                a, b, n, m = _numbers(r)
                state.update((";" * bool(sums[2]) + "".join(aligner.shown(a, b, n, m))[:-1]).encode())
                sums += (len(a), len(b), len(n), int((n * m).sum()))
            yield pd.DataFrame(done, columns=names)
            done = []
        if state:
            yield pd.DataFrame([(key, *sums.tolist(), state.hexdigest())], columns=names)

    ordered = groups.repartition("key").sortWithinPartitions("key", "at", "part")
    return ordered.mapInPandas(task, "key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")


def links(groups: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key, pair, times: how often a text holds a pair linked."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner.of(path_a, path_b)
        for frame in frames:
            for r in frame.itertuples(index=False):
                pair, times = np.unique(aligner.linked(*_numbers(r)), return_counts=True)
                yield pd.DataFrame({"key": r.key, "pair": pair, "times": times})

    return groups.mapInPandas(task, "key long, pair long, times long").groupBy("key", "pair").agg(F.sum("times").alias("times"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, n: partial counts of the rows whose ``pairs`` hold a pair."""

    def merged(pairs: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
        return pair, np.bincount(at, np.concatenate(counts), len(pair)).astype(np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            pair, n = np.unique(batch.column("pairs").flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            pairs, counts, held = [*pairs, pair], [*counts, n], held + len(pair)
            if held > COUNTED:
                pair, n = merged(pairs, counts)
                if len(pair) > COUNTED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])
                    pair, n = pair[:0], n[:0]
                pairs, counts, held = [pair], [n], len(pair)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged(pairs, counts)], ["pair", "n"])

    return texts.select("pairs").mapInArrow(task, "pair long, n long")


class _Counts:
    """Pairs, counts and marks of a written table, read once by a worker."""

    _own: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, address: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if address not in cls._own:
            system, path = opened(address)
            table = pq.read_table(path, filesystem=system)
            pair = table.column("pair").to_numpy()
            order = np.argsort(pair)
            cls._own = {address: (pair[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order])}
        return cls._own[address]


def _scored(texts: DataFrame, address: str) -> DataFrame:
    """``texts`` with n_best and count_sum in place of pairs and times, from a table of counts that workers read."""
    kept = [c for c in texts.columns if c not in ("pairs", "times")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name in kept)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = _Counts.of(address)
        for batch in batches:
            lists = batch.column("pairs")
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = np.searchsorted(pair, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sums = [_summed(times * best[at], bounds), _summed(times * n[at], bounds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(x, pa.int64()) for x in sums]], [*kept, "n_best", "count_sum"])

    return texts.mapInArrow(task, f"{schema}, n_best long, count_sum long")


def _scored_by_join(found: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """key, n_best, count_sum of (key, pair, times) rows."""
    met = found.join(broadcast_if_few(counts), "pair")
    return met.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def _written(df: DataFrame, spark: SparkSession, name: str) -> tuple[DataFrame, str]:
    place = new_folder(spark, name)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place), place


def aligned(docs: DataFrame, path_a: str, path_b: str, long: int = LONG, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """SUMMARY of each row of ``docs`` with n_best and count_sum; A's file is byte-level BPE, B's a SentencePiece model."""
    spark, aligner = docs.sparkSession, Aligner.of(path_a, path_b)
    size = aligner.size
    if len(aligner.of_a.sizes) * size >= 1 << 31:
        raise ValueError("a pair of ids must fit into 31 bits")
    docs = private(docs, "doc_id", "text")
    is_long = F.coalesce(F.octet_length("text") > long, F.lit(False))
    short, _ = _written(short_texts(docs.where(~is_long), path_a, path_b), spark, "aligned")
    pieces = cut(segments(docs.where(is_long), path_a, path_b))
    fragments = cut(range_fragments(pieces.repartition("key", "start"), path_a, path_b))
    sound = fragments.groupBy("key").agg(F.min("sound").alias("sound"))
    unsound = broadcast_if_few(cut(sound.where("not sound").select("key")))
    groups = cut(composed(fragments.join(unsound, "key", "left_anti")))
    found = cut(links(groups, path_a, path_b))
    numbers = digests(groups, path_a, path_b)

    counts = pair_counts(short).unionByName(found.groupBy("pair").agg(F.count("key").alias("n"))).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("a", F.floor(F.col("pair") / size)))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts, place = _written(counts.join(broadcast_if_few(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), spark, "pair-counts")

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if fits(counts, few_pairs):
        short_out = _scored(short, place)
    else:
        rows = cut(short.withColumn("row", F.monotonically_increasing_id()))
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        short_out = rows.join(_scored_by_join(each, counts, "row"), "row", "left")
    zero = F.lit(0).cast("long")
    whole = pieces.where("start = 0").select("key", "doc_id").join(numbers, "key", "left").join(_scored_by_join(found, counts, "key"), "key", "left")
    both = short_out.select(*columns).unionByName(whole.select(*columns))
    return both.select("doc_id", *[F.coalesce(c, zero).alias(c) for c in columns[1:-1]], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
