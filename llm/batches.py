"""Work on the words of many texts at once inside a task, with Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 6_000_000


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows with at most ``most`` bytes of text (or one row), and their texts with null as empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: distinct words, codes of all words, bounds of each text."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not full.all():
            flat, owner = flat.filter(pa.array(full)), owner[full]
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct: list[str] = coded.dictionary.to_pylist()
        self.sizes = np.bincount(owner, minlength=len(texts))
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every bit of the input reaches every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
