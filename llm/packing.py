"""Sequences of one document each, cut at powers of two.

A document of n tokens becomes floor(n / longest) pieces of the longest length, then one piece for each binary
digit of the rest, longest first. A piece fills a sequence of exactly its length, so nothing is padded and no
sequence crosses documents. Sequences of equal length are numbered one after the other, so a reader can take
batches of one length.

Tasks tokenize and cut on their own and count what they emit per length; only these counts (lengths x tasks)
meet to give each task the place its numbers start. The pieces are checkpointed before, so numbers don't depend
on a task that runs again.

Defined cases: null text is empty and has the end token alone; repeated rows are packed each; a null document
id stays null; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from stockcount.scale import cut

from llm.batches import SLICE_BYTES
from llm.tokens import encoded

LONGEST = 2048


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Whole longest pieces, then the binary digits of the rest, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = LONGEST, with_ids: bool = False, at_once: int = SLICE_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, task, nth (of its length in the task), and ids if wanted."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = TaskContext.get().partitionId(), dict.fromkeys(binary_lengths(2 * longest - 1, longest), 0)
        for rows, each in encoded(batches, tokenizer, end_id, at_once):
            owner, start, length, crc, nth, tokens = [], [], [], [], [], []
            for k, ids in enumerate(each):
                at = 0
                for n in binary_lengths(len(ids), longest):
                    owner.append(k)
                    start.append(at)
                    length.append(n)
                    piece = ids[at : at + n].astype("<u4")
                    crc.append(crc32(piece))
                    if with_ids:
                        tokens.append(piece)
                    nth.append(seen[n])
                    seen[n] += 1
                    at += n
            sizes = np.array([len(x) for x in each], dtype=np.int64)
            columns = [
                rows.column("doc_id").take(pa.array(owner)),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(sizes[owner]),
                pa.array([number] * len(owner), pa.int32()),
                pa.array(nth, pa.int64()),
            ] + ([pa.array(tokens, pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"] + ["ids"] * with_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"
    return docs.select("doc_id", "text").mapInArrow(task, schema + ", ids array<int>" * with_ids)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = LONGEST, with_ids: bool = False, at_once: int = SLICE_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0), and ids if wanted.

    A task works on ``at_once`` bytes of text. sequence_id counts from 0 without a gap, the longest sequences first.
    """
    cuts = cut(pieces(docs, tokenizer, end_id, longest, with_ids, at_once))
    before = Window.orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1)
    starts = cuts.groupBy("length", "task").count().select(
        F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first")
    )
    # One row per length and task: a dozen for each task.
    at = cuts.join(F.broadcast(starts), (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
    return at.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_first") + F.col("nth")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *["ids"] * with_ids,
    )
