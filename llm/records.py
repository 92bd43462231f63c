"""Token ids in length-delimited binary files with an offset index.

A data file is a run of records, little-endian:

    length of the payload     8 bytes unsigned
    masked checksum of these  4 bytes
    payload                   doc_id (8 bytes signed), known (1 byte: 1 if there is an id), width (1 byte),
                              ids (unsigned, width bytes each: 2 if the record's ids fit, else 4)
    masked checksum of it     4 bytes

A masked checksum is CRC-32 turned right by 15 bits plus 0xA282EAD8, so that checksums of data that hold
checksums stay meaningful. The index file beside it has 24 bytes for each record: where it begins, its length
in bytes, and the number of ids before it in this file.

Documents are dealt out by ranges of doc_id and sorted inside, a range is one file. A task writes under a name
of its own attempt, and its row in the checkpointed manifest names the file it wrote; files of lost attempts
are in no manifest and so never read. Files go to the shared folder through pyarrow's file systems (local paths
and file:, hdfs:, s3:, gs: addresses).

Defined cases: null text has the end id alone; null ids come first; rows of equal id are ordered by the hash of
their text, repeated rows are written each; an empty table has no files; further columns don't matter.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from stockcount.scale import cut, shared_dir

from llm.files import opened
from llm.tokens import encoded

HEAD = 12
#: Bytes of text that a task encodes at once; sorting and file buffers need the rest of the memory.
AT_ONCE = 3_000_000
INDEX = np.dtype([("begin", "<u8"), ("size", "<u8"), ("ids_before", "<u8")])


def masked(data: bytes) -> int:
    """CRC-32 of the data, turned and shifted."""
    c = crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if len(ids) == 0 or ids.max() < 1 << 16 else 4
    payload = struct.pack("<qBB", doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids of one framed record; ValueError if a length or checksum is wrong."""
    if len(record) < HEAD + 4:
        raise ValueError("record is cut short")
    (size,) = struct.unpack_from("<Q", record)
    payload = record[HEAD:-4]
    if struct.unpack_from("<I", record, 8)[0] != masked(record[:8]) or size != len(payload):
        raise ValueError("length of a record is damaged")
    if struct.unpack("<I", record[-4:])[0] != masked(payload):
        raise ValueError("payload of a record is damaged")
    doc_id, known, width = struct.unpack_from("<qBB", payload)
    return doc_id if known else None, np.frombuffer(payload, dtype=f"<u{width}", offset=10).astype("<u4")


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the files and returns their manifest: file, n_records, n_ids, first_id (of all files), checkpointed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}"
        system, root = opened(folder)
        data, index, begin, ids_before, n = None, [], 0, 0, 0
        for rows, each in encoded(batches, tokenizer, end_id, AT_ONCE):
            if data is None:
                system.create_dir(root, recursive=True)
                data = system.open_output_stream(f"{root}/{name}.rec")
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), each, strict=True):
                record = frame(doc_id, ids)
                data.write(record)
                index.append((begin, len(record), ids_before))
                begin += len(record)
                ids_before += len(ids)
                n += 1
        if data is None:
            return
        data.close()
        with system.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.array(index, dtype=INDEX).tobytes())
        yield pa.RecordBatch.from_pydict(
            {"task": pa.array([context.partitionId()], pa.int32()), "file": [f"{folder}/{name}"], "n_records": [n], "n_ids": [ids_before]}
        )

    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie").select("doc_id", "text")
    written = cut(ordered.mapInArrow(task, "task int, file string, n_records long, n_ids long"))
    # One row per file.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return written.select("file", "n_records", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id"))


def index_of(manifest: DataFrame) -> DataFrame:
    """file, begin, size, start of every record, start counting the ids of all files before it."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in frames:
            for file, first in zip(files["file"], files["first_id"], strict=True):
                system, path = opened(file)
                with system.open_input_stream(f"{path}.idx") as f:
                    rows = np.frombuffer(f.read(), dtype=INDEX)
                columns = {"begin": rows["begin"], "size": rows["size"], "start": rows["ids_before"] + np.uint64(first)}
                yield pd.DataFrame({"file": file} | {k: v.astype(np.int64) for k, v in columns.items()})

    # A stated number of partitions is not put together again, however small the manifest: files are read side by side.
    spread = manifest.select("file", "first_id").repartition(max(1, manifest.count()), "file")
    return spread.mapInPandas(task, "file string, begin long, size long, start long")


def read_records(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of the records an index lists, in any order of its rows."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for wanted in frames:
            for file, rows in wanted.groupby("file", sort=False):
                system, path = opened(file)
                out = []
                with system.open_input_file(f"{path}.rec") as f:
                    for begin, size, start in zip(rows["begin"], rows["size"], rows["start"], strict=True):
                        doc_id, ids = unframe(f.read_at(size, begin))
                        out.append((doc_id, start, len(ids), crc32(ids)) + ((ids.astype(np.int32),) if with_ids else ()))
                part = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                yield part.astype({"doc_id": "Int64"})

    return index.select("file", "begin", "size", "start").mapInPandas(
        task, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    )


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in a random order that a seed fixes, for shuffled reads of single records."""
    return index.repartition(F.xxhash64("file", "begin", F.lit(seed))).sortWithinPartitions(F.xxhash64("file", "begin", F.lit(seed)))


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused folder's address under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the documents and reads every record back: doc_id, start, n_tokens, ids_crc32."""
    place = folder or new_folder(docs.sparkSession, "records")
    return read_records(index_of(write_records(docs, place, tokenizer, end_id)))
