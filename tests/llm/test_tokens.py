"""Tokenizing, packing and binary records against the tokenizer itself."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import packing, records
from llm.tokens import Encoder, vocabulary
from pyspark.sql.functions import spark_partition_id
from tokenizers import Tokenizer

from tests.llm.helpers import crc, docs_of, odd_rows, with_clashes

VOCABULARY = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


TRICKY = ["İstanbul ŞŞ", "ſ ẞ K", "áb é", "don't it's I'll x'S", "<|endoftext|> a<|startoftext|>b", "日本語 123 a1b2", " a b",
          "ÿ×÷ª º µ", "a‍b", "it'\ns", "' s", "a_b __", "\x1c\x1d a\x1eb \x85c", "﻿x", "e ́x", "Σς", "ß!ä"]


def test_words_give_the_ids_of_the_text(tokenizer):
    rng = random.Random(0)
    texts = TRICKY + [" ".join(rng.sample(TRICKY, 4)) for _ in range(200)] + [t or "" for _, t in odd_rows()]
    ids, bounds = Encoder.of(VOCABULARY).encode(pa.array(texts, pa.large_string()))
    assert Encoder.of(VOCABULARY).straight
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == ids_of(tokenizer, text, 0)[:-1], text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text(texts):
    ids, bounds = Encoder.of(VOCABULARY).encode(pa.array(texts, pa.large_string()))
    plain = Encoder.of(VOCABULARY).tokenizer
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_round_trip(spark, tokenizer):
    rows = odd_rows()
    got = packing.packed(with_clashes(docs_of(spark, rows)), VOCABULARY, end_id=1, with_ids=True).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    lengths = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 and crc(r.ids) == r.ids_crc32 for r in got)
    rebuilt = sorted((str(r.doc_id), r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got)
    expected = []
    for i, text in rows:
        ids, at = ids_of(tokenizer, text, 1), 0
        for n in packing.binary_lengths(len(ids)):
            expected.append((str(i), len(ids), at, n, crc(ids[at : at + n])))
            at += n
        assert at == len(ids)
    assert rebuilt == sorted(expected)


def test_packing_needs_a_power_of_two_and_takes_empty_tables(spark):
    with pytest.raises(ValueError):
        packing.packed(docs_of(spark, []), VOCABULARY, longest=1000)
    assert packing.packed(docs_of(spark, []), VOCABULARY).count() == 0


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 10_000])
def test_binary_lengths(n):
    lengths = packing.binary_lengths(n)
    assert sum(lengths) == n and all(x & (x - 1) == 0 for x in lengths) and len(lengths) <= n // 2048 + 11


def test_records_round_trip(spark, tokenizer, tmp_path):
    rows = odd_rows()
    docs = with_clashes(docs_of(spark, rows).repartition(5))
    manifest = records.write_records(docs, str(tmp_path / "r"), VOCABULARY, 2)
    index = records.index_of(manifest)
    got = sorted(records.read_records(index, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    expected = sorted((str(i), crc(ids_of(tokenizer, t, 2))) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == expected
    mixed = records.read_records(records.shuffled(index, 5)).collect()
    assert sorted(map(str, mixed)) == sorted(str(r) for r in records.read_records(index).collect())
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(rows)


def test_records_empty_table(spark, tmp_path):
    assert records.round_trip(docs_of(spark, []), VOCABULARY, 2, str(tmp_path / "r")).count() == 0


def test_damaged_records_are_found():
    record = records.frame(7, np.array([1, 2, 3], dtype=np.uint32))
    doc_id, ids = records.unframe(record)
    assert doc_id == 7 and ids.tolist() == [1, 2, 3] and struct.unpack_from("<Q", record)[0] == 10 + 6
    wide = records.unframe(records.frame(7, np.array([1, 1 << 20], dtype=np.uint32)))[1]
    assert wide.tolist() == [1, 1 << 20]
    assert records.unframe(records.frame(None, ids))[0] is None
    for k in range(len(record)):
        bad = bytearray(record)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))
    with pytest.raises(ValueError):
        records.unframe(record[:-1])


def test_files_are_read_back_side_by_side(spark, tmp_path):
    docs = docs_of(spark, [(k, f"text {k}") for k in range(400)]).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = records.write_records(docs, str(tmp_path / "r"), VOCABULARY, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # However few bytes the manifest has.
    rows = records.read_records(records.index_of(manifest)).select("start", spark_partition_id().alias("p")).collect()
    assert manifest.count() == 8 and len(rows) == 400 and len({r.p for r in rows}) > 3


def test_records_are_written_from_small_slices_of_text(tokenizer):
    from llm.batches import SLICE_BYTES
    from llm.tokens import encoded

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["word " * 50_000] * 40})
    sizes = [250_000 * len(each) for _, each in encoded(iter([batch]), VOCABULARY, 2, records.AT_ONCE)]
    assert sum(sizes) == 10_000_000 and max(sizes) <= records.AT_ONCE <= SLICE_BYTES // 2
