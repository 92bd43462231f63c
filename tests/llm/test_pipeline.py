"""Every stage of the pipeline against brute force over what the stage before kept."""

import inspect

import corpus_pipeline
from llm.packing import binary_lengths
from llm.queries import OP7_SQL
from llm.tokens import vocabulary
from tokenizers import Tokenizer

from tests.compare import duck
from tests.llm.helpers import DOC_SCHEMA, crc, docs_of, jaccard_brute, odd_rows
from tests.llm.test_native import LOWER, leaks_brute

SF = "/root/testdata/sf0.001"


def without_shared_lines(rows):
    holders = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    stays = lambda i, k: len(holders.get(k, ())) < 3 or max(holders[k]) == i
    return [(i, "\n".join(line for line in t.split("\n") if stays(i, key(line)))) for i, t in rows]


def test_stages_equal_brute_force(spark):
    con = duck(SF)
    rows = con.execute(f"select d.doc_id, text from documents d join ({OP7_SQL}) q using (doc_id) where kept order by 1").fetchall()
    docs, after = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), DOC_SCHEMA if name != "packing" else None)
        after.append(docs)
        assert name == "packing" or docs.columns == columns
    texts = lambda k: sorted((r.doc_id, r.text) for r in after[k].collect())
    assert texts(0) == rows
    rows = without_shared_lines(rows)
    assert texts(1) == rows and all(r.n_chars == len(r.text) for r in after[1].collect())
    classes = jaccard_brute(rows)
    rows = [r for k, r in enumerate(rows) if classes[k][0] == r[0]]
    assert texts(2) == rows
    bad = {i for i, *_ in leaks_brute(rows, con.execute("select item_id, text from benchmark").fetchall())}
    assert bad
    rows = [r for r in rows if r[0] not in bad]
    assert texts(3) == rows
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = []
    for i, t in rows:
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 1], 0
        for n in binary_lengths(len(ids)):
            expected.append((i, at, n, crc(ids[at : at + n])))
            at += n
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in after[4].collect()) == sorted(expected)


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def test_stages_take_odd_rows_and_empty_tables(spark):
    for rows in (odd_rows(), []):
        docs = docs_of(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns, name


def test_repeated_ids_with_other_texts_go_through_all_stages(spark):
    words = lambda k: " ".join(f"word{k}x{n}" for n in range(60))
    rows = [(3, words(1)), (5, words(1)), (5, words(2)), (5, words(3)), (6, words(3)), (7, words(4)), (7, words(4))]
    docs = docs_of(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), DOC_SCHEMA)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(3, words(1)), (5, words(2)), (5, words(3)), (7, words(4))]


def test_stage_functions_take_what_the_driver_gives():
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
