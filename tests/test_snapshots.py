"""Snapshot store and running statistics."""

import random

import pytest
from pyspark.sql import functions as F

from stockcount.operators import running, runs
from stockcount.sources.snapshots import Part, SnapshotConflict, SnapshotTable

SCHEMA = "ean string, ref_id long, categoria string"


def rows(df):
    return sorted(tuple(r) for r in df.select("ean", "ref_id", "categoria").collect())


def test_readers_see_whole_snapshots(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), tag="categoria")
    assert table.read() is None and table.version() == 0 and table.compact() == 0
    first = [("A", 1, "lata"), ("B", 2, "bolsa"), ("C", 3, None), ("D", 4, "a b/c=d")]
    assert table.append(spark.createDataFrame(first, SCHEMA)) == 1
    assert table.append(spark.createDataFrame([("E", 5, "lata")], SCHEMA)) == 2
    assert rows(table.read(1)) == sorted(first, key=str) or set(rows(table.read(1))) == set(first)
    assert set(rows(table.read())) == {*first, ("E", 5, "lata")}
    assert set(rows(table.read(tags=["lata"]))) == {("A", 1, "lata"), ("E", 5, "lata")}
    assert set(rows(table.read(tags=["a b/c=d"]))) == {first[3]}
    # A product is replaced and moves; the folder of another category stays.
    before = {p for p in table.parts() if p.tag == "bolsa"}
    table.replace(spark.createDataFrame([("A", 9, "caja")], SCHEMA), "ean")
    assert set(rows(table.read())) == {("A", 9, "caja"), *first[1:], ("E", 5, "lata")} and before <= set(table.parts())
    table.compact()
    assert len({p.folder.split("/")[0] for p in table.parts()}) == 1 and set(rows(table.read())) == {("A", 9, "caja"), *first[1:], ("E", 5, "lata")}
    assert set(rows(table.read(1))) == set(first)
    assert table.vacuum(keep=1) > 0 and len(rows(table.read())) == 5


def test_a_writer_that_dies_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    old = spark.createDataFrame([("A", 1, "x")], SCHEMA)
    table.append(old)

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(SnapshotTable, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        table.overwrite(spark.createDataFrame([("B", 2, "y")], SCHEMA))
    monkeypatch.undo()
    assert rows(SnapshotTable(spark, str(tmp_path / "t")).read()) == [("A", 1, "x")]
    # A manifest cut short is a draft, which nobody reads.
    (tmp_path / "t" / "snapshots" / "_draft.json").write_text("{")
    assert table.version() == 1 and table.vacuum() == 1


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.append(spark.createDataFrame([("A", 1, "x")], SCHEMA))
    seen = table.version()
    table.append(spark.createDataFrame([("B", 2, "x")], SCHEMA))
    with pytest.raises(SnapshotConflict):
        table._commit(seen, [Part("other", None)])
    assert [r[0] for r in rows(table.read())] == ["A", "B"]


def test_statistics_after_deliveries_and_a_retraction(spark):
    rnd = random.Random(3)
    schema = "ejecucion_id long, ean string, cantidad_dedup int, confianza_promedio double"
    item = lambda k: (k, rnd.choice("ABCDEF"), rnd.choice([None, 1, 2, 3, 9]), rnd.choice([None, 0.25, 0.5, 0.9]))
    history = [item(k) for k in range(120)] + [(200, "G", 4, 0.5), (201, "H", None, None)]
    wrong = [(900, "A", 50, 0.1), (901, "B", -7, 0.1), (902, "Z", 5, 0.1), (903, "C", 9, None), *history[:4]]
    frame = lambda r: spark.createDataFrame(r, schema)
    state = running.partials(frame(history[:40]))
    for part in (history[40:90], history[90:] + wrong):
        state = running.merged(state, running.partials(frame(part)))
    state = running.retracted(state, frame(wrong), frame(history))
    asked = spark.createDataFrame([(e,) for e in "ABCDEFGHZ"], "ean string")
    got = {tuple(r) for r in running.stats_of(state, asked).collect()}
    assert got == {tuple(r) for r in runs.sku_stats(asked, frame(history)).collect()}
    assert state.filter(F.col("ean") == "Z").isEmpty()
    assert {tuple(r) for r in running.merged(state, running.partials(frame([]))).collect()} == {tuple(r) for r in state.collect()}
