"""Operators written in DataFrame functions alone: line dedup, quality, contamination, perspectives."""

import hashlib
import random
from collections import Counter

import pytest
from llm import contamination, line_dedup, perspectives, quality
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of, odd_rows, shingles, with_clashes, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_brute(rows):
    keyed = [[(line, line.strip(" \t\n\x0b\x0c\r").translate(LOWER)) for line in (t or "").split("\n")] for _, t in rows]
    holders = {}
    for (i, _), lines in zip(rows, keyed, strict=True):
        for _, k in lines:
            if len(k) >= 20 and i is not None:
                holders.setdefault(k, set()).add(i)
    out = []
    for (i, _), lines in zip(rows, keyed, strict=True):
        kept = [line for line, k in lines if not (i is not None and len(holders.get(k, ())) >= 3 and max(holders[k]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_on_odd_rows(spark):
    rows = odd_rows()
    got = line_dedup.line_report(with_clashes(docs_of(spark, rows))).drop("keep").collect()
    assert sorted(map(tuple, got), key=str) == lines_brute(rows)


def test_line_dedup_many_lines_random(spark):
    rng = random.Random(3)
    shared = [f"Shared Line number {k} of the corpus" for k in range(40)]
    rows = [(i, "\n".join(rng.choice(shared) if rng.random() < 0.5 else f"own line {i} {k} {rng.random()}" for k in range(rng.choice([1, 3, 63, 64, 65, 200])))) for i in range(60)]
    got = line_dedup.line_report(docs_of(spark, rows)).drop("keep").collect()
    assert sorted(map(tuple, got), key=str) == lines_brute(rows)


def test_line_dedup_joins_when_bitmaps_are_many(spark, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(line_dedup, "BITMAP_WORDS", 0)
    got = line_dedup.line_report(docs_of(spark, rows)).drop("keep").collect()
    assert sorted(map(tuple, got), key=str) == lines_brute(rows)


def test_line_dedup_filter_keeps_columns_and_null_text(spark):
    docs = with_clashes(docs_of(spark, odd_rows()))
    out = line_dedup.drop_shared_lines(docs)
    assert out.columns == docs.columns and out.count() == len(odd_rows())
    assert out.where("text is null").count() == 2
    assert out.where("doc_id = 9").first()["text"] == ""


def test_line_dedup_empty_table(spark):
    empty = docs_of(spark, [])
    assert line_dedup.line_report(empty).count() == 0 and line_dedup.drop_shared_lines(empty).count() == 0


def counts_brute(text):
    w = words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = {g for g, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, g in enumerate(windows) if g in often for j in range(3)}
    full = [line for line in (text or "").split("\n") if words(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(covered)


def test_quality_counts_on_odd_rows(spark):
    rows = odd_rows() + [(20, "x y z " * 30 + "| # <a>"), (21, "a a a a"), (22, "b b"), (23, "p q r s p q r")]
    got = quality.quality_report(with_clashes(docs_of(spark, rows))).collect()
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str)
    assert found == sorted(((i, *counts_brute(t)) for i, t in rows), key=str)


def test_quality_rejects_outliers_of_a_group_and_keeps_the_rest(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(2, 8) + str(rng.randint(0, 999)) for _ in range(120)), "en", f"s{i % 2}", 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"{rng.randint(0, 9999)}%%%" for _ in range(120)), "en", "s0", 0) for i in range(8)]
    docs = with_clashes(docs_of(spark, clean + junk))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(60))
    assert {r.doc_id for r in quality.quality_report(docs).where("kept").collect()} == set(range(60))


def test_quality_thresholds_follow_the_group(spark):
    table = [(i, " ".join(f"c{i}x{k} |" for k in range(80)), "en", "tables", 0) for i in range(30)]
    prose = [(100 + i, " ".join(f"c{i}x{k}" for k in range(80)), "en", "prose", 0) for i in range(30)]
    stray = [(200, table[0][1], "en", "prose", 0)]
    kept = {r.doc_id for r in quality.quality_report(docs_of(spark, table + prose + stray)).where("kept").collect()}
    assert kept == {*range(30), *range(100, 130)}


def test_quality_null_groups_and_empty_table(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = docs_of(spark, [(1, text, None, None, 0), (2, text, None, "s", 0), (3, None, None, None, 0)])
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [1, 2]
    assert quality.keep_good(docs_of(spark, [])).count() == 0 and quality.quality_report(docs_of(spark, [])).count() == 0


def test_limits_follow_the_group(spark):
    # What is usual differs by source: symbols, repeated lines and words, long words.
    def text(k, far):
        body = [f"w{k}x{n}" + "y" * (n % (2 + far)) for n in range(60)]
        extra = ["| " * far * 2, "again and again and again " * far, "\n".join(["the same line"] * (1 + (far > 1) * (far + k % 2)))]
        return "\n".join([" ".join(body), *extra, "one line", "another line", "a third line", "a fourth line"])

    docs = docs_of(spark, [(100 * far + k, text(k, far), "en", f"s{far}", 0) for far in (1, 2, 4) for k in range(60)])
    rows = quality.limits(quality.sketches(quality.counts(docs).drop("text"))).collect()
    assert len(rows) == 3
    assert all(len({r[f"max_{m}"] for r in rows}) == 3 for m in ("symbols", "dup_lines", "repeats"))
    assert len({r["max_word_length"] for r in rows}) > 1 and len({r["min_word_length"] for r in rows}) == 3


def test_sketches_merge(spark):
    docs = docs_of(spark, [(i, " ".join(f"w{k}" + "|" * (k % (i + 1) == 0) for k in range(70))) for i in range(40)])
    counted = quality.counts(docs).drop("text")
    parts = quality.sketches(counted.where("doc_id < 13")).unionByName(quality.sketches(counted.where("doc_id >= 13")))
    merged = parts.groupBy("lang", "source", "measure", "value").agg(F.sum("n").alias("n"))
    assert quality.limits(merged).collect() == quality.limits(quality.sketches(counted)).collect()


def leaks_brute(docs, items, threshold=0.8):
    out = set()
    for item, q in items:
        width = min(5, len(words(q)))
        own = shingles(q, width) if width else set()
        for i, t in docs:
            n = len(own & shingles(t, width)) if own and len(words(t)) >= width else 0
            if own and n >= threshold * len(own):
                out.add((i, item, n, len(own)))
    return out


@pytest.fixture(scope="module")
def leak_case():
    rng = random.Random(9)
    vocabulary = [f"t{k}" for k in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(make(n))) for k, n in enumerate([1, 2, 4, 5, 6, 12, 20, 21, 30, 60, 200])]
    docs = []
    for i in range(120):
        text = make(rng.choice([3, 40, 400, 6000]))
        if i % 2:
            q = words(items[rng.randrange(len(items))][1])
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                q[rng.randrange(len(q))] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = q
        docs.append((i, " \n".join(text)))
    return docs, items + [(50, None), (51, " ")]


def test_contamination_equals_brute_force(spark, leak_case):
    docs, items = leak_case
    odd = docs + [(None, items[5][1]), (300, items[6][1]), (300, items[6][1])] + [r for r in odd_rows() if r[0]]
    frame = with_clashes(docs_of(spark, odd))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("node", F.lit(1))
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contamination.contaminated(frame, bench).collect()}
    expected = leaks_brute(odd, items)
    assert len(expected) > 20 and got == expected
    kept = contamination.drop_contaminated(frame, bench)
    # Some ids occur under several texts; each row is judged by its own.
    bad = {k for k, *_ in leaks_brute([(k, t) for k, (_, t) in enumerate(odd)], items)}
    assert kept.columns == frame.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str((i, t)) for k, (i, t) in enumerate(odd) if k not in bad)


@pytest.mark.parametrize("threshold", [0.5, 0.3, 1.0])
def test_contamination_at_other_thresholds(spark, threshold):
    rng = random.Random(int(threshold * 10))
    vocabulary = [f"t{k}" for k in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 20, 60, 150])))) for i in range(40)]
    docs = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        # A run of the item that holds just about the threshold's share of its shingles.
        for k in range(-2, 3):
            n = min(len(w), max(1, round(threshold * (len(w) - 4)) + 4 + k))
            docs.append((100 * i + k, " ".join([*rng.choices(vocabulary, k=30), *w[:n], *rng.choices(vocabulary, k=30)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contamination.contaminated(docs_of(spark, docs), bench, threshold).collect()}
    assert len(got) >= 40 and got == leaks_brute(docs, items, threshold)


def test_contamination_without_broadcast(spark, leak_case, monkeypatch):
    docs, items = leak_case
    monkeypatch.setattr("llm.contamination.broadcast_if_few", lambda df: df)
    got = contamination.contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()} == leaks_brute(docs, items)


def test_contamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, odd_rows())
    assert contamination.contaminated(docs, none).count() == 0
    assert contamination.drop_contaminated(docs, none).count() == len(odd_rows())
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert contamination.contaminated(docs_of(spark, []), some).count() == 0


def render_brute(turns):
    """{(conversation, perspective): (text, learned spans)}"""
    by = {}
    for c, t, s, x in turns:
        by.setdefault(c, []).append((t is not None, t or 0, s, x or ""))
    out = {}
    for c, said in by.items():
        for view in {s for _, _, s, _ in said if s != "system"}:
            text, spans = "", []
            shown = []
            for has, t, s, x in said:
                role = "assistant" if s == view else "system" if s == "system" else "user"
                name = "unknown" if s is None else s
                shown.append((has, t, s, f"<|{role}|>{name if role == 'user' else ''}\n", x + "\n", role))
            for _, _, _, head, body, role in sorted(shown, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3] + r[4])):
                if role == "assistant":
                    spans.append((len(text) + len(head), len(text) + len(head) + len(body)))
                text += head + body
            out[c, view] = (text, spans)
    return out


def test_perspectives_equal_brute_force(spark):
    rng = random.Random(4)
    turns = [(c, t, rng.choice(["ann", "bob", "eve", "system", None]), rng.choice(["", None, "hi", "Grüße 日本"])) for c in range(6) for t in range(rng.choice([0, 1, 5, 700]))]
    turns += [(None, 0, "ann", "x"), (None, 1, None, "n"), (-1, 0, "bob", "real"), (-1, 1, "unknown", "u"), (-1, 2, None, "n"), (9, None, "bob", "y"), (9, 1, "bob", "z"), (9, 1, "bob", "z"), (10, 0, "system", "only")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1)).withColumn("name", F.lit(2))
    got = perspectives.rendered(perspectives.perspectives(frame), 10**9).collect()
    found = {(r.conv_id, r.perspective): (r.text, [(s.start, s.end) for s in r.mask_spans]) for r in got}
    assert found == render_brute(turns)


def test_perspectives_empty(spark):
    assert perspectives.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rows_of_one_id_under_two_texts_lose_their_own_lines(spark):
    shared = "a line that three documents share"
    rows = [(5, f"{shared}\nown A"), (5, "a unique first line of its own\nown B"), (6, shared), (7, shared), (8, None), (5, f"{shared}\nown A")]
    out = sorted((r.doc_id, r.text or "") for r in line_dedup.drop_shared_lines(docs_of(spark, rows)).collect())
    assert out == sorted([(5, "own A"), (5, "a unique first line of its own\nown B"), (6, ""), (7, shared), (8, ""), (5, "own A")])


def test_another_text_of_a_contaminated_id_stays(spark):
    item = "one two three four five six seven eight"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(5, f"before {item} after"), (5, "a text without any of it"), (6, None), (None, item), (None, "clean one")]
    left = contamination.drop_contaminated(docs_of(spark, rows), items).collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id) == [(5, "a text without any of it"), (6, None)]
    assert [r.text for r in left if r.doc_id is None] == ["clean one"]
