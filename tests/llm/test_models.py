"""Models: the word pair model against a plain one, the classifiers by held-out accuracy and on odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm import kneser_ney, language, toxicity
from llm.queries import fold, op5_language, op10_toxicity
from llm.text import hash_bound
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of, odd_rows, with_clashes, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_model(texts):
    """p(left, word), counts, tokens, types from whole texts."""
    pairs, single = Counter(), Counter()
    for t in texts:
        w = [*words((t or "").translate(LOWER)), "</end>"]
        single.update(w)
        pairs.update(zip(["<start>", *w[:-1]], w))
    at_most = lambda c: Counter(c.values())
    d = kneser_ney.discounts(*[at_most(pairs)[k] for k in (1, 2, 3, 4)])
    before = Counter(w for _, w in pairs)
    t = at_most(before)
    e = kneser_ney.discounts(*[t[k] for k in (1, 2, 3, 4)])
    rest = (e[0] * t[1] + e[1] * t[2] + e[2] * sum(v > 2 for v in before.values())) / len(pairs) if pairs else 1.0
    left, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for (h, _), c in pairs.items():
        left[h] += c
        kinds[h][min(c, 3) - 1] += 1

    def p(h, w):
        low = ((before[w] - e[min(before[w], 3) - 1]) / len(pairs) if before[w] else 0) + rest / (len(single) + 1)
        if not left[h]:
            return low
        c = pairs[h, w]
        return ((c - d[min(c, 3) - 1]) if c else 0) / left[h] + sum(x * y for x, y in zip(d, kinds[h])) / left[h] * low

    return p, single


def check_scores(rows, train, got):
    p, single = plain_model([t for (_, t), use in zip(rows, train) if use])
    n, v = sum(single.values()), len(single)
    expected = []
    for i, t in rows:
        w = [*words((t or "").translate(LOWER)), "</end>"]
        score = sum(math.log10(p(h, x)) for h, x in zip(["<start>", *w[:-1]], w))
        base = sum(math.log10((single[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        expected.append((str(i), len(w), sum(single[x] > 0 for x in w), n, base, score))
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(found) == len(expected)
    for a, b in zip(found, sorted(expected)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


@pytest.mark.parametrize("bucket_bytes", [24_000_000, 200])
def test_model_equals_the_plain_one(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", bucket_bytes)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("the The of a é É ß x1 y, z.".split() + [f"v{rng.randrange(60)}"]) for _ in range(rng.randrange(80)))) for i in range(90)]
    rows += odd_rows()
    docs = with_clashes(docs_of(spark, rows).repartition(4))
    got = kneser_ney.train_and_score(docs).collect()
    import zlib

    train = [i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    check_scores(rows, train, got)
    assert {(r.doc_id, r.held_out) for r in got} == {(i, not t) for (i, _), t in zip(rows, train)}


def test_probabilities_sum_to_one():
    p, single = plain_model(["a b a c a b", "b a d", "c c c b a", "e f g a b"])
    unseen = p("a", "never")
    assert sum(p("a", w) for w in single) + unseen == pytest.approx(1)


def test_model_without_rows(spark):
    docs = docs_of(spark, [(1, "a b"), (2, None)])
    got = kneser_ney.scored(docs, kneser_ney.fit(docs.where(F.lit(False)).select("text"))).collect()
    assert all(r.score == pytest.approx(0) and r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert kneser_ney.train_and_score(docs_of(spark, [])).count() == 0


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op5_language(spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    texts = {"en": "the house that they have with this and what is the thing", "de": "das haus und die katze nicht mit der über straße schön", "fr": "le chat est à la maison où été déjà vous êtes"}
    rows = [(i, texts[k], k, "s", 0) for i in range(60) for k in [list(texts)[i % 3]]]
    odd = [(100, None, None, None, 0), (101, "", "en", "s", 0), (102, "123 !!! \n", "de", "s", 0), (None, "die katze ist schön", None, None, 0), (103, "le chat", "fr", "s", 0), (103, "le chat", "fr", "s", 0)]
    docs = with_clashes(docs_of(spark, rows + odd))
    got = language.identify(docs, fold(5) == 0).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows + odd)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[None].lang_pred == "de" and all(by[i].lang_pred == k for i, _, k, _, _ in rows)


def test_language_one_or_no_language(spark):
    one = docs_of(spark, [(i, "some words here", "en", "s", 0) for i in range(12)])
    assert {(r.lang_pred, r.score) for r in language.identify(one, fold(5) == 0).collect()} == {("en", 1.0)}
    none = docs_of(spark, [(i, "some words here", None, "s", 0) for i in range(12)])
    assert {(r.lang_pred, r.score) for r in language.identify(none, fold(5) == 0).collect()} == {("und", 0.0)}
    assert language.identify(docs_of(spark, []), fold(5) == 0).count() == 0


@pytest.mark.parametrize("languages", [1, 2, 3, 5, 6, 30])
def test_codewords_differ(languages):
    code = language.codewords(languages)
    apart = [(code[a] != code[b]).sum() for a in range(languages) for b in range(a)]
    assert len(code) == languages and (not apart or min(apart) >= max(1, code.shape[1] // 4))


def test_many_languages_survive_wrong_bits():
    rng = np.random.default_rng(0)
    labels = np.repeat([f"l{k:02d}" for k in range(12)], 20)
    x = rng.normal(0, 0.3, (240, 60)).astype(np.float32)
    x[np.arange(240), np.repeat(np.arange(12), 20)] += 2
    model = language.train(x, labels)
    model["b"][0] += 50  # one classifier always says the same
    best, p, second = language.decode(model, x)
    assert np.mean([model["names"][k] == y for k, y in zip(best, labels)]) > 0.95
    assert ((p >= second) & (p <= 1)).all()


def test_sample_is_bounded(spark):
    docs = docs_of(spark, [(i, f"text {i}", ["en", "de"][i % 3 == 0], "s", 0) for i in range(3000)])
    sizes = {r["lang"]: r["count"] for r in language.sample(docs, per_language=50, most=80).groupBy("lang").count().collect()}
    assert sizes == {"en": 40, "de": 40}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op10_toxicity(spark, sf).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit / max(1, sum(r.predicted for r in rows)) > 0.97 and hit / sum(r.toxic for r in rows) > 0.75


def test_machine_learns_a_pair_that_no_sum_of_weights_can():
    rng = np.random.default_rng(1)
    y, owner, feature = [], [], []
    for k in range(1200):
        a, b = rng.integers(0, 2, 2)
        held = [f for f, on in ((0, a), (1, b)) if on] + [2 + rng.integers(0, 20)]
        owner += [k] * len(held)
        feature += held
        y.append(int(a != b))
    owner, feature, y = np.array(owner), np.array(feature), np.array(y, float)
    model = toxicity.train(owner, feature, y, 22, steps=600)
    right = ((toxicity._logits(model, owner, feature, len(y)) > 0) == (y > 0)).mean()
    assert right > 0.95


def test_toxicity_odd_rows(spark):
    rows = [(i, ("you are a total idiot " if i % 4 == 0 else "what a nice day ") + f"word{i}", "en", "s", 0) for i in range(120)]
    odd = [(200, None, None, None, 0), (201, "", None, None, 0), (None, "idiot", None, None, 0), (202, "IDIOT!", None, None, 0), (202, "IDIOT!", None, None, 0)]
    docs = with_clashes(docs_of(spark, rows + odd))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)] + [(3, 1, None), (4, 0, 0), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.train_and_score(docs, labels, fold(3) == 1).collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert all(r.predicted == 1 for r in got if r.doc_id in (None, 202)) and all(r.predicted == 0 for r in got if r.doc_id in (200, 201))


def test_toxicity_without_labels_or_rows(spark):
    docs = docs_of(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.train_and_score(docs, none, fold(3) == 1).collect()} == {0.5}
    assert toxicity.train_and_score(docs_of(spark, []), none, fold(3) == 1).count() == 0


def test_every_term_that_stands_out_is_a_feature(spark):
    # 20,000 common words lean a little, z about 20.5; one term is rare and always toxic, z about 19.5.
    common = F.struct(F.col("id").alias("bucket"), F.lit(5_000_000).cast("long").alias("n"), F.lit(260_000).cast("long").alias("toxic"))
    counts = spark.range(20_000).select(common.alias("c")).select("c.*")
    counts = counts.union(spark.createDataFrame([(-1, 100_000_000, 5_000_000), (700_000, 20, 20), (700_001, 5_000_000, 250_000)], counts.schema))
    buckets, share = toxicity.choose(counts)
    assert buckets.tolist() == [*range(20_000), 700_000] and share == pytest.approx(0.05)


def test_machine_in_parts_is_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    owner = np.sort(rng.integers(0, 300, 4000))
    feature, y = rng.integers(0, 500, 4000), (rng.random(300) < 0.3).astype(float)
    whole = toxicity.train(owner, feature, y, 500, steps=3)
    monkeypatch.setattr(toxicity, "PART", 10)
    parts = toxicity.train(owner, feature, y, 500, steps=3)
    assert all(np.allclose(whole[k], parts[k], atol=1e-3) for k in whole)


@pytest.mark.parametrize("count", [1, 50, 10**4, 10**9, 10**12, 10**18])
def test_a_sample_of_any_size_keeps_rows(count):
    """Of ``count`` evenly spread hashes about as many lie within the bound as wanted, and the first always does."""
    bound, least = hash_bound(count, 840, -(1 << 63) + 5), -(1 << 63) + 5
    assert least <= bound < 1 << 63
    assert (bound + (1 << 63)) * count / 2**64 == pytest.approx(min(840, count), rel=1e-6, abs=120 * (count == 10**18))
    assert hash_bound(count, 840, (1 << 63) - 1) == (1 << 63) - 1


def test_language_sample_with_huge_counts(spark, monkeypatch):
    rows = [(i, f"text {i}", ["en", "de"][i % 2], "s", 0) for i in range(60)]
    count = F.count
    monkeypatch.setattr(F, "count", lambda c: count(c) * F.lit(10**12))  # a hot language of 3 * 10**13 rows
    sizes = {r["lang"] for r in language.sample(docs_of(spark, rows)).collect()}
    assert sizes == {"en", "de"}
    labelled = docs_of(spark, rows).withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int"))
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda owner, feature, y, features: seen.append(len(y)) or {"w0": 0.0})
    toxicity.fit(labelled)
    assert seen and seen[0] >= 1


def test_language_sample_of_rows_without_id(spark):
    docs = docs_of(spark, [(None, f"text {i}", "en", "s", 0) for i in range(3000)])
    assert language.sample(docs, per_language=50, most=80).count() == 50
