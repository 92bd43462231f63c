"""Exact copies: the trie by itself, and whole results against a dictionary of texts."""

import hashlib
import random

import pytest
from llm import exact_dedup as E

from tests.llm.helpers import docs_of, odd_rows, with_clashes


def brute(rows):
    """Sorted (doc_id, keep_id, size, sha) and how many rows stay for each text."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out = [(i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    return sorted(out, key=str)


def check(out, rows):
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=str) == brute(rows)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def copies(seed, n=400):
    rnd = random.Random(seed)
    # Texts that share long beginnings, so that labels are split in many places.
    texts = ["".join(rnd.choice("ab") * rnd.randrange(1, 9) for _ in range(rnd.randrange(0, 6))) for _ in range(60)] + [None, ""]
    return [(rnd.choice([None, *range(300)]), rnd.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("limit", [E.TRIE_BYTES, 3000])
@pytest.mark.parametrize("few", [E.FEW_ROWS, 0])
def test_equals_brute_force(spark, limit, few):
    rows = copies(3) + odd_rows()
    out = E.exact_copies(with_clashes(docs_of(spark, rows)).repartition(5), limit=limit, few=few).collect()
    check(out, rows)


def test_of_repeated_rows_one_stays(spark):
    rows = [(5, "x"), (5, "x"), (4, "x"), (None, "y"), (None, "y"), (7, None), (7, "")]
    check(E.exact_copies(docs_of(spark, rows).repartition(3)).collect(), rows)


def test_empty_table(spark):
    assert E.exact_copies(docs_of(spark, [])).count() == 0


def test_one_hot_text_and_long_ones(spark):
    long = "z" * 3_000_000
    rows = [(k, "the same text") for k in range(2000)] + [(k, long) for k in range(5000, 5003)] + [(9000, long + "!"), (9001, long[:-1] + "!")]
    check(E.exact_copies(docs_of(spark, rows).repartition(6), limit=4_000_000).collect(), rows)


@pytest.mark.parametrize("seed", range(4))
def test_trie_keeps_every_string_when_it_spills(seed):
    rnd = random.Random(seed)
    keys = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 40))) for _ in range(500)]
    trie, found, again = E.Trie(), {}, []
    for k in keys:
        if not trie.insert(k, 0, 1, len(k), 1):
            again.append(k)
        while trie.held > 20_000 and trie.strings > 1:
            again += [key for key, node in trie.spill(close=True) for _ in range(node.n)]
    for key, node in trie.entries():
        found[key] = node.n
    # A string is either whole in the trie or whole among those for another round.
    assert not set(found) & set(again)
    for k in set(keys):
        assert found.get(k, 0) + again.count(k) == keys.count(k)
