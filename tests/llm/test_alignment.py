"""Alignment of two tokenizers: fragments as a monoid, and whole results against tokens of whole texts."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import alignment as A
from llm.tokens import byte_alphabet, vocabulary
from tokenizers import Tokenizer

from tests.llm.helpers import docs_of, odd_rows, with_clashes

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def whole_tokens(text, both=[]):  # noqa: B006
    """Ids of a whole text and their bytes, for both tokenizers."""
    if not both:
        a = Tokenizer.from_file(PATHS[0])
        a.encode_special_tokens = True
        both += [a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), {c: b for b, c in byte_alphabet().items()}]
    a, b, back = both
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return ids_a, [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a], ids_b, bytes_b


def brute(rows):
    docs = []
    for i, text in rows:
        groups = []
        if text:
            a, a_bytes, b, b_bytes = whole_tokens(text)
            want = b" " + text.encode()
            if b"".join(a_bytes) == want == b"".join(b_bytes):
                ends_a, ends_b = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
                x = y = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    p, q = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
                    groups.append((a[x:p], b[y:q]))
                    x, y = p, q
        docs.append((i, groups, Counter((p, q) for g in groups for p in g[0] for q in g[1])))
    count = Counter(pair for _, _, links in docs for pair in links)
    most = {}
    for (p, _), n in count.items():
        most[p] = max(most.get(p, 0), n)
    out = []
    for i, groups, links in docs:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for pair, n in links.items() if count[pair] == most[pair[0]])
        sums = sum(n * count[pair] for pair, n in links.items())
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), best, sums, digest))
    return sorted(out, key=str)


def found(docs, **kw):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r[c] for c in names) for r in A.aligned(docs, *PATHS, **kw).collect()], key=str)


def strange(seed, n=60):
    """Texts of characters that tokenizers treat in different ways."""
    rnd = random.Random(seed)
    bits = ["a", "é", "ﬁ", " ", "  ", "\n", "\t", " ", "　", "▁", "日本", "語", "한국어", "😀", "é", " ́", "don't", "’s", "<s>", "<|endoftext|>", "</s>", "123", "4 5", ".", "...", "!?", "​", "\r\n", "Straße", "\x00", "﻿", "ÃÃ", "\u0085", " "]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 40))) for _ in range(n)]


TEXTS = ["<|endoftext|> and <s> </s>", "two  spaces", " leading", "trailing ", "▁", "naïve café", "日本語 です"]


@pytest.mark.parametrize("kw", [{}, {"long": 40}, {"few_pairs": 0}])
def test_equals_brute_force(spark, kw, monkeypatch):
    monkeypatch.setattr(A, "SEGMENT", 64)
    monkeypatch.setattr(A, "RANGE", 7)
    rows = [r for r in odd_rows() if r[0] != 5] + list(enumerate(TEXTS + strange(1), 100))
    docs = with_clashes(docs_of(spark, rows)).repartition(4)
    assert found(docs, **kw) == brute(rows)


def test_long_texts_over_several_rounds(spark):
    words = [w for t in strange(2, 300) for w in t.replace("▁", "x").split() if w]
    rnd = random.Random(4)
    text = " ".join(rnd.choice(words) for _ in range(20_000))
    rows = [(1, text), (2, text[:70_000]), (3, "x" * 70_000), (4, text + "▁"), (5, text[:300])]
    assert found(docs_of(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert found(docs_of(spark, [])) == []


def test_units_are_tokenized_as_in_the_whole_text():
    aligner = A.Aligner.of(*PATHS)
    import pyarrow as pa

    for text in strange(3, 400) + TEXTS:
        a, a_bytes, b, b_bytes = whole_tokens(text)
        units, codes, _ = aligner.split(A.spaced(pa.array([text], pa.large_string())))
        sound = b"".join(a_bytes) == b" " + text.encode() == b"".join(b_bytes)
        assert units.sound.all() == sound
        if sound:
            assert A._gathered(units.a, units.a_bounds, codes)[0].tolist() == a
            assert A._gathered(units.b, units.b_bounds, codes)[0].tolist() == b


tokens = st.lists(st.integers(1, 4), max_size=12)


@settings(max_examples=200, deadline=None)
@given(tokens, tokens, st.lists(st.integers(0, 40), max_size=6), st.randoms())
def test_fragments_compose_in_any_tree(a_sizes, b_sizes, borders, rnd):
    a_ends, b_ends = list(accumulate(a_sizes)), list(accumulate(b_sizes))
    a, b = tuple(range(100, 100 + len(a_ends))), tuple(range(200, 200 + len(b_ends)))
    cuts = [0, *sorted(borders), 100]

    def part(low, high):
        x, y = [k for k, e in enumerate(a_ends) if low < e <= high], [k for k, e in enumerate(b_ends) if low < e <= high]
        take = lambda values, at: np.array([values[k] for k in at], dtype=np.int64)
        closing, rows = A.fragment(take(a, x), take(a_ends, x), take(b, y), take(b_ends, y))
        head_a, head_b, tail_a, tail_b, p, q, n, m = (tuple(r.tolist()) for r in rows)
        closed, i, j = [], 0, 0
        for u, v in zip(n, m):
            closed.append((p[i : i + u], q[j : j + v]))
            i, j = i + u, j + v
        return A.Fragment((head_a, head_b), tuple(closed), (tail_a, tail_b) if closing else None)

    parts = [part(p, q) for p, q in zip(cuts, cuts[1:])]
    while len(parts) > 1:
        k = rnd.randrange(len(parts) - 1)
        parts[k : k + 2] = [A.compose(parts[k], parts[k + 1])]
    assert A.groups_of(parts[0]) == A.groups_of(part(0, 100))
    assert A.compose(A.Fragment(), parts[0]) == A.compose(parts[0], A.Fragment()) == parts[0]


def test_unit_starts():
    data = np.frombuffer(" ab cd  e\tf g é ü".encode(), np.uint8)
    assert A.unit_starts(data, np.array([0])).tolist() == [0, 3, 11, 13, 16]
