"""Small tables and brute-force versions for the tests of this folder."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import combinations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; callers may have columns of the same names.
CLASHING = ["_h", "_g", "_s", "_p", "_row", "_keep", "_doc", "_text", "_bad", "_gone", "_again", "_n", "node", "label", "keep", "kept", "n_words", "hash", "bucket", "score", "position", "value", "measure"]
BLANK = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def docs_of(spark, rows, schema=DOC_SCHEMA):
    """rows: (doc_id, text) or whole rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def odd_rows():
    """Nulls, empty and blank texts, one word, a long text, ties and repeated rows."""
    long = " ".join(f"w{k % 5000}" for k in range(60_000)) + "\n" + "\n".join(f"line number {k % 7} is here again" for k in range(3000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, long), (6, "a b c d e f g h"), (7, "a b c d e f g h"),
        (None, "a b c d e f g h"), (None, None), (8, "line number 1 is here again\nother words in a text\nline number 1 is here again"),
        (9, "line number 1 is here again"), (10, "LINE number 1 is here again  "), (11, "\n\n\n"), (12, "日本語 の テキスト です ね あ い う"),
        (13, "ÄÖÜ straße É\r\nnext\rlast"),
    ]


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard_brute(rows, threshold=0.8):
    """{index: (class id, links)} over rows (doc_id, text); rows without an id are left out."""
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    head, links = list(range(len(rows))), defaultdict(int)

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
            links[a] += 1
            links[b] += 1
            head[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return {k: (least.get(find(k)) if i is not None else None, links[k]) for k, (i, _) in enumerate(rows)}


def crc(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
