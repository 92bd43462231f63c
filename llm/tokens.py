"""Token ids of whole texts with a public tokenizer, a distinct word at a time.

The vocabulary's tokenizer drops white space and never looks across it, so a text's ids are the ids of its
words one after the other. Each distinct word of a slice of texts is encoded once and kept in a bounded
store per worker; the words of the texts then pick their ids with numpy.

Words of Latin letters, perhaps followed by punctuation, go straight to the tokenizer's own BPE model: their
pieces are the letters and the punctuation, in lower case, as bytes in the vocabulary's printable alphabet.
All other words pass through the whole tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from llm.batches import SLICE_BYTES, Words, slices

#: For each distinct piece that a worker remembers before it starts afresh, bytes of text it works on at once.
BYTES_A_PIECE = 15
#: Letters whose lower case and composed form need no table: ASCII and the accented ones of Latin-1.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, the byte-level alphabet: printable bytes stand for themselves, the rest follow at 256."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LATIN = {c: "".join(byte_alphabet()[b] for b in chr(c).encode()) for c in range(128, 256)}


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, by its name."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts; one for each worker and vocabulary file."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.remembered = SLICE_BYTES // BYTES_A_PIECE
        # Straight ways hold only if the tokenizer gives the same ids for both.
        probe = ["Straße,", "ÉTÉ.", "don", "(x)", "Wort!!", "a|b", "naïve", "ça%%%", "e-mail", "#tag"]
        self.straight = all(self.word(w) == tuple(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in probe)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.pieces.get(text)
        if ids is None:
            shown = text if text.isascii() else text.translate(_LATIN)
            ids = tuple([t.id for t in self.model.tokenize(shown)])
            if len(self.pieces) >= self.remembered:
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def word(self, word: str, straight: bool = True) -> tuple[int, ...]:
        m = _SIMPLE.fullmatch(word) if straight else None
        if m is None:
            return tuple(self.tokenizer.encode(word, add_special_tokens=False).ids)
        letters, marks = m.groups()
        return self.piece(letters.lower()) + self.piece(marks) if marks else self.piece(letters.lower())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the bounds of each text's ids."""
        words = Words(texts)
        each = [self.word(w, self.straight) for w in words.distinct]
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        flat = np.fromiter((i for ids in each for i in ids), dtype=np.uint32, count=int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        n = sizes[words.codes]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[words.codes] - (ends - n), n)
        return flat[at], np.concatenate([[0], ends])[words.bounds]


def encoded(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, at_once: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows and, for each row, its ids followed by ``end_id``; ``at_once`` bytes of text bound the memory."""
    encoder = Encoder.of(path)
    encoder.remembered = at_once // BYTES_A_PIECE
    for rows, texts in slices(batches, most=at_once):
        ids, bounds = encoder.encode(texts)
        yield rows, [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
