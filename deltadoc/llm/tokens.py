"""Token ids of texts: one BPE vocabulary file, words cached within a worker.

The vocabulary's pre-tokenizer never joins characters across white space and its normalizer reads
no further than one such piece, so a text's ids are the ids of its blank-separated pieces in order.
Each worker keeps the pieces that it has met; only new ones reach the tokenizer. The vocabulary's added
tokens, such as the one that ends a text, are cut out of the raw text first, as the tokenizer does.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
CACHE_PIECES = 300_000
CALL_WORDS = 4000
WORD_END = "</w>"
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Finds characters beyond those whose lower case is one character whatever its neighbours are.
_not_simple = re.compile("[^\0-\u012f\u0131-\u024f]").search

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # pieces are lower case, where such strings are ordinary text
        added = {t.content: i for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._marks = {"".join(takewhile(lambda c: c.lower() == c.upper(), t))[:2] for t in added}
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self._ends[[i for k, i in vocabulary.items() if k.endswith(WORD_END)]] = True
        self._cache: dict[str, bytes] = {"": b""} | {f"\n{t}": struct.pack("<I", i) for t, i in added.items()}
        self._most = cache_pieces

    def __call__(self, texts: list[str | None], end_id: int = END_ID) -> list[bytes]:
        """Ids of each text with ``end_id`` after the last; null is an empty text."""
        split = [self._pieces(t) if t else [] for t in texts]
        met = set().union(*split)
        new = met.difference(self._cache)
        if len(self._cache) + len(new) > self._most:
            self._cache = dict(islice(self._cache.items(), self._most * 2 // 3))  # the first met are the commonest
            new = met.difference(self._cache)
        if new:
            self._learn(new)
        get, end = self._cache.__getitem__, struct.pack("<I", end_id)
        return [b"".join(map(get, pieces)) + end for pieces in split]

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text; an added token is a piece with a line feed before it, which no other has."""
        if self._added is not None and any(m in text for m in self._marks) and self._added.search(text):
            parts = self._added.split(text)
            return [p for k, x in enumerate(parts) for p in ([f"\n{x}"] if k % 2 else self._plain_pieces(x))]
        return self._plain_pieces(text)

    @staticmethod
    def _plain_pieces(text: str) -> list[str]:
        return (text if _not_simple(text) else text.lower()).replace("\n", " ").split(" ")

    def _learn(self, new: set[str]) -> None:
        """Ids of pieces that aren't in the cache. Symbols after a letter or digit are a word of their own."""
        cache, parts = self._cache, []
        for piece in new:
            base = piece.rstrip(SYMBOLS)
            if base != piece and base[-1:].isalnum() and not _not_simple(base[-1]):
                parts.append((piece, base, piece[len(base) :]))
        need = new.difference(p for p, _, _ in parts).union(b for _, b, _ in parts).union(t for _, _, t in parts)
        need = need.difference(cache)
        plain, words, rest = [], [], []
        for p in need:
            (rest if not p.isalpha() else plain if p.isascii() and p.islower() else words).append(p)
        cache.update(zip(plain, self._plain(plain)))
        cache.update(zip(words, self._words(words)))
        cache.update(zip(rest, self._each(rest)))
        for piece, base, tail in parts:
            cache[piece] = cache[base] + cache[tail]

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [
            struct.pack(f"<{len(e.ids)}I", *e.ids)
            for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        ]

    def _plain(self, words: list[str]) -> list[bytes]:
        """Words that the normalizer and the pre-tokenizer leave as they are go to the model at once."""
        split = self._tokenizer.model.tokenize
        return [struct.pack(f"<{len(x)}I", *x) for x in ([t.id for t in split(w)] for w in words)]

    def _words(self, words: list[str]) -> list[bytes]:
        """One call for many words of letters only: each ends with its one word-ending id."""
        if len(words) > CALL_WORDS:
            return [x for a in range(0, len(words), CALL_WORDS) for x in self._words(words[a : a + CALL_WORDS])]
        if not words:
            return []
        ids = self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ids = np.array(ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
        if len(ends) != len(words):  # a letter whose lower case holds a mark
            return self._each(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for the vocabulary file at ``path``."""
    path = vocabulary_path(path)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: pa.Array, most_bytes: int = 300_000) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows of at most ``most_bytes``, or of one longer text, with their texts as strings."""
    begin = size = 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > begin and size + n > most_bytes:
            yield begin, i, texts.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes), texts.slice(begin).to_pylist()
