"""Alignment of two tokenizers' ids over the same bytes, and how many documents link each pair of ids.

Both tokenizers cut a text at a single blank between two other characters, and neither joins bytes over such
a place, so a text is the row of its blank-separated pieces. New pieces are encoded in one call and aligned
together in numpy: token lengths add up to ends, ends that both have are the common cuts, a search in the
cuts labels each token's group, and links are expanded by repeating each token as often as tokens of the
other side overlap it. A worker keeps what it knows of a piece, the common ones longest; a document is then a row of piece codes.

Documents are written with their distinct pairs in blocks of a bounded size. A block has each of its pairs
once; those are counted in two stages, by a salted pair and by pair, joined with the counts, and go back to
the block's documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltadoc.llm.common import spread_join, written
from deltadoc.llm.tokens import slices

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
BLOCK_BYTES = 1 << 22
SALTS = 16
#: A blank that may part pieces. Python's white space has all characters that the vocabularies' patterns count as such.
_cut = re.compile(r"(?<=\S) (?=\S)")
#: Not a plain word: white space, or the sign that the pieces have for a blank.
_odd = re.compile(r"[\s▁]")
_AT_ONCE = 2000
_CACHE_PIECES = 300_000
_CACHE_LINKS = 4_000_000
_SPAN = 1 << 18

_aligners: dict[tuple[str, str], "Aligner"] = {}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def expand(first: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For row i the numbers first[i], first[i] + 1, ... (times[i] of them), and i beside each."""
    row = np.repeat(np.arange(len(times)), times)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)


def overlaps(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts, group labels of both sides' tokens, and links (places in A, places in B) of tokens of these byte lengths."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    first = np.searchsorted(end_b, end_a - len_a, "right")
    last = np.searchsorted(end_b - len_b, end_a, "left")
    at_a, at_b = expand(first, last - first)
    return cuts, group_a, group_b, at_a, at_b


class Aligner:
    """Aligns texts by two vocabulary files; keeps pieces that it has met."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_level)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        self._bytes_a = [b""] * self._a.get_vocab_size()
        for entry, i in self._a.get_vocab().items():
            self._bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        names = [self._b.id_to_piece(i) for i in range(len(self._b))]
        self._bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self._len_a, self._len_b = (np.array([len(x) for x in table], np.int64) for table in (self._bytes_a, self._bytes_b))
        self._blank_a, self._blank_b = (np.array([x[:1] == b" " for x in table]) for table in (self._bytes_a, self._bytes_b))
        #: Only if no piece goes on after a letter with a blank do pieces of a text not touch each other.
        self.parted = not any(re.search("[^▁]▁", p) for i, p in enumerate(names) if not (self._b.is_control(i) or self._b.is_unknown(i)))
        self._code: dict[str, int] = {}
        self._groups: list[str] = []
        #: For each code: ids of A and B, groups, links (all -1 where bytes differ), where its stretch of all pairs begins, and
        #: how many texts had it since the last clearing. Both tables grow ahead of what they hold.
        self._table, self._pairs, self._n_pairs = np.zeros((1 << 12, 6), np.int64), np.zeros(1 << 14, np.int64), 0

    def _clear(self) -> None:
        """Forgets pieces that fewer than two texts had lately, and the rarest ones if half would not go."""
        n = len(self._groups)
        hits, half = self._table[:n, 5], _CACHE_PIECES // 2
        least = max(2, int(np.partition(hits, n - half)[n - half]) + 1) if n > half else 2
        keep = hits >= least
        if self._table[:n, 3][keep].clip(0).sum() > _CACHE_LINKS // 2:
            keep[:] = False
        old = np.flatnonzero(keep)
        place = np.full(n, -1)
        place[old] = np.arange(len(old))
        place = place.tolist()
        self._code = {p: place[c] for p, c in self._code.items() if place[c] >= 0}
        self._groups = [self._groups[c] for c in old.tolist()]
        size = self._table[old, 3].clip(0)
        self._pairs = self._pairs[expand(self._table[old, 4], size)[1]]
        self._n_pairs = len(self._pairs)
        self._table = self._table[old]
        self._table[:, 4], self._table[:, 5] = np.cumsum(size) - size, 0

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces and aligns them. Plain words are encoded many at once, as one text of each vocabulary."""
        plain = [p for p in new if p and not _odd.search(p)]
        odd = [p for p in new if not p or _odd.search(p)]
        for a in range(0, len(plain), _AT_ONCE):
            self._store(plain[a : a + _AT_ONCE], *(self._together(plain[a : a + _AT_ONCE]) or self._apart(plain[a : a + _AT_ONCE])))
        for a in range(0, len(odd), _AT_ONCE):
            self._store(odd[a : a + _AT_ONCE], *self._apart(odd[a : a + _AT_ONCE]))

    def _together(self, words: list[str]):
        """Ids of A, how many each word has, and the same of B; None unless a blank begins each word and no other token."""
        text = " ".join(words)
        data, sides = f" {text}".encode(), []
        for ids, table, blank in ((self._a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self._bytes_a, self._blank_a), (self._b.encode(text, num_threads=1), self._bytes_b, self._blank_b)):
            if b"".join([table[i] for i in ids]) != data:
                return None
            ids = np.array(ids, np.int64)
            starts = np.flatnonzero(blank[ids])
            if len(starts) != len(words):
                return None
            sides += [ids, np.diff(np.append(starts, len(ids)))]
        return *sides, np.ones(len(words), bool)

    def _apart(self, pieces: list[str]):
        """The same by a call for each piece, without the ids of pieces whose bytes don't come back."""
        ids_a = [e.ids for e in self._a.encode_batch_fast([f" {p}" for p in pieces], add_special_tokens=False)]
        ids_b = self._b.encode(pieces, num_threads=1)
        whole = lambda ids, table: b"".join([table[i] for i in ids])
        fine = np.array([whole(a, self._bytes_a) == whole(b, self._bytes_b) == b" " + p.encode() for p, a, b in zip(pieces, ids_a, ids_b)])
        sides = []
        for ids in (ids_a, ids_b):
            good = [x for x, ok in zip(ids, fine) if ok]
            sides += [np.array([i for x in good for i in x], np.int64), np.array([len(x) for x in good], np.int64)]
        return *sides, fine

    def _store(self, pieces: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, fine: np.ndarray) -> None:
        """Aligns pieces in one row of bytes, in which each piece's end is a cut of both, and keeps what comes out."""
        rows, groups = np.zeros((len(pieces), 6), np.int64), [""] * len(pieces)
        rows[:, :4] = -1
        if fine.any():
            cuts, group_a, group_b, at_a, at_b = overlaps(self._len_a[a], self._len_b[b])
            upto = np.cumsum(n_a)
            ends = group_a[upto - 1] + 1  # groups up to each piece's end
            links = np.searchsorted(at_a, upto)  # links are in order of A
            begin = self._n_pairs + np.concatenate([[0], links[:-1]])
            rows[fine, :5] = np.stack([n_a, n_b, np.diff(ends, prepend=0), np.diff(links, prepend=0), begin], axis=1)
            self._pairs = _appended(self._pairs, self._n_pairs, a[at_a] << 32 | b[at_b])
            self._n_pairs += len(at_a)
            texts = [f"{x}|{y}" for x, y in zip(_joined(a, group_a, len(cuts)), _joined(b, group_b, len(cuts)))]
            begin = 0
            for k, end in zip(np.flatnonzero(fine).tolist(), ends.tolist()):
                groups[k] = texts[begin] if end - begin == 1 else ";".join(texts[begin:end])
                begin = end
        self._code.update(zip(pieces, range(len(self._groups), len(self._groups) + len(pieces))))
        self._table = _appended(self._table, len(self._groups), rows)
        self._groups += groups

    def _know(self, spans: Iterable[list[str]]) -> None:
        """Makes all pieces of these stretches known at the same time."""
        if len(self._groups) > _CACHE_PIECES or self._n_pairs > _CACHE_LINKS:
            self._clear()
        known = self._code
        if new := [p for p in dict.fromkeys(p for span in spans for p in span) if p not in known]:
            self._learn(new)

    def _spans(self, text: str) -> Iterator[list[str]]:
        """The pieces of ``text``, a bounded stretch at a time."""
        at = 0
        while True:
            m = _cut.search(text, at + _SPAN) if self.parted and len(text) - at > 2 * _SPAN else None
            span = text[at : m.start()] if m else text[at:]
            yield _cut.split(span) if self.parted else [span]
            if m is None:
                return
            at = m.end()

    def several(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs (a << 32 | b) with their numbers of links."""
        short = [next(self._spans(t)) if t and len(t) <= 2 * _SPAN else None for t in texts]
        self._know(span for span in short if span)
        for k, (text, span) in enumerate(zip(texts, short)):
            if span or not text:
                yield self._sums([span] if span else [], False)
            else:
                yield self._sums(self._spans(text), True)
                self._know(span for span in short[k + 1 :] if span)  # the long text may have displaced their pieces

    def _sums(self, spans: Iterable[list[str]], know: bool) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        nothing = 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        sums, sha, pairs, times = np.zeros(4, np.int64), hashlib.sha256(), [], []
        for k, span in enumerate(spans):
            if know:
                self._know([span])
            codes = list(map(self._code.__getitem__, span))
            met, n = np.unique(np.array(codes), return_counts=True)
            self._table[met, 5] += 1
            shapes = self._table[met, :4]
            if shapes[:, 0].min() < 0:
                return nothing
            sums += n @ shapes
            sha.update((";" if k else "").encode() + ";".join(map(self._groups.__getitem__, codes)).encode())
            row, at = expand(self._table[met, 4], shapes[:, 3])
            pairs.append(self._pairs[at])
            times.append(n[row])
        if not pairs:
            return nothing
        found, which = np.unique(np.concatenate(pairs), return_inverse=True)
        return *sums.tolist(), sha.hexdigest(), found, np.bincount(which, np.concatenate(times), len(found)).astype(np.int64)

    def __call__(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        return next(self.several([text]))


def _appended(table: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``table``, of which ``n`` rows are in use, with ``more`` behind these; it doubles where it is too small."""
    if n + len(more) > len(table):
        table = np.concatenate([table[:n], np.zeros((max(n, len(more), 1 << 12) + len(more), *table.shape[1:]), table.dtype)])
    table[n : n + len(more)] = more
    return table


def _joined(ids: np.ndarray, group: np.ndarray, n: int) -> list[str]:
    """Each group's ids as text, parted by commas."""
    words = list(map(str, ids.tolist()))
    at = np.searchsorted(group, np.arange(n + 1)).tolist()
    return [words[x] if y - x == 1 else ",".join(words[x:y]) for x, y in zip(at, at[1:])]


def aligner(byte_level: str | None = None, pieces: str | None = None) -> Aligner:
    """This worker's aligner for two vocabulary files."""
    if not byte_level or not pieces:
        import public_tokenizers

        byte_level, pieces = byte_level or public_tokenizers.path(BYTE_LEVEL), pieces or public_tokenizers.path(PIECES)
    if (byte_level, pieces) not in _aligners:
        _aligners[byte_level, pieces] = Aligner(byte_level, pieces)
    return _aligners[byte_level, pieces]


_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, *, byte_level: str | None = None, pieces: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): its counts, block, pairs and times; other columns are left out.

    A block is a run of documents of one task, of ``block_bytes`` of text or one longer document.
    """

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block, size = aligner(byte_level, pieces), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in slices(batch.column(1), 1 << 20):
                rows, blocks = [], []
                for text, row in zip(texts, of.several(texts)):
                    n = len(text or "")
                    if size and size + n > block_bytes:
                        block, size = block + 1, 0
                    size += n
                    rows.append(row)
                    blocks.append(block)
                column = [pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64()) for k in range(5)]
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *[len(r[k]) for r in rows]]).astype(np.int32), np.concatenate([r[k] for r in rows])) for k in (5, 6)]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "pairs", "times"]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *column, pa.array(blocks, pa.int64()), *lists], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(align, f"{_ROW}, block long, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each block (block, pair, docs), and of all (pair, count: documents, best: no pair of its A id has more, n: blocks)."""
    held = written(rows.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count("*").alias("docs")))
    salted = held.groupBy("pair", F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("docs").alias("count"), F.count("*").alias("n"))
    counts = written(salted.groupBy("pair").agg(F.sum("count").alias("count"), F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return held, counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"), "n")


def crosstoken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of ``docs`` (doc_id, text).

    Texts that are null or empty, and those whose bytes a tokenizer doesn't give back, have zeros and ''. Every
    row is a document of its own for the counts, whatever its id; ids may be null. An empty table gives no rows.
    """
    rows = written(aligned(docs, **options))
    held, counts = pair_counts(rows)
    found = spread_join(held.select("block", "pair"), counts, "pair", held.count()).select("block", "pair", "count", "best")

    def sums(documents: pa.Table, looked: pa.Table) -> pa.Table:
        pair, count, best = (looked.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        lists = documents.column("pairs").combine_chunks()
        size = lists.value_lengths().to_numpy()
        at = order[np.searchsorted(pair, lists.flatten().to_numpy(), sorter=order)]
        times = documents.column("times").combine_chunks().flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(size)])
        total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[upto]), pa.int64())
        plain = documents.drop_columns(["pairs", "times", "block"])
        return plain.append_column("n_best", total(times * best[at])).append_column("count_sum", total(times * count[at]))

    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(sums, f"{_ROW}, n_best long, count_sum long").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_crosstoken(spark, sf_dir: str) -> DataFrame:
    """All documents aligned by the byte-level and the piece vocabulary."""
    return crosstoken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
