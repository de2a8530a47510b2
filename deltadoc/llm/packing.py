"""Packing of documents into sequences: first-fit decreasing in randomised groups.

Documents longer than a sequence are cut into full pieces and one rest. Pieces are dealt at random into
groups of about ``group_pieces``; each group is packed by itself, largest pieces first, each into the
first sequence that has room. A tournament tree over the sequences' free room finds that one in
logarithmic time: each inner node holds the larger room of its two children.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltadoc.llm import tokens
from deltadoc.llm.common import written

SEQUENCE = 4096


class TournamentTree:
    """Free room of up to ``bins`` bins; finds the first one with enough room."""

    def __init__(self, bins: int, room: int):
        self._leaves = 1 << max(0, (bins - 1).bit_length())
        self._most = [room] * (2 * self._leaves)
        for k in range(bins, self._leaves):
            self._set(k, 0)

    def _set(self, k: int, room: int) -> None:
        most, k = self._most, k + self._leaves
        most[k] = room
        while k > 1:
            k //= 2
            best = max(most[2 * k], most[2 * k + 1])
            if most[k] == best:
                break
            most[k] = best

    def take(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first bin that has room; returns the bin and what it held before."""
        most = self._most
        if most[1] < size:
            raise ValueError(f"no bin has room for {size}")
        k = 1
        while k < self._leaves:
            k = 2 * k if most[2 * k] >= size else 2 * k + 1
        room = most[k]
        self._set(k - self._leaves, room - size)
        return k - self._leaves, room


def first_fit_decreasing(sizes: np.ndarray, room: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; equal sizes keep their order."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    tree = TournamentTree(max(1, len(sizes)), room)
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        bins[i], free = tree.take(int(sizes[i]))
        offsets[i] = room - free
    return bins, offsets


def pieces(docs: DataFrame, *, room: int = SEQUENCE, vocabulary: str | None = None, end_id: int = tokens.END_ID) -> DataFrame:
    """Pieces of at most ``room`` ids: doc_id, start, length, ids_crc32, doc_tokens; other columns are left out.

    Null texts are empty: a document has at least its end id. Rows of equal ids are documents of their own.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for a, b, texts in tokens.slices(batch.column(1)):
                for doc_id, data in zip(ids[a:b], encode(texts, end_id)):
                    for at in range(0, len(data), 4 * room):
                        piece = data[at : at + 4 * room]
                        rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4))
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack(cut: DataFrame, *, room: int = SEQUENCE, group_pieces: int = 4096, seed: int = 17) -> DataFrame:
    """``cut`` (any columns with ``length`` of 1 to ``room``) with sequence_id and offset.

    Columns of these two names are replaced, all others are kept. Equal rows are pieces of their own, pieces
    of equal length keep the order of doc_id and start, and no rows give no sequences. Groups are dealt by a hash of each row's place in the written table, so that no key can crowd one of
    them; their number follows the number of rows, so each task's share stays bounded. A sequence takes
    pieces of one group only, without gaps from offset 0.
    """
    cut = written(cut.drop("sequence_id", "offset"))
    own = "pack_group"
    while own in [c.lower() for c in cut.columns]:
        own += "_"
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([c for c in ("doc_id", "start") if c in frame.columns], kind="stable") if "doc_id" in frame else frame
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), room)
        group = frame.pop(own).to_numpy(dtype=np.int64)
        return frame.assign(sequence_id=(group << 24) + bins, offset=offsets)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy(own).applyInPandas(fill, f"{kinds}, sequence_id long, offset long")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs))
