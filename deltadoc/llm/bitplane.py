"""Token ids as binary shards of bit or byte planes.

A shard is one file::

    "BPSHUF01"
    block 0: plane 0, plane 1, ...      each a zstandard frame
    block 1: ...
    documents: doc_id (int64, null flag) and id count of each document, a zstandard frame
    index: one row for each block: file offset, ids, crc32 of the ids, bytes of each plane
    footer: JSON with mode, partition, first id, counts and the places of documents and index
    length of the footer (uint32), "BPSHUF01"

A block holds ``block_ids`` unsigned 32-bit ids. In mode ``byte`` it is transposed to 4 planes, of the
ids' lowest bytes first; in mode ``bit`` to 32 planes, of their lowest bits first. Since the index has
the place of each plane, any range of ids can be read alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltadoc.llm import tokens
from deltadoc.llm.common import shared_dir

MAGIC = b"BPSHUF01"
PLANES = {"byte": 4, "bit": 32}
MANIFEST = ("part", "shard", "first_id", "n_docs", "n_ids")


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of a block of ids, least significant first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        raw = np.empty((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8, n)
    else:
        bits = np.empty((n, 32), np.uint8)
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class ShardWriter:
    """Gathers documents' ids and turns full blocks into planes at once."""

    def __init__(self, partition: int, first_id: int, mode: str = "byte", block_ids: int = 65536, level: int = 3):
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=level)
        self.mode, self.block_ids, self.partition, self.first_id = mode, block_ids, partition, first_id
        self._parts, self._size, self._rest, self._waiting = [MAGIC], len(MAGIC), [], 0
        self._index: list[list[int]] = []
        self._docs: list[tuple[int | None, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append((doc_id, len(ids) // 4))
        self._rest.append(ids)
        self._waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self._waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self._rest)
        step, at = 4 * self.block_ids, 0
        while len(data) - at >= step or (last and at < len(data)):
            block = data[at : at + step]
            planes = [self._zstd.compress(p) for p in to_planes(np.frombuffer(block, "<u4"), self.mode)]
            self._index.append([self._size, len(block) // 4, zlib.crc32(block), *map(len, planes)])
            self._parts += planes
            self._size += sum(map(len, planes))
            at += step
        self._rest = [data[at:]]
        self._waiting = (len(data) - at) // 4

    def finish(self) -> bytes:
        self._flush(True)
        docs = np.array([(0 if d is None else d, d is None, n) for d, n in self._docs], dtype="<i8").reshape(-1, 3)
        table = self._zstd.compress(docs.tobytes())
        index = self._zstd.compress(np.array(self._index, dtype="<i8").tobytes())
        foot = json.dumps({
            "mode": self.mode, "block_ids": self.block_ids, "partition": self.partition,
            "first_id": self.first_id, "n_ids": self.n_ids, "n_docs": len(docs), "n_blocks": len(self._index),
            "docs": [self._size, len(table)], "index": [self._size + len(table), len(index)],
        }).encode()
        self._parts += [table, index, foot, len(foot).to_bytes(4, "little"), MAGIC]
        return b"".join(self._parts)


class ShardReader:
    """Reads a shard's bytes; raises ValueError where they are damaged."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a shard of id planes")
        self._zstd, self._data = zstandard.ZstdDecompressor(), data
        size = int.from_bytes(data[-12:-8], "little")
        self.head = json.loads(data[-12 - size : -12])
        take = lambda at: self._zstd.decompress(data[at[0] : at[0] + at[1]])
        width = 3 + PLANES[self.head["mode"]]
        self.index = np.frombuffer(take(self.head["index"]), "<i8").reshape(-1, width)
        self.docs = np.frombuffer(take(self.head["docs"]), "<i8").reshape(-1, 3)

    def block(self, k: int) -> np.ndarray:
        at, n, crc, *sizes = map(int, self.index[k])
        planes = []
        for size in sizes:
            planes.append(self._zstd.decompress(self._data[at : at + size]))
            at += size
        ids = from_planes(planes, n, self.head["mode"])
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} doesn't match its checksum")
        return ids

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids from ``begin`` up to ``end`` of this shard; only their blocks are read."""
        if begin >= end:
            return np.empty(0, "<u4")
        size = self.head["block_ids"]
        first = begin // size
        got = np.concatenate([self.block(k) for k in range(first, (end - 1) // size + 1)])
        return got[begin - first * size : end - first * size]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, place of its first id in this shard, and its ids; one block is held at a time."""
        rest, k, at = np.empty(0, "<u4"), 0, 0
        for doc_id, null, n in self.docs:
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield None if null else int(doc_id), at, rest[:n]
            rest, at = rest[n:], at + int(n)


def _place(path: str):
    """The file system and path of a URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_shards(
    docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = tokens.END_ID,
    mode: str = "byte", block_ids: int = 65536, shard_ids: int = 1 << 22,
) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes shards under ``path`` in ascending doc_id order.

    Range partitions are encoded and written by their own tasks; each shard gets a final name that
    depends only on its place and appears by a rename, so a task that runs twice leaves one file.
    Null ids come first, equal ids in order of their texts, null texts are empty. The shards are written
    when the result is first evaluated; it has a row for each: part, shard, first_id (ids before it in its
    partition), n_docs, n_ids.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = tokens.encoder(vocabulary)
        part, made, writer, first = TaskContext.get().partitionId(), [], None, 0
        system, folder = _place(path)

        def close() -> None:
            nonlocal writer, first
            name = f"{folder}/part-{part:06d}-{len(made):06d}"
            data = writer.finish()
            attempt = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
            with system.open_output_stream(attempt) as out:
                out.write(data)
            system.move(attempt, f"{name}.bps")
            made.append((part, len(made), first, len(writer._docs), writer.n_ids))
            first += writer.n_ids
            writer = None

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in tokens.slices(batch.column(1)):
                for doc_id, data in zip(ids[a:b], encode_texts(texts, end_id)):
                    if writer is None:
                        writer = ShardWriter(part, first, mode, block_ids)
                    writer.add(doc_id, data)
                    if writer.n_ids >= shard_ids:
                        close()
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in made], pa.int64()) for k, n in enumerate(MANIFEST)})

    system, folder = _place(path)
    system.create_dir(folder, recursive=True)
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, ", ".join(f"{n} long" for n in MANIFEST))


def read_shards(spark, path: str) -> DataFrame:
    """Documents of the shards under ``path``: doc_id, part, first_id (within the part), ids (binary)."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = ShardReader(content.as_py())
                rows, size = [], 0
                for doc_id, at, ids in shard.documents():
                    rows.append((doc_id, shard.head["partition"], shard.head["first_id"] + at, ids.tobytes()))
                    size += len(rows[-1][3])
                    if size > 1 << 23:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"doc_id": pa.int64(), "part": pa.int64(), "first_id": pa.int64(), "ids": pa.binary()}
        return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds.items())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bps").load(path).select("content")
    return files.mapInArrow(decode, "doc_id long, part long, first_id long, ids binary")


def op9_bitplane(spark, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as shards of byte planes, reads them back and sums them up."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_dir(spark)
    sums = write_shards(docs, path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # as many rows as tasks
    ahead, starts = 0, []
    for row in sorted(sums):
        starts.append((row.part, ahead))
        ahead += row.n
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    parts = spark.createDataFrame(starts, "part long, ahead long")
    return read_shards(spark, path).select(
        "doc_id", "part", "first_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    ).join(parts, "part").select("doc_id", (F.col("first_id") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
