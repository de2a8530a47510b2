"""Ogg media columns: writing, checked reading and features of 8-bit samples.

An Ogg page has a checksum, a serial number of its logical stream, a sequence number within that stream,
a granule position and lacing values that cut its body into packets; a packet can go on over several
pages. The reader verifies checksums, reassembles packets, separates the logical streams of one physical
stream and derives each packet's time from granule positions.

Payloads are kept as frames of 192 unsigned 8-bit samples that alternate between two logical streams (left
and right). A stream's first packet describes it; its granule position counts samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltadoc.llm.common import written

FRAME = 192
RATE = 48_000
PACKET_FRAMES = 40
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
STREAM = struct.Struct("<8sIBBHQ")  # magic, rate, channel, channels, frame size, samples of the stream
MAGIC = b"PCMU8\0\0\0"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 0x04c11db7, highest bit first, no inversion) by zlib's reflected one."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_REVERSED), "little")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    blank = HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one logical stream; the first packet has a page of its own."""
    out: list[bytes] = []

    def add(flags: int, granule: int, lacing: bytes, body: bytes) -> None:
        out.append(_page(flags | (FIRST if not out else 0), granule, serial, len(out), lacing, body))

    last = len(packets) - 1
    add(LAST if last == 0 else 0, granules[0], _lacing(packets[0]), packets[0])
    lacing, body, granule, flags = bytearray(), [], -1, 0
    for k in range(1, len(packets)):
        values, at = _lacing(packets[k]), 0
        while values:
            n = min(255 - len(lacing), len(values))
            now, values = values[:n], values[n:]
            lacing += now
            body.append(packets[k][at : at + sum(now)])
            at += sum(now)
            if not values:
                granule = granules[k]
            if len(lacing) == 255 or (k == last and not values):
                add(flags | (LAST if k == last and not values else 0), granule, bytes(lacing), b"".join(body))
                lacing, body, granule, flags = bytearray(), [], -1, CONTINUED if values else 0
    return out


def _lacing(packet: bytes) -> bytes:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def interleave(streams: list[list[bytes]]) -> bytes:
    """One physical stream: all first pages, then the others in turn."""
    out = [s[0] for s in streams]
    for k in range(1, max(map(len, streams), default=0)):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


def encode(payload: bytes) -> bytes:
    """``payload``, a positive multiple of 192 bytes, as two logical streams; equal payloads give equal bytes."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload has one or more frames of 192 bytes")
    frames, crc, streams = np.frombuffer(payload, np.uint8).reshape(-1, FRAME), zlib.crc32(payload), []
    for channel in range(2):
        data, step = frames[channel::2].tobytes(), FRAME * PACKET_FRAMES
        packets = [STREAM.pack(MAGIC, RATE, channel, 2, FRAME, len(data))]
        packets += [data[a : a + step] for a in range(0, len(data), step)]
        granules = [0, *(min(a + step, len(data)) for a in range(0, len(data), step))]
        streams.append(stream_pages((crc + channel) & 0xFFFFFFFF, packets, granules))
    return interleave(streams)


@dataclass
class LogicalStream:
    """What was read of one serial number. starts: the sample at which each packet begins, or None where unknown."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)
    lost: int = 0
    first: bool = False
    last: bool = False
    _sequence: int = -1
    _open: list[bytes] | None = None

    def starts(self, samples=len) -> list[int | None]:
        return [None if e is None else e - samples(p) for p, e in zip(self.packets, self.ends)]


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes] | None]:
    """Flags, granule, serial, sequence, lacing and body of each sound page; None for each damaged place."""
    at, bad = 0, False
    while at < len(data):
        if data[at : at + 4] == b"OggS" and at + 27 <= len(data):
            _, version, flags, granule, serial, sequence, crc, n = HEAD.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(data):
                if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc:
                    bad = False
                    yield flags, granule, serial, sequence, lacing, data[end - sum(lacing) : end]
                    at = end
                    continue
        if not bad:
            yield None
            bad = True
        at = data.find(b"OggS", at + 1)
        if at < 0:
            return


def demultiplex(data: bytes, samples=len) -> dict[int, LogicalStream]:
    """Logical streams by serial number, in order of appearance.

    A damaged page, or one that is missing by its sequence number, loses the packets that it holds and
    no other; ``lost`` counts such gaps. ``samples`` gives a packet's samples, from which the times of
    packets that end before their page's last one are counted back.
    """
    streams: dict[int, LogicalStream] = {}
    for page in read_pages(data):
        if page is None:
            continue
        flags, granule, serial, sequence, lacing, body = page
        s = streams.setdefault(serial, LogicalStream(serial))
        if sequence != s._sequence + 1:
            s.lost += 1
            s._open = None
        s._sequence = sequence
        s.first |= bool(flags & FIRST)
        s.last |= bool(flags & LAST)
        if not flags & CONTINUED:
            if s._open is not None:
                s.lost += 1
            s._open = []
        skip, at, size, ended = s._open is None, 0, 0, []
        parts = s._open or []
        for v in lacing:
            size += v
            if v < 255:
                parts.append(body[at : at + size])
                if not skip:
                    ended.append(b"".join(parts))
                at, size, parts, skip = at + size, 0, [], False
        if size:
            parts.append(body[at : at + size])
        if lacing:
            s._open = parts if lacing[-1] == 255 and not skip else None
        times, end = [], granule if granule >= 0 and ended else None
        for p in reversed(ended):
            times.append(end)
            end = None if end is None else end - samples(p)
        s.packets += ended
        s.ends += reversed(times)
    return streams


def decode(media: bytes) -> bytes:
    """The payload of ``encode``; raises ValueError where a stream is damaged, incomplete or unknown."""
    parts: dict[int, tuple[int, list[tuple[int, bytes]]]] = {}
    for s in demultiplex(media).values():
        if not (s.packets and s.first and s.last) or s.lost or len(s.packets[0]) != STREAM.size:
            raise ValueError(f"stream {s.serial} is damaged")
        magic, rate, channel, channels, frame, total = STREAM.unpack(s.packets[0])
        if magic != MAGIC or (rate, channels, frame) != (RATE, 2, FRAME):
            raise ValueError(f"stream {s.serial} has an unknown format")
        timed = sorted(zip(s.starts()[1:], s.packets[1:]))
        if sum(len(p) for _, p in timed) != total or any(t != k for (t, _), k in zip(timed, np.cumsum([0, *(len(p) for _, p in timed)]).tolist())):
            raise ValueError(f"stream {s.serial} has a gap")
        parts[channel] = total, [p for _, p in timed]
    if set(parts) != {0, 1}:
        raise ValueError("a channel is missing")
    frames = np.empty(((parts[0][0] + parts[1][0]) // FRAME, FRAME), np.uint8)
    for channel, (_, packets) in parts.items():
        frames[channel::2] = np.frombuffer(b"".join(packets), np.uint8).reshape(-1, FRAME)
    return frames.tobytes()


def features(payload: bytes) -> str:
    """Duration in milliseconds, level, power, sign changes about the middle level and an 8-bin histogram."""
    x = np.frombuffer(payload, np.uint8)
    signed = x.astype(np.int32) - 128
    above = signed >= 0
    bins = np.bincount(x >> 5, minlength=8)
    return (
        f"ms={len(x) * 1000 // (2 * RATE)};level={int(x.sum(dtype=np.int64)) * 100 // len(x)};"
        f"power={int((signed * signed).sum(dtype=np.int64)) // len(x)};turns={int((above[1:] != above[:-1]).sum())};"
        f"bins={','.join(map(str, bins.tolist()))}"
    )


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and its payload: followed by blanks up to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, bytes))
        if size >= most or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of each document (doc_id, text); null texts are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in batches:
            rows = ((i, n, encode(p)) for i, (n, p) in ((i, padded(t.as_py())) for i, t in zip(b.column(0).to_pylist(), b.column(1))))
            yield from _batches(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Digests and features of a media column (doc_id, n_bytes, media).

    A null or damaged medium keeps its row; ``error`` says what is wrong and the payload's columns are null.
    """
    kinds = [("doc_id", "long"), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("error", "string")]
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in kinds])

    def row(doc_id, n_bytes, data):
        if data is None:
            return doc_id, n_bytes, None, None, None, None, None, None, "no medium"
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            p = decode(data)
        except ValueError as e:
            return doc_id, n_bytes, None, None, None, *stored, None, str(e)
        return doc_id, n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), *stored, features(p), None

    def run(batches):
        for b in batches:
            yield from _batches((row(i, n, m.as_py()) for i, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))), schema)

    return media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media").mapInArrow(run, ", ".join(map(" ".join, kinds)))


def op2_ogg(spark, sf_dir: str) -> DataFrame:
    """Every whole text as an Ogg medium, stored as a table, read back and summed up."""
    return from_media(written(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
