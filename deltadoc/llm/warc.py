"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record holds an HTTP response. Its derivatives are a ``metadata`` record with what the response
said of itself (status, headers, digests, title, links) and a ``conversion`` record with its text. Both
name the response by WARC-Refers-To, WARC-Refers-To-Target-URI and WARC-Refers-To-Date and are linked with
each other by WARC-Concurrent-To; identifiers follow from the response's, so a rerun makes the same ones.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
#: A body that unpacks to more is an error.
MOST_BYTES = 1 << 28
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")

_opening = re.compile(r"<(?:!--|(script|style|noscript|template|head)\b)", re.I)
_closing = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "head")} | {None: re.compile("-->")}
_breaks = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|nav|header|footer|main|blockquote|pre|td|th)\b[^>]*>", re.I)
_tag = re.compile(r"<[^>]*>")
_blanks = re.compile(r"[^\S\n]+")
_lines = re.compile(r" ?\n[ \n]*")
_title = re.compile(r"<title\b[^>]*>", re.I)
_title_end = re.compile(r"</title", re.I)
_anchor = re.compile(r"<a\b", re.I)
_href = re.compile(r"\bhref\s*=", re.I)
_value = re.compile(r"""\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_charset = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


@dataclass
class Record:
    """Headers in order, as (name, value), and the block."""

    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for n, v in self.headers if n.lower() == name.lower()), default)

    def __bytes__(self) -> bytes:
        head = "".join(f"{n}: {v}\r\n" for n, v in [*self.headers, ("Content-Length", str(len(self.block)))])
        return f"{VERSION}\r\n{head}\r\n".encode("utf-8", "surrogatepass") + self.block + b"\r\n\r\n"

    def compressed(self, level: int = 6) -> bytes:
        """A gzip member of its own, as in .warc.gz files."""
        return gzip.compress(bytes(self), level, mtime=0)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, ' '.join(parts))}>"


def read_records(data: bytes) -> Iterator[Record]:
    """Records of a WARC file's bytes, plain or in gzip members; raises ValueError where they are damaged."""
    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest:
            d = zlib.decompressobj(31)
            try:
                parts.append(d.decompress(rest) + d.flush())
            except zlib.error as e:
                raise ValueError(f"damaged gzip member: {e}") from e
            rest = d.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else []
        if not lines or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers: list[tuple[str, str]] = []
        for line in lines[1:]:
            if line[:1] in " \t" and headers:  # a folded value
                headers[-1] = headers[-1][0], f"{headers[-1][1]} {line.strip()}"
            else:
                name, colon, value = line.partition(":")
                if not colon:
                    raise ValueError(f"bad header at byte {at}")
                headers.append((name.strip(), value.strip()))
        length = next((v for n, v in headers if n.lower() == "content-length"), "")
        begin = end + 4
        if not length.isdigit() or begin + int(length) > len(data):
            raise ValueError(f"bad length at byte {at}")
        at = begin + int(length)
        yield Record([h for h in headers if h[0].lower() != "content-length"], data[begin:at])
        while data[at : at + 2] == b"\r\n":
            at += 2


def http_parts(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers and body of an HTTP response; a block without a status line is a body only."""
    head, blank, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    status = re.match(r"HTTP/\S+\s+(\d{3})", lines[0])
    if not status or not blank:
        return None, [], block
    headers = [(n.strip(), v.strip()) for n, c, v in (x.partition(":") for x in lines[1:]) if c]
    return int(status[1]), headers, body


def unchunked(body: bytes) -> bytes:
    """A body in chunks put together; raises ValueError where they are damaged. Trailers are left out."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"\s*([0-9A-Fa-f]{1,15})\s*(?:;|$)", body[at:end]) if end >= 0 else None
        if size is None:
            raise ValueError("damaged chunks")
        n, begin = int(size[1], 16), end + 2
        if n == 0:
            return b"".join(parts)
        if begin + n > len(body):
            raise ValueError("damaged chunks")
        parts.append(body[begin : begin + n])
        at = begin + n
        if body[at : at + 2] != b"\r\n":
            raise ValueError("damaged chunks")
        at += 2


def inflated(body: bytes, bits: int) -> bytes:
    """All members of a gzip (bits 31), zlib (15) or bare deflate (-15) stream; ValueError if damaged, cut off or too large."""
    parts, size = [], 0
    while body:
        d = zlib.decompressobj(bits)
        try:
            parts.append(d.decompress(body, MOST_BYTES - size + 1))
        except zlib.error as e:
            raise ValueError(f"damaged body: {e}") from e
        size += len(parts[-1])
        if size > MOST_BYTES:
            raise ValueError("body too large")
        if not d.eof:
            raise ValueError("damaged body: it ends early")
        body = d.unused_data if bits == 31 else b""
    return b"".join(parts)


def decoded(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without its transfer and content encodings, the last one first; ValueError for damaged or unknown ones.

    A body that says ``chunked`` but has no chunk line was stored without it, and stays as it is.
    """
    codings = lambda name: [c for n, v in headers if n.lower() == name for c in re.split(r"[,\s]+", v.lower()) if c]
    for coding in [*codings("content-encoding"), *codings("transfer-encoding")][::-1]:
        if coding == "chunked":
            body = unchunked(body) if re.match(rb"\s*[0-9A-Fa-f]+\s*(?:;[^\r\n]*)?\r\n", body) else body
        elif coding in ("gzip", "x-gzip"):
            body = inflated(body, 31)
        elif coding == "deflate":
            try:
                body = inflated(body, 15)
            except ValueError:
                body = inflated(body, -15)
        elif coding != "identity":
            raise ValueError(f"unknown encoding: {coding}")
    return body


def payload_holds(source: Record) -> bool | None:
    """Whether the response's payload digest is that of its body, with or without chunks; None without a SHA-1 digest."""
    said = source.get("WARC-Payload-Digest")
    if not said or not said.lower().startswith("sha1:"):
        return None
    _, headers, body = http_parts(source.block)
    forms = [body]
    if any(n.lower() == "transfer-encoding" and "chunked" in v.lower() for n, v in headers):
        try:
            forms.append(unchunked(body))
        except ValueError:
            pass
    value = said[5:].strip().upper()
    return any(value in (digest(x)[5:], hashlib.sha1(x).hexdigest().upper()) for x in forms)


def response(uri: str | None, page: str | None, date: str = DATE) -> Record:
    """A response record for a fetched page; a null URI or page is empty."""
    body = (page or "").encode("utf-8", "surrogatepass")
    uri = re.sub(r"[\r\n]", "", uri or "")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    payload = digest(body)
    return Record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", uri, date, payload)), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)),
    ], block)


def without_hidden(page: str) -> str:
    """The page with a blank for each comment and each closed element whose text isn't shown.

    A closing that isn't found once isn't looked for again, so that each character is met a bounded number of times.
    """
    parts, at, begin, missing = [], 0, 0, set()
    while (m := _opening.search(page, at)) is not None:
        name = m[1].lower() if m[1] else None
        end = None if name in missing else _closing[name].search(page, m.end())
        if end is None:
            missing.add(name)
            at = m.end()
            continue
        parts += [page[begin : m.start()], " "]
        begin = at = end.end()
    return "".join([*parts, page[begin:]])


def plain_text(page: str) -> str:
    """Visible text, a line for each block of the page. What follows the last ``>`` holds no whole tag."""
    text = without_hidden(page)
    last = text.rfind(">") + 1
    text = _tag.sub("", _breaks.sub("\n", text[:last])) + text[last:]
    if "&" in text:
        text = html.unescape(text)
    return _lines.sub("\n", _blanks.sub(" ", text)).strip()


def title_of(page: str) -> str | None:
    """The text after the first whole ``title`` tag up to its end; None without either."""
    m = _title.search(page, 0, page.rfind(">") + 1)
    end = m and _title_end.search(page, m.end())
    return page[m.end() : end.start()] if end else None


def links_of(page: str) -> list[str]:
    """The first ``href`` with a value of each ``a`` tag, in order; tags are walked once, forwards."""
    found, at = [], 0
    while (m := _anchor.search(page, at)) is not None:
        end = page.find(">", m.end())
        end = len(page) if end < 0 else end
        at = max(end, m.end())
        near = m.end()
        while (h := _href.search(page, near, end)) is not None:
            value = _value.match(page, h.end())
            if value:
                found.append(value[1] or value[2] or value[3] or "")
                at = value.end()
                break
            near = h.end()
    return found


def derive(source: Record, date: str | None = None) -> tuple[Record, Record | None, str | None]:
    """The metadata and the conversion record of a response record, and why there is no conversion.

    A body is unpacked by its encodings; where that fails there is no text, title or link. A payload digest
    that isn't the body's is kept with the one that is beside it.
    """
    status, headers, raw = http_parts(source.block)
    try:
        body, error = decoded(headers, raw), None
    except ValueError as e:
        body, error = b"", str(e)
    its_id, uri, when = source.get("WARC-Record-ID", ""), source.get("WARC-Target-URI", ""), source.get("WARC-Date", DATE)
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    charset = (_charset.search(kind) or _charset.search(body[:1024].decode("latin-1")) or ["", "utf-8"])[1]
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    payload = source.get("WARC-Payload-Digest") or digest(raw)
    meta_id, text_id = record_id("metadata", its_id), record_id("conversion", its_id)
    title = title_of(page)
    links = dict.fromkeys(html.unescape(x).strip() for x in links_of(page))
    one = lambda s: re.sub(r"\s+", " ", s).strip()
    fields = [("source-record-id", its_id), ("source-payload-digest", payload)]
    fields += [("source-block-digest", source.get("WARC-Block-Digest") or digest(source.block))]
    fields += [("computed-payload-digest", digest(raw))] if payload_holds(source) is False else []
    fields += [("http-status", str(status))] if status is not None else []
    fields += [(f"http-header-{n.lower()}", v) for n, v in headers]
    fields += [("conversion-error", error)] if error else []
    fields += [("charset", charset)] + ([("title", one(html.unescape(title)))] if title is not None else [])
    fields += [("outlink", one(x)) for x in links if x]
    meta_block = "".join(f"{n}: {v}\r\n" for n, v in fields).encode("utf-8", "surrogatepass")
    text = plain_text(page).encode("utf-8", "surrogatepass")
    shared = [("WARC-Date", date or when), ("WARC-Target-URI", uri), ("WARC-Refers-To", its_id), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", when)]
    beside = lambda other: [] if error else [("WARC-Concurrent-To", other)]
    meta = Record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *shared, *beside(text_id), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(meta_block))], meta_block)
    made = Record([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *shared, *beside(meta_id), ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(text))], text)
    return meta, None if error else made, error


def responses(pages: DataFrame) -> DataFrame:
    """page_id and a response record (bytes) of each page (page_id, url, html); other columns are left out.

    Null urls and pages are empty. A record's id follows from the url, the date and the page, so rows that are
    equal in these get the same one, as one capture stored twice; each row keeps its record.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                made = [bytes(response(u.as_py(), p.as_py())) for u, p in zip(b.column(1), b.column(2))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, record binary")


DERIVED = "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, source_payload_digest string, block_digest string, block binary, record binary, payload_holds boolean, error string"


def derivatives(records: DataFrame, level: int = 1) -> DataFrame:
    """Two rows for each response among ``records`` (page_id, record): its metadata and its conversion.

    ``record`` is the derivative as a gzip member. Null, damaged and other records give one row with ``error``, and
    a response whose body can't be unpacked has one with ``error`` in place of its conversion. ``payload_holds`` says
    whether the response's payload digest is right, null without one.
    Ids follow from the response's, so equal responses have equal derivatives, a pair for each row.
    """
    names = [x.split()[0] for x in DERIVED.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}.get(x.split()[1], pa.string()) for x in DERIVED.split(", ")]

    def rows(page_id, data):
        try:
            found = list(read_records(data)) if data is not None else []
        except ValueError as e:
            yield (page_id, *[None] * 10, str(e))
            return
        for source in found:
            if source.get("WARC-Type") == "response":
                *made, error = derive(source)
                payload, holds = source.get("WARC-Payload-Digest") or digest(http_parts(source.block)[2]), payload_holds(source)
                for r in made:
                    if r is None:
                        yield (page_id, "conversion", None, source.get("WARC-Record-ID"), None, source.get("WARC-Target-URI"), payload, None, None, None, holds, error)
                        continue
                    get = [r.get(n) for n in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Concurrent-To", "WARC-Target-URI")]
                    yield (page_id, *get, payload, r.get("WARC-Block-Digest"), r.block, r.compressed(level), holds, None)
        if not any(r.get("WARC-Type") == "response" for r in found):
            yield (page_id, *[None] * 10, "no response record")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                made = [r for i, d in zip(b.column(0).to_pylist(), b.column(1)) for r in rows(i, d.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=names)

    return records.select(F.col("page_id").cast("long"), "record").mapInArrow(run, DERIVED)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """The derivatives of every page's response record, with digests of their blocks and stored bytes."""
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "source_payload_digest", "block_digest",
        F.length("block").cast("long").alias("block_bytes"), F.sha2("block", 256).alias("block_sha256"),
        F.length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"), "error",
    )
