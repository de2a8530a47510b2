"""Encoded, chunked and damaged bodies of responses, read back without the operator's own reader; clashing columns of near copies."""

import gzip
import re
import zlib

import pytest

from deltadoc.llm import dartminhash, warc

PAGE = "<html><head><title>Ships</title></head><body><p>Ships &amp; harbours</p><a href='/next'>next</a></body></html>" * 30


def chunks(data, n=100):
    return b"".join(b"%x;x=1\r\n%s\r\n" % (len(data[k : k + n]), data[k : k + n]) for k in range(0, len(data), n)) + b"0\r\nTrailer: x\r\n\r\n"


def record(body, headers=b"", payload=None):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + headers + b"\r\n" + body
    return warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", warc.DATE), ("WARC-Target-URI", "u"), ("WARC-Payload-Digest", payload or warc.digest(body))], block)


RAW = PAGE.encode()
BARE = zlib.compressobj(wbits=-15)
FORMS = [
    (RAW, b""), (gzip.compress(RAW), b"Content-Encoding: gzip\r\n"), (gzip.compress(RAW[:500]) + gzip.compress(RAW[500:]), b"Content-Encoding: x-gzip\r\n"),
    (zlib.compress(RAW), b"Content-Encoding: deflate\r\n"), (BARE.compress(RAW) + BARE.flush(), b"Content-Encoding: deflate\r\n"), (chunks(RAW), b"Transfer-Encoding: chunked\r\n"),
    (chunks(gzip.compress(RAW)), b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n"), (RAW, b"Transfer-Encoding: chunked\r\n"), (gzip.compress(gzip.compress(RAW)), b"Content-Encoding: gzip, gzip\r\n"),
]


def plain_fields(member):
    """Headers and block of a gzip member, by splitting alone."""
    head, block = gzip.decompress(member).split(b"\r\n\r\n", 1)
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), block[:-4]


def test_bodies_are_unpacked(spark):
    rows = [(k, bytes(record(body, headers))) for k, (body, headers) in enumerate(FORMS)]
    made = warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    assert len(made) == 2 * len(FORMS) and not any(r.error for r in made) and all(r.payload_holds for r in made)
    for r in made:
        head, block = plain_fields(r.record)
        assert head["WARC-Refers-To"] == "<urn:x>" and block == bytes(r.block) and int(head["Content-Length"]) == len(block)
        if r.record_type == "conversion":
            assert block.decode() == "\n".join(["Ships & harbours\nnext"] * 30)
        else:
            fields = [x.split(": ", 1) for x in block.decode().split("\r\n") if x]
            assert ["title", "Ships"] in fields and ["outlink", "/next"] in fields and "computed-payload-digest" not in dict(fields)


@pytest.mark.parametrize(("body", "headers", "said"), [
    (RAW, b"Content-Encoding: br\r\n", "unknown encoding: br"), (gzip.compress(RAW)[:-20], b"Content-Encoding: gzip\r\n", "ends early"), (b"\x1f\x8bnone", b"Content-Encoding: gzip\r\n", "damaged"),
    (chunks(RAW)[:500], b"Transfer-Encoding: chunked\r\n", "damaged chunks"), (gzip.compress(b"x" * 4000), b"Content-Encoding: gzip\r\n", "too large"),
])
def test_what_cant_be_unpacked_has_an_error(body, headers, said, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 3500)
    meta, text, error = warc.derive(record(body, headers))
    assert text is None and said in error and f"conversion-error: {error}".encode() in meta.block and meta.get("WARC-Concurrent-To") is None


def test_wrong_digests_are_told(spark):
    hexed = "sha1:" + __import__("hashlib").sha1(RAW).hexdigest()
    rows = [(1, bytes(record(RAW, payload="sha1:WRONG"))), (2, bytes(record(RAW, payload="md5:x"))), (3, bytes(record(RAW, payload=hexed))), (4, bytes(record(chunks(RAW), b"Transfer-Encoding: chunked\r\n", warc.digest(RAW))))]
    got = {r.page_id: r for r in warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).where("record_type = 'metadata'").collect()}
    assert {k: r.payload_holds for k, r in got.items()} == {1: False, 2: None, 3: True, 4: True}
    assert re.search(rb"source-payload-digest: sha1:WRONG\r\n", bytes(got[1].block)) and f"computed-payload-digest: {warc.digest(RAW)}".encode() in bytes(got[1].block)


def test_near_copies_of_columns_with_inner_names(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "a", "b", 1), (2, text + " end", "a", "b", 1), (3, "other " * 9, "a", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, words_key string, key int")
    assert sorted(tuple(r) for r in dartminhash.near_copies(docs).collect()) == [(1, 1, 1), (2, 2, 1), (3, 3, 3)]
    assert {r.doc_id for r in dartminhash.one_of_each(docs).collect()} == {1, 3}
