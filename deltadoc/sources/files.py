"""Files as rows: dispatch by extension, validation, integrity and office documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltadoc import fixed
from deltadoc.functions import text as T
from deltadoc.sources import plain

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, extension, content, size_bytes and sha256 of each file under ``path``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return described(rows.select("path", "content"))


def described(files: DataFrame) -> DataFrame:
    """Adds filename, extension, size_bytes and sha256 to ``files`` (path, content)."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.withColumn("filename", name).withColumn("extension", extension).withColumn("size_bytes", F.length("content").cast("long")).withColumn("sha256", F.sha2("content", 256))


def ingest_error(extension: Column, size_bytes: Column) -> Column:
    """Why a file can't be taken in, or null: an unsupported format, an empty or a too large file."""
    return (
        F.when(~F.coalesce(extension, F.lit("")).isin(*fixed.SUPPORTED), F.concat(F.lit("Unsupported format: "), F.coalesce(extension, F.lit(""))))
        .when(F.coalesce(size_bytes, F.lit(0)) == 0, "The file is empty.")
        .when(size_bytes > fixed.UPLOAD_BYTES, "The file is larger than 80 MB.")
    )


def text_of(files: DataFrame, doc_id: str = "path") -> DataFrame:
    """doc_id and text of the plain-text files among ``files``."""
    return files.where(F.col("extension").isin("txt", "md")).select(F.col(doc_id).alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


def verify(stored: DataFrame, originals: DataFrame) -> DataFrame:
    """doc_id and integrity (verified, failed or missing): ``stored`` (doc_id, sha256) against ``originals`` (doc_id, content)."""
    now = originals.select("doc_id", F.sha2("content", 256).alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("sha256"), "verified").otherwise("failed")
    return stored.join(now, "doc_id", "left").select("doc_id", state.alias("integrity"))


def docx_blocks(files: DataFrame, doc_id: str = "path") -> DataFrame:
    """Blocks of the DOCX files among ``files``: paragraphs and table rows in body order.

    Pages follow rendered or explicit page breaks; without any, a page is taken to hold 2600 characters.
    A file that can't be opened has no blocks.
    """
    names = ["doc_id", "page", "block_index", "block_type", "text", "cells"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    rows += [(i, page, k, kind, text, cells) for k, (page, kind, text, cells) in enumerate(docx_body(content.as_py()))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)

    some = files.where(F.col("extension") == "docx").select(F.col(doc_id).cast("string"), "content")
    rows = some.mapInArrow(run, "doc_id string, page int, block_index int, block_type string, text string, cells array<string>")
    key = F.when(F.col("block_type") == "table_row", T.normalize_text(F.element_at("cells", 1)))
    kind = F.when(F.col("block_type") == "text", T.block_type(F.col("text"))).otherwise(F.col("block_type"))
    return plain.described(rows.withColumn("row_key", key).withColumn("block_type", kind))


def docx_body(content: bytes) -> Iterator[tuple[int, str, str, list[str] | None]]:
    """Page, type (``text`` where the look decides), text and cells of each block of a document's body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    hinted = any(_breaks(e) for e in body.iter())
    page, chars = 1, 0
    for item in body:
        made: list[tuple[str, str, list[str] | None]] = []
        if item.tag == f"{_W}p":
            page += sum(map(_breaks, item.iter()))
            text = " ".join(_text(item).split())
            made = [(_style(item), text, None)] if text else []
        elif item.tag == f"{_W}tbl":
            rows = [[" ".join(" ".join(_text(p) for p in c.iter(f"{_W}p")).split()) for c in r.findall(f"{_W}tc")] for r in item.findall(f"{_W}tr")]
            rows = [r for r in rows if any(r)]
            made = [("table_row" if k else "table", " | ".join(r), r) for k, r in enumerate(rows)]
        for kind, text, cells in made:
            if not hinted:
                if chars and chars + len(text) > fixed.DOCX_PAGE_CHARS:
                    page, chars = page + 1, 0
                chars += len(text)
            yield page, kind, text, cells


def _breaks(e: ElementTree.Element) -> bool:
    return e.tag == f"{_W}lastRenderedPageBreak" or (e.tag == f"{_W}br" and e.get(f"{_W}type") == "page")


def _text(p: ElementTree.Element) -> str:
    return "".join(e.text or "" if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "" for e in p.iter())


def _style(p: ElementTree.Element) -> str:
    style = next((e.get(f"{_W}val", "").lower() for e in p.iter(f"{_W}pStyle")), "")
    if style.startswith("heading") or style == "title":
        return "heading"
    return "list_item" if "list" in style or next(p.iter(f"{_W}numPr"), None) is not None else "text"
