"""Plain text: pages at form feeds, paragraphs at blank lines, running headers and footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltadoc import fixed
from deltadoc.functions import text as T


def pages(files: DataFrame) -> DataFrame:
    """doc_id, page, raw_text, status and approximate_pages of each page (doc_id, text).

    Null texts have no pages. Without a form feed, pages are only estimated.
    """
    parts = F.posexplode(F.split("text", "\f"))
    rows = files.where("text is not null").select("doc_id", ~F.contains("text", F.lit("\f")), parts).toDF("doc_id", "approximate_pages", "at", "raw_text")
    status = F.when(T.squeeze_edges(F.col("raw_text")) == "", "unreadable_page").otherwise("extraction_successful")
    return rows.select("doc_id", (F.col("at") + 1).alias("page"), "raw_text", status.alias("status"), "approximate_pages")


def blocks(files: DataFrame, unicode: bool = True) -> DataFrame:
    """Blocks of plain texts (doc_id, text): white space is one blank, empty paragraphs are left out.

    ``block_index`` counts over the whole document from 0, so ids are ``p<page>-b<index>``.
    """
    paragraphs = pages(files).select("doc_id", "page", F.posexplode(F.split("raw_text", r"\n\s*\n")).alias("para", "raw"))
    rows = paragraphs.select("doc_id", "page", "para", T.squeeze(F.col("raw")).alias("text")).where("text != ''")
    order = Window.partitionBy("doc_id").orderBy("page", "para")
    rows = rows.withColumn("block_index", F.row_number().over(order) - 1)
    return described(rows.select("doc_id", "page", "block_index", "text"), unicode)


def described(rows: DataFrame, unicode: bool = True) -> DataFrame:
    """``rows`` (doc_id, page, block_index, text and maybe block_type, row_key, cells) as full blocks."""
    have = set(rows.columns)
    kind = F.col("block_type") if "block_type" in have else T.block_type(F.col("text"))
    return rows.select(
        "doc_id", "page", "block_index", F.format_string("p%d-b%d", "page", "block_index").alias("block_id"), kind.alias("block_type"), "text",
        T.normalize_text(F.col("text"), unicode).alias("normalized"),
        (F.col("row_key") if "row_key" in have else F.lit(None).cast("string")).alias("row_key"),
        (F.col("cells") if "cells" in have else F.lit(None).cast("array<string>")).alias("cells"),
        (F.col("ocr") if "ocr" in have else F.lit(False)).alias("ocr"),
    )


def renumbered(blocks: DataFrame) -> DataFrame:
    """Blocks with consecutive numbers again, in their order."""
    order = Window.partitionBy("doc_id").orderBy("block_index")
    out = blocks.withColumn("block_index", F.row_number().over(order) - 1)
    return out.withColumn("block_id", F.format_string("p%d-b%d", "page", "block_index"))


def without_runners(blocks: DataFrame) -> DataFrame:
    """Blocks without short texts that come back on most pages of a document of three pages or more.

    Occurrences are counted, not pages. Documents that lose nothing keep their numbers.
    """
    short = F.coalesce((F.length("text") <= fixed.RUNNER_CHARS) & (F.col("normalized") != ""), F.lit(False))
    doc = Window.partitionBy("doc_id")
    turn = F.dense_rank().over(doc.orderBy("page")) - F.when(F.min(F.col("page").isNotNull()).over(doc), 0).otherwise(1)  # null is no page
    rows = blocks.withColumn("_page", turn).withColumn("_pages", F.max("_page").over(doc))
    rows = rows.withColumn("_n", F.sum(short.cast("int")).over(Window.partitionBy("doc_id", "normalized")))
    least = F.greatest(F.lit(3), F.floor(F.col("_pages") * fixed.RUNNER_SHARE))
    runner = short & (F.col("_pages") >= fixed.RUNNER_PAGES) & (F.col("_n") >= least)
    return renumbered(rows.where(~runner).select(*blocks.columns))
