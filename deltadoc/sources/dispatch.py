"""Files of several formats to one table of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltadoc.sources import files, plain


def extract(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of all files that can be read, and a row with ``error`` for each file.

    ``listed``: as ``files.described`` gives it. PDF files have no parser here: their pages come in as text
    items through ``layout``, and until then they are reported as unsupported.
    """
    why = files.ingest_error(F.col("extension"), F.col("size_bytes"))
    why = F.coalesce(why, F.when(F.col("extension") == "pdf", "PDF pages are read from text items."))
    rows = listed.withColumn("error", why)
    good = rows.where("error is null")
    texts = plain.blocks(files.text_of(good)).select("*")
    blocks = plain.without_runners(texts.unionByName(files.docx_blocks(good)))
    some = blocks.select(F.col("doc_id").alias("path")).distinct().withColumn("_some", F.lit(True))
    states = rows.join(some, "path", "left").withColumn("error", F.coalesce("error", F.when(F.col("_some").isNull(), "No text was found.")))
    return blocks, states.select("path", "filename", "sha256", "size_bytes", "error")
