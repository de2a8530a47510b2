"""Stored tables: write-once originals, replaced rows and an append-only trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def put_once(originals: DataFrame, path: str) -> None:
    """Originals into a new folder; an existing one is an error and stays as it is."""
    originals.write.mode("errorifexists").parquet(path)


def replace_rows(rows: DataFrame, path: str, by: str) -> None:
    """Rows in place of those with the same ``by``; other partitions aren't touched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(events: DataFrame, path: str) -> None:
    """Events after those that are there; nothing is ever rewritten."""
    events.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def erased(rows: DataFrame, path: str) -> None:
    """Leaves a stored table without rows, with its columns."""
    rows.limit(0).write.mode("overwrite").parquet(path)


def with_missing(orgs: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """``orgs`` (org_id, ``key``) and a row for each wanted name that has none; a new id follows from the name."""
    names = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(orgs, key, "left_anti")
    return orgs.select("org_id", key).unionByName(names.select(F.sha2(key, 256).alias("org_id"), key))


def calls(answers: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens in and out and the last error of a model's ``answers`` (at, tokens_in, tokens_out, error)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    last = F.max(F.when(F.col("error").isNotNull(), F.struct("at", "error")))["error"].alias("last_error")
    return answers.groupBy(*by).agg(F.count("*").alias("calls"), total("tokens_in"), total("tokens_out"), last)


def usage(documents: DataFrame) -> DataFrame:
    """Number of documents and their bytes (size_bytes)."""
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
