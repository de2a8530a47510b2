"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes the documents that its predecessor kept, as Parquet, and applies one operator to all of
them. All but the last return the columns of ``documents``; columns that stages add for themselves start
with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltadoc.llm import dartminhash, langid, mixing, packing, quality
from deltadoc.llm.common import written

#: Below it, no language stands out and a document goes.
LEAST_LANGUAGE = 0.35


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5, the threshold of the pairwise ranking (operator 5)."""
    ranker = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free(docs, "__score")
    return quality.measured(docs, ranker, score).where(F.col(score) >= 0.5).select(*_columns(docs))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found and stands out (operator 4)."""
    lang, score = _free(docs, "__lang"), _free(docs, "__score")
    found = langid.identify(docs, langid.fit(docs), (lang, score))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).select(*_columns(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the least id (operator 8).

    Rows are classed by their texts, whatever their ids; of rows equal in id and text one stays.
    """
    return dartminhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number (operator 10).

    A document that the mix takes less than half of goes. Rows equal in id, text and source count as one document.
    """
    key, times, copy = (_free(docs, n) for n in ("__key", "__times", "__copy"))
    null = lambda c: F.coalesce(F.md5(F.col(c).cast("string")), F.lit("null"))
    rows = docs.withColumn(key, F.md5(F.concat_ws(":", null("doc_id"), null("text"), null("source"))))
    taken = mixing.mix(rows, keep=(key,)).groupBy(key).agg(F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int").alias(times))
    some = rows.join(taken.where(F.col(times) > 0), key)
    return some.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 ids (operator 1)."""
    return packing.pack(packing.pieces(docs))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it a new one."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [("quality", by_quality), ("language", by_language), ("near_copies", without_copies), ("mixing", mixed), ("packing", packed)]

#: The models and the packing aren't SQL; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
