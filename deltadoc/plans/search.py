"""Search in stored changes and blocks through an index of trigrams.

An index has two tables: the rows, in parts by their number, and for every three characters that occur the
numbers of the rows that have them, in buckets by a hash of the three. A search reads the buckets of its
term's trigrams, keeps the rows that have all of them, reads those rows' parts and looks for the term itself. Each
text is followed by two end signs, so that a shorter term begins a trigram wherever it occurs; it is
looked for among all trigrams, without reading texts that lack it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltadoc.plans.review import searchable

BUCKETS = 64
PART_ROWS = 1 << 16
#: Rows in one list of a trigram, and parts that are named in a filter; with more all parts are read.
LIST_ROWS, NAMED_PARTS = 1 << 14, 1000
_END = "\x00"
#: Characters of texts whose trigrams are sorted together.
_PIECE = 1 << 22


def entries(changes: DataFrame, blocks: DataFrame) -> DataFrame:
    """cmp_id, kind, place, at, text and hay (what is searched, in lower case) of changes and blocks."""
    a = changes.select("cmp_id", F.lit("change").alias("kind"), F.col("change_id").alias("place"), F.col("ordinal").cast("long").alias("at"), F.col("summary").alias("text"), searchable(changes).alias("hay"))
    b = blocks.select("cmp_id", F.lit("document").alias("kind"), F.concat_ws(":", "side", "block_id").alias("place"), F.col("block_index").cast("long").alias("at"), "text", F.lower("text").alias("hay"))
    return a.unionByName(b)


def _posted(rows: list[int], texts: list[str]) -> pa.RecordBatch:
    """gram, list and rows of the trigrams of some texts, all of one list, with two end signs behind each text."""
    codes = np.frombuffer("".join(t + 2 * _END for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.array([len(t) + 2 for t in texts])
    own = np.repeat(np.array(rows) % LIST_ROWS, sizes)
    begins = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    begins[ends - 1] = begins[ends - 2] = False
    at = np.flatnonzero(begins)
    grams, own = codes[at] << 42 | codes[np.minimum(at + 1, len(codes) - 1)] << 21 | codes[np.minimum(at + 2, len(codes) - 1)], own[at]
    order = np.argsort(grams, kind="stable")
    grams, own = grams[order], own[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    grams, own = grams[new], own[new]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.array([], int)
    one = grams[first]
    named = np.stack([one >> 42, one >> 21 & 0x1FFFFF, one & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(grams)), pa.int32()), pa.array(own.astype(np.int16)))
    return pa.RecordBatch.from_arrays([pa.array([named[k : k + 3] for k in range(0, len(named), 3)], pa.string()), pa.array(np.full(len(first), rows[0] // LIST_ROWS)), lists], names=["gram", "list", "rows"])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of row and hay, for some rows of a list at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if rows and (size > _PIECE or row // LIST_ROWS != rows[0] // LIST_ROWS):
                yield _posted(rows, texts)
                rows, texts, size = [], [], 0
            rows.append(row)
            texts.append(text)
            size += len(text)
    if rows:
        yield _posted(rows, texts)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(rows: DataFrame, path: str) -> None:
    """Writes the index of ``rows`` (with ``hay``; null has no place) to a new folder.

    A trigram's rows are lists of a bounded length, so a common one is many rows of its bucket. Tasks make pieces of lists,
    two bytes a row, and only these are shuffled.
    """
    spark = rows.sparkSession
    numbered = rows.where("hay is not null").withColumn("row", F.monotonically_increasing_id())
    numbered.withColumn("part", F.expr(f"row div {PART_ROWS}")).write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    pieces = stored.select("row", "hay").mapInArrow(_pieces, "gram string, list long, rows array<smallint>")
    lists = pieces.groupBy("gram", "list").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))
    lists.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", "list").sortWithinPartitions("bucket", "gram").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/grams")


def _rows(lists: DataFrame) -> DataFrame:
    """Numbers of the rows in lists, which have them from their own beginning on, in two bytes each."""
    return lists.select("list", F.explode("rows").alias("n")).select((F.col("list") * LIST_ROWS + F.col("n")).alias("row"))


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame:
    """``row`` of all rows that have each trigram of the term, of a shorter one those with a trigram that it begins."""
    low, grams = term.lower(), spark.read.parquet(f"{path}/grams")
    if not low:
        raise ValueError("an empty term is everywhere")
    if len(low) < 3:
        return _rows(grams.where(F.col("gram").startswith(low))).distinct()
    need = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in need], "g string").select(_bucket(F.col("g"))).distinct().collect()]
    held = grams.where(F.col("bucket").isin(buckets) & F.col("gram").isin(need))
    full = held.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") == len(need)).select("list")  # a list without one of them has no such row
    return _rows(held.join(full, "list", "left_semi")).groupBy("row").agg(F.count("*").alias("n")).where(F.col("n") == len(need)).select("row")


def places(spark: SparkSession, path: str, term: str) -> DataFrame:
    """All rows of the index in which the term occurs, whatever its case."""
    return places_of(spark, path, [term]).drop("term")


def places_of(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """``places`` of some terms with the ``term``; a row is read and joined once for all of them."""
    each = [candidates(spark, path, t).withColumn("_t", F.lit(k)) for k, t in enumerate(terms)]
    found = reduce(DataFrame.unionByName, each).groupBy("row").agg(F.collect_list("_t").alias("_t")).withColumn("part", F.expr(f"row div {PART_ROWS}"))
    parts = [r[0] for r in found.select("part").distinct().limit(NAMED_PARTS + 1).collect()]
    rows = spark.read.parquet(f"{path}/rows")
    if len(parts) <= NAMED_PARTS:
        rows = rows.where(F.col("part").isin(parts))
    rows = rows.drop("part").join(found.select("row", "_t"), "row")
    named = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(t.lower()).alias("low")) for t in terms])
    rows = rows.withColumn("_t", F.explode("_t")).withColumn("_t", F.get(named, F.col("_t")))
    return rows.where(F.contains("hay", F.col("_t.low"))).withColumn("term", F.col("_t.term")).drop("row", "hay", "_t")


def search(spark: SparkSession, path: str, term: str, limit: int = 50) -> DataFrame:
    """Places of ``term`` as ``review.search`` gives them: ``limit`` changes and twice as many blocks of each comparison."""
    rank = F.row_number().over(Window.partitionBy("cmp_id", "kind").orderBy("at", "place"))
    return places(spark, path, term).withColumn("_r", rank).where(F.col("_r") <= F.when(F.col("kind") == "change", limit).otherwise(2 * limit)).drop("_r")
