"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents are shuffled by a hash and laid end to end on a line of words, which is cut into
blocks of equal size; a source of few words has smaller ones, an eighth of it each. The schedule is a row of
slots; slot i stands at the i-th multiple of the golden ratio, modulo 1, on the line of cumulative shares of
the blocks that the targets ask for, and so belongs to one source. The slots of a source are ranked; rank r
takes the source's block r, and after the last block its first one again. Any run of slots has each source
near its share, and a rerun gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltadoc.llm.common import written

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 128
PARTS = 8
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, key: str, chunk: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of ``key``, in order of ``chunk`` and ``order``.

    Rows are summed within (key, chunk) and the chunks' sums within the key, so that a key with many rows
    is spread over as many tasks as it has chunks.
    """
    before = Window.unboundedPreceding, -1
    ahead = df.groupBy(key, chunk).agg(F.sum(value).alias("_sum")).select(
        key, chunk, F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy(chunk).rowsBetween(*before)), F.lit(0)).alias("_ahead")
    )
    within = F.coalesce(F.sum(value).over(Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(*before)), F.lit(0))
    return df.withColumn("_within", within).join(ahead, [key, chunk]).withColumn(name, F.col("_ahead") + F.col("_within")).drop("_ahead", "_within")


def sources(sized: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """sid, source, source_size, target, block_size and its stretch (low, high) of the line of shares.

    Sources are in code point order, null last, with ``weights`` repeating. ``budget`` times all words are
    shared out by weight; no target is above ``most`` times its source, and what is cut off goes to the
    others by weight. Filling from the source that is full first gives the level at once: a source is full
    if the level that all from it on would share is above its own.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(one))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * most
    fill = Window.orderBy("_ratio", "sid")
    rows = named.withColumn("_w", weight.cast("double")).withColumn("_ratio", full / F.col("_w"))
    rows = rows.withColumn("_total", F.sum("source_size").over(Window.partitionBy(F.lit(1)))).withColumn(
        "_level",
        (F.col("_total") * budget - F.coalesce(F.sum(full).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
    )
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "sid", "_level"))).over(Window.partitionBy(F.lit(1)))
    rows = rows.withColumn("target", F.least(full, F.coalesce(level["_level"], F.lit(float("inf"))) * F.col("_w")))
    rows = rows.withColumn("block_size", F.greatest(F.least(F.lit(block), F.ceil(F.col("source_size") / PARTS)), F.lit(1)).cast("long"))
    rows = rows.withColumn("_wants", F.col("target") / F.col("block_size"))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("_wants").over(upto)).withColumn("_all", F.sum("_wants").over(Window.partitionBy(F.lit(1))))
    share = lambda x: F.when(F.col("_all") > 0, x / F.col("_all")).otherwise(F.lit(0.0))
    return rows.select("sid", "source", "source_size", "target", "block_size", share(F.col("_upto") - F.col("_wants")).alias("low"), share(F.col("_upto")).alias("high"))


def schedule(named: DataFrame, slots: int) -> DataFrame:
    """slot, sid, rank and block of each slot that a target has room for.

    A source's slots end at the one that comes nearest to its target, and the last source's stretch is
    closed at 1. Slots meet sources through cells of the line, by equality. The few slots of a small source
    that the line is too short for come behind it.
    """
    spark = named.sparkSession
    cells = named.where("high > low").withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)).cast("int")))
    )
    last = F.max("sid").over(Window.partitionBy("_cell"))
    cells = cells.withColumn("high", F.when((F.col("_cell") == CELLS - 1) & (F.col("sid") == last), 2.0).otherwise(F.col("high")))
    point = F.col("id") * F.lit(GOLDEN)
    line = spark.range(1, slots + 1).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("_u"))
    line = line.withColumn("_cell", F.floor(F.col("_u") * CELLS).cast("int"))
    met = line.join(cells.select("_cell", "sid", "low", "high"), "_cell").where("_u >= low and _u < high")
    met = met.select("slot", "sid", F.expr("slot div 8192").alias("_chunk"), F.lit(1).alias("_one"))
    wants = named.where("source_size > 0").select("sid", F.floor(F.col("target") / F.col("block_size") + 0.5).alias("_wants"), F.ceil(F.col("source_size") / F.col("block_size")).alias("_blocks"))
    ranked = running(met, "sid", "_chunk", ["slot"], "_one", "rank").join(wants, "sid").where("rank < _wants")
    had = met.groupBy("sid").agg(F.count("*").alias("_had"))
    late = wants.join(had, "sid", "left").withColumn("_had", F.coalesce("_had", F.lit(0))).where("_had < _wants")
    late = late.withColumn("rank", F.explode(F.sequence(F.col("_had"), F.col("_wants") - 1))).withColumn("slot", slots + 1 + F.col("rank"))
    both = ranked.select("slot", "sid", "rank", "_blocks").unionByName(late.select("slot", "sid", "rank", "_blocks"))
    return both.select("slot", "sid", "rank", F.pmod(F.col("rank"), F.col("_blocks")).alias("block"))


def mix(docs: DataFrame, *, block: int = BLOCK, chunk_rows: int = 2000, seed: int = 7, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and ``keep`` for each row of ``docs`` (doc_id, text, source).

    Null texts have no words; null is a source of its own. Equal rows stay apart, though which of them is
    taken more often may be either. ``taken`` counts words with repeats and is at most twice the size.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed))))
    base = written(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), key.alias("_key"), *keep))
    total = base.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count_distinct("source").alias("s")).first()
    bits = max(0, min(24, (total.n // chunk_rows).bit_length()))
    named = written(sources(base, block=block, **options))
    base = base.withColumn("_chunk", F.expr(f"shiftright(cast(conv(substr(_key, 1, 6), 16, 10) as int), {24 - bits})"))
    base = base.join(named.select("sid", "source", "source_size", "target", "block_size").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    base = running(base, "sid", "_chunk", ["_key", "size"], "size", "_start")
    wanted = named.agg(F.coalesce(F.sum(F.col("target") / F.col("block_size")), F.lit(0.0))).first()[0]
    slots = int(1.05 * max(1.5 * total.words / block, wanted)) + 50 * (total.s + 1)
    copies = schedule(named, slots).groupBy("sid", "block").agg(F.count("*").alias("_copies"))
    first, last = F.expr("_start div block_size"), F.expr("(_start + size - 1) div block_size")
    cut = base.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    over = F.least(F.col("_start") + F.col("size"), (F.col("block") + 1) * F.col("block_size")) - F.greatest(F.col("_start"), F.col("block") * F.col("block_size"))
    columns = ["doc_id", "source", "size", "source_size", "target", *keep]
    parts = cut.withColumn("_over", over).join(copies, ["sid", "block"], "left")
    taken = parts.groupBy(*columns, "_start").agg(F.sum(F.coalesce(F.col("_copies"), F.lit(0)) * F.col("_over")).cast("long").alias("taken"))
    empty = base.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return taken.drop("_start").unionByName(empty)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
