"""Quality rules by distribution divergence, in DataFrame operations only.

Two histograms of a document are held against its language's, which are those of all documents of the
language: the share of each class of characters, and the share of each of the language's commonest words of
at most five characters, with one more cell for all other words. The Jensen-Shannon distance (0 to 1) of
either may not pass its limit; a document too short for a histogram isn't judged by it.

Whole texts are read once. Counts, classes and the short words of each document are written; references and
verdicts come from that table. A document is a row of its own all the way, so nothing is joined by its id;
the references, a row for each language, are joined by language as Spark's size check sees fit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltadoc.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
#: Small letters and blanks are taken out first, then the classes below, one after the other; what is left is punctuation.
_PLAIN = r"[a-z\x20\x09-\x0D]+"
_CLASSES = (("other", r"[^\x00-\x7F]+"), ("capital", r"[A-Z]+"), ("digit", r"[0-9]+"), ("symbol", r"[#*$%&|<>]+"))

LEAST_WORDS = 20
MOST_REPEATED = 30
COMMON = 20
SHORT = 5
CHARACTER_LIMIT = 0.33
WORD_LIMIT = 0.36
LEAST_CHARACTERS = 100
LEAST_COUNTED = 100
LEAST_REFERENCE = 2000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` (a power of two) words that occur twice or more; windows are known by 64-bit hashes.

    Pairs of words are hashed, then pairs of pairs and so on. Only where some window repeats are the windows
    sorted, neighbours compared and the places that they cover summed up.
    """

    def doubled(hashes: Column, width: int) -> Column:
        if width == window:
            return count(F.slice(hashes, 1, F.greatest(F.size(words) - (window - 1), F.lit(0))))
        return let(F.zip_with(hashes, F.slice(hashes, width + 1, F.greatest(F.size(hashes), F.lit(1))), lambda x, y: F.xxhash64(x, y)), lambda h: doubled(h, 2 * width))

    def count(windows: Column) -> Column:
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
        ))

    def covered(s: Column) -> Column:
        none = F.lit(None).cast("bigint")
        near = lambda k: F.coalesce(F.get(s, k)["h"], none)
        twice = F.transform(s, lambda x, k: F.when((near(k - 1) == x["h"]) | (near(k + 1) == x["h"]), x["i"]))
        places = F.array_sort(F.filter(twice, lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["sum"] + i + window - F.greatest(i, a["end"])).alias("sum"), (i + window).alias("end"))
        return F.aggregate(places, start, step, lambda a: a["sum"])

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1))).cast("long")


def _classes(text: Column, blanks: Column) -> Column:
    """Characters of each class in words: small letters, then those of ``_CLASSES``, then the rest."""

    def peel(rest: Column, k: int, sizes: list[Column]) -> Column:
        if k == len(_CLASSES):
            return F.array(*[x.cast("double") for x in (*sizes, F.length(rest))])
        return let(F.regexp_replace(rest, _CLASSES[k][1], ""), lambda r: peel(r, k + 1, [*sizes, F.length(rest) - F.length(r)]))

    return let(F.regexp_replace(text, _PLAIN, ""), lambda r: peel(r, 0, [F.length(text) - blanks - F.length(r)]))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and short words of each row."""

    def measures(text: Column, words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
        of_words = lambda chars: F.struct(
            F.size(words).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"), _classes(text, F.length(text) - chars).alias("classes"),
            F.transform(F.filter(words, lambda w: F.length(w) <= SHORT), lambda w: F.lower(w)).alias("short"),
        )
        return let(F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)), of_words)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = let(text, lambda t: let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: measures(t, w)))
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), row.alias("m")).select("doc_id", "lang", "m.*")


def references(rows: DataFrame, *, common: int = COMMON, least: int = LEAST_REFERENCE) -> DataFrame:
    """lang, class_share, words and word_share (with the other words' last) of each language of at least ``least`` words."""
    named = rows.where("lang is not null")
    total = named.groupBy("lang").agg(F.sum("n_words").alias("n"), F.sum("word_chars").alias("chars"), *[F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(_CLASSES) + 2)])
    total = total.where(F.col("n") >= least)
    counts = named.select("lang", F.explode("short").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("k"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("k"), "word"))).where(F.col("rank") <= common)
    words = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "k"))).alias("top"))
    both = total.join(words, "lang", "left").withColumn("top", F.coalesce("top", F.array().cast("array<struct<rank:int,word:string,k:bigint>>")))
    rest = F.col("n") - F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s + x["k"])
    share = F.concat(F.transform("top", lambda x: x["k"] / F.col("n")), F.array(rest / F.col("n")))
    return both.select("lang", F.array(*[F.col(f"c{k}") / F.col("chars") for k in range(len(_CLASSES) + 2)]).alias("class_share"), F.transform("top", lambda x: x["word"]).alias("words"), share.alias("word_share"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, to the base of 2, of two arrays of shares."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, *, character_limit: float = CHARACTER_LIMIT, word_limit: float = WORD_LIMIT, **options) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, lang; other columns are left out), with its counts and verdict.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated windows. ``kept``: not so, and
    neither ``class_distance`` nor ``word_distance`` passes its limit. Either is null, and passes, where the
    document has fewer than 100 characters or words, or its language none or too few words for a reference. Null
    texts have no words; an empty table gives no rows; repeated rows are judged each.
    """
    rows = written(measured(docs))
    known = written(references(rows, **options))
    met = rows.join(known, "lang", "left")
    n = F.col("n_words")
    counts = F.transform("words", lambda k: F.size(F.filter("short", lambda x: x == k)))
    shares = let(counts, lambda c: F.concat(F.transform(c, lambda x: x / n), F.array((n - F.aggregate(c, F.lit(0), lambda s, x: s + x)) / n)))
    met = met.withColumn("class_distance", F.when(F.col("word_chars") >= LEAST_CHARACTERS, distance(F.transform("classes", lambda x: x / F.col("word_chars")), F.col("class_share"))))
    met = met.withColumn("word_distance", F.when(n >= LEAST_COUNTED, distance(shares, F.col("word_share"))))
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)
    within = F.coalesce(F.col("class_distance") <= character_limit, F.lit(True)) & F.coalesce(F.col("word_distance") <= word_limit, F.lit(True))
    return met.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & within).alias("kept"), "class_distance", "word_distance"
    )


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents by the base rules and the divergence from their languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
