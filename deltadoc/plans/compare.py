"""Comparison of document versions: one lazy dataflow over all comparisons."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltadoc import fixed
from deltadoc.functions import entities as E
from deltadoc.functions import scoring as G
from deltadoc.functions import text as T
from deltadoc.operators import align, reconcile
from deltadoc.operators.segment import sections_of
from deltadoc.operators.cut import cut
from deltadoc.sources import plain


@dataclass
class Comparison:
    """The tables of a comparison, all keyed by cmp_id. Each is made when it is first asked for, from those before it."""

    pairs: DataFrame
    given: DataFrame
    day_first: bool = True
    unicode: bool = True
    semantic: DataFrame | None = None
    choices: DataFrame | None = None
    arbitration: str = "split"
    mode: str = "best"

    @cached_property
    def _placed(self) -> tuple[DataFrame, DataFrame]:
        placed, sections = sections_of(cut(self.given), self.unicode)
        return cut(placed), sections

    def _own(self, df: DataFrame) -> DataFrame:
        docs = [F.struct(F.lit(s).alias("side"), F.col(f"doc_{s.lower()}").alias("doc_id")) for s in "AB"]
        sides = self.pairs.select("cmp_id", F.explode(F.array(*docs)).alias("s")).select("cmp_id", "s.*")
        return cut(sides.join(df, "doc_id").drop("doc_id"))

    @cached_property
    def blocks(self) -> DataFrame:
        return self._own(self._placed[0])

    @cached_property
    def sections(self) -> DataFrame:
        return self._own(cut(self._placed[1]))

    @cached_property
    def entities(self) -> DataFrame:
        return self._own(cut(E.entities(self._placed[0], ["doc_id", "block_index", "section_id"], self.day_first)))

    @cached_property
    def alignments(self) -> DataFrame:
        found = cut(align.align_sections(self.sections, self.blocks, self.entities, self.mode))
        return found if self.choices is None else cut(align.arbitrated(found, self.choices, self.arbitration))

    @cached_property
    def aligned(self) -> DataFrame:
        return cut(align.align_blocks(self.blocks, self.alignments))

    @cached_property
    def _steps(self) -> reconcile.Steps:
        return reconcile.Steps(self.blocks, self.sections, self.entities, self.alignments, self.aligned, self.semantic)

    @cached_property
    def value_changes(self) -> DataFrame:
        """The changes of typed values with their scores, without ids and rank, for which all other changes are needed too."""
        return reconcile.scored(self._steps.of_values()).drop("emit")

    @cached_property
    def changes(self) -> DataFrame:
        return cut(reconcile.ranked(self._steps.all()))


def compare(
    pairs: DataFrame, blocks: DataFrame, *, day_first: bool = True, unicode: bool = True, semantic: DataFrame | None = None, choices: DataFrame | None = None, arbitration: str = "split", mode: str = "best",
) -> Comparison:
    """All changes between the documents of each pair.

    ``pairs``: cmp_id, doc_a, doc_b. ``blocks``: as ``plain.blocks`` gives them, by doc_id. A document in
    several pairs is segmented and read once. ``semantic`` and ``choices`` are a model's optional answers, and
    ``arbitration`` says what the choices may do (``align.arbitrated``). Mode ``greedy`` pairs sections by the best score first.
    """
    return Comparison(pairs, blocks, day_first, unicode, semantic, choices, arbitration, mode)


def compare_texts(versions: DataFrame, **options) -> Comparison:
    """Comparison of plain texts: ``versions`` has cmp_id, text_a and text_b."""
    texts = versions.select("cmp_id", F.explode(F.array(F.struct(F.lit("A").alias("s"), F.col("text_a").alias("t")), F.struct(F.lit("B").alias("s"), F.col("text_b").alias("t")))).alias("v"))
    doc = lambda s: F.concat(F.col("cmp_id").cast("string"), F.lit(f":{s}"))
    files = texts.select(F.concat_ws(":", F.col("cmp_id").cast("string"), "v.s").alias("doc_id"), F.col("v.t").alias("text"))
    pairs = versions.select("cmp_id", doc("A").alias("doc_a"), doc("B").alias("doc_b"))
    return compare(pairs, plain.without_runners(plain.blocks(files, options.get("unicode", True))), **options)


def summary(pairs: DataFrame, changes: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Counts, headline, key changes and identity of each comparison (cmp_id, label_a, label_b)."""
    minor = G.is_minor(F.col("type"), F.col("importance"), F.col("categories"))
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    counts = changes.groupBy("cmp_id").agg(
        F.count("*").alias("total"), count(minor).alias("minor"), *[count(F.col("importance") == level).alias(level.lower()) for level in ("HIGH", "MEDIUM", "LOW")]
    )
    rows = pairs.select("cmp_id", "label_a", "label_b").join(counts, "cmp_id", "left").fillna(0, ["total", "minor", "high", "medium", "low"]).withColumn("material", F.col("total") - F.col("minor"))
    rows = rows.withColumn("headline", headline(F.col("total"), F.col("material"), F.col("label_a"), F.col("label_b")))
    for name, kind in (("by_category", F.explode("categories")), ("by_type", F.col("type"))):
        parts = changes.select("cmp_id", kind.alias("k")).groupBy("cmp_id", "k").agg(F.count("*").alias("n"))
        rows = rows.join(parts.groupBy("cmp_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name)), "cmp_id", "left")
    if blocks is not None:
        rows = rows.join(identical(blocks), "cmp_id", "left")
    return rows


def headline(total: Column, material: Column, label_a: Column, label_b: Column) -> Column:
    return (
        F.when(total == 0, F.concat(F.lit("No differences detected between "), label_a, F.lit(" and "), label_b, F.lit(".")))
        .when(material == 0, F.concat(F.lit("No material changes detected. "), total.cast("string"), F.lit(" minor formatting or wording difference"), F.when(total == 1, "").otherwise("s"), F.lit(" found.")))
        .otherwise(F.concat(label_b, F.lit(" contains "), total.cast("string"), F.lit(" detected change"), F.when(total == 1, "").otherwise("s"), F.lit(" compared with "), label_a, F.lit(".")))
    )


def identical(blocks: DataFrame) -> DataFrame:
    """Whether both versions have the same normalized blocks in the same order."""
    whole = F.array_sort(F.collect_list(F.struct("block_index", F.sha2("normalized", 256).alias("h"))))
    sides = blocks.groupBy("cmp_id").pivot("side", ["A", "B"]).agg(whole)
    return sides.select("cmp_id", F.coalesce(F.transform("A", lambda x: x.h) == F.transform("B", lambda x: x.h), F.col("A").isNull() & F.col("B").isNull()).alias("identical"))


def key_changes(changes: DataFrame) -> DataFrame:
    """The first twelve changes of high importance, in review order."""
    rank = F.row_number().over(Window.partitionBy("cmp_id").orderBy("ordinal"))
    return changes.where("importance = 'HIGH'").withColumn("rank", rank).where(F.col("rank") <= fixed.KEY_CHANGES).select("cmp_id", "rank", "change_id", "category", "summary", "importance")


def section_map(alignments: DataFrame, sections: DataFrame, changes: DataFrame) -> DataFrame:
    """Both versions' sections side by side with the number of changes in each."""
    side = lambda s: sections.where(F.col("side") == s).select("cmp_id", F.col("section_id").alias(f"section_id_{s.lower()}"), F.col("path").alias(f"section_{s.lower()}"), F.col("start_page").alias(f"page_{s.lower()}"))
    rows = alignments.join(side("A"), ["cmp_id", "section_id_a"], "left").join(side("B"), ["cmp_id", "section_id_b"], "left").withColumn("place", F.coalesce("section_b", "section_a"))
    counts = changes.groupBy("cmp_id", F.coalesce("section_b", "section_a").alias("place")).agg(F.count("*").alias("change_count"))
    rounded = F.struct(*[T.half_up(F.col(f"signals.{n}"), 3).alias(n) for n in ("heading", "content", "entity", "position", "numbering")])
    rows = rows.join(counts, ["cmp_id", "place"], "left").withColumn("signals", F.when(F.col("signals").isNotNull(), rounded))
    return rows.select("cmp_id", "al_no", "status", "section_a", "section_b", "page_a", "page_b", "confidence", "signals", F.coalesce("change_count", F.lit(0)).alias("change_count"))


def document_summary(blocks: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages, sections and blocks of each document, and the state of its pages."""
    states = F.array_sort(F.collect_list(F.struct("page", "status")))
    counts = [blocks.groupBy("doc_id").agg(F.count("*").alias("block_count")), sections.groupBy("doc_id").agg(F.count("*").alias("section_count"))]
    rows = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), states.alias("pages"), F.max(F.col("status").isin("scanned_document", "unreadable_page")).alias("partial"))
    for c in counts:
        rows = rows.join(c, "doc_id", "left")
    return rows.fillna(0, ["block_count", "section_count"])
