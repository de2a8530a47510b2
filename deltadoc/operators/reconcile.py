"""Alignments and findings to one ranked list of changes with citations."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltadoc import fixed
from deltadoc.functions import diff as D
from deltadoc.functions import scoring as G
from deltadoc.functions import text as T
from deltadoc.operators import values as V
from deltadoc.operators.cut import cut

VALUE = "struct<value_num:double,value_str:string,unit:string,currency:string,source_text:string,kind:string,context:string,actor:string,action:string,strength:int,frequency:string,days_equivalent:double>"
DELTA = "struct<absolute:double,percentage:double,percentage_points:double,days:double,strength_change:double,unit:string>"
OPS = "array<struct<op:string,a:string,b:string>>"
SEMANTIC = "cmp_id string, n_a int, n_b int, meaning_changed boolean, category string, summary string, confidence double"


def text_value(value: Column, unit: str) -> Column:
    none = lambda k: F.lit(None).cast(k)
    made = F.struct(
        none("double").alias("value_num"), value.alias("value_str"), F.lit(unit).alias("unit"), none("string").alias("currency"), none("string").alias("source_text"), none("string").alias("kind"),
        none("string").alias("context"), none("string").alias("actor"), none("string").alias("action"), none("int").alias("strength"), none("string").alias("frequency"), none("double").alias("days_equivalent"),
    )
    return F.when(value.isNotNull() & (value != ""), made)


def citation(side: str, block: str, start: Column | None = None, end: Column | None = None) -> Column:
    """Where a change stands: the whole block, or the span from ``start`` to ``end`` within it."""
    b = lambda n: F.col(f"{block}.{n}")
    size = F.length(b("text"))
    begin = F.lit(0) if start is None else F.coalesce(F.greatest(F.lit(0), F.least(start, size)), F.lit(0))
    stop = size if end is None else F.coalesce(F.greatest(begin, F.least(end, size)), size)
    made = F.struct(
        F.lit(side).alias("document_version"), b("block_id").alias("block_id"), b("page").alias("page"), b("path").alias("section"),
        begin.cast("int").alias("char_start"), stop.cast("int").alias("char_end"), F.substring(b("text"), begin + 1, stop - begin).alias("text"),
    )
    return F.when(F.col(block).isNotNull(), made)


def _change(rows: DataFrame, **given) -> DataFrame:
    """A change from each row; fields that aren't given have their defaults. ``emit`` orders the ids."""
    none = lambda k: F.lit(None).cast(k)
    field = lambda n, default: given.get(n, default)
    path = lambda end: F.col(f"{end}.path") if end in rows.columns else none("string")
    text = lambda end: F.coalesce(F.col(f"{end}.text"), F.lit("")) if end in rows.columns else F.lit("")
    return rows.withColumn("_categories", given["categories"]).select(
        "cmp_id", given["emit"].alias("emit"), given["type"].alias("type"), F.element_at("_categories", 1).alias("category"), F.col("_categories").alias("categories"), given["summary"].alias("summary"),
        given["signals"].alias("confidence_signals"), field("old_value", none(VALUE)).cast(VALUE).alias("old_value"), field("new_value", none(VALUE)).cast(VALUE).alias("new_value"),
        field("delta", none(DELTA)).cast(DELTA).alias("delta"), given["direction"].alias("direction"), field("citation_a", citation("A", "a") if "a" in rows.columns else none("string")).alias("citation_a"),
        field("citation_b", citation("B", "b") if "b" in rows.columns else none("string")).alias("citation_b"), field("text_a", text("a")).alias("text_a"), field("text_b", text("b")).alias("text_b"),
        field("word_diff", none(OPS)).cast(OPS).alias("word_diff"), given["detectors"].alias("detectors"), field("section_a", path("a")).alias("section_a"), field("section_b", path("b")).alias("section_b"),
        field("notes", F.array().cast("array<string>")).alias("notes"),
    )


def _emit(phase: int, *parts: Column | str) -> Column:
    """The order in which changes get their ids: phase, section alignment, block, kind, then the finding."""
    cols = [F.lit(phase).alias("phase")]
    for name, p, kind in zip(("al", "block", "kind", "group", "late", "at"), parts, ("int", "int", "int", "string", "int", "int")):
        cols.append((p if isinstance(p, Column) else F.lit(p)).cast(kind).alias(name))
    for name, kind in list(zip(("al", "block", "kind", "group", "late", "at"), ("int", "int", "int", "string", "int", "int")))[len(parts) :]:
        cols.append(F.lit(None).cast(kind).alias(name))
    return F.struct(*cols)


def _array(*items: str) -> Column:
    return F.array(*map(F.lit, items))


class Steps:
    """The tables between the alignments and the changes, each made when it is first asked for.

    Tables are keyed by cmp_id and side. ``semantic`` (SEMANTIC's columns) has a model's opinions on pairs.
    """

    def __init__(self, blocks: DataFrame, sections: DataFrame, entities: DataFrame, alignments: DataFrame, aligned: DataFrame, semantic: DataFrame | None = None) -> None:
        self.alignments, self.sections, self.semantic, self.aligned = alignments, sections, semantic, aligned
        section = sections.select("cmp_id", "side", "section_id", "path", F.col("heading").alias("section_heading"))
        self.full = blocks.join(section, ["cmp_id", "side", "section_id"], "left")
        self.values = entities.withColumnRenamed("block_index", "n")
        self.id_type = blocks.schema["cmp_id"].dataType

    @cached_property
    def rows(self) -> DataFrame:
        one = F.struct("block_index", "block_id", "page", "block_type", "text", "cells", "path", "section_heading")
        side = lambda s: self.full.where(F.col("side") == s).select("cmp_id", F.col("block_index").alias(f"n_{s.lower()}"), one.alias(s.lower()))
        al = self.alignments.select("cmp_id", "al_no", F.col("status").alias("al_status"), F.col("confidence").alias("al_confidence"))
        rows = self.aligned.where("status != 'UNCHANGED'").join(al, ["cmp_id", "al_no"])
        whole = rows.where(~((F.col("status") == "ADDED") & (F.col("al_status") == "ADDED")) & ~((F.col("status") == "REMOVED") & (F.col("al_status") == "REMOVED")))
        return cut(whole.join(side("A"), ["cmp_id", "n_a"], "left").join(side("B"), ["cmp_id", "n_b"], "left"))

    @cached_property
    def paired(self) -> DataFrame:
        paired = self.rows.where("status = 'MODIFIED' or (status = 'MOVED' and similarity < 0.999)").withColumn("ops", D.word_diff(F.col("a.text"), F.col("b.text")))
        paired = paired.withColumn("phase", F.when(F.col("status") == "MODIFIED", 1).otherwise(2))
        semantic = self.aligned.sparkSession.createDataFrame([], SEMANTIC) if self.semantic is None else self.semantic
        sem = F.struct(*[c for c in semantic.columns if c not in ("cmp_id", "n_a", "n_b")]).alias("sem")
        return cut(paired.join(semantic.select(F.col("cmp_id").cast(self.id_type).alias("cmp_id"), "n_a", "n_b", sem), ["cmp_id", "n_a", "n_b"], "left"))

    @cached_property
    def found(self) -> DataFrame:
        return cut(_block_findings(self.paired, self.values))

    @cached_property
    def parts_of_values(self) -> list[DataFrame]:
        return [cut(_from_findings(self.paired, self.found)), cut(_fallback(self.rows, self.values, self.alignments, self.full))]

    def of_values(self) -> DataFrame:
        """Changes of typed values, in paired blocks and between unpaired ones."""
        return reduce(DataFrame.unionByName, self.parts_of_values)

    def all(self) -> DataFrame:
        """All changes of all comparisons."""
        others = [_from_text(self.paired, self.found), _moved(self.rows), _alone(self.rows, self.values), _sections(self.alignments, self.sections, self.full)]
        return reduce(DataFrame.unionByName, [*self.parts_of_values, *map(cut, others)])


def changes(
    blocks: DataFrame, sections: DataFrame, entities: DataFrame, alignments: DataFrame, aligned: DataFrame, semantic: DataFrame | None = None
) -> DataFrame:
    """All changes of all comparisons, with ids, scores and their rank (``ordinal``)."""
    return ranked(Steps(blocks, sections, entities, alignments, aligned, semantic).all())


def scored(rows: DataFrame) -> DataFrame:
    """Changes with their confidence and importance."""
    of = lambda change, old: F.col(f"delta.{change}") / F.nullif(F.col(f"old_value.{old}"), F.lit(0.0)) * 100
    share = F.when(F.col("delta.percentage").isNotNull(), F.coalesce(of("absolute", "value_num"), of("days", "days_equivalent")))
    score = G.importance_score(F.col("type"), F.col("categories"), F.col("delta"), share)
    rows = rows.withColumn("confidence", G.confidence(F.col("confidence_signals"))).withColumn("importance_score", score).withColumn("importance", G.importance(F.col("importance_score")))
    return rows.withColumn("confidence_label", G.confidence_label(F.col("confidence")))


def ranked(rows: DataFrame) -> DataFrame:
    """Ids in order of emission, scores, and the order for review."""
    rows = scored(rows)
    ids = F.row_number().over(Window.partitionBy("cmp_id").orderBy("emit"))
    rows = rows.withColumn("change_id", F.format_string("chg_%05d", ids)).drop("emit")
    level = F.when(F.col("importance") == "HIGH", 0).when(F.col("importance") == "MEDIUM", 1).otherwise(2)
    page = F.coalesce(F.col("citation_b.page"), F.col("citation_a.page"), F.lit(999))
    order = Window.partitionBy("cmp_id").orderBy(level, F.desc("importance_score"), page, "change_id")
    return rows.withColumn("ordinal", F.row_number().over(order))


def _block_findings(paired: DataFrame, values: DataFrame) -> DataFrame:
    """Findings between the values of aligned blocks, keyed by cmp_id, n_a and n_b."""
    scope = ["cmp_id", "n_a", "n_b"]
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"n_{s.lower()}").alias("n")) for s in "AB"]))
    own = paired.select(*scope, ends.alias("_e")).select(*scope, "_e.*").join(values, ["cmp_id", "side", "n"]).select(*scope, "side", *V.ENTITY)
    return V.findings(V.pair_sides(own, scope)).withColumnsRenamed({"a": "ea", "b": "eb"})


def _from_findings(paired: DataFrame, found: DataFrame) -> DataFrame:
    rows = found.join(paired, ["cmp_id", "n_a", "n_b"])
    meaning = F.coalesce(F.col("sem.meaning_changed"), F.lit(False))
    texts = T.categories_or(T.categorize(F.col("a.text"), F.col("b.text")), F.col("category"))
    kind = F.when(F.col("old_value").isNull(), "ADDED").when(F.col("new_value").isNull(), "REMOVED").otherwise("MODIFIED")
    span = lambda e, n: F.col(f"{e}.{n}")
    note = F.when(meaning & F.col("sem.summary").isNotNull() & (F.col("left_over") == 0), F.array(F.concat(F.lit("Semantic analysis: "), F.col("sem.summary"))))
    covered = found.groupBy("cmp_id", "n_a", "n_b").agg(F.flatten(F.collect_list(F.array_compact(F.array("ea.source_text", "eb.source_text")))).alias("covered"))
    rows = rows.join(covered, ["cmp_id", "n_a", "n_b"]).withColumn("left_over", D.residual_count(F.col("ops"), F.col("covered")))
    return _change(
        rows, emit=_emit_pair(2, F.col("group"), F.col("seq.late"), F.col("seq.at")), type=kind, categories=T.merge_categories(F.array("category"), texts), summary=F.col("summary"),
        signals=G.signals(alignment=F.coalesce("al_confidence", F.lit(0.8)), diff=F.least(F.lit(1.0), F.col("similarity") * 0.4 + 0.6), extraction=F.col("sure"), semantic=F.when(meaning, F.col("sem.confidence"))),
        old_value=F.col("old_value"), new_value=F.col("new_value"), delta=F.col("delta"), direction=F.col("direction"),
        citation_a=citation("A", "a", span("ea", "char_start"), span("ea", "char_end")), citation_b=citation("B", "b", span("eb", "char_start"), span("eb", "char_end")), word_diff=F.col("ops"),
        detectors=F.when(meaning, _array("structured_extraction", "text_diff", "semantic_analysis")).otherwise(_array("structured_extraction", "text_diff")),
        notes=F.coalesce(note, F.array().cast("array<string>")),
    )


def _emit_pair(kind: int, *more: Column) -> Column:
    parts = [F.col("phase").cast("int").alias("phase"), F.col("al_no").cast("int").alias("al"), F.col("n_a").cast("int").alias("block"), F.lit(kind).cast("int").alias("kind")]
    extra = [*more, *[F.lit(None)] * (3 - len(more))]
    return F.struct(*parts, extra[0].cast("string").alias("group"), extra[1].cast("int").alias("late"), extra[2].cast("int").alias("at"))


def _from_text(paired: DataFrame, found: DataFrame) -> DataFrame:
    """Changed wording that no finding explains, and changes of form only."""
    covered = found.groupBy("cmp_id", "n_a", "n_b").agg(F.flatten(F.collect_list(F.array_compact(F.array("ea.source_text", "eb.source_text")))).alias("covered"))
    rows = paired.join(covered, ["cmp_id", "n_a", "n_b"], "left").withColumn("has_findings", F.col("covered").isNotNull())
    rows = rows.withColumn("left_over", D.residual_count(F.col("ops"), F.coalesce("covered", F.array().cast("array<string>"))))
    rows = rows.withColumn("cosmetic", T.is_cosmetic(F.col("a.text"), F.col("b.text"))).withColumn("meaning", F.coalesce(F.col("sem.meaning_changed"), F.lit(False)))
    none = F.col("left_over") == 0
    form = F.col("cosmetic") & ~F.col("meaning") & ~(none & F.col("has_findings"))
    wording = ~form & (~none | (F.col("meaning") & ~F.col("has_findings")))
    rows = rows.withColumn("form", form).where(form | wording)
    before, after = D.fragments(F.col("ops"), "a"), D.fragments(F.col("ops"), "b")
    subject = T.categories_or(T.categorize(F.col("a.text"), F.col("b.text")), "WORDING")
    named = F.when(F.col("meaning") & F.col("sem.category").isNotNull(), T.merge_categories(F.array("sem.category"), subject)).otherwise(subject)
    said = F.when(F.col("meaning") & F.col("sem.summary").isNotNull(), F.col("sem.summary")).otherwise(T.rewrite_summary(before, after))
    sure = F.coalesce("al_confidence", F.lit(0.8))
    pick = lambda x, y: F.when(F.col("form"), x).otherwise(y)
    return _change(
        rows, emit=_emit_pair(3), type=pick("MODIFIED", F.when(F.col("meaning"), "MEANING_CHANGED").otherwise("MODIFIED")), categories=pick(_array("FORMATTING"), named),
        summary=pick("Formatting or punctuation only — no wording change detected.", said),
        signals=G.signals(alignment=sure, diff=pick(F.lit(1.0), F.least(F.lit(1.0), F.col("similarity") * 0.4 + 0.55)), semantic=pick(F.lit(None), F.col("sem.confidence"))),
        old_value=F.when(~F.col("form"), text_value(before, "text")), new_value=F.when(~F.col("form"), text_value(after, "text")),
        direction=pick("formatting", F.when(F.col("meaning"), "meaning_changed").otherwise("text_modified")), word_diff=F.col("ops"),
        detectors=pick(_array("text_diff"), F.when(F.col("sem").isNotNull(), _array("text_diff", "semantic_analysis")).otherwise(_array("text_diff"))),
        notes=F.when(~F.col("form") & F.col("meaning"), _array("Meaning change flagged by semantic analysis. Review recommended.")).otherwise(F.array().cast("array<string>")),
    )


def _moved(rows: DataFrame) -> DataFrame:
    rows = rows.where("status = 'MOVED'").withColumn("phase", F.lit(2))
    summary = F.concat(
        F.format_string("Content moved from %s (page %d) to %s (page %d).", "a.path", "a.page", "b.path", "b.page"),
        F.when(F.col("similarity") >= 0.999, " No wording change detected.").otherwise(""),
    )
    return _change(
        rows, emit=_emit_pair(1), type=F.lit("MOVED"), categories=T.categories_or(T.categorize(F.col("a.text"), F.col("b.text")), "SCOPE"), summary=summary,
        signals=G.signals(alignment=F.col("similarity"), diff=F.col("similarity")), direction=F.lit("moved"), word_diff=D.word_diff(F.col("a.text"), F.col("b.text")), detectors=_array("text_diff"),
    )


def _alone(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Blocks that only one version has."""
    rows = rows.where("status in ('ADDED', 'REMOVED')").withColumn("new", F.col("status") == "ADDED").withColumn("own", F.coalesce("b", "a"))
    rows = rows.withColumn("side", F.when(F.col("new"), "B").otherwise("A")).withColumn("n", F.coalesce("n_b", "n_a"))
    types = values.groupBy("cmp_id", "side", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "type"))), lambda e: e.type).alias("types"))
    rows = rows.join(types, ["cmp_id", "side", "n"], "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    verb = F.when(F.col("new"), "added").otherwise("removed")
    body = T.merge_categories(T.categories_or(T.categorize(F.col("own.text")), "SCOPE"), T.entity_categories(F.col("types")))
    cells = F.filter(F.slice("own.cells", F.lit(2), F.greatest(F.size("own.cells") - 1, F.lit(0))), lambda c: c != "")
    first = F.coalesce(F.nullif(F.element_at("own.cells", 1), F.lit("")), F.lit("(unnamed)"))
    row = F.concat(F.lit("Table row "), verb, F.lit(": "), first, F.when(F.size(cells) > 0, F.concat(F.lit(" ("), F.array_join(cells, ", "), F.lit(")"))).otherwise(""))
    is_row = (F.col("own.block_type") == "table_row") & F.col("own.cells").isNotNull() & (F.size("own.cells") > 0)
    some = F.size("types") > 0
    value = text_value(F.col("own.text"), "text")
    phase = F.when(F.col("new"), 4).otherwise(3)
    emit = F.struct(phase.cast("int").alias("phase"), F.col("al_no").cast("int").alias("al"), F.col("n").cast("int").alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("group"), F.lit(None).cast("int").alias("late"), F.lit(None).cast("int").alias("at"))
    return _change(
        rows, emit=emit, type=F.col("status"), categories=T.merge_categories(T.categorize(F.col("own.section_heading")), body),
        summary=F.when(is_row, row).otherwise(F.concat(F.lit("Content "), verb, F.lit(": "), T.shorten(F.col("own.text")))),
        signals=G.signals(alignment=F.coalesce("al_confidence", F.lit(0.7)), diff=1.0, extraction=F.when(some, 0.95)), old_value=F.when(~F.col("new"), value), new_value=F.when(F.col("new"), value),
        direction=F.concat(F.lit("content_"), verb), word_diff=F.array(F.struct(F.when(F.col("new"), "insert").otherwise("delete").alias("op"), F.coalesce("a.text", F.lit("")).alias("a"), F.coalesce("b.text", F.lit("")).alias("b"))),
        detectors=F.when(some, _array("text_diff", "structured_extraction")).otherwise(_array("text_diff")),
    )


def _fallback(rows: DataFrame, values: DataFrame, alignments: DataFrame, full: DataFrame) -> DataFrame:
    """Values that changed between the blocks that a matched section left unpaired."""
    scope = ["cmp_id", "al_no"]
    left = rows.where("al_status = 'MATCHED' and status in ('ADDED', 'REMOVED')")
    exact = values.where(F.col("type").isin(*fixed.FALLBACK_TYPES))
    side = lambda s, status, n, block: (
        left.where(F.col("status") == status).where(F.col(f"{block}.block_type") != "table_row").select(*scope, F.col(n).alias("n")).join(exact.where(F.col("side") == s), ["cmp_id", "n"]).select(*scope, *V.ENTITY)
    )
    found = cut(V.findings(V.pair_values(side("A", "REMOVED", "n_a", "a"), side("B", "ADDED", "n_b", "b"), scope))).where("old_value is not null and new_value is not null")
    found = found.withColumnsRenamed({"a": "ea", "b": "eb"}).withColumn("n_a", F.col("ea.n")).withColumn("n_b", F.col("eb.n"))
    one = F.struct("block_index", "block_id", "page", "block_type", "text", "cells", "path", "section_heading")
    get = lambda s: full.where(F.col("side") == s).select("cmp_id", F.col("block_index").alias(f"n_{s.lower()}"), one.alias(s.lower()))
    rows = found.join(alignments.select("cmp_id", "al_no", F.col("confidence").alias("al_confidence")), scope).join(get("A"), ["cmp_id", "n_a"]).join(get("B"), ["cmp_id", "n_b"])
    span = lambda e, n: F.col(f"{e}.{n}")
    emit = F.struct(F.lit(5).alias("phase"), F.col("al_no").cast("int").alias("al"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("int").alias("kind"), F.col("group").alias("group"), F.col("seq.late").cast("int").alias("late"), F.col("seq.at").cast("int").alias("at"))
    return _change(
        rows, emit=emit, type=F.lit("MODIFIED"), categories=T.merge_categories(F.array("category"), T.categories_or(T.categorize(F.col("a.text"), F.col("b.text")), F.col("category"))), summary=F.col("summary"),
        signals=G.signals(alignment=F.col("al_confidence"), extraction=F.col("sure") * 0.85), old_value=F.col("old_value"), new_value=F.col("new_value"), delta=F.col("delta"), direction=F.col("direction"),
        citation_a=citation("A", "a", span("ea", "char_start"), span("ea", "char_end")), citation_b=citation("B", "b", span("eb", "char_start"), span("eb", "char_end")),
        detectors=_array("structured_extraction"), notes=_array(fixed.FALLBACK_NOTE),
    )


def _sections(alignments: DataFrame, sections: DataFrame, full: DataFrame) -> DataFrame:
    """Whole sections added or removed, and matched ones with another name or number."""
    parts = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    first = F.min_by(F.struct("block_index", "block_id", "page", "block_type", "text", "cells", "path", "section_heading"), "block_index")
    bodies = full.groupBy("cmp_id", "side", "section_id").agg(first.alias("first"), F.array_join(F.transform(parts, lambda p: p.text), " ").alias("body"), F.count("*").alias("size"))
    named = sections.select("cmp_id", "side", "section_id", "heading", "normalized_heading", F.coalesce("section_number", F.lit("")).alias("number"), "label", "path", "start_page", "end_page").join(bodies, ["cmp_id", "side", "section_id"])
    pack = F.struct(*[c for c in named.columns if c not in ("cmp_id", "side", "section_id")])
    get = lambda s: named.where(F.col("side") == s).select("cmp_id", F.col("section_id").alias(f"section_id_{s.lower()}"), pack.alias(f"s{s.lower()}"))
    rows = alignments.join(get("A"), ["cmp_id", "section_id_a"], "left").join(get("B"), ["cmp_id", "section_id_b"], "left")
    rows = rows.withColumn("a", F.col("sa.first")).withColumn("b", F.col("sb.first")).withColumn("own", F.coalesce("sb", "sa"))
    emit = _emit(6, F.col("al_no"))
    new = F.col("status") == "ADDED"
    verb = F.when(new, "added").otherwise("removed")
    pages = F.when(F.col("own.start_page") == F.col("own.end_page"), F.format_string("page %d", "own.start_page")).otherwise(F.format_string("pages %d-%d", "own.start_page", "own.end_page"))
    alone = rows.where("status != 'MATCHED'")
    label = text_value(F.col("own.label"), "section")
    whole = _change(
        alone, emit=emit, type=F.when(new, "SECTION_ADDED").otherwise("SECTION_REMOVED"), categories=T.merge_categories(T.categorize(F.col("own.heading")), T.categories_or(T.categorize(F.col("own.body")), "SCOPE")),
        summary=F.concat(F.lit("Section "), verb, F.lit(": "), F.col("own.label"), F.lit(" ("), T.plural(F.col("own.size"), "block"), F.lit(", "), pages, F.lit(").")),
        signals=G.signals(alignment=0.95, diff=1.0), old_value=F.when(~new, label), new_value=F.when(new, label), direction=F.concat(F.lit("section_"), verb),
        text_a=F.when(~new, T.shorten(F.col("own.body"), 600)).otherwise(""), text_b=F.when(new, T.shorten(F.col("own.body"), 600)).otherwise(""), detectors=_array("section_alignment"),
        section_a=F.col("sa.path"), section_b=F.col("sb.path"),
    )
    title = F.col("sa.normalized_heading") != F.col("sb.normalized_heading")
    other = rows.where("status = 'MATCHED'").where(title | (F.col("sa.number") != F.col("sb.number")))
    found = T.merge_categories(T.categorize(F.col("sb.heading"), F.col("sa.heading")), _array("FORMATTING"))
    renamed = _change(
        other, emit=emit, type=F.lit("SECTION_RENAMED"), categories=F.when(title, found).otherwise(_array("FORMATTING")),
        summary=F.concat(F.when(title, "Section renamed: \"").otherwise("Section renumbered: \""), F.col("sa.label"), F.lit("\" → \""), F.col("sb.label"), F.lit("\".")),
        signals=G.signals(alignment=F.col("confidence"), diff=1.0), old_value=text_value(F.col("sa.label"), "section"), new_value=text_value(F.col("sb.label"), "section"),
        direction=F.when(title, "section_renamed").otherwise("section_renumbered"), text_a=F.col("sa.label"), text_b=F.col("sb.label"), detectors=_array("section_alignment"),
        section_a=F.col("sa.path"), section_b=F.col("sb.path"),
        notes=F.array(F.format_string("Matched with %d%% alignment confidence — the sections' content was compared as corresponding.", F.floor(F.col("confidence") * 100 + 0.5))),
    )
    return whole.unionByName(renamed)


def semantic_candidates(aligned: DataFrame, blocks: DataFrame) -> DataFrame:
    """Modified or moved passages that a model could say more about, at most 80 a comparison, best first."""
    from deltadoc.functions import similarity as S

    side = lambda s: blocks.where(F.col("side") == s).select("cmp_id", F.col("block_index").alias(f"n_{s.lower()}"), F.col("text").alias(f"text_{s.lower()}"), F.col("normalized").alias(f"norm_{s.lower()}"))
    rows = aligned.where("status in ('MODIFIED', 'MOVED')").join(side("A"), ["cmp_id", "n_a"]).join(side("B"), ["cmp_id", "n_b"]).where(~T.is_cosmetic(F.col("text_a"), F.col("text_b")))
    rows = rows.withColumn("change", 1 - S.ratio(F.col("norm_a"), F.col("norm_b"))).where(F.col("change") >= fixed.SEMANTIC_LEAST).withColumn("ops", D.word_diff(F.col("text_a"), F.col("text_b")))
    rows = rows.withColumn("before", D.fragments(F.col("ops"), "a")).withColumn("after", D.fragments(F.col("ops"), "b"))
    modal = T.any_of(F.lower(F.concat_ws(" ", "before", "after")), fixed.MODALITY_HINTS)
    rows = rows.withColumn("modal", modal).where(F.col("modal") | (F.col("change") >= fixed.SEMANTIC_PLAIN))
    priority = F.col("change") + F.when(F.col("modal"), 0.5).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("cmp_id").orderBy(F.desc("priority"), "al_no", "n_a"))
    rows = rows.withColumn("priority", priority).withColumn("rank", rank).where(F.col("rank") <= fixed.SEMANTIC_PASSAGES)
    return rows.select("cmp_id", "rank", "n_a", "n_b", "text_a", "text_b", "before", "after", "priority")
