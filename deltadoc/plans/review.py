"""Review of changes: filters, search, facets, overlays, notes and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltadoc import fixed
from deltadoc.functions import scoring as G


def searchable(changes: DataFrame) -> Column:
    """Everything of a change that a search looks at, in lower case."""
    return F.lower(F.concat_ws(" ", "summary", "text_a", "text_b", "section_a", "section_b", "old_value.source_text", "new_value.source_text"))


def filtered(
    changes: DataFrame, *, minor: bool = True, importance: list[str] | None = None, types: list[str] | None = None, categories: list[str] | None = None,
    statuses: list[str] | None = None, confidence: float | None = None, search: str | None = None,
) -> DataFrame:
    """Changes that meet every given condition; a category counts wherever it is among a change's categories."""
    keep = F.lit(True)
    if not minor:
        keep &= ~G.is_minor(F.col("type"), F.col("importance"), F.col("categories"))
    for column, values in (("importance", importance), ("type", types), ("review_status", statuses)):
        if values:
            keep &= F.col(column).isin(*values)
    if categories:
        keep &= F.arrays_overlap("categories", F.array(*map(F.lit, categories)))
    if confidence is not None:
        keep &= F.col("confidence") >= confidence
    if search:
        keep &= F.contains(searchable(changes), F.lit(search.lower()))
    return changes.where(keep)


def page(changes: DataFrame, offset: int = 0, limit: int = 2000) -> DataFrame:
    """A page of each comparison's changes in review order; at most 2000 rows."""
    at = F.row_number().over(Window.partitionBy("cmp_id").orderBy("ordinal"))
    return changes.withColumn("_at", at).where((F.col("_at") > offset) & (F.col("_at") <= offset + min(limit, 2000))).drop("_at")


def facets(changes: DataFrame) -> DataFrame:
    """Counts of each value of importance, type, review status and category, and of all changes."""
    parts = F.explode(F.concat(
        F.array(F.struct(F.lit("total").alias("facet"), F.lit("all").alias("value")), F.struct(F.lit("importance").alias("facet"), F.col("importance").alias("value")), F.struct(F.lit("type").alias("facet"), F.col("type").alias("value")), F.struct(F.lit("review_status").alias("facet"), F.col("review_status").alias("value"))),
        F.transform("categories", lambda c: F.struct(F.lit("category").alias("facet"), c.alias("value"))),
    )).alias("f")
    return changes.select("cmp_id", parts).groupBy("cmp_id", "f.facet", "f.value").agg(F.count("*").alias("n"))


def latest(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last of the ``events`` with the same ``keys``; of equal times, the greatest row."""
    others = [c for c in events.columns if c not in keys]
    rest = F.struct(at, *[c for c in others if c != at])
    return events.groupBy(*keys).agg(F.max(rest).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def with_reviews(changes: DataFrame, reviews: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Changes with their last review (cmp_id, change_id, status, reviewed_by, reviewed_at) and notes in order."""
    keys = ["cmp_id", "change_id"]
    last = latest(reviews.where(F.col("status").isin(*fixed.REVIEW_STATUSES)), keys, "reviewed_at")
    rows = changes.join(last, keys, "left").withColumn("review_status", F.coalesce("status", F.lit("unreviewed"))).drop("status")
    if notes is not None:
        listed = notes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("created_at", "author", "body"))).alias("reviewer_notes"))
        rows = rows.join(listed, keys, "left")
    return rows


def progress(changes: DataFrame) -> DataFrame:
    """How many changes of each comparison have each review status."""
    count = lambda s: F.count_if(F.col("review_status") == s).alias(s)
    return changes.groupBy("cmp_id").agg(F.count("*").alias("total"), F.count_if(F.col("review_status") != "unreviewed").alias("reviewed"), *map(count, fixed.REVIEW_STATUSES))


def latest_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents with their last version, if any: ``versions`` has doc_id, created_at and more."""
    return documents.join(latest(versions, ["doc_id"], "created_at"), "doc_id", "left")


def newest(rows: DataFrame, by: list[str], at: str = "created_at", limit: int | None = None) -> DataFrame:
    """Rows with their place (``at_no``, from 1) among those of the same ``by``, newest first; the first ``limit`` of each.

    Equal times follow the other columns in reverse; nulls come last.
    """
    rest = [F.col(c).desc_nulls_last() for c in rows.columns if c not in (*by, at)]
    placed = rows.withColumn("at_no", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(at).desc_nulls_last(), *rest)))
    return placed if limit is None else placed.where(F.col("at_no") <= limit)


def of_org(changes: DataFrame, comparisons: DataFrame, org_id) -> DataFrame:
    """Changes of comparisons (cmp_id, org_id) that belong to ``org_id``."""
    return changes.join(comparisons.where(F.col("org_id") == org_id).select("cmp_id"), "cmp_id", "left_semi")


def facet_order(counts: DataFrame, by: list[str]) -> DataFrame:
    """Facets' values with their place, the most frequent first and equal ones by name."""
    return counts.withColumn("at_no", F.row_number().over(Window.partitionBy(*by, "facet").orderBy(F.desc("n"), "value")))


def listing(comparisons: DataFrame, documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Comparisons with both documents' names and the numbers of changes and reviewed ones."""
    name = lambda s: documents.select(F.col("doc_id").alias(f"doc_{s}"), F.col("filename").alias(f"filename_{s}"))
    counts = changes.groupBy("cmp_id").agg(F.count("*").alias("change_count"), F.count_if(F.col("review_status") != "unreviewed").alias("reviewed_count"))
    return comparisons.join(name("a"), "doc_a").join(name("b"), "doc_b").join(counts, "cmp_id", "left").fillna(0, ["change_count", "reviewed_count"])


def search(changes: DataFrame, blocks: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """Places of ``term``: ``limit`` changes and twice as many blocks of each comparison."""
    low = term.lower()
    a = changes.where(F.contains(searchable(changes), F.lit(low))).select("cmp_id", F.lit("change").alias("kind"), F.col("change_id").alias("place"), F.col("summary").alias("text"), F.col("ordinal").alias("at"))
    b = blocks.where(F.contains(F.lower("text"), F.lit(low))).select("cmp_id", F.lit("document").alias("kind"), F.concat_ws(":", "side", "block_id").alias("place"), "text", F.col("block_index").alias("at"))
    rank = F.row_number().over(Window.partitionBy("cmp_id", "kind").orderBy("at", "place"))
    return a.unionByName(b).withColumn("_r", rank).where(F.col("_r") <= F.when(F.col("kind") == "change", limit).otherwise(2 * limit)).drop("_r")


def audit_trail(events: DataFrame, comparisons: DataFrame) -> DataFrame:
    """What happened to each comparison and its two documents, in order of time.

    ``events``: subject_type, subject_id, action, at. Equal times follow the kind of subject and the action.
    """
    subjects = comparisons.select("cmp_id", F.explode(F.array(
        F.struct(F.lit("comparison").alias("subject_type"), F.col("cmp_id").cast("string").alias("subject_id")),
        F.struct(F.lit("document").alias("subject_type"), F.col("doc_a").cast("string").alias("subject_id")),
        F.struct(F.lit("document").alias("subject_type"), F.col("doc_b").cast("string").alias("subject_id")),
    )).alias("s")).select("cmp_id", "s.*").distinct()
    rows = subjects.join(events, ["subject_type", "subject_id"])
    return rows.withColumn("at_no", F.row_number().over(Window.partitionBy("cmp_id").orderBy("at", "subject_type", "subject_id", "action")))


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` aren't in ``gone``; deletes and upserts are rewrites with this."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return without(table, rows, keys).unionByName(rows)
