"""Chains of versions: consecutive comparisons and the course of values over versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltadoc.functions import text as T


def consecutive(versions: DataFrame) -> DataFrame:
    """Pairs of consecutive versions (chain_id, version, doc_id): cmp_id, step, doc_a and doc_b.

    A version whose ``sha256`` (where given) equals the one before it is left out first; a null is unlike any other.
    """
    versions, order = _unlike(versions), Window.partitionBy("chain_id").orderBy("version")
    rows = versions.withColumn("step", F.row_number().over(order) - 1).withColumn("doc_b", F.lead("doc_id").over(order))
    rows = rows.where("doc_b is not null")
    return rows.select("chain_id", F.concat_ws(":", F.col("chain_id").cast("string"), F.col("step").cast("string")).alias("cmp_id"), "step", F.col("doc_id").alias("doc_a"), "doc_b")


def _unlike(versions: DataFrame) -> DataFrame:
    """Versions without those whose ``sha256`` (where given) equals the one before."""
    if "sha256" not in versions.columns:
        return versions
    before = F.lag("sha256").over(Window.partitionBy("chain_id").orderBy("version"))
    return versions.withColumn("_before", before).where("_before is null or sha256 is null or _before != sha256").drop("_before")


def placed(versions: DataFrame) -> DataFrame:
    """Versions that count for ``consecutive``, with ``sides``: the steps that each is in, as side B of one and side A of the next.

    What is read from a version can thus go to its steps without being joined with them.
    """
    chain = Window.partitionBy("chain_id")
    rows = _unlike(versions).withColumn("_n", F.row_number().over(chain.orderBy("version"))).withColumn("_last", F.count("*").over(chain))
    side = lambda s, step, there: F.when(there, F.struct((F.col("_n") - step).cast("int").alias("step"), F.lit(s).alias("side")))
    sides = F.array_compact(F.array(side("B", 2, F.col("_n") > 1), side("A", 1, F.col("_n") < F.col("_last"))))
    return rows.withColumn("sides", sides).drop("_n", "_last")


def loaded(chains: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents (doc_id, filename, ...) of each chain (chain_id, ids: array) in its order.

    Ids without a document are left out; version counts those that are there, from 1, and a document
    without a name is called by it.
    """
    rows = chains.select("chain_id", F.posexplode("ids").alias("at", "doc_id")).join(documents, "doc_id")
    rows = rows.withColumn("version", F.row_number().over(Window.partitionBy("chain_id").orderBy("at")))
    return rows.withColumn("filename", F.coalesce(F.nullif("filename", F.lit("")), F.concat(F.lit("Version "), F.col("version").cast("string")))).drop("at")


def tracked(changes: DataFrame) -> DataFrame:
    """Changes of a number with a currency or a unit of time or share."""
    unit = F.coalesce("new_value.unit", "old_value.unit").isin("days", "weeks", "months", "years", "hours", "percent")
    money = F.coalesce("new_value.currency", "old_value.currency").isNotNull()
    return changes.where(F.col("old_value.value_num").isNotNull() & F.col("new_value.value_num").isNotNull() & (money | unit))


def timeline(changes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """The value of each tracked group at each version of its chain, in long form.

    ``steps``: chain_id, cmp_id, step; not needed where changes have chain_id and step themselves. A group is a section, a category and a unit. A change's new value is
    the version's value, the last one if there are several; its old value fills the version before where
    nothing else is known. Net differences are between the first and the last known value.
    """
    unit = F.coalesce("new_value.currency", "new_value.unit", "old_value.currency", "old_value.unit")
    place = F.coalesce("section_b", "section_a")
    rows = tracked(changes) if steps is None else tracked(changes).join(steps, "cmp_id")
    rows = rows.select(
        "chain_id", F.concat_ws("|", place, "category", unit, F.coalesce("new_value.kind", "new_value.context")).alias("group"), "step", "ordinal",
        F.col("old_value.value_num").alias("old"), F.col("new_value.value_num").alias("new"),
    )
    key = ["chain_id", "group"]
    old = F.struct(F.col("step").alias("version"), F.struct(F.lit(0).alias("known"), (-F.col("ordinal")).alias("o"), F.col("old").alias("v")).alias("p"))
    new = F.struct((F.col("step") + 1).alias("version"), F.struct(F.lit(1).alias("known"), F.col("ordinal").alias("o"), F.col("new").alias("v")).alias("p"))
    points = rows.repartition(*key).select(*key, F.explode(F.array(old, new)).alias("x")).groupBy(*key, "x.version").agg(F.max("x.p").alias("p"), F.sum("x.p.known").alias("n"))
    points = points.select(*key, "version", F.col("p.v").alias("value"), "n")
    # Groups stay where they were dealt to, so neither the points nor the windows move them again.
    whole = Window.partitionBy(*key).orderBy("version").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    points = points.withColumn("first_value", F.first("value").over(whole)).withColumn("last_value", F.last("value").over(whole)).withColumn("steps", F.sum("n").over(whole)).drop("n")
    points = points.withColumn("net_absolute", T.half_up(F.col("last_value") - F.col("first_value"), 2))
    return points.withColumn("net_percentage", F.when(F.col("first_value") != 0, T.half_up(F.col("net_absolute") / F.nullif(F.col("first_value"), F.lit(0.0)) * 100, 2)))


def timeline_order(rows: DataFrame) -> DataFrame:
    """Groups by number of changes, then by net share of change."""
    return rows.orderBy(F.desc("steps"), F.desc(F.abs(F.coalesce("net_percentage", F.lit(0.0)))), "chain_id", "group", "version")


def chain_summary(changes: DataFrame, steps: DataFrame) -> DataFrame:
    """Changes and those of high importance for each step, and for the whole chain (step null)."""
    counts = changes.groupBy("cmp_id").agg(F.count("*").alias("n"), F.count_if(F.col("importance") == "HIGH").alias("h"))
    rows = steps.join(counts, "cmp_id", "left").fillna(0, ["n", "h"])
    return rows.rollup("chain_id", "step").agg(F.sum("n").alias("changes"), F.sum("h").alias("high")).where("chain_id is not null")


