"""Confidence and review priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltadoc import fixed
from deltadoc.functions import text as T

SIGNALS = {"alignment": fixed.W_ALIGNMENT, "diff": fixed.W_DIFF, "extraction": fixed.W_EXTRACTION, "semantic": fixed.W_SEMANTIC}


def signals(**given: Column | float | None) -> Column:
    """The four signals as a struct; those that aren't given are null."""
    return F.struct(*[F.lit(given.get(n)).cast("double").alias(n) if not isinstance(given.get(n), Column) else given[n].cast("double").alias(n) for n in SIGNALS])


def confidence(s: Column) -> Column:
    """The weighted mean of the signals that are there, from 0 to 1."""
    here = {n: s[n].isNotNull() for n in SIGNALS}
    total = sum((F.when(here[n], w).otherwise(0.0) for n, w in SIGNALS.items()), F.lit(0.0))
    mass = sum((F.coalesce(s[n] * w, F.lit(0.0)) for n, w in SIGNALS.items()), F.lit(0.0))
    return F.when(total > 0, T.half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mass / total)), 4)).otherwise(0.0)


def confidence_label(score: Column) -> Column:
    return F.when(score >= fixed.CONFIDENT, "High confidence").when(score >= fixed.LIKELY, "Medium confidence").otherwise("Low confidence")


def importance_score(kind: Column, categories: Column, delta: Column, share: Column | None = None) -> Column:
    """The heaviest category, moved by the kind of change and by large differences.

    ``share``: the percentage before it was rounded for ``delta``; a difference of 9.996 percent isn't one of 10.
    """
    weights = F.transform(categories, lambda c: F.coalesce(T.lookup(c, fixed.CATEGORY_WEIGHT), F.lit(1)))
    base = F.coalesce(F.array_max(weights), F.lit(1))
    by_kind = (
        F.when(kind.isin("SECTION_ADDED", "SECTION_REMOVED"), base + 2).when(kind.isin("ADDED", "REMOVED", "MEANING_CHANGED"), base + 1)
        .when(kind == "MOVED", base - 2).when(kind == "SECTION_RENAMED", F.least(base, F.lit(1))).otherwise(base)
    )
    big = lambda n, least: F.coalesce((F.abs(delta[n]) >= least).cast("int"), F.lit(0))
    percent = F.coalesce((F.abs(delta["percentage"] if share is None else F.coalesce(share, delta["percentage"])) >= fixed.BIG_PERCENT).cast("int"), F.lit(0))
    score = by_kind + percent + big("days", fixed.BIG_DAYS) + big("percentage_points", fixed.BIG_PERCENT) + big("strength_change", fixed.BIG_STRENGTH)
    only = lambda c: (F.size(F.array_distinct(categories)) == 1) & F.array_contains(categories, c)
    return F.when(only("FORMATTING"), 0).when(only("WORDING") & (kind != "MEANING_CHANGED"), F.least(score, F.lit(1))).otherwise(score).cast("double")


def importance(score: Column) -> Column:
    return F.when(score >= fixed.HIGH, "HIGH").when(score >= fixed.MEDIUM, "MEDIUM").otherwise("LOW")


def is_minor(kind: Column, level: Column, categories: Column) -> Column:
    plain = F.forall(categories, lambda c: c.isin("FORMATTING", "WORDING"))
    return F.when(kind == "MEANING_CHANGED", False).when(kind.isin("SECTION_RENAMED", "MOVED"), True).otherwise((level == "LOW") & plain)
