"""Values as a reader sees them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "—"


def bytes_label(n: Column) -> Column:
    """A size in B, whole KB, MB with one decimal or GB with two; a dash for null."""
    kb, mb, gb = n / 1024, n / 1024**2, n / 1024**3
    made = lambda x, form, unit: F.concat(F.call_function("format_number", x, F.lit(form)), F.lit(f" {unit}"))
    return (
        F.when(n.isNull(), NOTHING).when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(kb < 1024, made(F.floor(kb + 0.5), "0", "KB")).when(mb < 1024, made(F.floor(mb * 10 + 0.5) / 10, "0.0", "MB")).otherwise(made(F.floor(gb * 100 + 0.5) / 100, "0.00", "GB"))
    )


def date_label(iso: Column) -> Column:
    """A date such as ``Mar 5, 2024``; a text that is no date stays, null is a dash."""
    return F.when(F.coalesce(iso, F.lit("")) == "", NOTHING).otherwise(F.coalesce(F.date_format(F.try_to_timestamp(iso), "MMM d, yyyy"), iso))


def value_text(value: Column) -> Column:
    """A value by its source, else by its number with sign, share or unit; a dash for none."""
    from deltadoc.functions import text as T

    body = F.call_function("format_number", value["value_num"], F.lit("#,##0.##"))
    unit = F.coalesce(value["unit"], F.lit(""))
    number = (
        F.when(T.lookup(value["currency"], T.fixed.GLYPHS).isNotNull(), T.amount(value["value_num"], value["currency"]))
        .when(unit == "percent", F.concat(body, F.lit("%"))).when(~unit.isin("", "text", "section"), F.concat_ws(" ", body, unit)).otherwise(body)
    )
    return F.coalesce(F.nullif(value["source_text"], F.lit("")), number, value["value_str"], F.lit(NOTHING))


def scaled_box(x0: Column, top: Column, x1: Column, bottom: Column, scale: Column) -> Column:
    """A box of a page in pixels, two wide and high at least."""
    return F.struct(
        (x0 * scale).alias("left"), (top * scale).alias("top"),
        F.greatest(F.lit(2.0), (x1 - x0) * scale).alias("width"), F.greatest(F.lit(2.0), (bottom - top) * scale).alias("height"),
    )


def sees_images(provider: Column, model: Column) -> Column:
    """Whether a provider's model takes images; unknown providers may be tried."""
    has = lambda *names: F.lower(model).rlike("|".join(names))
    return F.when(provider == "deepseek", has("flash")).when(provider == "openai", has("4o", r"4\.1")).when(provider == "anthropic", has("claude")).otherwise(True)
