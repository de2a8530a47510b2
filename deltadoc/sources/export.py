"""Exports of changes: labelled rows, CSV, JSON and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltadoc.functions import text as T

# The columns of the exported table.
COLUMNS = ("ID", "Review priority", "Type", "Category", "Summary", "Old value", "New value", "Difference", "Section", "Page A", "Page B", "Confidence", "Review status", "Notes")


def value_label(value: Column) -> Column:
    """A value for display: an amount with its currency, a number with its unit, else the text; sections' and texts' own are shown elsewhere."""
    number = F.when(value["currency"].isNotNull(), T.amount(value["value_num"], value["currency"])).when(value["unit"] == "percent", F.concat(T.number(value["value_num"]), F.lit("%")))
    number = number.otherwise(F.concat_ws(" ", T.number(value["value_num"]), value["unit"]))
    text = F.when(~F.coalesce(value["unit"], F.lit("")).isin("text", "section"), F.coalesce(value["source_text"], value["value_str"]))
    return F.coalesce(F.when(value["value_num"].isNotNull(), number).otherwise(text), F.lit(""))


def delta_label(delta: Column) -> Column:
    signed = lambda x, tail: F.when(x.isNotNull(), F.concat(F.when(x > 0, "+").when(x < 0, "-").otherwise(""), T.number(F.abs(x)), F.lit(tail)))
    return F.concat_ws(", ", signed(delta["absolute"], ""), signed(delta["percentage"], "%"), signed(delta["percentage_points"], " pp"), signed(delta["days"], " days"))


def citation_label(citation: Column, approximate: Column | None = None) -> Column:
    page = F.concat(F.lit("p. "), citation["page"].cast("string"))
    page = page if approximate is None else F.concat(F.when(approximate, "approx. ").otherwise(""), page)
    return F.when(citation.isNotNull(), F.concat_ws(" · ", T.short_section(citation["section"]), page))


def rows(changes: DataFrame, minor: bool = True) -> DataFrame:
    """The exported columns of each change, in review order; without minor changes those of low importance go."""
    some = changes if minor else changes.where("importance != 'LOW'")
    status = F.col("review_status") if "review_status" in changes.columns else F.lit("unreviewed")
    words = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    values = [
        F.col("change_id"), F.col("importance"), words(F.col("type")), words(F.col("category")), F.col("summary"), value_label(F.col("old_value")), value_label(F.col("new_value")), F.coalesce(delta_label(F.col("delta")), F.lit("")),
        F.coalesce("section_b", "section_a", F.lit("")), F.col("citation_a.page").cast("string"), F.col("citation_b.page").cast("string"), F.col("confidence_label"), words(status), F.array_join("notes", "; "),
    ]
    return some.select("cmp_id", "ordinal", *[F.coalesce(v, F.lit("")).alias(n) for n, v in zip(COLUMNS, values)])


def csv_line(*cells: Column) -> Column:
    """Cells with commas; those with quotes, commas or line ends are quoted."""
    quoted = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *map(quoted, cells))


def csv(exported: DataFrame) -> DataFrame:
    """One CSV text for each comparison: a byte order mark, the names, CRLF line ends."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", csv_line(*[F.col(f"`{c}`") for c in COLUMNS]).alias("line")))), lambda x: x.line)
    return exported.groupBy("cmp_id").agg(F.concat(F.lit("﻿" + ",".join(COLUMNS) + "\r\n"), F.array_join(lines, "\r\n"), F.lit("\r\n")).alias("csv"))


def json(changes: DataFrame) -> DataFrame:
    """One JSON text for each comparison with all of its changes."""
    items = F.array_sort(F.collect_list(F.struct("ordinal", F.to_json(F.struct(*[c for c in changes.columns if c != "cmp_id"])).alias("j"))))
    return changes.groupBy("cmp_id").agg(F.concat(F.lit('{"changes":['), F.array_join(F.transform(items, lambda x: x.j), ","), F.lit("]}")).alias("json"))


def html(exported: DataFrame) -> DataFrame:
    """One self-contained HTML page for each comparison."""
    cell = lambda c: F.concat(F.lit("<td>"), T.html_escape(c), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *[cell(F.col(f"`{c}`")) for c in COLUMNS], F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", row.alias("r")))), lambda x: x.r), "\n")
    head = "<!doctype html><meta charset=\"utf-8\"><title>Changes</title><table><tr>" + "".join(f"<th>{c}</th>" for c in COLUMNS) + "</tr>\n"
    return exported.groupBy("cmp_id").agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("html"))


def report(exported: DataFrame, changes: DataFrame, summaries: DataFrame) -> DataFrame:
    """One HTML report for each comparison: headline, counts, the state of the review, and each change with its citations.

    ``summaries``: cmp_id, headline, total, material, high, medium and low. A comparison without changes has
    its headline only.
    """
    state = F.col("review_status") if "review_status" in changes.columns else F.lit("unreviewed")
    quote = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("<blockquote><cite>"), T.html_escape(citation_label(F.col(c))), F.lit("</cite> "), T.html_escape(F.col(f"{c}.text")), F.lit("</blockquote>"))).otherwise("")
    cited = changes.select("cmp_id", "ordinal", F.concat(quote("citation_a"), quote("citation_b")).alias("_cited"), (state != "unreviewed").cast("int").alias("_done"))
    name = lambda n: T.html_escape(F.col(f"`{n}`"))
    item = F.concat(F.lit("<li><b>"), name("Review priority"), F.lit("</b> "), name("Summary"), F.lit(" <i>"), name("Review status"), F.lit("</i>"), F.col("_cited"), F.lit("</li>"))
    rows = exported.join(cited, ["cmp_id", "ordinal"]).select("cmp_id", "_done", F.struct("ordinal", item.alias("li")).alias("x"))
    lists = rows.groupBy("cmp_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.li), "\n").alias("_list"), F.sum("_done").alias("_done"))
    counts = F.concat_ws(" · ", *[F.concat(F.col(c).cast("string"), F.lit(f" {c}")) for c in ("total", "material", "high", "medium", "low")], F.concat(F.coalesce("_done", F.lit(0)).cast("string"), F.lit(" reviewed")))
    page = F.concat(F.lit('<!doctype html><meta charset="utf-8"><h1>'), T.html_escape(F.col("headline")), F.lit("</h1><p>"), counts, F.lit("</p><ol>"), F.coalesce("_list", F.lit("")), F.lit("</ol>"))
    return summaries.join(lists, "cmp_id", "left").select("cmp_id", page.alias("html"))
