"""Blocks to nested sections: windows for sections and levels, one sorted pass with a stack for their nesting."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltadoc.functions import text as T

#: Sections and characters of paths that are passed on at once.
_ROWS, _CHARS = 4096, 1 << 22


def nested(sections: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, order_index, parent, last and path of each row of ``sections``, and the columns ``keep`` as they are.

    ``sections``: doc_id, order_index, level, label and value (an int or null). The parent is the nearest
    earlier section of a smaller level, ``last`` the greatest value of a section and all below it, ``path`` the labels
    from the outermost section inwards. Levels below 1 have neither parent nor children; where orders
    repeat in a document, either comes first.

    A document's sections pass through one task in order, which holds the open ones only: a section of a
    level closes all of the same and deeper levels, and leaves when it is closed.
    """

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, stack, out, size = None, [], [], 0

        def close(level: int) -> None:
            nonlocal size
            while stack and stack[-1][1] >= level:
                order, _, parent, last, path, *at = stack.pop()
                if stack and last is not None and (stack[-1][3] is None or last > stack[-1][3]):
                    stack[-1][3] = last
                out.append((doc, order, parent, last, path, *at))
                size += len(path)

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal size
            *made, whence, rows = zip(*out)
            held = {id(b): b for b in whence}
            begins, n = {}, 0
            for k, b in held.items():
                begins[k], n = n, n + b.num_rows
            places = pa.array([begins[id(b)] + r for b, r in zip(whence, rows)], pa.int64())
            kept = [pa.concat_arrays([b.column(5 + k) for b in held.values()]).take(places) for k in range(len(keep))]
            kinds = (("doc_id", kind), ("order_index", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("path", pa.string()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, (_, t) in zip(made, kinds)), *kept], names=[*(n for n, _ in kinds), *keep])
            out.clear()
            size = 0

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for row, (own, order, level, label, value) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)))):
                if own != doc:
                    close(-(1 << 31))
                    doc = own
                if level < 1:
                    out.append((doc, order, None, value, label, batch, row))
                else:
                    close(level)
                    parent, path = (stack[-1][0], f"{stack[-1][4]} > {label}") if stack else (None, label)
                    stack.append([order, level, parent, value, path, batch, row])
                if len(out) >= _ROWS or size > _CHARS:
                    yield from full()
        close(-(1 << 31))
        if out:
            yield from full()

    own = [F.col("level").cast("int").alias("_level"), F.coalesce("label", F.lit("")).alias("_label"), F.col("value").cast("int").alias("_value")]
    rows = sections.select("doc_id", F.col("order_index").cast("int"), *own, *keep)
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "order_index")
    kind, more = sections.schema["doc_id"].dataType.simpleString(), "".join(f", {c} {sections.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(walk, f"doc_id {kind}, order_index int, parent int, last int, path string{more}")


def sections_of(blocks: DataFrame, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """Blocks with their section_id, and the sections with at least one block.

    A heading opens a section and is its first block; what comes before the first heading is the preamble
    ``s0``. A numbered heading's level is the depth of its number, another one's is one more than the
    previous heading's. The parent is the nearest earlier heading of a smaller level. A section's last page
    covers the plain blocks of its descendants.
    """
    order = Window.partitionBy("doc_id").orderBy("block_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("block_type") == "heading"
    placed = blocks.withColumn("section_order", F.sum(is_heading.cast("int")).over(upto).cast("int"))
    placed = placed.withColumn("section_id", F.concat(F.lit("s"), F.col("section_order").cast("string")))
    # A section has one heading at most, so its rows make one row without a join.
    found = placed.where("section_order is not null").groupBy("doc_id", "section_id", F.col("section_order").alias("order_index")).agg(
        F.max(F.when(is_heading, F.struct("text", "page"))).alias("_head"), F.max(F.when(~is_heading, F.col("page"))).alias("value"), F.min("page").alias("_first"),
    )
    preamble, text = F.col("order_index") == 0, F.col("_head.text")
    found = found.withColumn("section_number", T.heading_number(text, unicode))
    depth = F.size(F.split("section_number", r"\."))
    numbered = F.col("section_number").isNotNull()
    found = found.withColumn("_run", F.sum(numbered.cast("int")).over(Window.partitionBy("doc_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("doc_id", "_run").orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0)
    base = F.coalesce(F.first(F.when(numbered, depth)).over(within), F.lit(0))
    level = (base + F.sum((~numbered & ~preamble).cast("int")).over(within)).cast("int")
    start = F.when(preamble, F.min("_first").over(Window.partitionBy("doc_id"))).otherwise(F.col("_head.page"))
    tree = found.select(
        "doc_id", "section_id", "order_index", "section_number", F.when(preamble, "(preamble)").otherwise(T.heading_body(text, F.col("section_number"))).alias("heading"),
        F.when(preamble, "").otherwise(T.normalize_heading(text, unicode)).alias("normalized_heading"), start.alias("start_page"), F.when(preamble, 0).otherwise(level).alias("level"), "value",
    )
    own = ("section_id", "section_number", "heading", "normalized_heading", "start_page", "level", "label")
    tree = nested(_labelled(tree), own).withColumn("end_page", F.greatest("start_page", F.coalesce("last", "start_page")))
    tree = tree.withColumn("parent_id", F.when(F.col("parent").isNotNull(), F.concat(F.lit("s"), F.col("parent").cast("string"))))
    columns = ["doc_id", "section_id", "order_index", "section_number", "heading", "normalized_heading", "start_page", "end_page", "parent_id", "level", "label", "path"]
    return placed.drop("section_order"), tree.select(columns)


def _labelled(sections: DataFrame) -> DataFrame:
    return sections.withColumn("label", T.section_label(F.col("section_number"), F.col("heading")))


def excerpts(blocks: DataFrame, keys: list[str], limit: int = 500) -> DataFrame:
    """The first ``limit`` characters of each section's blocks (``keys``, block_index, text), joined by blanks."""
    texts = F.array_sort(F.collect_list(F.struct("block_index", F.substring("text", 1, limit).alias("text"))))
    return blocks.groupBy(*keys).agg(F.substring(F.array_join(F.transform(texts, lambda b: b.text), " "), 1, limit).alias("excerpt"))
