"""Comparison of versions as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from deltadoc.plans.compare import Comparison, compare_texts


def compare_stream(versions: DataFrame, sink: Callable[[Comparison, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Compares each micro-batch of ``versions`` (cmp_id, text_a, text_b) and hands the tables to ``sink``.

    A batch may come twice after a failure, so ``sink`` writes by batch number or by cmp_id.
    """

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(compare_texts(batch, **options), number)

    return versions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
