"""``python -m deltadoc OLD NEW [--json]``: the changes between two text files."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from deltadoc.plans.compare import compare_texts, summary
    from deltadoc.sources.export import citation_label

    parser = argparse.ArgumentParser(prog="deltadoc", description="Changes between two versions of a document.")
    parser.add_argument("old")
    parser.add_argument("new")
    parser.add_argument("--json", action="store_true", help="print all fields of the changes")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("deltadoc").getOrCreate()
    texts = [Path(p).read_text(encoding="utf-8", errors="replace") for p in (given.old, given.new)]
    found = compare_texts(spark.createDataFrame([(1, *texts)], "cmp_id long, text_a string, text_b string"))
    if given.json:
        rows = [r.asDict(recursive=True) for r in found.changes.orderBy("ordinal").collect()]
        print(json.dumps({"changes": rows}, ensure_ascii=False, default=str))
        return
    names = spark.createDataFrame([(1, Path(given.old).name, Path(given.new).name)], "cmp_id long, label_a string, label_b string")
    print(summary(names, found.changes, found.blocks).first()["headline"])
    from pyspark.sql import functions as F

    place = F.coalesce(citation_label(F.col("citation_b")), citation_label(F.col("citation_a")))
    for r in found.changes.select("ordinal", "importance", "summary", place.alias("place")).orderBy("ordinal").collect():
        print(f"{r.ordinal}. [{r.importance}] {r.summary} ({r.place})")


if __name__ == "__main__":
    main()
