"""Ground truth on files, reports, arbitration and the command line."""

import json

from pyspark.sql import functions as F

from deltadoc import __main__ as command
from deltadoc.plans import compare, evaluate, semantic
from deltadoc.sources import export, store


def test_ground_truth_is_found_at_any_depth(spark, tmp_path):
    for name in ("a", "deep/er/b"):
        folder = tmp_path / name
        folder.mkdir(parents=True)
        spec = {"version_a": "v1.txt", "version_b": "v2.txt", "changes": [{"id": "x", "category": "PRICING", "severity": "HIGH", "match": ["$5"]}]}
        (folder / "ground_truth.json").write_text(json.dumps(spec, indent=1))
        (folder / "other.json").write_text("{}")
    rows = sorted(evaluate.ground_truth(spark, str(tmp_path)).collect())
    assert [r.version_b.rsplit("/", 2)[1:] for r in rows] == [["a", "v2.txt"], ["b", "v2.txt"]] and rows[0].labels[0].match == ["$5"]


def test_arbitration_asks_once_and_keeps_offered_choices(spark):
    rows = [(1, 1, "s1", "s2", "s7", 1, "x", "y", "z"), (1, 1, "s1", "s2", "s8", 2, "x", "y", "w"), (1, 2, "s3", "s4", "s7", 1, "p", "q", "z"), (2, 1, "s1", "s2", "s9", 1, "x", "y", "z")]
    cases = spark.createDataFrame(rows, "cmp_id long, case int, section_id_a string, section_id_b string, rival string, rank int, excerpt_a string, excerpt_b string, rival_excerpt string")

    def ask(cases):
        if len(cases) == 1:
            raise TimeoutError
        assert [sorted(c["choices"]) for c in cases] == [["s2", "s7", "s8"], ["s4", "s7"]]
        return [{"id": "c1", "choice": None}, {"id": "c2", "choice": "s99"}, {"id": "c9", "choice": "s2"}]

    assert [tuple(r) for r in semantic.arbitrate(cases, ask).collect()] == [(1, "s1", None)]


def test_report_and_command_line(spark, tmp_path, capsys):
    old, new = "1. FEES\n\nThe fee is $500. It goes to <b> & co.", "1. FEES\n\nThe fee is $600. It goes to <b> & co."
    found = compare.compare_texts(spark.createDataFrame([(1, old, new), (2, old, old)], "cmp_id long, text_a string, text_b string"))
    labels = spark.createDataFrame([(1, "v1", "v2"), (2, "v1", "v2")], "cmp_id long, label_a string, label_b string")
    made = {r.cmp_id: r.html for r in export.report(export.rows(found.changes), found.changes, compare.summary(labels, found.changes, found.blocks)).collect()}
    assert "1 total" in made[1] and "0 reviewed" in made[1] and made[1].count("<blockquote>") == 2 and "$600</blockquote>" in made[1] and "1 FEES" in made[1]
    assert "No differences" in made[2] and "<ol></ol>" in made[2]
    for name, text in (("a.txt", old), ("b.txt", new)):
        (tmp_path / name).write_text(text)
    command.main([str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert "b.txt contains 1 detected change compared with a.txt." in capsys.readouterr().out


def test_erasing_keeps_the_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(5).withColumn("x", F.lit("a"))
    rows.write.parquet(path)
    store.erased(rows, path)
    assert spark.read.parquet(path).columns == ["id", "x"] and spark.read.parquet(path).count() == 0
