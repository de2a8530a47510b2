"""What keeps steps within their limits on large tables, held on small ones."""

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from deltadoc.functions import entities
from deltadoc.operators.assign import assign
from deltadoc.operators.cut import cut
from deltadoc.operators.segment import sections_of
from deltadoc.plans import search
from deltadoc.plans.compare import compare_texts
from deltadoc.sources import plain


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_cut_rows_wait_for_measured_sizes(spark):
    """Three short numbers become a megabyte of text; Spark's guess would broadcast it."""
    texts = cut(spark.range(2000).select("id", F.repeat(F.lit("x"), 1000).alias("text")))
    assert "BroadcastHashJoin" not in plan_of(texts.join(texts.withColumnRenamed("text", "other"), "id"))
    assert "BroadcastHashJoin" in plan_of(texts.join(F.broadcast(texts.limit(1)), "id"))


def test_problems_of_assignment_stream(spark):
    """Each group is a chain of rivals whose best total leaves the best pair out, over several batches."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(30).select((F.col("id") % 10).alias("g"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("score")) for a, b, s in ((0, 0, 0.7), (0, 1, 0.9), (1, 1, 0.7))])).alias("x")).select("g", "x.*").distinct()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = assign(rows, ["g"], "a", "b", "score", 0.3)
        assert "FlatMapGroupsInPandas" not in plan_of(found)
        assert sorted(map(tuple, found.select("g", "a", "b").collect())) == sorted((g, k, k) for g in range(10) for k in (0, 1))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_runners_are_found_without_joins(spark):
    """One shuffle by document: blocks aren't made again for their counts."""
    pages = spark.createDataFrame([(1, p, 2 * p + k, t) for p in range(1, 5) for k, t in enumerate(("Same head", f"page {p} has its own words."))] + [(2, p, p, "Same head") for p in (1, 2)], "doc_id int, page int, block_index int, text string")
    left = plain.without_runners(plain.described(pages, unicode=False))
    assert "Join" not in plan_of(left)
    assert sorted((r.doc_id, r.block_index, r.text) for r in left.collect()) == [(1, p - 1, f"page {p} has its own words.") for p in range(1, 5)] + [(2, 0, "Same head"), (2, 1, "Same head")]


def test_table_pages_shuffle_lines_not_words(spark, sf_dir):
    """Every word was shuffled seven times; now lines are dealt by order before they become words, and blocks are shuffled."""
    plan = plan_of(entry.queries()["table_pages"](spark, sf_dir))
    shuffles = [line for line in plan.splitlines() if "Exchange " in line]
    assert sum("REPARTITION_BY_NUM" not in line for line in shuffles) <= 2 and "MergeJoin" not in plan and "HashJoin" not in plan


def test_equal_texts_are_read_once(monkeypatch):
    """Each text was read, and its values went through a row of Python objects."""
    read = []
    monkeypatch.setattr(entities, "_spans", lambda t, first, real=entities._spans: read.append(t) or real(t, first))
    texts = pa.array(["within 10 days", None, "none", "within 10 days", "5% and 30 days"])
    found = entities._span_lists(texts, True).to_pylist()
    assert sorted(read) == ["5% and 30 days", "none", "within 10 days"]
    assert [[(v["family"], v["value_num"], v["char_start"]) for v in own or ()] for own in found] == [[("DURATION", 10.0, 7)], [], [], [("DURATION", 10.0, 7)], [("PERCENT", 5.0, 0), ("DURATION", 30.0, 7)]]


def test_terms_and_classes_are_made_once(spark, sf_dir):
    """Terms of all texts were made four times, for two counts with a filter each, and normalized texts likewise."""
    for name in ("term_weights", "identical_classes"):
        assert "regexp" not in plan_of(entry.queries()[name](spark, sf_dir))


def test_sections_without_joins(spark):
    """Headings, last pages and preambles were branches of their own that joins put together."""
    rows = [(1, 3, 0, "it begins here."), (1, 2, 1, "so it does."), (1, 1, 2, "1. Scope"), (1, 4, 3, "it is wide."), (1, 2, 4, "1.1 Place"), (1, 5, 5, "it is here."), (2, 1, 0, "no heading at all.")]
    blocks = plain.described(spark.createDataFrame(rows, "doc_id int, page int, block_index int, text string"), unicode=False)
    sections = sections_of(blocks, unicode=False)[1]
    assert "Join" not in plan_of(sections).replace("array_join", "")
    assert sorted((r.doc_id, r.section_id, r.level, r.start_page, r.end_page, r.path, r.parent_id) for r in sections.collect()) == [
        (1, "s0", 0, 1, 3, "(preamble)", None), (1, "s1", 1, 1, 5, "1 Scope", None), (1, "s2", 2, 2, 5, "1 Scope > 1.1 Place", "s1"), (2, "s0", 0, 1, 1, "(preamble)", None),
    ]


def test_terms_share_one_reading_of_rows(spark, tmp_path):
    """Each term had a shuffle of all texts of its own; postings were rows, not lists, when they were shuffled."""
    path = str(tmp_path / "i")
    texts = ["alpha beta", "", "b", "béta 𝒳y", "alpha", None] * 3
    search.write_index(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, hay string").repartition(2), path)
    found = search.places_of(spark, path, ["beta", "b", "𝒳Y", "alp"])
    assert plan_of(found).count(f"{path}/rows") == 1
    want = sorted((t, k) for t in ("beta", "b", "𝒳Y", "alp") for k, text in enumerate(texts) if text and t.lower() in text)
    assert sorted((r.term, r.k) for r in found.collect()) == want


def test_a_comparison_joins_its_blocks_once(spark):
    """Every step that read blocks, sections or values joined them with the pairs again."""
    made = compare_texts(spark.createDataFrame([(1, "1. FEES\n\nThe fee is $10.", "1. FEES\n\nThe fee is $20.")], "cmp_id int, text_a string, text_b string"), unicode=False)
    assert not any(join in plan_of(t) for t in (made.blocks, made.sections, made.entities) for join in ("MergeJoin", "HashJoin"))
    assert [r.direction for r in made.changes.collect()] == ["amount_increased"]
