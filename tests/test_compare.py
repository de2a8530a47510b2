"""Sources, segmentation and whole comparisons."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from deltadoc.operators import align
from deltadoc.operators.segment import sections_of
from deltadoc.plans import chain, compare, evaluate, review, semantic
from deltadoc.sources import dispatch, export, files, layout, plain, store

OLD = """Harbour Survey Proposal

Draft of 12 August 2026

1. Project Scope

The Supplier shall chart the outer harbour with sonar equipment.

The Supplier shall run classroom seminars for twelve Client officers.

The Supplier shall provide hull inspection.

2. Pricing

The total survey price is ₦5,000,000 before levies.

3. Delivery

The Supplier shall finish the chart within 45 days of kick-off.

4. Payment Terms

The Client shall pay 50% of the total price upfront on signature.

Unpaid sums attract interest at 2% per month.

5. Exclusivity

The Supplier shall not chart harbours of rival ports for twelve months.

6. Termination

Either party may end this contract by giving 14 days written notice.

7. Governing Law

This contract follows the statutes of Lagos State."""
NEW = """Harbour Survey Proposal

Draft of 2 September 2026

1. Scope of Services

The Supplier shall chart the outer harbour with sonar equipment.

The Supplier may provide hull inspection when requested.

The Supplier shall publish monthly tide bulletins for pilots.

2. Commercial Terms

The total survey price is ₦6,000,000 before levies.

3. Timeline

The Supplier shall finish the chart within 60 days of kick-off.

4. Payment

The Client shall pay 70% of the total price upfront on signature.

Unpaid sums attract interest at 2% per month.

5. Termination

Either party may end this contract by giving 30 days written notice.

6. Governing Law

This contract follows the statutes of Lagos State.

7. Data Protection

The Supplier shall erase personal data within 30 days of expiry."""
LABELS = [
    ("price", ["5,000,000", "6,000,000"], "HIGH", "PRICING"), ("delivery", ["45 days", "60 days"], "HIGH", "DURATION"), ("seminars", ["classroom seminars"], "HIGH", "SCOPE"),
    ("upfront", ["50%", "70%"], "HIGH", "PAYMENT_TERMS"), ("notice", ["14 days", "30 days"], "HIGH", "TERMINATION"), ("hull", ["hull inspection"], "HIGH", "OBLIGATIONS"),
    ("tides", ["tide bulletins"], "MEDIUM", "SCOPE"), ("rivals", ["exclusivity"], "HIGH", "SCOPE"), ("data", ["data protection"], "MEDIUM", "CONFIDENTIALITY"), ("draft", ["12 August 2026", "2 September 2026"], "LOW", "DATES"),
]


@pytest.fixture(scope="module")
def result(spark):
    versions = spark.createDataFrame([(1, OLD, NEW), (2, OLD, OLD), (3, "", ""), (4, "Only old text here.", None)], "cmp_id long, text_a string, text_b string")
    return compare.compare_texts(versions)


def test_quality_gate(spark, result):
    labels = spark.createDataFrame([(1, *x) for x in LABELS], "cmp_id long, label_id string, match array<string>, severity string, category string")
    report = evaluate.report(labels, result.changes.where("cmp_id = 1")).first()
    assert report.recall >= 0.95 and report.precision >= 0.90 and report.citation_accuracy >= 0.98 and report.weighted_recall >= 0.95
    assert evaluate.missed(labels, result.changes).count() == 0


def test_exact_values(result):
    rows = {r.direction: r for r in result.changes.where("cmp_id = 1").collect()}
    price = rows["amount_increased"]
    assert (price.old_value.value_num, price.new_value.value_num, price.delta.absolute, price.delta.percentage) == (5e6, 6e6, 1e6, 20.0)
    assert rows["percent_increased"].delta.percentage_points == 20 and rows["date_later"].delta.days == 21
    assert rows["obligation_weakened"].delta.strength_change == -4
    assert price.importance == "HIGH" and price.summary == "Amount increased from ₦5,000,000 to ₦6,000,000 — +₦1,000,000 (+20%)."


def test_citations_resolve(result):
    blocks = {(r.cmp_id, r.side, r.block_id): r.text for r in result.blocks.collect()}
    for c in result.changes.collect():
        assert c.detectors and (c.citation_a or c.citation_b)
        for x in (c.citation_a, c.citation_b):
            if x:
                assert blocks[c.cmp_id, x.document_version, x.block_id][x.char_start : x.char_end] == x.text


def test_identical_and_empty(spark, result):
    counts = {r["cmp_id"]: r["count"] for r in result.changes.groupBy("cmp_id").count().collect()}
    assert 2 not in counts and 3 not in counts and counts[4] >= 1
    pairs = spark.createDataFrame([(k, "a", "b") for k in (1, 2)], "cmp_id long, label_a string, label_b string")
    rows = {r.cmp_id: r for r in compare.summary(pairs, result.changes, result.blocks).collect()}
    assert rows[2].identical and rows[2].headline == "No differences detected between a and b." and not rows[1].identical
    assert rows[1].total == counts[1] == rows[1].high + rows[1].medium + rows[1].low


def test_renames_and_order(result):
    kinds = [r.type for r in result.changes.where("cmp_id = 1").orderBy("ordinal").collect()]
    assert "SECTION_RENAMED" in kinds and kinds[0] != "SECTION_RENAMED"
    assert {r.status for r in result.alignments.where("cmp_id = 1").collect()} == {"MATCHED", "ADDED", "REMOVED"}
    assert compare.key_changes(result.changes).where("rank > 12").count() == 0


def test_exports(result):
    rows = export.rows(result.changes)
    text = {r.cmp_id: r.csv for r in export.csv(rows).collect()}[1]
    assert text.startswith("﻿ID,") and text.endswith("\r\n") and "₦5,000,000" in text
    assert "&lt;" in export.html(rows.withColumn("Summary", F.lit("<b>"))).first().html
    assert export.rows(result.changes, minor=False).where("`Review priority` = 'LOW'").count() == 0


def test_semantic_answers(spark, result):
    from deltadoc.operators.reconcile import changes, semantic_candidates

    candidates = semantic_candidates(result.aligned, result.blocks)
    assert candidates.count() > 0

    def ask(passages):
        if any("sonar" in p["before"] for p in passages):
            raise RuntimeError("the provider is down")
        return [{"id": p["id"], "meaning_changed": True, "category": "RIGHTS", "summary": "It means something else.", "confidence": 3} for p in passages] + [{"id": "made up"}]

    answers = semantic.analyze(candidates, ask)
    assert {r.confidence for r in answers.collect()} == {1.0}
    more = changes(result.blocks, result.sections, result.entities, result.alignments, result.aligned, answers)
    assert more.where("array_contains(detectors, 'semantic_analysis')").count() > 0


def test_arbitration_splits(spark, result):
    choices = spark.createDataFrame([(1, "s2", None)], "cmp_id long, section_id_a string, choice string")
    rows = align.arbitrated(result.alignments, choices).where("cmp_id = 1").collect()
    before = result.alignments.where("cmp_id = 1").count()
    assert len(rows) == before + 1 and [r.status for r in rows if r.section_id_a == "s2"] == ["REMOVED"]
    assert align.ambiguous(result.alignments, result.sections).count() >= 0


def test_section_tree(spark):
    text = "intro line of text.\n\n1. One\n\nbody of one.\n\n1.1 Inner\n\ndeep body text.\n\nAPPENDIX\n\nmore of it.\n\n2. Two\n\nlast words here."
    placed, sections = sections_of(plain.blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    rows = {r.section_id: r for r in sections.collect()}
    assert [(rows[f"s{k}"].level, rows[f"s{k}"].parent_id) for k in range(5)] == [(0, None), (1, None), (2, "s1"), (3, "s2"), (1, None)]
    assert rows["s3"].path == "1 One > 1.1 Inner > APPENDIX" and rows["s0"].path == "(preamble)"
    assert placed.where("section_id = 's2'").count() == 2


def test_pages_and_runners(spark):
    pages = "\f".join(f"Secret draft\n\nbody number {k} goes here." for k in range(4))
    blocks = plain.blocks(spark.createDataFrame([(1, pages), (2, None), (3, " \n\n ")], "doc_id int, text string"))
    assert blocks.count() == 8
    left = plain.without_runners(blocks).orderBy("block_index").collect()
    assert [(r.page, r.block_index, r.block_id) for r in left] == [(k + 1, k, f"p{k + 1}-b{k}") for k in range(4)]


def docx(*parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(parts)}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    (tmp_path / "a.docx").write_bytes(docx(p("Scope", "Heading1"), p("some plain words go here."), f"<w:tbl>{row('Item', 'Price')}{row('Desk', '$5')}</w:tbl>"))
    (tmp_path / "b.txt").write_text("plain text.\n\nand more.")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.docx").write_bytes(b"broken")
    blocks, states = dispatch.extract(files.read_files(spark, str(tmp_path)))
    errors = {r.filename: r.error for r in states.collect()}
    assert errors["a.docx"] is errors["b.txt"] is None and errors["c.xyz"].startswith("Unsupported") and errors["d.docx"] == "No text was found."
    empty = files.described(spark.createDataFrame([("x/e.txt", bytearray(b""))], "path string, content binary"))
    assert dispatch.extract(empty)[1].first().error == "The file is empty."
    kinds = [(r.block_type, r.row_key) for r in blocks.where("doc_id like '%a.docx'").orderBy("block_index").collect()]
    assert kinds == [("heading", None), ("paragraph", None), ("table", None), ("table_row", "desk")]


def test_tables_compare_by_first_cell(spark):
    def doc(i, rows):
        cells = [(i, 1, 1, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]
        return layout.table_blocks(spark.createDataFrame(cells, "doc_id int, page int, table int, row int, column int, text string"))

    both = doc(1, [("Role", "Rate"), ("Consulting", "$10,000"), ("Training", "$900")]).unionByName(doc(2, [("Role", "Rate"), ("Consulting", "$12,500"), ("Support", "$700")]))
    c = compare.compare(spark.createDataFrame([(7, 1, 2)], "cmp_id int, doc_a int, doc_b int"), plain.described(both))
    rows = {(r.type, r.summary) for r in c.changes.collect()}
    assert ("MODIFIED", "Amount increased from $10,000 to $12,500 — +$2,500 (+25%).") in rows
    assert ("REMOVED", "Table row removed: Training ($900)") in rows and ("ADDED", "Table row added: Support ($700)") in rows


def test_chain(spark):
    prices = [("₦5,000,000", "45"), ("₦6,000,000", "60"), ("₦6,500,000", "60")]
    text = "1. Pricing\n\nThe total price is {}.\n\n2. Delivery\n\nThe chart is delivered within {} days."
    docs = spark.createDataFrame([(k, text.format(*p)) for k, p in enumerate(prices)], "doc_id int, text string")
    steps = chain.consecutive(spark.createDataFrame([(1, k, k) for k in range(3)], "chain_id int, version int, doc_id int"))
    c = compare.compare(steps.select("cmp_id", "doc_a", "doc_b"), plain.blocks(docs))
    rows = {(r.group, r.version): r for r in chain.timeline(c.changes, steps.select("chain_id", "cmp_id", "step")).collect()}
    money = [v for (g, _), v in sorted(rows.items()) if "NGN" in g]
    assert [r.value for r in money] == [5e6, 6e6, 6.5e6] and money[0].net_absolute == 1.5e6 and money[0].net_percentage == 30 and money[0].steps == 2
    totals = {r.step: r.changes for r in chain.chain_summary(c.changes, steps).collect()}
    assert totals == {0: 2, 1: 1, None: 3}


def test_reviews(spark, result):
    first = result.changes.where("cmp_id = 1 and ordinal = 1").first()
    reviews = spark.createDataFrame([(1, first.change_id, "confirmed", "x", "2026-01-01"), (1, first.change_id, "resolved", "y", "2026-01-02")], "cmp_id long, change_id string, status string, reviewed_by string, reviewed_at string")
    rows = review.with_reviews(result.changes, reviews)
    p = {r.cmp_id: r for r in review.progress(rows).collect()}[1]
    assert (p.reviewed, p.resolved, p.confirmed) == (1, 1, 0)
    assert review.filtered(rows, statuses=["resolved"], categories=[first.category], confidence=0.1, search=first.summary[:10]).count() == 1
    assert review.filtered(rows, minor=False).count() < rows.count()
    total = review.facets(rows).where("facet = 'total' and cmp_id = 1").first().n
    assert total == result.changes.where("cmp_id = 1").count()


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "cmp_id int, v string")
    store.put_once(rows, str(tmp_path / "o"))
    with pytest.raises(Exception):
        store.put_once(rows, str(tmp_path / "o"))
    store.replace_rows(rows, str(tmp_path / "t"), "cmp_id")
    store.replace_rows(rows.where("cmp_id = 2").withColumn("v", F.lit("c")), str(tmp_path / "t"), "cmp_id")
    assert {(r.cmp_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "c")}
    assert review.upserted(rows, rows.where("cmp_id = 2").withColumn("v", F.lit("d")), ["cmp_id"]).where("v = 'd'").count() == 1


def test_stream(spark, tmp_path):
    from deltadoc.streaming.versions import compare_stream

    spark.createDataFrame([(1, "The price is $5.", "The price is $6.")], "cmp_id long, text_a string, text_b string").write.parquet(str(tmp_path / "in"))
    seen = []
    versions = spark.readStream.schema("cmp_id long, text_a string, text_b string").parquet(str(tmp_path / "in"))
    compare_stream(versions, lambda c, n: seen.extend(r.direction for r in c.changes.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["amount_increased"]
