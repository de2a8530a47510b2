"""Scalar functions, entities, similarity, differences and assignment."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltadoc.functions import diff as D
from deltadoc.functions import entities as E
from deltadoc.functions import similarity as S
from deltadoc.functions import text as T
from deltadoc.operators.assign import assign, solve, spread


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("words, value", [("thirty", 30), ("ninety", 90), ("three hundred and fifty", 350), ("three million", 3e6), ("twenty-one", 21), ("a hundred", 100), ("banana", None), ("and", None), ("fourty", 40)])
def test_words_to_number(words, value):
    assert E.words_to_number(words) == value


MONEY = [
    ("costs ₦3,500,000 in all", 3.5e6, "NGN"), ("costs N3,500,000 in all", 3.5e6, "NGN"), ("NGN 3.5 million", 3.5e6, "NGN"), ("$20,000", 2e4, "USD"), ("USD 20,000", 2e4, "USD"),
    ("twenty thousand dollars", 2e4, "USD"), ("£5,000", 5e3, "GBP"), ("€1,250.50", 1250.5, "EUR"), ("5,000,000 naira", 5e6, "NGN"),
]


@pytest.mark.parametrize("text, value, code", MONEY)
def test_money(text, value, code):
    found = list(E.money_spans(text))
    assert [(f[4], f[6]) for f in found] == [(value, code)]
    assert text[found[0][2] : found[0][3]].strip() == found[0][1]


@pytest.mark.parametrize("text", ["answer within 45 days", "Version 3 of 12 August 2026", "within 8 hours", "14 days written notice", "section 4 has 12 parts"])
def test_not_money(text):
    assert not list(E.money_spans(text))


@pytest.mark.parametrize(
    "text, value, sure",
    [("October 15, 2026", "2026-10-15", 1.0), ("15 October 2026", "2026-10-15", 1.0), ("15/10/2026", "2026-10-15", 0.9), ("2026-10-15", "2026-10-15", 1.0), ("1st of March 2027", "2027-03-01", 1.0), ("04/05/2026", "2026-05-04", 0.55), ("on 3 May", "--05-03", 0.6)],
)
def test_dates(text, value, sure):
    assert [(f[5], f[7]) for f in E.date_spans(text)] == [(value, sure)]


def test_month_first():
    assert [f[5] for f in E.date_spans("04/05/2026", day_first=False)] == ["2026-04-05"]


def test_entity_table(spark):
    rows = [(1, "Pay the invoice within 60 days. Interest of 2% per month."), (2, "50% of it upfront."), (3, "The Supplier shall not provide monthly reports."), (4, None), (5, "Support for three months.")]
    found = {(r.k, r.type): r for r in E.entities(spark.createDataFrame(rows, "k int, text string"), ["k"]).collect()}
    assert found[1, "PAYMENT_PERIOD"].value_num == 60 and found[1, "INTEREST_RATE"].context == "interest"
    assert found[2, "PERCENT"].context == "upfront"
    o = found[3, "OBLIGATION"]
    assert (o.actor, o.value_str, o.strength, o.frequency, o.negated) == ("supplier", "shall", 6, "monthly", True)
    assert found[5, "DURATION"].days_equivalent == 90 and found[5, "DURATION"].kind == "support"


def test_text_functions(spark):
    c = F.lit
    r = one(
        spark, folded=T.normalize_text(c("  “Fees” –  and ﬁne​print ")), heading=T.normalize_heading(c("4.0 PAYMENT & TERMS")), number=T.heading_number(c("3rd item")), none=T.heading_number(c("Item")),
        body=T.heading_body(c("2.1) Scope"), c("2.1")), untitled=T.heading_body(c("2."), c("2")), marker=T.strip_list_marker(c("iv) the rest")), terms=T.content_terms(c("the supplier provides policies and reporting -x-")),
        same=T.is_cosmetic(c("1.5%, ok"), c("15% OK!")), cats=T.categorize(c("the total fee is payable")), short=T.shorten(c("aaa bbb ccc"), 6), amount=T.amount(c(1250.5), c("EUR")), coded=T.amount(c(5.0), c("KES")),
        half=T.half_up(c(-2.5), 0), stem=T.safe_stem(c("a/b: c  d")), path=T.short_section(c("a > b > c")),
    )
    assert r.folded == "\"fees\" - and fineprint" and r.heading == "payment terms" and r.number == "3" and r.none is None
    assert r.body == "Scope" and r.untitled == "(untitled)" and r.marker == "the rest" and r.terms == ["supplier", "provid", "polic", "report"]
    assert r.same and r.cats == ["PRICING", "PAYMENT_TERMS"] and r.short == "aaa b…" and r.amount == "€1,250.5" and r.coded == "5 KES"
    assert r.half == -2 and r.stem == "a-b--c-d" and r.path == "… > b > c"


@pytest.mark.parametrize("text, kind", [("a) item", "list_item"), ("• item", "list_item"), ("2.1 Scope of work", "heading"), ("2. This is a sentence.", "paragraph"), ("PAYMENT TERMS", "heading"), ("Governing Law", "heading"), ("the rest of it", "paragraph"), ("", "paragraph")])
def test_block_type(spark, text, kind):
    assert one(spark, k=T.block_type(F.lit(text))).k == kind


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 20))) for _ in range(2))
        assert S.lcs_length(a, b) == S.lcs_length(b, a) == slow_lcs(a, b)
    assert S.ratio_of("", "") == 1 and S.ratio_of("a", "") == 0 and S.ratio_of("x" * 5000 + "a", "x" * 5000 + "b") == 1
    assert S.partial_of("abc", "zzabczz") > 0.6 and S.partial_of("abc", "abczz") == 1


def test_set_and_sort_ratios(spark):
    pairs = [("b a", "a b"), ("", ""), ("x", ""), ("pay the fee", "pay the fee now and then"), ("alpha beta", "gamma delta")]

    def expected(a, b):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            return float(not x and not y)
        base, left, right = (" ".join(w) for w in (sorted(x & y), sorted(x & y) + sorted(x - y), sorted(x & y) + sorted(y - x)))
        return max(S.ratio_of(base, left), S.ratio_of(base, right), S.ratio_of(left, right))

    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.token_set_ratio(S.word_set(F.col("a")), S.word_set(F.col("b"))).alias("s"), S.token_sort_ratio(F.col("a"), F.col("b")).alias("t")).collect()
    for r in rows:
        assert abs(r.s - expected(r.a, r.b)) < 1e-12 and r.t == S.ratio_of(" ".join(sorted(r.a.split())), " ".join(sorted(r.b.split())))


def test_headings(spark):
    pairs = [("project scope", "scope of services", 0.6, 1), ("pricing", "commercial terms", 0.6, 1), ("delivery", "timeline", 0.6, 1), ("payment terms", "payment", 0.6, 1), ("confidentiality", "pricing", 0, 0.5), ("x", "x", 1, 1), ("", "", 0.5, 0.5), ("x", "", 0, 0)]
    pairs = [(a, b, float(lo), float(hi)) for a, b, lo, hi in pairs]
    rows = spark.createDataFrame(pairs, "a string, b string, lo double, hi double").withColumn("s", S.heading_similarity(F.col("a"), F.col("b"))).collect()
    assert all(r.lo <= r.s <= r.hi for r in rows)


def test_word_diff_rebuilds_both_texts():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (" ".join(rng.choice(["a", "b", "C", "c", "d"]) for _ in range(rng.randint(0, 15))) for _ in range(2))
        ops = D.word_diff_of(a, b)
        assert "".join(o[1] for o in ops) == a and "".join(o[2] for o in ops) == b
        assert all((x == "") == (k == "insert") and (y == "") == (k == "delete") for k, x, y in ops)
    assert D.word_diff_of("pay $20 now", "pay $28 now") == [("equal", "pay ", "pay "), ("replace", "$20", "$28"), ("equal", " now", " now")]


def brute(margin):
    def best(r, used):
        if r == len(margin):
            return 0.0
        return max([best(r + 1, used)] + [margin[r, c] + best(r + 1, used | {c}) for c in range(margin.shape[1]) if c not in used and not np.isnan(margin[r, c])])

    return best(0, frozenset())


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(3)
    for k in range(300):
        m = rng.random((rng.integers(1, 6), rng.integers(1, 6))) if k % 2 else rng.integers(0, 3, (rng.integers(1, 6), rng.integers(1, 6))) / 4
        m[rng.random(m.shape) < 0.3] = np.nan
        at = rng.permutation(np.argwhere(~np.isnan(m)))
        times = solve(at[:, 0].tolist(), at[:, 1].tolist(), [m[r, c] for r, c in at], [1] * m.shape[0], [1] * m.shape[1])
        pairs = [tuple(x) for x, n in zip(at.tolist(), times) if n]
        assert len({c for _, c in pairs}) == len({r for r, _ in pairs}) == len(pairs) and abs(sum(m[p] for p in pairs) - brute(m)) < 1e-9


def test_assignment_of_equal_rows():
    """A row that stands for several equal ones gives the total of its copies."""
    rng = np.random.default_rng(5)
    for _ in range(150):
        m = rng.integers(0, 4, (rng.integers(1, 4), rng.integers(1, 4))) / 4
        room_a, room_b = rng.integers(1, 3, m.shape[0]), rng.integers(1, 3, m.shape[1])
        at = np.argwhere(m >= 0)
        times = solve(at[:, 0].tolist(), at[:, 1].tolist(), [m[r, c] for r, c in at], room_a.tolist(), room_b.tolist())
        taken = np.zeros(m.shape, int)
        taken[at[:, 0], at[:, 1]] = times
        assert (taken.sum(axis=1) <= room_a).all() and (taken.sum(axis=0) <= room_b).all()
        assert abs((taken * m).sum() - brute(np.repeat(np.repeat(m, room_a, axis=0), room_b, axis=1))) < 1e-9


def test_a_large_knot_of_rivals_needs_memory_for_its_pairs_only():
    import random
    import tracemalloc

    rng, n = random.Random(1), 5000
    pairs = sorted({(r, rng.randrange(n)) for r in range(n) for _ in range(4)})
    tracemalloc.start()
    times = solve([r for r, _ in pairs], [c for _, c in pairs], [rng.random() for _ in pairs], [1] * n, [1] * n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(times) > 0.9 * n and peak < 20_000_000  # a dense matrix of numbers would take 400 MB


def test_spread_deals_equal_rows_in_order(spark):
    found = spark.createDataFrame([(1, 10, 5, 2), (1, 10, 7, 1), (1, 20, 7, 1)], "g int, a int, b int, times int")
    members = [("A", 10, 10), ("A", 10, 12), ("A", 10, 13), ("A", 20, 20), ("B", 5, 5), ("B", 5, 6), ("B", 7, 7), ("B", 7, 9)]
    got = spread(found, spark.createDataFrame([(1, *m) for m in members], "g int, side string, rep int, n int"), ["g"], "a", "b")
    assert sorted((r.a, r.b) for r in got.collect()) == [(10, 5), (12, 6), (13, 7), (20, 9)]


def test_greedy_equals_a_scan_of_sorted_scores(spark):
    import random

    rng, rows = random.Random(8), []
    for g in range(40):
        rows += [(g, a, b, rng.randint(1, 6) / 10) for a in range(6) for b in range(6) if rng.random() < 0.6]
    rows += [(99, k, k + d, 0.3 + (2 * k + d) / 1000) for k in range(12) for d in (0, 1)]  # each round settles one end of this chain
    want, used = set(), set()
    for g, a, b, s in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if s >= 0.3 and not {(g, "a", a), (g, "b", b)} & used:
            used |= {(g, "a", a), (g, "b", b)}
            want.add((g, a, b))
    got = assign(spark.createDataFrame(rows, "g int, a int, b int, s double"), ["g"], "a", "b", "s", 0.3, mode="greedy")
    assert {(r.g, r.a, r.b) for r in got.collect()} == want


def test_assignment_prefers_margin(spark):
    rows = [(1, 0, 0, 0.81), (1, 0, 1, 0.80), (1, 1, 0, 0.79), (1, 1, 1, 0.10), (2, 0, 0, 0.53), (2, 1, 0, 0.82), (2, 1, 1, 0.504), (3, 0, 0, 0.3), (4, 0, 0, 0.9)]
    got = {(r.g, r.a, r.b) for r in assign(spark.createDataFrame(rows, "g int, a int, b int, s double"), ["g"], "a", "b", "s", 0.5).collect()}
    assert got == {(1, 0, 1), (1, 1, 0), (2, 1, 0), (4, 0, 0)}
