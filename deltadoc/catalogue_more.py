"""More registered queries: labels and texts for display, edits of every kind, listings and evaluation by values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deltadoc.catalogue import EDITS, ORACLE_SQL, changes_of, compared, money, query, say, table
from deltadoc.functions import display, scoring
from deltadoc.functions import text as T
from deltadoc.operators import segment
from deltadoc.plans import chain, compare, evaluate, review, search, semantic
from deltadoc.operators.cut import shared_folder
from deltadoc.sources import layout, snapshots, store

#: The longest common subsequence of neighbouring names, a row of the table of lengths at each step.
ORACLE_SQL["text_ratios"] = r"""
WITH RECURSIVE p AS (SELECT * FROM (SELECT p_partkey, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL),
w AS (SELECT DISTINCT a, b, list_sort(list_filter(regexp_split_to_array(lower(a), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS wa, list_sort(list_filter(regexp_split_to_array(lower(b), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS wb FROM p),
s AS (SELECT *, list_sort(list_distinct(list_intersect(wa, wb))) AS shared, list_sort(list_filter(list_distinct(wa), lambda x: NOT list_contains(wb, x))) AS oa, list_sort(list_filter(list_distinct(wb), lambda x: NOT list_contains(wa, x))) AS ob FROM w),
t AS (SELECT a, b, array_to_string(wa, ' ') AS sa, array_to_string(wb, ' ') AS sb, array_to_string(shared, ' ') AS base, array_to_string(list_concat(shared, oa), ' ') AS l, array_to_string(list_concat(shared, ob), ' ') AS r,
 CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM s),
v AS (SELECT a, b, long[i + 1:i + length(short)] AS part FROM t, LATERAL (SELECT unnest(list_append(range(0, length(long) - length(short) + 1, greatest(1, length(short) // 2)), length(long) - length(short))) AS i)),
q AS (SELECT a AS x, b AS y FROM t UNION SELECT sa, sb FROM t UNION SELECT l, r FROM t UNION SELECT t.short, v.part FROM t JOIN v USING (a, b)),
d AS (SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0) AS row FROM q
 UNION ALL SELECT x, y, i + 1, list_prepend(0, list_transform(range(1, length(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda h: greatest(row[h + 1], row[h] + CAST(x[i + 1] = y[h] AS INT)))))) FROM d WHERE i < length(x)),
e AS (SELECT x, y, CASE WHEN x = y THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE 2.0 * row[length(y) + 1] / (length(x) + length(y)) END AS ratio FROM d WHERE i = length(x)),
f AS (SELECT a, b, max(ratio) AS partial FROM (SELECT a, b, short, part FROM t JOIN v USING (a, b)) JOIN e ON x = short AND y = part GROUP BY a, b)
SELECT p_partkey, round(CAST(e1.ratio AS DOUBLE), 6) AS ratio, round(CAST(e2.ratio AS DOUBLE), 6) AS sorted,
 round(CAST(greatest(e3.ratio, CASE WHEN base = l OR base = r THEN 1.0 WHEN base = '' THEN 0.0 ELSE greatest(2.0 * length(base) / (length(base) + length(l)), 2.0 * length(base) / (length(base) + length(r))) END) AS DOUBLE), 6) AS as_sets, round(CAST(partial AS DOUBLE), 6) AS partial
FROM p JOIN t USING (a, b) JOIN f USING (a, b) JOIN e e1 ON e1.x = a AND e1.y = b JOIN e e2 ON e2.x = sa AND e2.y = sb JOIN e e3 ON e3.x = l AND e3.y = r"""


@query(r"""SELECT p_partkey, CASE WHEN length(long) <= 60 THEN long ELSE rtrim(substr(long, 1, 59)) || '…' END AS short,
 CASE WHEN p_size % 4 <> 0 AND p_size % 3 <> 0 THEN 'Wording changed: "' || p_name || '" → "' || p_brand || '".' WHEN p_size % 3 <> 0 THEN 'Text added: "' || p_brand || '".' WHEN p_size % 4 <> 0 THEN 'Text removed: "' || p_name || '".' ELSE 'Text modified.' END AS rewritten,
 array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '-Of O''Neil_x' AS titled,
 CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Terms > ' || p_name ELSE '… > 2 Terms > ' || p_name END AS path, p_size || CASE WHEN p_size = 1 THEN ' block' ELSE ' blocks' END AS counted,
 CASE p_size % 4 WHEN 0 THEN '$' || body WHEN 1 THEN '£' || body WHEN 2 THEN body || ' CHF' ELSE body END AS amount, replace(p_name, ' ', '-') || '-v1--' || replace(p_brand, '#', '-') AS stem,
 '&lt;' || p_name || ' &amp; &quot;it&#39;s&quot;&gt;' AS escaped, p_name AS unmarked, replace(p_name, ' ', '|') || '|5%/a-b|€3.50|x' AS tokens, 'Full fi ' || p_name || '''s "x"-2 1⁄2' AS folded
 FROM (SELECT *, trim(regexp_replace(repeat(p_name || '  ', p_size), '\s+', ' ', 'g')) AS long, format('{:,}', CAST(floor(p_size * 1234.5) AS BIGINT)) || CASE WHEN p_size % 2 = 1 THEN '.5' ELSE '' END AS body FROM part)""")
def text_labels(spark, sf_dir):
    """Parts' names and sizes through the functions that shorten, fold, escape and label texts."""
    name, size = F.col("p_name"), F.col("p_size")
    pick = lambda *w: F.element_at(F.array(*map(F.lit, w)), (size % len(w) + 1).cast("int"))
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", T.shorten(F.expr("repeat(concat(p_name, '  '), p_size)"), 60).alias("short"),
        T.rewrite_summary(F.when(size % 4 == 0, "").otherwise(name), F.when(size % 3 == 0, "").otherwise(F.col("p_brand"))).alias("rewritten"),
        T.title_case(say(name, "-of o'neil_x")).alias("titled"), T.short_section(F.concat(pick("", "Terms > ", "1 Scope > 2 Terms > "), name)).alias("path"),
        T.plural(size, "block").alias("counted"), T.amount(size * 1234.5, pick("USD", "GBP", "CHF", None)).alias("amount"), T.safe_stem(say(name, "/v1:  ", F.col("p_brand"))).alias("stem"),
        T.html_escape(say("<", name, " & \"it's\">")).alias("escaped"), T.strip_list_marker(F.concat(pick("3.2. ", "b) ", "iv. ", ""), name)).alias("unmarked"),
        F.array_join(T.tokens(say(name, " 5%/a-b, €3.50 (x)")), "|").alias("tokens"), T.fold(say("Ｆｕｌｌ ﬁ ", name, "’s “x”—² ½")).alias("folded"),
    )


@query(r"""SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(floor(n / 1024 + 0.5) AS BIGINT) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', floor(n / 1048576 * 10 + 0.5) / 10) || ' MB' ELSE printf('%.2f', floor(n / 1073741824 * 100 + 0.5) / 100) || ' GB' END AS bytes,
 CASE WHEN p_size % 5 = 0 THEN 'not a day' ELSE strftime(DATE '2024-01-01' + p_size, '%b %-d, %Y') END AS dated, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN '$' || p_size || '.5' WHEN 2 THEN p_size || '.5%' ELSE p_size || '.5 days' END AS value,
 CAST(p_size * 1.5 AS DOUBLE) AS left, CAST(greatest(2, p_size * 0.15) AS DOUBLE) AS width, ['contains', 'mini', 'any'][p_size % 3 + 1] = 'any' OR (p_size % 3 = 0 AND contains(p_name, 'e')) AS sees,
 CASE WHEN p_size >= 40 THEN 'High confidence' WHEN p_size >= 28 THEN 'Medium confidence' ELSE 'Low confidence' END AS trust, CAST(CASE WHEN p_size % 7 = 0 THEN 0.6 ELSE least(1, greatest(0, p_size / 25 - 0.5)) END AS DOUBLE) AS clamped, p_partkey AS answer, substr(p_name, 1, 4) || ' […]' AS clipped FROM (SELECT *, p_partkey * p_partkey * 700 AS n FROM part)""")
def display_labels(spark, sf_dir):
    """Sizes, days, values, boxes, models and scores of parts as a reader sees them; numbers of a model's replies."""
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    part = table(spark, sf_dir, "part")
    value = F.struct(F.when(size % 4 == 0, name).alias("source_text"), (size + 0.5).alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.when(size % 4 == 1, "USD").alias("currency"), F.element_at(F.array(*map(F.lit, ("text", "USD", "percent", "days"))), (size % 4 + 1).cast("int")).alias("unit"))
    box = display.scaled_box(F.lit(1.0) * size, F.lit(2.0), size * 1.1, F.lit(9.0), F.lit(1.5))
    reply = say(F.element_at(F.array(*map(F.lit, ("", "It is:\n```json\n", "So "))), (size % 3 + 1).cast("int")), '{"n": ', key, "}", F.element_at(F.array(*map(F.lit, ("", "\n```", " it is."))), (size % 3 + 1).cast("int")))
    model = F.when(size % 3 == 0, F.when(F.contains(name, F.lit("e")), say("m-4o-", name)).otherwise("m-3")).otherwise("mini")
    provider = F.when(size % 3 == 0, "openai").when(size % 3 == 1, "anthropic").otherwise("own")
    return part.select(
        "p_partkey", display.bytes_label(key * key * 700).alias("bytes"), display.date_label(F.when(size % 5 == 0, "not a day").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), size).cast("string"))).alias("dated"),
        display.value_text(value).alias("value"), box["left"].alias("left"), F.round(box["width"], 6).alias("width"), display.sees_images(provider, model).alias("sees"),
        scoring.confidence_label(size / 50.0).alias("trust"), semantic.unit_interval(F.when(size % 7 != 0, size / 25.0 - 0.5)).alias("clamped"), semantic.loose_json(reply, "n long")["n"].alias("answer"), semantic.clipped(name, 4).alias("clipped"),
    )


@query("""SELECT o_custkey AS org, o_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS at_no FROM orders QUALIFY at_no <= 3""")
def newest_documents(spark, sf_dir):
    """The last three orders of each customer, as documents of an organisation."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("org"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("created_at"))
    return review.newest(docs, ["org"], limit=3).select("org", "doc_id", "at_no")


@query("""SELECT c_nationkey AS chain_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS INT) AS version, c_custkey AS doc_id,
 CASE WHEN c_custkey % 4 = 0 THEN 'Version ' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) ELSE c_name END AS filename FROM customer WHERE c_custkey % 5 <> 0""")
def chain_loading(spark, sf_dir):
    """Chains of a nation's customers by descending number; some are gone, some have no name."""
    k = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    chains = customer.groupBy(F.col("c_nationkey").alias("chain_id")).agg(F.sort_array(F.collect_list("c_custkey"), False).alias("ids"))
    docs = customer.where(k % 5 != 0).select(k.alias("doc_id"), F.when(k % 4 != 0, F.col("c_name")).alias("filename"))
    return chain.loaded(chains, docs).select("chain_id", "version", "doc_id", "filename")


@query("""SELECT cmp_id, value, n, CAST(row_number() OVER (PARTITION BY cmp_id ORDER BY n DESC, value) AS INT) AS at_no FROM (SELECT user_id % 50 AS cmp_id, event_type AS value, count(*) AS n FROM events GROUP BY ALL)""")
def facet_ordering(spark, sf_dir):
    """Kinds of events of groups of users as values of a facet, the most frequent first."""
    counts = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("cmp_id"), F.lit("type").alias("facet"), F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    return review.facet_order(counts, ["cmp_id"]).select("cmp_id", "value", "n", "at_no")


@query("""SELECT l_orderkey AS cmp_id, l_linenumber AS change_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3""")
def org_scope(spark, sf_dir):
    """Order lines as changes; those of one nation's orders."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cmp_id"), F.col("l_linenumber").alias("change_id"))
    return review.of_org(changes, orders.select(F.col("o_orderkey").alias("cmp_id"), F.col("c_nationkey").alias("org_id")), 3)


@query("""SELECT CASE WHEN n_nationkey < 10 THEN 'n' || n_nationkey ELSE sha256(n_name) END AS org_id, n_name AS name FROM nation WHERE n_nationkey < 10 OR n_nationkey IN (SELECT c_nationkey FROM customer)""")
def org_creation(spark, sf_dir):
    """Ten nations are organisations already; those of customers that aren't get a row."""
    nation = table(spark, sf_dir, "nation")
    orgs = nation.where("n_nationkey < 10").select(say("n", F.col("n_nationkey")).alias("org_id"), F.col("n_name").alias("name"))
    wanted = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("name"))
    return store.with_missing(orgs, wanted)


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS calls, CAST(sum(event_id % 90) AS BIGINT) AS tokens_in, CAST(sum(event_id % 7) AS BIGINT) AS tokens_out, arg_max(event_id, (ts, lpad(CAST(event_id AS VARCHAR), 12, '0'))) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id""")
def usage_counters(spark, sf_dir):
    """Events as a model's answers for each user, of which some are errors."""
    at = F.struct("ts", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    rows = table(spark, sf_dir, "events").select("user_id", at.alias("at"), (F.col("event_id") % 90).alias("tokens_in"), (F.col("event_id") % 7).alias("tokens_out"), F.when(F.col("event_type") == "error", F.col("event_id").cast("string")).alias("error"))
    return store.calls(rows, ["user_id"]).select("user_id", "calls", "tokens_in", "tokens_out", F.col("last_error").cast("long").alias("failed"))


@query(f"""SELECT CAST(count(*) FILTER (price) AS BIGINT) + CAST(count(*) FILTER (pay) AS BIGINT) AS checked, CAST(count(*) FILTER (price AND k % 5 <> 0) AS BIGINT) + CAST(count(*) FILTER (pay AND k % 2 = 0) AS BIGINT) AS right,
 round((count(*) FILTER (price AND k % 5 <> 0) + count(*) FILTER (pay AND k % 2 = 0)) / (count(*) FILTER (price) + count(*) FILTER (pay)), 6) AS value_accuracy FROM {EDITS}""")
def value_accuracy(spark, sf_dir):
    """Labels that state values and differences of prices and days, some of them wrong."""
    k, old = F.col("c_custkey"), F.abs("c_acctbal") + 1000
    new = old + 500 * (k % 4)
    base, none = table(spark, sf_dir, "customer"), F.lit(None).cast("double")
    label = lambda i, match, expect: [k.alias("cmp_id"), F.lit(i).alias("label_id"), match.alias("match"), expect.alias("expect")]
    sum_ = lambda x: say("$", T.amount(x, F.lit(None).cast("string")))
    prices = F.struct(F.round(old, 2).alias("old"), (F.round(new, 2) + F.when(k % 5 == 0, 1.0).otherwise(0.0)).alias("new"), none.alias("days"))
    days = F.struct(none.alias("old"), none.alias("new"), F.when(k % 2 == 0, 15.0).otherwise(14.0).alias("days"))
    price = base.where(k % 4 != 0).select(*label("price", F.array(sum_(old), sum_(new)), prices))
    pay = base.where(k % 3 == 0).select(*label("pay", F.array(F.lit("payment period"), say(30 + k % 4 * 15, " days")), days))
    rows = evaluate.value_accuracy(price.unionByName(pay).withColumns({"severity": F.lit("HIGH"), "category": F.lit("PRICING")}), changes_of(spark, sf_dir))
    return rows.select("checked", "right", F.round("value_accuracy", 6).alias("value_accuracy"))


@query(f"""SELECT k AS cmp_id, 's' || n AS section_id, ['SERVICE AGREEMENT This agreement is made with ' || c_name || '.', '1. PRICING The total contract price is $' || format('{{:,.2f}}', bal) || '.', '2. PAYMENT TERMS Each invoice is payable wit'][n] AS excerpt
 FROM {EDITS} JOIN customer ON c_custkey = k, (SELECT unnest(range(1, 4)) AS n)""")
def section_excerpts(spark, sf_dir):
    """The start of the first sections of each contract's first version."""
    blocks = compared(spark, sf_dir).blocks.where("side = 'A' and section_id in ('s1', 's2', 's3')")
    limit = F.when(F.col("section_id") == "s3", F.substring("excerpt", 1, 44)).otherwise(F.col("excerpt"))
    return segment.excerpts(blocks, ["cmp_id", "section_id"]).select("cmp_id", "section_id", limit.alias("excerpt"))


_FIVE = f"""(SELECT k, 1 AS n, 'MODIFIED' AS type, ['PRICING'] AS categories, CASE WHEN 500 * (k % 4) / bal * 100 >= 10 THEN 5 ELSE 4 END AS score, 'amount_increased' AS direction, '1 PRICING' AS a, '1 PRICING' AS b, 'p1-b3' AS block, 28 AS pos,
  '$' || format('{{:,.2f}}', bal) AS ta, '$' || format('{{:,.2f}}', bal + 500 * (k % 4)) AS tb FROM {EDITS} WHERE price
 UNION ALL SELECT k, 2, 'MODIFIED', ['PAYMENT_TERMS'], 6, 'duration_longer', '2 PAYMENT TERMS', '2 PAYMENT TERMS', 'p1-b5', 31, (15 + k % 4 * 15) || ' days', (30 + k % 4 * 15) || ' days' FROM {EDITS} WHERE pay
 UNION ALL SELECT k, 3, 'MODIFIED', ['OBLIGATIONS'], 4, 'obligation_weakened', '4 REPORTING', '4 REPORTING', 'p1-b9', 0, 'The Supplier shall provide weekly dashboards.', 'The Supplier may provide weekly dashboards.' FROM {EDITS} WHERE duty
 UNION ALL SELECT k, 4, 'MODIFIED', ['PRICING', 'RENEWAL'], 4, 'percent_increased', '5 DISCOUNT', '5 DISCOUNT', 'p1-b11', 14, (2 + k % 6) || '%', (6 + k % 6) || '%' FROM {EDITS} WHERE share
 UNION ALL SELECT k, 5, 'SECTION_ADDED', ['SCOPE'], 5, 'section_added', NULL, '6 INSURANCE', 'p1-b12', 0, NULL, '6. INSURANCE' FROM {EDITS} WHERE more)"""


@query(f"""SELECT k AS cmp_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, n) AS INT) AS ordinal, printf('chg_%05d', row_number() OVER (PARTITION BY k ORDER BY n)) AS change_id, type, array_to_string(categories, ',') AS categories,
 CAST(score AS DOUBLE) AS score, 'High confidence' AS trust, direction, a AS section_a, b AS section_b, CASE WHEN ta IS NULL THEN NULL ELSE 'A ' || block || ' ' || pos || '-' || (pos + length(ta)) || ' ' || ta END AS cited_a,
 'B ' || block || ' ' || pos || '-' || (pos + length(tb)) || ' ' || tb AS cited_b FROM {_FIVE}""")
def change_records(spark, sf_dir):
    """Ids, order, scores and citations of every change of the contracts."""
    cited = lambda c: F.when(F.col(c).isNotNull(), say(F.col(f"{c}.document_version"), " ", F.col(f"{c}.block_id"), " ", F.col(f"{c}.char_start"), "-", F.col(f"{c}.char_end"), " ", F.col(f"{c}.text")))
    return changes_of(spark, sf_dir).select(
        "cmp_id", "ordinal", "change_id", "type", F.array_join("categories", ",").alias("categories"), F.col("importance_score").alias("score"), F.col("confidence_label").alias("trust"),
        "direction", "section_a", "section_b", cited("citation_a").alias("cited_a"), cited("citation_b").alias("cited_b"),
    )


@query(f"""SELECT category AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(categories) AS category FROM {_FIVE}) GROUP BY category""")
def category_facets(spark, sf_dir):
    rows = review.facets(changes_of(spark, sf_dir).withColumn("review_status", F.lit("unreviewed"))).where("facet = 'category'")
    return rows.groupBy("value").agg(F.sum("n").alias("n"))


def amendments(spark, sf_dir):
    """Two versions of an agreement for each customer, with edits that the contracts don't have."""
    k, fee = F.col("c_custkey"), 2000 + F.col("c_custkey") * 10
    day = lambda n: F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), n.cast("int")), "d MMMM yyyy")

    def version(start, price, notice, heading, modal, end, audit):
        return say(
            "LEASE AGREEMENT\n\nThis lease is made with ", F.col("c_name"), ".\n\n1. COMMENCEMENT\n\nThe lease is effective from ", start, ".\n\n2. FEES\n\nThe annual fee is $", F.call_function("format_number", price, F.lit("#,##0")),
            ".\n\n3. TERMINATION\n\nEither party may cancel with ", notice, " days notice.\n\n4. ", heading, "\n\nLetters go to the registered office of each party.\n\n5. REPAIRS\n\nThe Contractor ", modal, " inspect the roof every year", end, audit,
        )

    audit = "\n\n6. AUDIT\n\nBooks stay open to inspection by accountants."
    a = version(day(k % 20), fee, F.lit(90), F.lit("CORRESPONDENCE"), F.lit("may"), F.lit("."), F.lit(audit))
    b = version(
        day(k % 20 + F.when(k % 2 == 0, 10).otherwise(0)), fee - F.when(k % 3 == 0, 500).otherwise(0), F.when(k % 5 == 0, 60).otherwise(90), F.when(k % 7 == 0, "NOTICES").otherwise("CORRESPONDENCE"),
        F.when(k % 4 == 1, "must").otherwise("may"), F.when(k % 4 == 3, " .").otherwise("."), F.when(k % 6 == 1, "").otherwise(audit),
    )
    return table(spark, sf_dir, "customer").select(k.alias("cmp_id"), a.alias("text_a"), b.alias("text_b"))


_SIX = """(SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS id FROM (
 SELECT k, 1 AS n, 'MODIFIED' AS type, 'DATES' AS category, 'MEDIUM' AS importance, 3 AS score, 'date_later' AS direction, '1 COMMENCEMENT' AS a, '1 COMMENCEMENT' AS b, 'p1-b3' AS block, 28 AS pos, strftime(d, '%-d %B %Y') AS ta, strftime(d + 10, '%-d %B %Y') AS tb,
  NULL AS absolute, NULL AS percentage, 10 AS days, NULL AS strength, 'Start date changed from ' || strftime(d, '%-d %B %Y') || ' to ' || strftime(d + 10, '%-d %B %Y') || ' — moved 10 days later.' AS summary FROM c WHERE k % 2 = 0
 UNION ALL SELECT k, 2, 'MODIFIED', 'PRICING', 'HIGH', CASE WHEN abs(share) >= 10 THEN 5 ELSE 4 END, 'amount_decreased', '2 FEES', '2 FEES', 'p1-b5', 18, '$' || format('{:,}', fee), '$' || format('{:,}', fee - 500), -500, share, NULL, NULL, NULL FROM c WHERE k % 3 = 0
 UNION ALL SELECT k, 3, 'MODIFIED', 'TERMINATION', 'HIGH', 6, 'duration_shorter', '3 TERMINATION', '3 TERMINATION', 'p1-b7', 29, '90 days', '60 days', NULL, -33.33, -30, NULL, 'Notice period changed from 90 days to 60 days — 30 days shorter.' FROM c WHERE k % 5 = 0
 UNION ALL SELECT k, 4, 'MODIFIED', 'OBLIGATIONS', 'HIGH', 4, 'obligation_strengthened', '5 REPAIRS', '5 REPAIRS', 'p1-b11', 0, 'The Contractor may inspect the roof every year.', 'The Contractor must inspect the roof every year.', NULL, NULL, NULL, 5,
  'Contractor: Requirement language changed from "may" (permissive) to "must" (mandatory).' FROM c WHERE k % 4 = 1
 UNION ALL SELECT k, 4, 'MODIFIED', 'FORMATTING', 'LOW', 0, 'formatting', '5 REPAIRS', '5 REPAIRS', 'p1-b11', 0, 'The Contractor may inspect the roof every year.', 'The Contractor may inspect the roof every year .', NULL, NULL, NULL, NULL, 'Formatting or punctuation only — no wording change detected.' FROM c WHERE k % 4 = 3
 UNION ALL SELECT k, 5, 'SECTION_RENAMED', 'FORMATTING', 'LOW', 0, 'section_renamed', '4 CORRESPONDENCE', '4 NOTICES', 'p1-b8', 0, '4. CORRESPONDENCE', '4. NOTICES', NULL, NULL, NULL, NULL, 'Section renamed: "4 CORRESPONDENCE" → "4 NOTICES".' FROM c WHERE k % 7 = 0
 UNION ALL SELECT k, 6, 'SECTION_REMOVED', 'SCOPE', 'HIGH', 5, 'section_removed', '6 AUDIT', NULL, 'p1-b12', 0, '6. AUDIT', NULL, NULL, NULL, NULL, NULL, 'Section removed: 6 AUDIT (2 blocks, page 1).' FROM c WHERE k % 6 = 1))"""


@query(f"""WITH c AS (SELECT k, fee, d, floor(-500 / fee * 100 * 100 + 0.5) / 100 AS share FROM (SELECT c_custkey AS k, 2000 + c_custkey * 10 AS fee, DATE '2024-03-01' + CAST(c_custkey % 20 AS INT) AS d FROM customer))
 SELECT k AS cmp_id, CAST(row_number() OVER (PARTITION BY k ORDER BY CASE importance WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, score DESC, id) AS INT) AS ordinal, printf('chg_%05d', id) AS change_id, type, category, importance, CAST(score AS DOUBLE) AS score, direction, a AS section_a, b AS section_b,
 CASE WHEN ta IS NULL THEN NULL ELSE 'A ' || block || ' ' || pos || '-' || (pos + length(ta)) || ' ' || ta END AS cited_a, CASE WHEN tb IS NULL THEN NULL ELSE 'B ' || block || ' ' || pos || '-' || (pos + length(tb)) || ' ' || tb END AS cited_b,
 CAST(absolute AS DOUBLE) AS absolute, CAST(percentage AS DOUBLE) AS percentage, CAST(days AS DOUBLE) AS days, CAST(strength AS DOUBLE) AS strength,
 coalesce(summary, 'Amount decreased from ' || ta || ' to ' || tb || ' — -$500 (' || regexp_replace(printf('%.2f', percentage), '\\.?0+$', '') || '%).') AS summary FROM {_SIX}""")
def amended_records(spark, sf_dir):
    """Every field of the changes of the amended agreements: dates, decreases, renamed and removed sections, punctuation."""
    made = compare.compare_texts(amendments(spark, sf_dir), unicode=True).changes
    cited = lambda c: F.when(F.col(c).isNotNull(), say(F.col(f"{c}.document_version"), " ", F.col(f"{c}.block_id"), " ", F.col(f"{c}.char_start"), "-", F.col(f"{c}.char_end"), " ", F.col(f"{c}.text")))
    return made.select(
        "cmp_id", "ordinal", "change_id", "type", "category", "importance", F.col("importance_score").alias("score"), "direction", "section_a", "section_b", cited("citation_a").alias("cited_a"), cited("citation_b").alias("cited_b"),
        "delta.absolute", "delta.percentage", "delta.days", F.col("delta.strength_change").alias("strength"), "summary",
    )


@query("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i, 'P' || l_partkey AS part, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS price FROM lineitem),
 b AS (SELECT DISTINCT k, unnest([{'o': 0, 't': 'heading', 'x': 'ORDER ' || k, 'r': NULL}, {'o': 1, 't': 'paragraph', 'x': 'the goods are listed below and belong to the order.', 'r': NULL}, {'o': 2, 't': 'table', 'x': 'Part | Unit price | Note', 'r': NULL}, {'o': 1000, 't': 'paragraph', 'x': 'all prices are final.', 'r': NULL}]) AS b FROM l
  UNION ALL SELECT k, {'o': 2 + i, 't': 'table_row', 'x': part || ' | USD ' || price || ' | ' || CASE WHEN i % 2 = 1 THEN 'odd' ELSE '' END, 'r': lower(part)} FROM l)
 SELECT CAST(k AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY b.o) - 1 AS INT) AS block_index, b.t AS block_type, trim(b.x) AS text, b.r AS row_key FROM b""")
def table_pages(spark, sf_dir):
    """A page for each order with its lines in a table between two paragraphs, as words with positions."""
    line = table(spark, sf_dir, "lineitem")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    line = line.select(F.col("l_orderkey").cast("long").alias("doc_id"), "l_linenumber", "l_partkey", "l_extendedprice")
    line = line.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # before lines become words
    line = line.select("doc_id", turn.alias("i"), say("P", F.col("l_partkey")).alias("part"), F.floor("l_extendedprice").cast("string").alias("price"))
    word = lambda x, y, text: F.struct(F.lit(x).cast("double").alias("x0"), F.lit(y).cast("double").alias("top"), (text if not isinstance(text, str) else F.lit(text)).alias("text"))
    y = 90 + F.col("i") * 20
    rows = line.select("doc_id", F.explode(F.array_compact(F.array(word(60, y, F.col("part")), word(200, y, "USD"), word(224, y, F.col("price")), F.when(F.col("i") % 2 == 1, word(330, y, "odd"))))).alias("w"))
    orders = line.groupBy("doc_id").agg(F.max("i").alias("n"))
    end = 90 + F.col("n") * 20
    spread = lambda x, y, words: [word(x + 30 * k, y, w) for k, w in enumerate(words.split())]
    fixed_words = [word(50, 10, "ORDER"), word(90, 10, F.col("doc_id").cast("string")), *spread(50, 30, "the goods are listed below"), *spread(50, 50, "and belong to the order."), word(60, 90, "Part"), word(200, 90, "Unit"), word(223, 90, "price"), word(330, 90, "Note"), *spread(50, end + 40, "all prices are final.")]
    rows = rows.unionByName(orders.select("doc_id", F.explode(F.array(*fixed_words)).alias("w")))
    words = rows.select("doc_id", F.lit(1).alias("page"), "w.*").withColumn("x1", F.col("x0") + 20).withColumn("bottom", F.col("top") + 12)
    boxes = orders.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("table"), F.lit(55.0).alias("x0"), F.lit(85.0).alias("top"), F.lit(360.0).alias("x1"), (end + 15).cast("double").alias("bottom"))
    blocks = layout.page_blocks(words, boxes)
    return blocks.select("doc_id", F.col("block_index").cast("int").alias("block_index"), "block_type", F.trim("text").alias("text"), "row_key")


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
 t AS (SELECT unnest(['the th', 'Ent', 'ó', 'zq', '%%', 'is']) AS term) SELECT term, doc_id, CAST(line AS BIGINT) AS line FROM t JOIN l ON contains(lower(text), lower(term))""")
def text_search(spark, sf_dir):
    """Every line of every document in which one of six terms occurs, through the index of trigrams."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    path = shared_folder(spark)
    search.write_index(docs.withColumn("hay", F.lower("text")), path)
    found = search.places_of(spark, path, ["the th", "Ent", "ó", "zq", "%%", "is"])
    return found.select("term", "doc_id", F.col("line").cast("long").alias("line"))


@query("""WITH e AS (SELECT user_id AS cmp_id, event_type AS status, ts, event_id, user_id % 3 = 0 AS gone FROM events),
 r AS (SELECT cmp_id, count(*) AS notes, arg_max(status, (ts, event_id)) AS last FROM e GROUP BY cmp_id)
 SELECT CAST(cmp_id AS BIGINT) AS cmp_id, last AS status, CAST(notes AS BIGINT) AS notes FROM r WHERE cmp_id % 3 <> 0""")
def committed_reviews(spark, sf_dir):
    """Reviews of all users' events in two commits, by half of the time, and a third one that deletes every third comparison."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("cmp_id"), F.lit("c").alias("change_id"), F.col("event_type").alias("status"), "ts", "event_id")
    middle = events.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    store = snapshots.Store(spark, shared_folder(spark))
    for part in (events.where(F.col("ts") < F.lit(middle)), events.where((F.col("ts") >= F.lit(middle)))):
        last = part.groupBy("cmp_id", "change_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
        snapshots.review(store, last, part.select("cmp_id", "change_id", F.col("event_id").cast("string").alias("body")), part.select("cmp_id", F.lit("reviewed").alias("action")))
    gone = events.where("cmp_id % 3 = 0").select("cmp_id").distinct()
    now = snapshots.delete_comparisons(store, gone, gone.withColumn("action", F.lit("deleted")))
    notes = now.read("notes").groupBy("cmp_id").agg(F.count("*").alias("notes"))
    return now.read("reviews").join(notes, "cmp_id").select("cmp_id", "status", "notes")


@query(r"""SELECT doc_id, substr(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' '), 1, 500) AS excerpt FROM documents WHERE text IS NOT NULL AND text <> ''""")
def document_excerpts(spark, sf_dir):
    """The first 500 characters of every document's lines, most of which have more."""
    docs = table(spark, sf_dir, "documents").where("text is not null and text != ''")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_index", "text")).where("text != ''")
    return segment.excerpts(lines, ["doc_id"])
