"""Registered queries of the alignment: weights, scored pairs, assignment in both modes, decisions on sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltadoc import fixed
from deltadoc.catalogue import EDITS, compared, money, query, say, table
from deltadoc.functions import similarity as S
from deltadoc.functions import text as T
from deltadoc.operators import align
from deltadoc.operators.assign import assign
from deltadoc.plans import evaluate
from deltadoc.plans.compare import compare_texts

#: The first ending of a word that has two letters or more before it is cut off.
_STEM = "CASE " + " ".join(f"WHEN length(w) > {len(x) + 2} AND ends_with(w, '{x}') THEN left(w, length(w) - {len(x)})" for x in fixed.SUFFIXES) + " ELSE w END"
_STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)


@query(rf"""WITH d AS (SELECT lang, list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z-]+'), lambda w: trim(w, '-')), lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w)), lambda w: {_STEM})) AS terms FROM documents WHERE text IS NOT NULL),
 n AS (SELECT lang, count(*) AS total FROM d WHERE len(terms) > 0 GROUP BY lang), f AS (SELECT lang, unnest(terms) AS term FROM d)
 SELECT lang, term, round(CAST(ln((any_value(total) + 1) / (count(*) + 1)) + 0.1 AS DOUBLE), 6) AS weight FROM f JOIN n USING (lang) GROUP BY lang, term""")
def term_weights(spark, sf_dir):
    """Weights of all content terms of the documents, a language being one comparison."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("lang", T.normalize_text(F.col("text")).alias("normalized"))
    return align.term_weights(docs, "lang").select("lang", "term", F.round("weight", 6).alias("weight"))


def _scored(spark, sf_dir):
    """Pairs of neighbouring lines of each order, scored by their parts and suppliers."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("int").alias("n"), "l_partkey", "l_suppkey").groupBy("g", "n").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    a, b = line.select("g", F.col("n").alias("a"), "p"), line.select("g", F.col("n").alias("b"), "s")
    near = a.withColumn("b", F.explode(F.array(F.col("a") - 1, F.col("a"), F.col("a") + 1)))
    return near.join(b, ["g", "b"]).select("g", "a", "b", ((F.col("p") * 7 + F.col("s") * 13) % 20 / 20).alias("score"))


_SCORED = """l AS (SELECT l_orderkey AS g, CAST(l_linenumber AS INT) AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
 e AS (SELECT x.g, x.n AS a, y.n AS b, (x.p * 7 + y.s * 13) % 20 AS m FROM l x JOIN l y ON y.g = x.g AND y.n BETWEEN x.n - 1 AND x.n + 1 WHERE (x.p * 7 + y.s * 13) % 20 >= 6)"""


@query(f"""WITH RECURSIVE {_SCORED}, i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m DESC, a, b) AS i FROM e),
 r AS (SELECT g, 0::BIGINT AS i, []::INT[] AS ua, []::INT[] AS ub FROM (SELECT DISTINCT g FROM e)
  UNION ALL SELECT r.g, i.i, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END FROM r JOIN i ON i.g = r.g AND i.i = r.i + 1),
 z AS (SELECT g, arg_max(ua, i) AS ua, arg_max(ub, i) AS ub FROM r GROUP BY g)
 SELECT g AS l_orderkey, unnest(ua) AS a, unnest(ub) AS b FROM z""")
def greedy_matching(spark, sf_dir):
    """Lines of each order matched by the best score first."""
    return assign(_scored(spark, sf_dir), ["g"], "a", "b", "score", 0.3, mode="greedy").select(F.col("g").alias("l_orderkey"), "a", "b")


@query(f"""WITH RECURSIVE {_SCORED}, k AS (SELECT g, max(n) AS last FROM l GROUP BY g),
 r AS (SELECT g, -1 AS n, []::INT[] AS used, 0::BIGINT AS total FROM k
  UNION ALL SELECT r.g, r.n + 1, CASE WHEN c.b IS NULL THEN r.used ELSE list_append(list_filter(r.used, lambda u: u >= r.n), c.b) END, r.total + coalesce(c.m, 0)
   FROM r JOIN k ON k.g = r.g AND r.n < k.last JOIN (SELECT g, a, b, m - 6 AS m FROM e UNION ALL SELECT g, unnest(range(0, last + 1)), NULL, NULL FROM k) c ON c.g = r.g AND c.a = r.n + 1 AND (c.b IS NULL OR NOT list_contains(r.used, c.b)))
 SELECT r.g AS l_orderkey, round(CAST(max(total) AS DOUBLE) / 20, 6) AS total FROM r JOIN k ON k.g = r.g AND r.n = k.last WHERE r.g IN (SELECT g FROM e) GROUP BY r.g""")
def assignment_totals(spark, sf_dir):
    """The greatest margin above 0.3 that lines of each order can have together."""
    rows = assign(_scored(spark, sf_dir), ["g"], "a", "b", "score", 0.3)
    return rows.groupBy(F.col("g").alias("l_orderkey")).agg(F.round(F.sum(F.col("score") - 0.3), 6).alias("total"))


@query(rf"""SELECT o_custkey AS cmp_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS INT) AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE floor((0.55 + 0.45 * 2 * la / (2 * la + lt)) * 10000 + 0.5) / 10000 END::DOUBLE AS similarity
 FROM (SELECT *, length(CAST(o_orderkey AS VARCHAR)) + 4 AS la, CASE WHEN o_orderkey % 3 = 1 THEN 12 ELSE 25 END AS lt FROM orders)""")
def modified_scores(spark, sf_dir):
    """A clause for each order of a customer; in the second version most go on after their last word.

    All its words but the last are equal, so the score is that of the tails and of all its terms.
    """
    o = F.col("o_orderkey")
    name = F.translate(o.cast("string"), "0123456789", "abcdefghij")
    order = F.struct(o.alias("o"), say("The goods leave the harbour on time as lot", name).alias("a"), F.when(o % 3 == 0, ".").when(o % 3 == 1, " and insured.").otherwise(" with a permit of exports.").alias("more"))
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cmp_id")).agg(F.array_sort(F.collect_list(order)).alias("orders"))
    text = lambda f: F.concat(F.lit("1. DELIVERIES\n\n"), F.array_join(F.transform("orders", f), "\n\n"))
    pairs = docs.select("cmp_id", text(lambda x: F.concat(x["a"], F.lit("."))).alias("text_a"), text(lambda x: F.concat(x["a"], x["more"])).alias("text_b"))
    rows = compare_texts(pairs, unicode=False).aligned
    return rows.select("cmp_id", (F.col("n_a") + 1).cast("int").alias("n"), "status", "similarity")


@query(f"""WITH e AS (SELECT *, k % 12 = 0 AS moved, k % 12 <> 0 AND k % 5 = 1 AS split FROM {EDITS}),
 x AS (SELECT k, n AS oa, n AS ob, 'MATCHED' AS status FROM e, (SELECT unnest(range(1, 6)) AS n) UNION ALL
  SELECT k, 6, CASE WHEN moved THEN 7 WHEN split THEN NULL ELSE 6 END, CASE WHEN split THEN 'REMOVED' ELSE 'MATCHED' END FROM e UNION ALL
  SELECT k, NULL, 6, 'ADDED' FROM e WHERE moved OR split UNION ALL SELECT k, NULL, 7, 'ADDED' FROM e WHERE more AND NOT moved)
 SELECT k AS cmp_id, CAST(row_number() OVER (PARTITION BY k ORDER BY coalesce(oa, ob), oa IS NULL) AS INT) AS al_no, status, 's' || CAST(oa AS VARCHAR) AS section_id_a, 's' || CAST(ob AS VARCHAR) AS section_id_b FROM x""")
def repaired_sections(spark, sf_dir):
    """Decisions on the contracts' last section: a new partner, none, its own one, and one that isn't free."""
    found = compared(spark, sf_dir).alignments
    k = F.col("cmp_id")
    asked = found.where("section_id_a = 's6'").select("cmp_id", "section_id_a", F.when(k % 12 == 0, "s7").when(k % 5 == 1, F.lit(None)).when(k % 7 == 2, "s2").otherwise("s6").alias("choice"))
    rivals = found.where("section_id_a = 's5' and cmp_id % 24 = 0").select("cmp_id", "section_id_a", F.lit("s7").alias("choice"))
    choices = asked.withColumn("confidence", F.lit(0.9)).unionByName(rivals.withColumn("confidence", F.lit(0.4)))
    rows = align.arbitrated(found, choices, "fixed")
    return rows.select("cmp_id", "al_no", "status", "section_id_a", "section_id_b")


@query(f"""SELECT k AS cmp_id, n AS section, CAST(1.0 AS DOUBLE) AS heading, CASE WHEN edited THEN NULL ELSE 1.0 END::DOUBLE AS content, CASE WHEN n = 1 OR edited THEN 0.0 ELSE 1.0 END::DOUBLE AS entity,
 round(CAST(1 - 2 * abs(n / 6 - n / (6 + CAST(more AS INT))) AS DOUBLE), 6) AS position, CASE WHEN n = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS numbering,
 CASE WHEN edited THEN NULL ELSE floor((0.3 + 0.3 + CASE WHEN n = 1 THEN 0.0 ELSE 0.15 END + 0.15 * (1 - 2 * abs(n / 6 - n / (6 + CAST(more AS INT)))) + CASE WHEN n = 1 THEN 0.0 ELSE 0.1 END) * 10000 + 0.5) / 10000 END::DOUBLE AS confidence
 FROM (SELECT *, [false, price, pay, false, duty, share][n] AS edited FROM {EDITS}, (SELECT CAST(unnest(range(1, 7)) AS INT) AS n))""")
def section_scores(spark, sf_dir):
    """The five signals of each pair of sections, and their score where nothing was edited."""
    k, n = F.col("cmp_id"), F.substring("section_id_a", 2, 9).cast("int")
    edited = F.get(F.array(F.lit(False), k % 4 != 0, k % 3 == 0, F.lit(False), k % 7 == 0, k % 5 == 0), n - 1)
    rows = compared(spark, sf_dir).alignments.where("status = 'MATCHED'")
    return rows.select("cmp_id", n.alias("section"), "signals.heading", F.when(~edited, F.col("signals.content")).alias("content"), "signals.entity", F.round("signals.position", 6).alias("position"), "signals.numbering", F.when(~edited, F.col("confidence")).alias("confidence"))


@query("""SELECT p_partkey, round(CAST(CASE p_size % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 ELSE 0.9 END AS DOUBLE), 6) AS heading FROM part""")
def heading_scores(spark, sf_dir):
    """Headings that are empty, equal, longer by some words, of other order or of one family."""
    pick = lambda *w: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in w]), (F.col("p_size") % len(w)).cast("int"))
    a = pick("", "", F.col("p_name"), "payment terms", "terms of payment", "governing law")
    b = pick("", "x", F.col("p_name"), say("payment terms of ", F.col("p_name")), "payment of terms", "applicable law")
    rows = table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    return rows.select("p_partkey", F.round(S.heading_similarity(F.col("a"), F.col("b")), 6).alias("heading"))


@query(f"SELECT k AS cmp_id, CASE WHEN price AND pay THEN true END AS split, CASE WHEN price AND pay THEN CAST(1 AS INT) END AS ordinal FROM {EDITS}")
def split_labels(spark, sf_dir):
    """A label of each contract whose two markers are in two changes, if both are made: the old price and the new payment period."""
    k = F.col("c_custkey")
    marks = F.array(say("$", money(F.abs("c_acctbal") + 1000)), say(30 + k % 4 * 15, " days"))
    labels = table(spark, sf_dir, "customer").select(k.alias("cmp_id"), F.lit("l").alias("label_id"), marks.alias("match"))
    return evaluate.matched(labels, compared(spark, sf_dir).changes).select("cmp_id", "split", F.col("ordinal").cast("int").alias("ordinal"))
