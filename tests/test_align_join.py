"""The join of blocks by their heaviest terms against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from deltadoc import fixed
from deltadoc.functions import similarity as S
from deltadoc.functions import text as T
from deltadoc.operators import align

WORDS = "supplier invoice payment delivery warranty penalty notice insurance premium contract termination liability goods services schedule region".split()


def random_blocks(seed, n):
    rng = random.Random(seed)
    rows = []
    for g in (1, 2):
        for side in "AB":
            for k in range(n):
                words = [rng.choice(WORDS[:4] if rng.random() < 0.4 else WORDS) for _ in range(rng.randint(0, 9))]
                kind = rng.choice(["paragraph"] * 5 + ["list_item", "table_row"])
                rows.append((g, side, f"s{k % 2}", k, kind, " ".join(words), rng.choice([None, "key"]) if kind == "table_row" else None))
    return rows


KINDS = "cmp_id int, side string, section_id string, n int, block_type string, normalized string, row_key string"


@pytest.mark.parametrize("threshold", [fixed.BLOCK_THRESHOLD, fixed.MOVE_THRESHOLD])
@pytest.mark.parametrize("hot", [2, 1000])
def test_join_loses_no_pair(spark, threshold, hot, monkeypatch):
    df = spark.createDataFrame(random_blocks(7, 40), KINDS)
    weights = align.term_weights(df.withColumnRenamed("n", "block_index"))
    a, b = (align.block_classes(df.where(F.col("side") == s).drop("side"), ["cmp_id"]) for s in "AB")
    posted = align.candidate_pairs
    monkeypatch.setattr(align, "candidate_pairs", lambda x, y, scope, share: posted(x, y, scope, share, hot))
    found = align.block_pairs(a, b, weights, ["cmp_id"], threshold).where(F.col("score") >= threshold)
    got = {(r.cmp_id, r.n_a, r.n_b): (round(r.score, 9), r.room_a, r.room_b) for r in found.collect()}

    one = lambda df, end: df.groupBy("cmp_id", "rep").agg(F.first("normalized").alias("x"), F.first("block_type").alias("t"), F.count("*").alias("m")).select("cmp_id", *[F.col(c).alias(f"{c}_{end}") for c in ("rep", "x", "t", "m")])
    heavy = {(r.cmp_id, r.term): r.weight for r in weights.collect()}
    texts = {r.normalized: set(r.t) for r in df.select("normalized", T.content_terms(F.col("normalized")).alias("t")).distinct().collect()}
    pairs = one(a, "a").join(one(b, "b"), "cmp_id").where("t_a = t_b or (t_a != 'table_row' and t_b != 'table_row')")
    pairs = pairs.withColumn("lexical", S.lexical_similarity(T.strip_list_marker(F.col("x_a")), T.strip_list_marker(F.col("x_b"))))
    want = {}
    for r in pairs.collect():
        mass = lambda terms: sum(heavy[r.cmp_id, t] for t in terms)  # noqa: B023, E731
        shared = texts[r.x_a] & texts[r.x_b]
        if shared:
            score = min(1.0, r.lexical * fixed.W_LEXICAL + mass(shared) / min(mass(texts[r.x_a]), mass(texts[r.x_b])) * fixed.W_TERMS)
            if score >= threshold:
                want[r.cmp_id, r.rep_a, r.rep_b] = (round(score, 9), r.m_a, r.m_b)
    assert want and got == want


def test_common_words_bring_no_square_of_candidates(spark):
    """Each block has the same eight words and three of its own: all pairs share words, few can reach the threshold."""
    def blocks(n):
        rows = [(1, side, "s", k, "paragraph", " ".join(WORDS[:8]) + f" own{'abcdefghij'[k % 10]}{'x' * (k // 10 % 10 + 1)}{'y' * (k // 100 + 1)} second{'q' * (k % 97 + 1)} third{'z' * (k % 89 + 1)}", None) for side in "AB" for k in range(n)]
        return spark.createDataFrame(rows, KINDS)

    counts = []
    for n in (100, 200, 400):
        df = blocks(n)
        weights = align.term_weights(df.withColumnRenamed("n", "block_index"))
        a, b = (align._posted(df.where(F.col("side") == s), weights, ["cmp_id"]) for s in "AB")
        share = (fixed.MOVE_THRESHOLD - fixed.W_LEXICAL) / fixed.W_TERMS
        counts.append(align.candidate_pairs(a, b, ["cmp_id"], share).count())
    assert counts[0] >= 100 and counts[2] < 40 * 400 and counts[2] < 9 * counts[0]  # all pairs: 10,000, 40,000, 160,000


def test_equal_blocks_pair_as_often_as_both_sides_have_them(spark):
    text = "The supplier delivers the goods within ninety days of the order."
    moved = "1. ALPHA\n\nAlpha is about apples and pears only.\n\n2. BETA\n\nBeta is about ships and harbours only.\n\n"
    from deltadoc.plans.compare import compare_texts

    a = moved.replace("pears only.", "pears only.\n\n" + "\n\n".join([text] * 3))
    b = moved.replace("harbours only.", "harbours only.\n\n" + "\n\n".join([text] * 2))
    got = compare_texts(spark.createDataFrame([(1, a, b)], "cmp_id int, text_a string, text_b string")).aligned.collect()
    status = sorted(r.status for r in got)
    assert status.count("MOVED") == 2 and status.count("REMOVED") == 1
    pairs = sorted((r.n_a, r.n_b) for r in got if r.status == "MOVED")
    assert pairs[0][0] < pairs[1][0] and pairs[0][1] < pairs[1][1]


def test_greedy_sections_and_repair_through_a_comparison(spark):
    from deltadoc.plans.compare import compare_texts

    a = "1. PAYMENT TERMS\n\nEach invoice is payable within 30 days.\n\n2. WARRANTY\n\nThe goods are free of defects.\n\n"
    b = "1. PAYMENT TERMS\n\nEach invoice is payable within 45 days.\n\n2. WARRANTY\n\nThe goods are free of defects.\n\n3. INSURANCE\n\nThe cover is held by the supplier.\n\n"
    pairs = spark.createDataFrame([(1, a, b)], "cmp_id int, text_a string, text_b string")
    choices = spark.createDataFrame([(1, "s2", "s3", 0.9)], "cmp_id int, section_id_a string, choice string, confidence double")
    rows = lambda c: sorted((r.status, r.section_id_a or "", r.section_id_b or "") for r in c.alignments.collect())
    assert rows(compare_texts(pairs, mode="greedy")) == [("ADDED", "", "s3"), ("MATCHED", "s1", "s1"), ("MATCHED", "s2", "s2")]
    got = compare_texts(pairs, choices=choices, arbitration="fixed")
    assert rows(got) == [("ADDED", "", "s2"), ("MATCHED", "s1", "s1"), ("MATCHED", "s2", "s3")]
    assert got.changes.where("section_b like '2 WARRANTY%' and type = 'SECTION_ADDED'").count() == 1
