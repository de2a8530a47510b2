"""Whole texts count, pairs of a batch are compared together, and shares count before they are rounded."""

import random

import pytest
from pyspark.sql import functions as F

from deltadoc.functions import similarity as S
from deltadoc.operators.cut import cut
from deltadoc.plans.compare import compare_texts


def test_pairs_of_a_batch_are_compared_together(spark, monkeypatch):
    """Each pair went through Python a character at a time; now only texts of over 256 characters do."""
    rng = random.Random(1)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    sizes = (0, 1, 7, 8, 9, 63, 64, 65, 127, 128, 129, 200, 256, 257)
    pairs = [(same + text(rng.choice(sizes), letters), same + text(rng.choice(sizes), letters)) for letters in ("abc", "aé日𝒳 ") for same in ("", "x" * 11) for _ in range(300)]
    want = [S.lcs_length(a, b) for a, b in pairs]
    alone = []
    monkeypatch.setattr(S, "lcs_length", lambda a, b, real=S.lcs_length: alone.append(min(len(a), len(b))) or real(a, b))
    assert S.lcs_lengths(pairs) == want and alone and min(alone) > 256


def test_whole_texts_are_compared(spark):
    """Only the first 3000 characters counted, so that these were equal."""
    row = spark.sql("select concat(repeat('x', 5000), 'a') as a, concat(repeat('x', 5000), 'b') as b")
    found = row.select(S.ratio("a", "b").alias("whole"), S.partial_ratio("a", "b").alias("partial"), S.token_set_ratio(F.array("a", F.lit("c")), F.array("b", F.lit("c"))).alias("sets")).first()
    assert found.whole == found.partial == 10000 / 10002 and 0 < found.sets < 1


def test_steps_are_small_enough_to_be_compiled(spark):
    """Methods of over 8000 bytes, which the JVM doesn't compile, took section pairs five times as long."""
    cut(spark.range(1))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


@pytest.mark.parametrize(("old", "score"), [("5,002.00", 4), ("5,000.00", 5)])
def test_shares_count_before_they_are_rounded(spark, old, score):
    """500 of 5002 is 9.996 percent, which became 10 before it was held against 10."""
    new = f"{float(old.replace(',', '')) + 500:,.2f}"
    text = "1. PRICING\n\nThe total contract price is ${}."
    made = compare_texts(spark.createDataFrame([(1, text.format(old), text.format(new))], "cmp_id int, a string, b string").toDF("cmp_id", "text_a", "text_b"), unicode=False)
    assert [(r.importance_score, r.delta.percentage) for r in made.value_changes.collect()] == [(score, 10.0)]
