"""Chains: what is read from a version goes to its steps without joins."""

import contextlib
import io
import random
from collections import defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as entry
from deltadoc.operators import values as V
from deltadoc.plans import chain

KINDS = "chain_id int, version int, doc_id int, sha256 string"


def test_timeline_reads_orders_once(spark, sf_dir):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        entry.queries()["timeline"](spark, sf_dir).explain()
    plan = out.getvalue()
    assert "Join" not in plan and "ExistingRDD" not in plan and plan.count("FileScan parquet") == 1


def test_placed_are_the_sides_of_consecutive_versions(spark):
    rows = [(1, 1, 10, "x"), (1, 2, 11, "x"), (1, 3, 12, None), (1, 4, 13, "y"), (2, 1, 20, "z"), (3, 5, 30, "a"), (3, 9, 31, "b")]
    versions = spark.createDataFrame(rows, KINDS)
    want = set()
    for r in chain.consecutive(versions).collect():
        want |= {(r.chain_id, r.step, "A", r.doc_a), (r.chain_id, r.step, "B", r.doc_b)}
    got = chain.placed(versions).select("chain_id", F.explode("sides").alias("s"), "doc_id").select("chain_id", "s.step", "s.side", "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_values_meet_equal_ones_first(spark):
    draw = random.Random(5)
    kinds = "k int, side string, type string, source_text string, char_start int, char_end int, value_num double, value_str string, unit string, currency string, confidence double, kind string, context string, days_equivalent double, actor string, strength int, action string, frequency string, negated boolean, n int"
    rows = [(k, side, draw.choice(["MONEY", "PERCENT"]), None, at, at + 1, draw.choice([1.0, 2.0, 3.0, float("nan"), None]), None, None, "USD", 1.0, None, None, None, None, None, None, None, None, draw.randrange(2)) for k in range(40) for side in "AB" for at in range(draw.randrange(7))]
    draw.shuffle(rows)
    values = spark.createDataFrame(rows, kinds)
    want = set()
    groups = defaultdict(lambda: {"A": [], "B": []})
    for r in rows:
        groups[r[0], r[2]][r[1]].append((r[19], r[4], repr(r[6]).replace("None", "nan")))
    for (k, kind), g in groups.items():
        a, b = sorted(g["A"]), sorted(g["B"])
        done_a, done_b = set(), set()
        for x in a:
            y = next((y for y in b if y[2] == x[2] and y not in done_b), None)
            if y:
                want.add((k, kind, 0, a.index(x) + 1, x[:2], y[:2]))
                done_a.add(x), done_b.add(y)
        a, b = [x for x in a if x not in done_a], [y for y in b if y not in done_b]
        for i in range(max(len(a), len(b))):
            want.add((k, kind, 1, i + 1, a[i][:2] if i < len(a) else None, b[i][:2] if i < len(b) else None))
    side = lambda s: values.where(F.col("side") == s).drop("side")
    got = {(r.k, r.group.split("|")[0], r.seq.late, r.seq.at, r.a and (r.a.n, r.a.char_start), r.b and (r.b.n, r.b.char_start)) for r in V.pair_values(side("A"), side("B"), ["k"]).collect()}
    assert got == want
