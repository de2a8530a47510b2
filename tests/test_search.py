"""The index of trigrams against a scan of all texts."""

import random
import re

from pyspark.sql import functions as F

from deltadoc.plans import search

TEXTS = ["Der Preis beträgt $1,200.00 im Monat.", "The price is 10% higher — see §4.", "", None, "aaa", "aa", "a", "Ünïcode İ ſ", "back\\slash 'quote' %_x", "the the the", "日本語の契約書", "x\ny"]


def index(spark, path, n=40):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["price", "prices", "payment", "pays", "notice"]) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    rows = [(k % 3, "document", f"A:b{k}", k, t, t and t.lower()) for k, t in enumerate(texts)]
    search.write_index(spark.createDataFrame(rows, "cmp_id int, kind string, place string, at long, text string, hay string").repartition(4), path)
    return rows


def test_every_part_of_every_text_is_found(spark, tmp_path):
    rows = index(spark, str(tmp_path / "i"))
    rng = random.Random(5)
    cuts = {t[a : a + n] for *_, t in rows if t for n in (1, 2, 3, 4, 7) for a in range(len(t) - n + 1)}
    terms = rng.sample(sorted(cuts), 14) + ["%_", "zzz", "PRICE", "日本", "aaa", "the the", "\\"]
    for term in terms:
        want = {r[2] for r in rows if r[5] is not None and term.lower() in r[5]}
        assert {r.place for r in search.places(spark, str(tmp_path / "i"), term).collect()} == want, term


def test_a_search_reads_its_buckets_and_parts_only(spark, tmp_path):
    path = str(tmp_path / "i")
    index(spark, path)

    def filters(df):
        return re.findall(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())

    def files_read(df):
        """Files that the plan's scans list after their partition filters."""
        df.collect()
        plan, scans = df._jdf.queryExecution().executedPlan(), []

        def walk(node):
            if node.nodeName().startswith("Scan") and node.metrics().contains("numFiles"):
                scans.append(node.metrics().apply("numFiles").value())
            inner = [node.children().apply(k) for k in range(node.children().size())]
            for name in ("executedPlan", "plan"):
                if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec") and not inner:
                    try:
                        inner.append(getattr(node, name)())
                    except Exception:  # the other kind of node
                        pass
            for x in inner:
                walk(x)

        walk(plan)
        return sum(scans)

    assert any("bucket" in f for f in filters(search.candidates(spark, path, "price")))
    assert any("part" in f for f in filters(search.places(spark, path, "beträgt")))
    every = len(spark.read.parquet(f"{path}/grams").inputFiles())
    assert 0 < files_read(search.candidates(spark, path, "pri")) < every / 5


def test_limits_by_comparison(spark, tmp_path):
    rows = index(spark, str(tmp_path / "i"), 200)
    got = search.search(spark, str(tmp_path / "i"), "p", limit=10).collect()
    for c in range(3):
        want = [r[2] for r in rows if r[0] == c and r[5] and "p" in r[5]][:20]
        assert sorted(r.place for r in got if r.cmp_id == c) == sorted(want)
