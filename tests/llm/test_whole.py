"""Cases in which the operators once did less than the whole job."""

from deltadoc.llm import mixing, urltree


def test_small_alike_branches_are_merged(spark):
    """Two branches unlike the largest, with one bad label each, are one template; at each level."""
    for above in ("", "top/", "top/mid/"):
        urls = [f"http://h.com/{above}big/{k}.html" for k in range(400)]
        urls += [f"http://h.com/{above}{s}/{k}" for s in ("one", "two") for k in range(40)]
        labels = spark.createDataFrame([(400, 1), (440, 1)], "page_id long, bad int")
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        rows = {r.page_id: r for r in urltree.judge(pages, rules=(), labels=labels).collect()}
        assert rows[400].template == rows[440].template != rows[0].template
        assert rows[400].verdict == rows[479].verdict == "block" and rows[0].verdict == "allow"


def test_mix_reaches_a_larger_budget(spark):
    docs = spark.createDataFrame([(k, "w " * 400, "ab"[k % 2]) for k in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, block=16, budget=2.0).collect()
    assert abs(sum(r.taken for r in rows) - 2 * sum(r.size for r in rows)) <= 2 * 16
