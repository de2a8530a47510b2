"""Queries and operators against brute force: media, derivatives, url trees, mixes, search, clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deltadoc.llm import langid, media, mixing, packing, permindex, quality, urltree, warc
from deltadoc.llm.queries import QUERIES


def test_media_columns_are_the_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_ogg"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert int(re.search(r"bins=([\d,]+)", r.feature)[1].split(",")[1]) == sum(32 <= b < 64 for b in payload)


def test_derivatives_are_the_pages(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op3_warc"](spark, sf_dir).collect()
    assert len(rows) == 2 * len(pages) and not any(r.error for r in rows)
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    by_id = {r.record_id: r for r in rows}
    for r in rows:
        page = pages[r.page_id]
        assert r.target_uri == re.sub(r"[\r\n]", "", page.url or "") and r.source_payload_digest == sha1((page.html or "").encode())
        assert by_id[r.concurrent_to].refers_to == r.refers_to and by_id[r.concurrent_to].record_type != r.record_type
        if r.record_type == "conversion":
            text = warc.plain_text(page.html or "").encode()
            assert (r.block_digest, r.block_bytes, r.block_sha256) == (sha1(text), len(text), hashlib.sha256(text).hexdigest())


OLD = {
    "hidden": re.compile(r"<!--.*?-->|<(script|style|noscript|template|head)\b.*?</\1\s*>", re.S | re.I),
    "title": re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I),
    "link": re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I),
}


def test_scanners_equal_plain_patterns():
    rng = random.Random(4)
    bits = ["<a ", "<A href=", "href=", "HREF = ", '"', "'", ">", "<", "</a>", " x", "<!--", "-->", "<script>", "</script >", "<STYLE ", "</style>", "<head", "</head>", "<title>", "<title ", "</title", "text", "=", "\n", "&amp;", "<p", "</p>", "<ahref=1"]
    for _ in range(4000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert warc.without_hidden(page) == OLD["hidden"].sub(" ", page), page
        assert warc.links_of(page) == [a or b or c for a, b, c in OLD["link"].findall(page)], page
        old = OLD["title"].search(page)
        assert warc.title_of(page) == (old[1] if old else None), page


@pytest.mark.parametrize("bit", ["<a ", "<a href=", "<script ", "<!-- ", "<title>", "<title ", "<p ", "<", "<a x>", "<head></hea", " \n"])
def test_long_pages_take_linear_time(bit):
    page = bit * (1_000_000 // len(bit))
    began = time.process_time()
    made = warc.derive(next(warc.read_records(bytes(warc.response("u", page)))))
    assert time.process_time() - began < 6 and made[1] is not None


def test_letters():
    assert not any(langid.has_letter(t) for t in ("", "½", "² 3", "①", "12 _ %")) and langid.has_letter("½ é")


def test_rare_languages_are_learned(spark):
    texts = [("aa", "alpha gamma delta " * 9), ("zz", "ψυχή λόγος κόσμος " * 9)]
    rows = [(k, texts[k % 500 == 7][1] + str(k), texts[k % 500 == 7][0]) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    x, y, languages = langid.sample_windows(docs, sample_docs=200)
    assert languages == ["aa", "zz"] and np.bincount(y).tolist() == [400, 32]


def test_threshold_is_the_quantile_of_all_labels(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("ab") * rng.randint(1, 9) for _ in range(30)) + (" ### @@" * rng.randint(1, 3) if k % 5 == 0 else ""), int(k % 5 > 0)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    ranker = quality.fit(docs, docs.select("doc_id", "quality"), sample_docs=200)
    free = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    u = ranker.strengths(np.array([quality.measures(t) for _, t, _ in free]))
    assert abs((u < ranker.threshold).mean() - np.mean([q == 0 for _, _, q in free])) < 0.005
    same = quality.Ranker(ranker.mean, ranker.spread, ranker.weights, float(u[0]))
    assert same.scores(np.array([quality.measures(free[0][1])]))[0] == 0.5  # a tie with the threshold counts as good


def test_pairwise_loss_is_at_its_minimum():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, len(quality.MEASURES)))
    label = (x[:, 0] + rng.normal(0, 1, 60) > 0).astype(int)
    r = quality.bradley_terry(x, label, pairs=500)
    draw, z = np.random.default_rng(11), (x - r.mean) / r.spread
    d = z[draw.choice(np.flatnonzero(label == 1), 500)] - z[draw.choice(np.flatnonzero(label == 0), 500)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 5e-4 * (w @ w)
    best = loss(r.weights)
    assert all(loss(r.weights + rng.normal(0, s, len(r.weights))) >= best for s in (1e-4, 1e-2, 1.0) for _ in range(50))


# the url tree


def follows(segs):
    """The cell of what follows a segment: a hash from the end on, modulo the cells of the sketch."""
    h = 0
    for s in reversed(segs):
        h = xxhash.xxh64(h.to_bytes(8, "little"), seed=xxhash.xxh64(s.encode(), seed=42).intdigest()).intdigest()
    return h % urltree.CELLS


def brute_tree(rows, labels, support=5, share=0.01, smoothing=4.0, reject=0.6):
    """rows: (page_id, host, path); labels: page_id to 0 or 1. Template and verdict of each page.

    A host's pages are dealt out segment by segment. Of a node's pages, those with a segment of too few go on
    together under the wildcard; a node of few pages has wildcards only.
    """
    segs = {}

    def grow(pages, above):
        level = len(above)
        ended = [(i, p) for i, p in pages if len(p) == level]
        for i, p in ended if len(pages) >= support else pages:
            segs[i] = above + ("*",) * (len(p) - level)
        if len(pages) >= support:
            count = collections.Counter(p[level] for _, p in pages if len(p) > level)
            children = {}
            for i, p in pages:
                if len(p) > level:
                    n = count[p[level]]
                    children.setdefault(p[level] if n >= support and n >= share * len(pages) else "*", []).append((i, p))
            for seg, own in children.items():
                grow(own, (*above, seg))

    hosts = {}
    for i, host, path in rows:
        hosts.setdefault(host, []).append((i, re.sub("[0-9]+", "<n>", path.removeprefix("/")).split("/")))
    out = {}
    for host, pages in hosts.items():
        grow(pages, ())
        while new := next((x for level in range(max(len(segs[i]) for i, _ in pages)) if (x := merges([i for i, _ in pages], segs, labels, level))), None):
            for i, to in new.items():
                segs[i] = to
        sums = collections.defaultdict(lambda: [0, 0])
        for i, _ in pages:
            if labels.get(i) is not None:
                sums[segs[i]][0] += 1
                sums[segs[i]][1] += labels[i]
        for i, _ in pages:
            n, bad = sums[segs[i]]
            out[i] = "/" + "/".join(segs[i]), "block" if (bad + smoothing / 2) / (n + smoothing) > reject else "allow"
    return out


def merges(ids, segs, labels, level):
    """New segments of pages whose branch at ``level`` joins a larger one beside it."""
    nodes = {}
    for i in ids:
        if len(segs[i]) > level:
            nodes.setdefault(segs[i][:level], {}).setdefault(segs[i][level], []).append(i)
    new = {}
    for above, branches in nodes.items():
        cells = {b: collections.Counter(follows(segs[i][level + 1 :]) for i in own) for b, own in branches.items()}
        marks = {b: [labels[i] for i in own if labels.get(i) is not None] for b, own in branches.items()}

        def alike(x, y):
            m, n = marks[x], marks[y]
            if bool(m) != bool(n):
                return False
            if m:
                p = (sum(m) + sum(n)) / (len(m) + len(n))
                if abs(sum(m) / len(m) - sum(n) / len(n)) > 2 * math.sqrt(p * (1 - p) * (1 / len(m) + 1 / len(n))) + 1e-12:
                    return False
            na, nb = len(branches[x]), len(branches[y])
            kinds = cells[x].keys() | cells[y].keys()
            chi = sum((math.sqrt(nb / na) * cells[x][c] - math.sqrt(na / nb) * cells[y][c]) ** 2 / (cells[x][c] + cells[y][c]) for c in kinds)
            return chi <= len(kinds) - 1 + 2 * math.sqrt(2 * (len(kinds) - 1)) + 1e-9

        left = sorted(branches, key=lambda b: (len(branches[b]), b))
        while left:
            hi = left.pop()
            for lo in [b for b in left if alike(hi, b)]:
                left.remove(lo)
                new |= {i: (*above, hi, *segs[i][level + 1 :]) for i in branches[lo]}
    return new


def test_tree_equals_brute_force(spark, sf_dir):
    rng = random.Random(6)
    urls = []
    for host in ("a.com", "b.com"):
        for _ in range(700):
            top = rng.choice(["news", "shop", "ads", "wiki", "old", f"u{rng.randint(0, 400)}"])
            path = [top] + [rng.choice(["x", "y", f"{rng.randint(0, 99)}", "item"]) for _ in range(rng.randint(0, 6))]
            urls.append((len(urls), f"http://{host}/{'/'.join(path)}"))
    labels = {i: int("ads" in u or "shop/x" in u or rng.random() < 0.1) for i, u in urls if rng.random() < 0.3}
    table = spark.createDataFrame([(i, int(v)) for i, v in labels.items()], "page_id long, bad int")
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in urls], "page_id long, url string, host string, purity int")
    rows = [(i, u.split("/")[2], "/" + u.split("/", 3)[3]) for i, u in urls]
    got = {r.page_id: (r.template, r.verdict) for r in urltree.judge(pages, rules=(), labels=table).collect()}
    assert got == brute_tree(rows, labels)
    assert {v for _, v in got.values()} == {"allow", "block"}


def test_url_query_equals_brute_force(spark, sf_dir):
    got = QUERIES["op7_urltree"](spark, sf_dir).collect()
    rules = {r.page_id: r.rule and ("block" if dict(urltree.RULES)[r.rule] == "block" else "allow") for r in got}
    want = brute_tree([(r.page_id, r.host, r.path) for r in got], {i: int(v == "block") for i, v in rules.items() if v})
    assert all((r.template, r.verdict) == (want[r.page_id][0], rules[r.page_id] or want[r.page_id][1]) for r in got)


def test_slugs_are_one_template(spark):
    """Segments with digits are generalised like any other, and what follows the wildcard is a branch of its own."""
    urls = [(k, f"http://h.com/{k}-{'abcdefghij'[k % 10] * (k // 10 % 50 + 1)}{'klmnopqr'[k % 8] * (k // 500 + 1)}-title{'' if k % 2 else '/comments'}") for k in range(4000)]
    got = {r.page_id: r.template for r in urltree.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert len(got) == 4000 and {got[k] for k in range(1, 4000, 2)} == {"/*"} and {got[k] for k in range(0, 4000, 2)} == {"/*/comments"}


def test_repeated_pages_and_long_paths(spark):
    pages = [(1, "http://h/a"), (1, "http://h/b"), (None, "http://h/a"), (2, "http://h/" + "s/" * 600), (3, "http://h/" + "z" * 100_000)]
    rows = urltree.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()
    assert len(rows) == len(pages) and all(r.verdict == "allow" for r in rows)


# mixing, packing and search


def test_small_sources_come_near_their_targets(spark):
    docs = [(k, "w " * 300, "a") for k in range(40)] + [(100, "w " * 20, "b"), (101, "w " * 31, "c"), (102, "w", "d"), (103, "w " * 130, "e"), (104, None, "f"), (105, "w " * 9, None)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.first("source_size").alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    for r in rows:
        assert abs(r.t - r.target) <= max(1, min(mixing.BLOCK, r.n / 8)) and r.over <= 0, r


def test_pack_replaces_clashing_columns(spark):
    cut = spark.createDataFrame([(k, 0, 3000, "x", 5, 7) for k in range(9)], "doc_id long, start long, length long, sequence_id string, `OFFSET` int, pack_group int")
    rows = packing.pack(cut, group_pieces=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(9)) and len({r.sequence_id for r in rows}) == 9 and {(r.offset, r.pack_group) for r in rows} == {(0, 7)}


def brute_search(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = x @ np.array(v, dtype=float)
            order = np.lexsort((ids, -s))
            out[i] = [int(ids[j]) for j in order if ids[j] != i][:k]
    return out


def test_search_of_the_table(spark, sf_dir):
    use = permindex.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = [(r.vec_id, r.embedding) for r in use.collect()]
    want, got = brute_search(rows, 20), {}
    for r in QUERIES["op6_permindex"](spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys() and np.mean([len(set(got[q]) & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_recall_with_a_third_of_copies(spark):
    """4,000 random vectors, a third of the rows one vector; with the query's own settings but for the blocks."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.permutation(4000)[:1333]] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    use = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for share, least in ((0.15, 0.9), (1, 1)):
        got = {}
        for r in permindex.nearest(use, use.where("vec_id % 20 = 0"), share=share, block_rows=1500, group_rows=90).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        hits = [len(set(got[q]) & set(w)) / 20 for q, w in brute_search(rows, 20).items()]
        assert len(hits) == 200 and np.mean(hits) >= least and min(hits) >= 0.5
