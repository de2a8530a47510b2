"""Near copies against brute force: repeated ids, texts around the threshold, counts of shingles, hot buckets."""

import random
from collections import Counter

import pytest

from deltadoc.llm import dartminhash


def brute(docs, weights="set", least=0.8):
    """Least id of the component of each row's text, by all pairs of different texts."""
    bags = {}
    for _, t in docs:
        w = (t or "").lower().split()
        c = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
        bags[t] = c if weights == "count" else Counter(dict.fromkeys(c, 1))
    texts, parent = list(bags), {t: t for t in bags}
    sizes = {t: sum(c.values()) for t, c in bags.items()}
    where = {}
    for t, c in bags.items():
        for s in c:
            where.setdefault(s, []).append(t)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for t in texts:
        both = Counter()
        for s, n in bags[t].items():
            for u in where[s]:
                both[u] += min(n, bags[u][s])
        for u, n in both.items():
            if u is not t and n >= least * (sizes[t] + sizes[u] - n) - 1e-9:
                links += 1
                parent[find(t)] = find(u)
    ids = {}
    for i, t in docs:
        if i is not None:
            ids[find(t)] = min(i, ids.get(find(t), i))
    return [(i, t, None if i is None else i if not (t or "").split() else ids[find(t)]) for i, t in docs], links // 2


def planted(rng, bases, copies, words):
    docs = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, copies)):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(copy) // 50), max(1, len(copy) // 45)])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    return docs


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


def classed(spark, docs, **options):
    rows = dartminhash.classes(table(spark, docs), keep=("text",), **options).collect()
    return sorted(((r.doc_id, r.text, r.class_id) for r in rows), key=str)


def test_unlike_texts_of_one_id_stay_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, "x y"), (None, None), (7, ""), (7, "")]
    keys = {(r.doc_id, r.text): r.class_key for r in dartminhash.classes(table(spark, docs), keep=("text",)).collect()}
    assert keys[1, a] == keys[2, a] == keys[None, a] != keys[1, b] == keys[3, b]
    left = sorted(((r.doc_id, r.text) for r in dartminhash.one_of_each(table(spark, docs)).collect()), key=str)
    assert left == sorted([(1, a), (1, b), (None, "x y"), (None, None), (7, "")], key=str)


def test_no_link_is_lost(spark):
    rng = random.Random(1)
    texts = planted(rng, 300, 12, [f"w{k}" for k in range(300)])
    docs = [(rng.choice([k, k, k, k // 7, None]), t) for k, t in enumerate(texts)]
    want, links = brute(docs)
    assert links > 1000 and len(docs) > 1500
    for margin in (dartminhash.MARGIN, None):
        assert classed(spark, docs, margin=margin) == sorted(want, key=str)


def test_counts_of_shingles(spark):
    rng = random.Random(2)
    docs = []
    for _ in range(60):
        parts = [" ".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4)]
        for _ in range(4):
            docs.append((len(docs), " ".join(p for p in parts for _ in range(rng.randint(1, 6)))))
    want, links = brute(docs, "count")
    assert links > 10 and want != brute(docs)[0]
    assert classed(spark, docs, weights="count") == sorted(want, key=str)


@pytest.mark.parametrize("block", [7])
def test_largest_class_meets_the_others_only(spark, block):
    """A bucket with a large class and other members: each similar pair of different classes is found once."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k] + [f"x{rng.randrange(9)}"] + base[k + 1 :]) for k in (rng.randrange(60) for _ in range(90))]
    rows = dartminhash.classes(table(spark, list(enumerate(dict.fromkeys(texts)))), keep=("text",)).collect()
    signed = dartminhash.signatures(table(spark, list(enumerate(dict.fromkeys(texts))))).withColumnRenamed("doc_id", "key")
    sets = dartminhash.sets_of(table(spark, list(enumerate(dict.fromkeys(texts)))).withColumnRenamed("doc_id", "key"))
    members = signed.selectExpr("0L as bucket", "key", "if(key % 3 = 0, key, -1L) as class_key")
    same = signed.selectExpr("key", "sig", "transform(bands, x -> 0L) as bands")
    got = {(r.a, r.b) for r in dartminhash.across(members, same, sets, 0.8, -1.0, block).collect()}
    sh = {r.doc_id: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for r in rows for w in [r.text.split()]}
    of = lambda i: i if i % 3 == 0 else -1
    assert got == {(a, b) for a in sh for b in sh if a < b and of(a) != of(b) and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]) - 1e-9}


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, "a b c", 6)], "doc_id long, text string, _row int")
    assert [tuple(r) for r in dartminhash.one_of_each(docs).collect()] == [(1, "a b c", 5)]
    assert dartminhash.one_of_each(docs.limit(0)).columns == docs.columns and dartminhash.near_copies(docs.limit(0)).count() == 0
