"""Nesting of sections against a scan, and one document of very many."""

import random

from deltadoc.operators.segment import nested


def scan(rows):
    """parent, last and path of each (order, level, label, value) of a document, by looking at all others."""
    out = {}
    for k, (o, level, label, value) in enumerate(rows):
        if level < 1:
            out[o] = (None, value, label)
            continue
        above, at = [], level
        for p, lv, name, _ in reversed(rows[:k]):
            if 0 < lv < at:
                above.append((p, name))
                at = lv
        stop = next((j for j in range(k + 1, len(rows)) if 0 < rows[j][1] <= level), len(rows))
        inside = [v for _, lv, _, v in rows[k:stop] if v is not None and lv > 0]
        out[o] = (above[0][0] if above else None, max(inside, default=None), " > ".join([n for _, n in reversed(above)] + [label]))
    return out


def test_nesting_equals_a_scan(spark):
    rng = random.Random(4)
    docs = {f"d{d}": [(o, rng.choice([0, 1, 1, 2, 3, 4, 7]), f"h{o}", rng.choice([None, rng.randint(1, 9)])) for o in range(rng.randint(1, 40))] for d in range(60)}
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "doc_id string, order_index int, level int, label string, value int").repartition(5)
    got = {(r.doc_id, r.order_index): (r.parent, r["last"], r.path) for r in nested(df).collect()}
    assert got == {(d, o): x for d, rows in docs.items() for o, x in scan(rows).items()}
    assert nested(df.limit(0)).count() == 0


def test_a_document_of_many_headings(spark):
    n = 100_000
    df = spark.range(n).selectExpr("0 as doc_id", "cast(id as int) as order_index", "cast(1 + (id * 7919 % 9973) % 6 as int) as level", "concat('h', id) as label", "cast(id % 11 as int) as value")
    got = nested(df).collect()
    level = {k: 1 + (k * 7919 % 9973) % 6 for k in range(n)}
    assert len(got) == n and all(r.parent is None or level[r.parent] < level[r.order_index] for r in got)
    for r in got:
        if r.order_index % 5000 == 0:
            assert r.parent == next((k for k in range(r.order_index - 1, -1, -1) if level[k] < level[r.order_index]), None)
