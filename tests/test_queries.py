"""Each query against its SQL on the smallest tables."""

import re
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and not re.match(r"op\d+_|pipeline", n)]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(v) if isinstance(v, list) else v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(entry.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_text_ratios(spark, sf_dir):
    from deltadoc.functions.similarity import partial_of, ratio_of

    names = [r.p_name for r in spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").collect()]
    rows = {r.p_partkey: r for r in entry.queries()["text_ratios"](spark, sf_dir).collect()}
    for k, (a, b) in enumerate(zip(names, names[1:])):
        assert rows[k].ratio == round(ratio_of(a, b), 6) and rows[k].partial == round(partial_of(a, b), 6)
