"""Queries whose result SQL can express, against that SQL."""

import duckdb
import pytest

from deltadoc.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, sf_dir, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=str)
    rel = c.sql(ORACLE_SQL[name])
    at = [list(rel.columns).index(k) for k in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
