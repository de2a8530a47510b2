"""Cases in which comparisons once did less than the whole job."""

from pyspark.sql import functions as F

from deltadoc import catalogue
from deltadoc.operators import assign


def test_solver_gets_connected_parts(spark):
    """Many small knots of rivals in one group come to the solver apart, and each gets its best pairs."""
    pairs = []
    for k in range(400):
        pairs += [(1, 2 * k, 2 * k, 0.9), (1, 2 * k, 2 * k + 1, 0.8), (1, 2 * k + 1, 2 * k, 0.85)]
    pairs += [(1, 1000 + k, 1000 + k, 0.9) for k in range(50)] + [(1, 1001 + k, 1000 + k, 0.6) for k in range(49)]
    rows = spark.createDataFrame(pairs, "g int, a int, b int, s double")
    parts = assign.components(rows, ["g"], "a", "b").groupBy("_part").count().collect()
    assert len(parts) == 401 and sorted(r["count"] for r in parts)[-2:] == [3, 99]
    got = {(r.a, r.b) for r in assign.assign(rows, ["g"], "a", "b", "s", 0.5).collect()}
    want = {p for k in range(400) for p in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k))} | {(1000 + k, 1000 + k) for k in range(50)}
    assert got == want


def test_next_rows_without_a_task_for_all(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1009).alias("k"), F.col("id").cast("string").alias("v"))
    got = catalogue._with_next(rows, "k", "v", "w")
    want = sorted((r.k, r.v) for r in rows.collect())
    assert {r.k: r.w for r in got.collect()} == dict(zip([k for k, _ in want], [v for _, v in want[1:]] + [None]))


def test_every_customer_and_event(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    assert catalogue.comparison_listing_all(spark, sf_dir).count() == read("customer").count() - 1 > 100
    assert catalogue.audit_trail_all(spark, sf_dir).select("event_id").distinct().count() == read("events").count()
