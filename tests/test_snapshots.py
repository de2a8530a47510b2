"""Commits over several tables: together or not at all."""

import pytest
from pyspark.sql import functions as F

from deltadoc.sources.snapshots import Conflict, Store, delete_comparisons, review

REVIEWS, NOTES, AUDIT = "cmp_id int, change_id string, status string", "cmp_id int, change_id string, body string", "cmp_id int, action string"


def rows(table):
    return sorted(tuple(r) for r in table.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_review_note_and_audit_appear_together(spark, store):
    make = spark.createDataFrame
    review(store, make([(1, "a", "confirmed"), (2, "b", "confirmed")], REVIEWS), make([(1, "a", "first")], NOTES), make([(1, "reviewed")], AUDIT))
    before = store.snapshot()
    review(store, make([(1, "a", "resolved")], REVIEWS), make([(1, "a", "second")], NOTES), make([(1, "again")], AUDIT))
    now = store.snapshot()
    assert now.number == 2 and rows(now.read("reviews")) == [(1, "a", "resolved"), (2, "b", "confirmed")]
    assert rows(now.read("notes")) == [(1, "a", "first"), (1, "a", "second")] and rows(now.read("audit")) == [(1, "again"), (1, "reviewed")]
    assert rows(before.read("reviews")) == [(1, "a", "confirmed"), (2, "b", "confirmed")] and before.read("notes").count() == 1  # a reader keeps its own
    delete_comparisons(store, make([(1,)], "cmp_id int"), make([(1, "deleted")], AUDIT))
    left = store.snapshot()
    assert rows(left.read("reviews")) == [(2, "b", "confirmed")] and left.read("notes").count() == 0 and left.read("audit").count() == 3


def test_a_failure_between_writes_changes_nothing(spark, store):
    make = spark.createDataFrame
    review(store, make([(1, "a", "confirmed")], REVIEWS), make([], NOTES), make([], AUDIT))
    broken = make([(1, "x")], AUDIT).withColumn("action", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        review(store, make([(1, "a", "resolved")], REVIEWS), make([(1, "a", "n")], NOTES), broken)
    now = store.snapshot()
    assert now.number == 1 and rows(now.read("reviews")) == [(1, "a", "confirmed")] and now.read("notes").count() == 0
    with pytest.raises(ValueError, match="columns"):
        store.commit(now, appended={"audit": make([(1,)], "other int")})


def test_the_second_of_two_commits_is_told(spark, store):
    make = spark.createDataFrame
    first = store.commit(store.snapshot(), replaced={"t": make([(1,)], "v int")})
    other = store.commit(first, replaced={"t": first.read("t").unionByName(make([(2,)], "v int"))})  # reads what it replaces
    with pytest.raises(Conflict):
        store.commit(first, replaced={"t": make([(9,)], "v int")})
    assert rows(store.snapshot().read("t")) == [(1,), (2,)] == rows(other.read("t"))
    seen = []

    def late(base):
        if not seen:
            store.commit(base, appended={"t": make([(3,)], "v int")})
        seen.append(base.number)
        return {"appended": {"t": make([(4,)], "v int")}}

    assert store.transact(late).number == 4 and seen == [2, 3] and rows(store.snapshot().read("t")) == [(1,), (2,), (3,), (4,)]
    assert rows(store.snapshot(1).read("t")) == [(1,)] and store.numbers() == [1, 2, 3, 4]
