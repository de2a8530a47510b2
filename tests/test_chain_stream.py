"""Pairs of a stream of versions against those of all rows at once."""

import random

import pytest

from deltadoc.plans import chain
from deltadoc.streaming.chains import pairs_of

KINDS = "chain_id string, version long, doc_id string, sha256 string"


def streamed(spark, tmp_path, batches):
    folder, out = tmp_path / "in", []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(str(folder / f"b{k:03d}"))
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    pairs_of(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_pairs_of_all_rows(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"c{c}", v, f"c{c}v{v}", rng.choice(["x", "y", "z"])) for c in range(5) for v in range(1, rng.randint(2, 7))]
    rows.sort(key=lambda r: (r[1], r[0]))  # chains side by side, each in order
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    got = streamed(spark, tmp_path, [rng.sample(b, len(b)) for b in batches])
    want = chain.consecutive(spark.createDataFrame(rows, KINDS)).collect()
    assert not any(r.late for r in got) and len(want) > 3
    assert sorted((r.chain_id, r.cmp_id, r.step, r.doc_a, r.doc_b) for r in got) == sorted((r.chain_id, r.cmp_id, r.step, r.doc_a, r.doc_b) for r in want)


def test_late_and_repeated_versions(spark, tmp_path):
    batches = [[("c", 2, "b", "2"), ("c", 1, "a", "1"), (None, 1, "n", "n")], [("c", 2, "b", "2"), ("c", 1, "old", "0"), ("c", 3, "c", "2")], [("c", 3, "again", "9"), ("c", 4, "d", None), ("c", 5, "e", None)]]
    got = [(r.cmp_id, r.doc_a, r.doc_b) for r in streamed(spark, tmp_path, batches) if not r.late]
    assert sorted(got) == [("c:0", "a", "b"), ("c:1", "b", "d"), ("c:2", "d", "e")]
