"""Nearest neighbours by a permutation index.

A bounded sample gives the pivots. A vector is represented by the order of its nearest pivots; the first
``prefix`` of them post it in their inverted files together with its rank. A query walks the files of its
own nearest pivots and sums the footrule distance of the two orders over the vectors posted there (a pivot
beyond a prefix counts as rank ``prefix``); the nearest ``share`` of a block's vectors are reranked by the
exact inner product.

Equal vectors are one entry with their smallest ids, so that copies neither fill the candidates nor cost more
than one. Entries are dealt into blocks of bounded size by a hash, and each block's files are built and
searched by a task of its own, so no pivot's file is ever gathered whole. Different queries go to every
block, in groups of a size that a task can hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltadoc.llm.common import spread_join, written


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part.

    Null ids and vectors, zero vectors, those with null or non-finite components and those whose length is
    not the most frequent one take no part.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0].n if sizes else 0))


def pivots(rows: DataFrame, count: int = 1024, sample: int = 4000, seed: int = 3) -> np.ndarray:
    """``count`` different vectors, to unit length, of a sample of at most ``sample`` rows by a hash of the id.

    The sample's distinct vectors are permuted at random, so a large group of copies gives one pivot at most.
    """
    taken = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).collect()
    x = np.array([r.embedding for r in taken], dtype=float)
    if not len(x):
        return x.reshape(0, 0)
    x = np.unique(x, axis=0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit[np.random.default_rng(seed).permutation(len(unit))[:count]]


def orders(x: np.ndarray, pivot: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest ``prefix`` pivots of each vector, nearest first; equal ones in order of their number."""
    out = np.empty((len(x), prefix), np.int32)
    for a in range(0, len(x), 2048):
        near = -(x[a : a + 2048] @ pivot.T)
        if prefix < len(pivot):
            least = np.partition(near, prefix - 1, axis=1)[:, prefix - 1 : prefix]
            few = near < least
            ties = (near == least) & (np.cumsum(near == least, axis=1) <= prefix - few.sum(axis=1, keepdims=True))
            some = np.nonzero(few | ties)[1].reshape(len(near), prefix)
            out[a : a + 2048] = np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)
        else:
            out[a : a + 2048] = np.argsort(near, axis=1, kind="stable")
    return out


class Block:
    """Inverted files of some vectors: those that have pivot ``p`` in their prefix, in turn, with their ranks."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, prefix: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x, self.pivot = ids[by_id], np.ascontiguousarray(x[by_id]), pivot
        self.prefix = min(prefix, len(pivot))
        posted = orders(self.x, pivot, self.prefix).reshape(-1)
        turn = np.argsort(posted, kind="stable")
        self.begin = np.searchsorted(posted[turn], np.arange(len(pivot) + 1))
        self.line, self.rank = (turn // self.prefix).astype(np.int32), (turn % self.prefix).astype(np.int16)

    def common(self, order: np.ndarray) -> np.ndarray:
        """Half of what each vector's footrule distance to a query's order is below the largest one.

        A common pivot with ranks r and s adds |r - s| where two lone ones add (prefix - r) + (prefix - s):
        twice prefix - max(r, s) less. Vectors that share no pivot have 0.
        """
        files = [slice(self.begin[p], self.begin[p + 1]) for p in order]
        less = [self.prefix - np.maximum(self.rank[f], r) for r, f in enumerate(files)]
        return np.bincount(np.concatenate([self.line[f] for f in files]), np.concatenate(less), len(self.ids))

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, share: float, least: int) -> list[tuple[int, int, float]]:
        """The ``k`` best of the candidates for each query; equal scores and distances: smaller ids first."""
        take, found = min(len(self.ids), max(least, int(share * len(self.ids)), k)), []
        line = np.arange(len(self.ids))
        for query_id, vector, order in zip(query_ids.tolist(), q, orders(q, self.pivot, self.prefix)):
            near = line
            if take < len(self.ids):
                key = self.common(order) * -len(self.ids) + line
                near = np.sort(np.argpartition(key, take - 1)[:take])
            score = np.einsum("ij,j->i", self.x[near], vector)
            best = np.argsort(-score, kind="stable")[:k] if len(near) <= 4 * k else self._top(score, k)
            found += [(query_id, i, s) for i, s in zip(self.ids[near[best]].tolist(), score[best].tolist())]
        return found

    @staticmethod
    def _top(score: np.ndarray, k: int) -> np.ndarray:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.argsort(-score[some], kind="stable")[:k]]


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id (the smallest of its copies), embedding and ids (the ``k`` smallest) of each different vector."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.select("vec_id", "embedding", F.row_number().over(first).alias("_n")).where(F.col("_n") <= k)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "embedding", "ids")


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, count: int = 1024, prefix: int = 48, share: float = 0.15,
    least: int = 400, block_rows: int = 16384, group_rows: int = 16384, seed: int = 3,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest by inner product.

    Both tables: vec_id, embedding, as ``usable`` gives them; no rows give no rows. A row with the query's
    id is no candidate, its copies are. Equal scores go to smaller ids, and rows of one id in ``vectors``
    are candidates each. ``share=1`` makes the search exact.
    """
    pivot = pivots(vectors, count, seed=seed)
    kinds = written(entries(vectors, k + 1))
    asked = written(queries.groupBy("embedding").agg(F.min("vec_id").alias("asked"), F.count("*").alias("n")))
    total = queries.count()
    names = written(spread_join(queries.select("vec_id", "embedding"), asked, "embedding", total).select(F.col("vec_id").alias("query_id"), "asked").distinct())
    blocks = max(1, -(-kinds.count() // block_rows))
    groups = max(1, -(-asked.count() // group_rows))
    deal = lambda c, n, s: F.pmod(F.xxhash64(c, F.lit(s)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = kinds.select("vec_id", "embedding", deal("vec_id", blocks, seed).alias("block")).withColumn("group", each(groups))
    right = asked.select(F.col("asked").alias("vec_id"), "embedding", deal("asked", groups, seed + 1).alias("group")).withColumn("block", each(blocks))
    schema = pa.schema([("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return t.column("vec_id").to_numpy(), flat.reshape(t.num_rows, -1)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        found = Block(*matrix(a), pivot, prefix).search(*matrix(b), k + 1, share, least)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [(), (), ()], schema.types)], schema=schema)

    got = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(search, "asked long, vec_id long, score double")
    best = lambda q: Window.partitionBy(q).orderBy(F.desc("score"), "vec_id")
    few = got.withColumn("_n", F.row_number().over(best("asked"))).where(F.col("_n") <= k + 1)
    full = few.join(kinds.select("vec_id", "ids"), "vec_id").groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("found"))  # k + 1 at most
    sized = written(full.join(asked.select("asked", "n"), "asked"))
    rows = spread_join(names, sized, "asked", total).select("query_id", F.explode("found").alias("f")).select("query_id", "f.score", F.explode("f.ids").alias("vec_id"))
    rows = rows.where("query_id != vec_id").withColumn("rank", F.row_number().over(best("query_id"))).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "vec_id", "score")


def op6_permindex(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    rows = written(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return nearest(rows, rows.where("vec_id % 20 = 0"))
