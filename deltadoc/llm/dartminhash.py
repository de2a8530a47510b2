"""Near copies by DartMinHash signatures, banded joining and an exact check.

A document is a weighted set of shingles (five lower-case words; a shorter text is one shingle). Each element
has a plane of weight and rank on which darts land at random, one for each unit of area on average, always
the same ones. Those below the element's weight and the document's rank limit hit it; each dart has one of
``k`` coordinates, and each coordinate keeps its dart of the lowest rank. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. About k (ln k + 4) darts hit a
document of any length; one that has an empty coordinate is thrown at again with twice the rank limit.

Rows with equal words are one class from the start, whatever their ids, and each class of words has a number
of its own. Bands of coordinates give buckets of candidates:

1. Each bucket is a star around its member that meets most others in all of its buckets. Stars' edges of
   similar signatures are checked on the whole sets of shingles; links give components.
2. Where a bucket still holds several components, its members of different components are compared in
   blocks of bounded size, by signature and then by their sets. Members of its largest component meet the
   others only.

So a group of copies costs a star, not all pairs, and yet no candidate pair of different components is left out.
A bucket or a star's centre that has more than a thousandth of the rows meets its row by a broadcast of at most
a thousand rows, so that none is gathered in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltadoc.llm.common import spread_join, written
from deltadoc.llm.tokens import slices

SHINGLE = 5
SIMILARITY = 0.8
K, ROWS = 128, 4
MARGIN = 0.3
_HASH = np.uint64((1 << 48) - 1)
_u64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _u64(30))
    x = x * _u64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _u64(27))
    x = x * _u64(0x94D049BB133111EB)
    return x ^ (x >> _u64(31))


_rng = np.random.default_rng(20200505)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _u64(1)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(13)])


def words_of(text: str | None) -> bytes:
    """The text's lower-case words, each followed by a blank."""
    words = (text or "").lower().split()
    return (" ".join(words) + " ").encode("utf-8", "surrogatepass") if words else b""


def shingles(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the document and hash (64 bits) of each shingle of ``words_of`` texts, with repeats."""
    raw = np.frombuffer(b"".join(docs), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - starts + 1
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    power = _PLACE[place & 63] + place.astype(np.uint64) * _PLACE[7]
    word = mix(np.add.reduceat(_BYTE[raw] * (power | _u64(1)), starts))
    sizes = np.array([d.count(b" ") for d in docs])
    doc = np.repeat(np.arange(len(docs)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(word)) - begin[doc]
    size = sizes[doc]
    total = np.zeros(len(word), np.uint64)
    for j in range(min(SHINGLE, len(word))):
        n = len(word) - j
        total[:n] += np.where((at + j < size)[:n], word[j:] * _PLACE[j + 8], _u64(0))
    keep = (at + SHINGLE <= size) | (at == 0)
    return doc[keep], mix(total[keep])


def weighted(doc: np.ndarray, element: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, element's lower 48 bits), sorted, with weight 1 (``set``) or how often it occurs (``count``)."""
    key, n = np.unique(doc.astype(np.uint64) << _u64(48) | element & _HASH, return_counts=True)
    return (key >> _u64(48)).astype(np.int64), key & _HASH, np.ones(len(key)) if weights == "set" else n.astype(float)


def throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = K, seed: int = 1) -> np.ndarray:
    """The lowest dart of each coordinate, (docs, k) numbers that are equal where darts are; 0 without elements.

    An element's plane is cut into unit squares; a square's hash gives its number of darts (Poisson with
    mean 1) and their places.
    """
    best = np.zeros((docs, k), np.uint64)
    mass = np.bincount(doc, weight, docs) if len(doc) else np.zeros(docs)
    limit = np.where(mass > 0, k * (math.log(k) + 4) / np.maximum(mass, 1e-300), 0.0)
    open_ = mass > 0
    while open_.any():
        rows = np.flatnonzero(open_[doc])
        got = np.full(docs * k, np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(rows), 200_000):
            _darts(doc, element, weight, limit, rows[a : a + 200_000], got, k, seed)
        got = got.reshape(docs, k)
        full = open_ & (got != np.iinfo(np.uint64).max).all(axis=1)
        best[full] = mix(got[full])
        open_ &= ~full
        limit[open_] *= 2
    return best


def _darts(doc, element, weight, limit, rows, got, k, seed):
    d, e, w = doc[rows], element[rows], weight[rows]
    across, up = np.ceil(w).astype(np.int64), np.ceil(limit[d]).astype(np.int64)
    cells = across * up
    for a, z in _parts(cells, 400_000):
        n = cells[a:z]
        which = np.repeat(np.arange(a, z), n)
        number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = number % up[which], number // up[which]
        cell = mix(e[which] + mix((i.astype(np.uint64) << _u64(20)) + j.astype(np.uint64) + _u64(seed << 50)))
        darts = np.searchsorted(_POISSON, (cell >> _u64(11)).astype(np.float64) * 2.0**-53, side="right")
        which, i, j, cell = (np.repeat(x, darts) for x in (which, i, j, cell))
        x = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell + (x.astype(np.uint64) + _u64(1)) * _PLACE[20])
        rank = i + (dart >> _u64(32)).astype(np.float64) * 2.0**-32
        high = j + (dart & _u64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        hit = (rank < limit[d[which]]) & (high < w[which])
        dart, rank = mix(dart[hit] ^ _PLACE[21]), rank[hit]
        place = d[which[hit]] * k + (dart % _u64(k)).astype(np.int64)
        order = (rank * 2.0**20).astype(np.uint64) << _u64(22) | dart >> _u64(42)
        np.minimum.at(got, place, order)


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


def band_hashes(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows) * _PLACE[24 : 24 + rows]
    return mix(parts.sum(axis=2, dtype=np.uint64) + np.arange(k // rows, dtype=np.uint64) * _PLACE[23])


def signatures(docs: DataFrame, *, k: int = K, rows: int = ROWS, weights: str = "set", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, words_key (of the words in order; null without words), bands, sig (a byte of each coordinate) and ``keep``."""
    from pyspark.sql import types as Y

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, texts in slices(b.column(1)):
                words = [words_of(t) for t in texts]
                keys = [hashlib.blake2b(w, digest_size=16).digest() if w else None for w in words]
                s = throw(*weighted(*shingles(words), weights), len(words), k)
                bands = band_hashes(s, rows).view(np.int64)
                full = np.array([bool(w) for w in words])
                flat = pa.array(bands[full].reshape(-1))
                offsets = np.concatenate([[0], np.cumsum(np.where(full, k // rows, 0))]).astype(np.int32)
                small = (s >> _u64(7)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([x.tobytes() for x in small], pa.binary()), *[c.slice(a, z - a) for c in b.columns[2:]]],
                    names=["doc_id", "words_key", "bands", "sig", *keep],
                )

    rest = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    made = [("doc_id", Y.LongType()), ("words_key", Y.BinaryType()), ("bands", Y.ArrayType(Y.LongType())), ("sig", Y.BinaryType())]
    return rest.mapInArrow(run, Y.StructType([Y.StructField(n, t) for n, t in made] + rest.schema.fields[2:]))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures of one byte a coordinate, of which 1 in 256 agrees by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _similar(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures' estimate is at least ``least``."""
    centres = written(pairs.groupBy("a").agg(F.count("*").alias("n")).join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("_sa")), "a"))
    both = spread_join(pairs, centres, "a", pairs.count()).join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("_sb")), "b")

    def run(batches):
        for x in batches:
            if x.num_rows:
                sa, sb = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint8).reshape(x.num_rows, -1) for i in (2, 3))
                yield x.select(["a", "b"]).filter(pa.array(alike(sa, sb) >= least))

    return both.select("a", "b", "_sa", "_sb").mapInArrow(run, "a long, b long")


def checked(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, star: int = 256) -> DataFrame:
    """Pairs (a, b) whose ``sets`` of shingles have a Jaccard similarity of at least ``similarity``.

    A pair's first set is sent once for each ``star`` of its pairs, its second one once a pair. Both sides of
    these joins grow with the corpus, so they are merged and never broadcast.
    """
    sets = sets.select(F.col("key").alias("_id"), "own").hint("merge")
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / star).cast("int").alias("_n"))
    rays = pairs.join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_n")).cast("int").alias("_s"))
    rays = rays.join(sets, F.col("b") == F.col("_id")).select("a", "_s", "b", "own")
    centres = stars.join(sets, F.col("a") == F.col("_id")).select("a", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_s"), F.lit(None).cast("long").alias("b"), "own")
    rows = centres.unionByName(rays).repartition("a", "_s").sortWithinPartitions("a", "_s", F.col("b").asc_nulls_first())

    def run(batches):
        centre, mine = None, np.empty(0, "<u8")
        for x in batches:
            found = []
            for a, s, b, own in zip(*(x.column(i).to_pylist() for i in range(3)), x.column(3)):
                its = np.frombuffer(own.as_py(), "<u8")
                if b is None:
                    centre, mine = (a, s), its
                elif centre == (a, s):
                    both = int((mine[np.minimum(np.searchsorted(mine, its), len(mine) - 1)] == its).sum())
                    if both >= similarity * (len(mine) + len(its) - both) - 1e-9:
                        found.append((a, b))
            yield _pairs(found)

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """key and class_key (the least key of its component) of each key in ``links`` (a, b).

    Each round sends every key's neighbours to the least of them, first the larger ones and then the smaller
    ones, until nothing changes; the rounds follow the logarithm of the longest chain.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, now = None, state(edges)
    while now != before:
        before, total = now, 2 * now[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = written(spread_join(both, least, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, "u", total)
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = state(edges)
    return edges.select(F.col("u").alias("key"), F.col("v").alias("class_key")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("class_key")).distinct())


def across(members: DataFrame, sigs: DataFrame, sets: DataFrame, similarity: float, least: float, block: int = 512) -> DataFrame:
    """Similar pairs (a < b) of a bucket (bucket, key, class_key) in different classes.

    A bucket's largest class and its other members are cut into blocks of about ``block`` each. Two blocks
    of others, and a block of the largest class with one of others, are compared by a task that holds
    nothing else. A pair is looked at in the first band that it shares only: first its signatures, then,
    if their estimate is at least ``least``, its ``sets`` of shingles.
    """
    of = members.groupBy("bucket", "class_key").agg(F.count("*").alias("c"))
    largest = F.max(F.struct("c", "class_key"))
    sized = of.groupBy("bucket").agg(largest["class_key"].alias("_first"), largest["c"].alias("_c"), F.sum("c").alias("n"))
    parts = lambda x: F.ceil(x / block).cast("int")
    sized = written(sized.select("bucket", "_first", parts(F.col("_c")).alias("_nf"), parts(F.col("n") - F.col("_c")).alias("_no"), "n"))
    rows = spread_join(members, sized, "bucket", members.count())
    inner, deal = F.col("class_key") == F.col("_first"), lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    rows = rows.withColumn("_i", F.when(inner, F.col("_no") + deal(F.col("_nf"))).otherwise(deal(F.col("_no"))))
    rows = rows.join(sigs.select("key", "sig", "bands"), "key").join(sets.hint("merge"), "key")
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.when(inner, F.col("_no")).otherwise(F.col("_no") + F.col("_nf")) - 1)))
    rows = rows.select("bucket", F.least("_i", "_j").alias("_x"), F.greatest("_i", "_j").alias("_y"), "_i", "key", "class_key", "sig", "bands", "own")
    rows = rows.repartition("bucket", "_x", "_y").sortWithinPartitions("bucket", "_x", "_y", "key")

    def compare(part: pa.Table) -> Iterator[tuple[int, int]]:
        bucket, x, y = (part.column(n)[0].as_py() for n in ("bucket", "_x", "_y"))
        ids, cls, i = (part.column(n).to_numpy() for n in ("key", "class_key", "_i"))
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = part.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        own = [np.frombuffer(s, "<u8") for s in part.column("own").to_pylist()]
        left, right = np.flatnonzero(i == x), np.flatnonzero(i == y)
        for a in range(0, len(left), 64):
            p = left[a : a + 64]
            near = (cls[p][:, None] != cls[right][None, :]) & (ids[p][:, None] != ids[right][None, :])
            if x == y:
                near &= ids[p][:, None] < ids[right][None, :]
            if not near.any():
                continue
            near &= alike(sig[p][:, None, :], sig[right][None, :, :]) >= least
            first = (bands[p][:, None, :] == bands[right][None, :, :]).argmax(axis=2)
            near &= bands[p][np.arange(len(p))[:, None], first] == bucket
            for u in np.flatnonzero(near.any(axis=1)):
                mine, some = own[p[u]], right[near[u]]
                sizes = np.array([len(own[v]) for v in some])
                theirs = np.concatenate([own[v] for v in some])
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(sizes) - sizes)
                for v in some[both >= similarity * (len(mine) + sizes - both) - 1e-9]:
                    yield tuple(sorted((int(ids[p[u]]), int(ids[v]))))

    def run(batches):
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            now = now if held is None else pa.concat_tables([held, now])
            keys = [now.column(n).to_numpy() for n in ("bucket", "_x", "_y")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [0, *cut.tolist()]
            yield _pairs(p for a, z in zip(edges, edges[1:]) for p in compare(now.slice(a, z - a)))
            held = now.slice(edges[-1]).combine_chunks()
        if held is not None:
            yield _pairs(compare(held))

    return rows.mapInArrow(run, "a long, b long").distinct()


def sets_of(texts: DataFrame, weights: str = "set") -> DataFrame:
    """key and ``own``: its distinct shingles as sorted hashes of 64 bits. Texts without words are left out.

    With ``count`` the n-th occurrence of a shingle is an element of its own, so that the Jaccard similarity
    of two sets is the weighted one of their counts.
    """

    def elements(found: np.ndarray) -> np.ndarray:
        if weights == "set":
            return np.unique(found)
        found = np.sort(found)
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        times = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
        return np.unique(mix(found + times.astype(np.uint64) * _PLACE[22]))

    def run(batches):
        for x in batches:
            keys = x.column(0).to_numpy()
            x = x.filter(pa.array(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]])))  # equal rows
            keys = x.column(0).to_pylist()
            for a, z, texts in slices(x.column(1)):
                doc, element = shingles([words_of(t) for t in texts])
                edge = np.searchsorted(doc, np.arange(z - a + 1))
                sets = [(keys[a + k], elements(element[edge[k] : edge[k + 1]]).astype("<u8").tobytes()) for k in range(z - a) if edge[k] < edge[k + 1]]
                yield pa.RecordBatch.from_pydict({"key": pa.array([i for i, _ in sets], pa.int64()), "own": pa.array([s for _, s in sets], pa.binary())})

    return texts.select("key", "text").mapInArrow(run, "key long, own binary")


def _pairs(pairs: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    found = list(dict.fromkeys(pairs))
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def classes(docs: DataFrame, *, similarity: float = SIMILARITY, k: int = K, rows: int = ROWS, margin: float | None = MARGIN, weights: str = "set", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, exact_id, class_id and class_key of each row of ``docs`` (doc_id, text).

    Rows are classed by their texts, so rows of one id with different texts may be of different classes.
    exact_id is the least id with the same words, class_id the least id of the component of links, and
    class_key its number, which is null for a text without words.
    """
    its_text = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_text")
    signed = written(signatures(docs.select("doc_id", "text", *keep, its_text), k=k, rows=rows, weights=weights, keep=(*keep, "_text")))
    worded = signed.where("words_key is not null")
    one = F.min_by(F.struct("doc_id", "_text", "bands", "sig"), F.struct(F.col("doc_id").isNull(), "doc_id", "_text"))
    exact = worded.groupBy("words_key").agg(F.min("doc_id").alias("exact_id"), one.alias("s"), F.count("*").alias("n"))
    exact = written(exact.withColumn("key", F.monotonically_increasing_id()))
    sigs = exact.select("key", "s.bands", "s.sig")
    posted = sigs.select("key", F.explode("bands").alias("bucket"))
    shared = written(posted.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    distinct = exact.count()
    members = written(spread_join(posted, shared, "bucket", distinct * (k // rows)))
    size = members.count()
    met = members.groupBy("key").agg(F.sum("n").alias("met"))
    stars = written(members.join(met, "key").groupBy("bucket").agg((-F.max(F.struct("met", (-F.col("key")).alias("key"))).getField("key")).alias("a"), F.count("*").alias("n")))
    rays = written(spread_join(members.drop("n"), stars, "bucket", size).where("a != key").select("a", F.col("key").alias("b")).distinct())
    near = rays if margin is None else written(_similar(rays, sigs, similarity - margin))
    some = exact.select("key", F.col("s.doc_id").alias("_id"), F.col("s._text").alias("_its")).join(members.select("key").distinct(), "key", "left_semi").hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", its_text)  # other columns may have any names
    sets = written(sets_of(texts.join(some, texts.doc_id.eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_its"))), weights))
    links = written(checked(near, sets, similarity))
    first = components(links)
    classed = written(members.join(first, "key", "left").select("bucket", "key", F.coalesce("class_key", "key").alias("class_key")))
    mixed = written(classed.groupBy("bucket").agg(F.min("class_key").alias("lo"), F.max("class_key").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("bucket", "n"))
    late = written(across(written(spread_join(classed, mixed, "bucket", size).drop("n")), sigs, sets, similarity, -1.0 if margin is None else similarity - margin))
    final = components(links.unionByName(late)) if not late.isEmpty() else first
    found = exact.select("words_key", "exact_id", "n", "key").join(final, "key", "left").withColumn("class_key", F.coalesce("class_key", "key"))
    least = found.groupBy("class_key").agg(F.min("exact_id").alias("class_id"), F.count("*").alias("n"))
    found = written(spread_join(found.drop("key").withColumnRenamed("n", "_n"), least, "class_key", distinct).drop("n").withColumnRenamed("_n", "n"))
    out = spread_join(worded.select("doc_id", "words_key", *keep), found, "words_key", signed.count())
    named = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    lone = signed.where("words_key is null").select("doc_id", *keep, F.col("doc_id").alias("exact_id"), F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("class_key"))
    return out.select("doc_id", *keep, named("exact_id"), named("class_id"), "class_key").unionByName(lone)


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, exact_id and class_id of each row of ``docs`` (doc_id, text); other columns are left out.

    exact_id is the least id with the same words, class_id the least id of the component of links. A text
    without words is alone. Rows with null ids link others, but have null for both. Options: ``similarity``; ``k``
    and ``rows``, the coordinates and how many a band has; ``weights``, ``set`` or ``count`` of shingles;
    ``margin``, how far below ``similarity`` a signature's estimate may lie before a pair is dropped
    unchecked (None: each pair of a bucket is checked).
    """
    return classes(docs, **options).select("doc_id", "exact_id", "class_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near copies: of each class the row of the least id stays, and each text without words.

    Of rows equal in id and text one stays. Rows without an id stay if their class has no row with one.
    """
    name = "_row"
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.withColumn(name, key)
    found = classes(rows.select("doc_id", "text", name), keep=(name,), **options)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", name))[name].alias(name)
    first = found.where("class_key is not null").groupBy("class_key").agg(best).select(name).unionByName(found.where("class_key is null").select(name).distinct())
    return rows.join(first, name, "left_semi").dropDuplicates([name]).drop(name)


def op8_dartminhash(spark, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
