"""Audit of how far the sources of a language differ in their terms, by joint histograms of counts.

For a pair of sources of one language, a term matters only through its two counts. So the pair's terms are
tallied by (count, count): cells of two counts above zero come from the terms that both have, all others
follow from each source's own histogram of counts and the number of kept terms. The divergence of a cell is
then worked out once and weighed by how many terms it has.

Terms are counted in tasks over the raw bytes; the only rows that are shuffled are counts of (language,
source, term). All sums are of whole numbers; numerators that could pass 64 bits are decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltadoc.llm.common import written

LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
ADDED = 2
TOP = 10
#: A-Z to a-z; letters and bytes above 127 stay, all others part terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_CHUNK_BYTES = 1 << 22
_HELD_TERMS = 200_000
PAIRS_AT_ONCE = 1 << 21


def chunks(text: str) -> Iterator[list[bytes]]:
    """The terms of ``text`` in UTF-8, in order, a bounded list at a time."""
    data = text.encode().translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _CHUNK_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it) of ``docs`` (text, lang, source).

    Nulls are empty strings; each row is a document of its own. Tasks add up what they meet and pass it on
    before it grows beyond a bound.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, among) in held.items():
                terms = list(times)
                for a in range(0, len(terms), 50_000):
                    some = terms[a : a + 50_000]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.repeat(lang, len(some)), "source": pa.repeat(source, len(some)), "term": pa.array(some, pa.binary()).cast(pa.string()),
                        "n": pa.array([times[t] for t in some], pa.int64()), "docs": pa.array([among[t] for t in some], pa.int64()),
                    })
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                times, among = held.setdefault((lang, source), (Counter(), Counter()))
                met: set[bytes] = set()
                for terms in chunks(text):
                    times.update(terms)
                    met.update(terms)
                among.update(met)
            if sum(len(x) for x, _ in held.values()) > _HELD_TERMS:
                yield from out()
        yield from out()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*named).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column, *, added: int = ADDED, scale: int = SCALE) -> Column:
    """Smoothed share of a term, in whole parts of ``scale``."""
    top = (count.cast("decimal(18,0)") + F.lit(added).cast("decimal(4,0)")) * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, total + terms * added)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def joint_cells(lists: DataFrame, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """lang, one, other, x, y, terms: how many terms source ``one`` has x times and ``other`` y times, both above 0.

    ``lists``: lang and counts, the (sid, n) of one term's sources in order of sid; sources are met within
    a term's list in numpy, in slices of a bounded number of pairs, and leave as tallies of cells only.
    """

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            counts = batch.column(1)
            offsets = counts.offsets.to_numpy()
            size = np.diff(offsets)
            cells = counts.flatten()
            sid, n = (cells.field(k).to_numpy() for k in (0, 1))
            of = np.repeat(lang.indices.to_numpy(), size)
            places, place = np.unique(np.stack([of, sid]), axis=1, return_inverse=True)
            values, value = np.unique(n, return_inverse=True)
            after = np.repeat(np.cumsum(size), size) - np.arange(len(n)) - 1  # partners behind each cell in its list
            upto = np.cumsum(after)
            at, wide = 0, max(1, len(values))
            while at < len(n):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, "right")))
                times = after[at:end]
                one = np.repeat(np.arange(at, end), times)
                other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
                pairs, code = np.unique(place.ravel()[one] * places.shape[1] + place.ravel()[other], return_inverse=True)
                left, code = np.unique(code * wide + value[one], return_inverse=True)  # codes stay below the pairs at once
                met, terms = np.unique(code * wide + value[other], return_counts=True)
                of_left = left[met // wide]
                which, x, y = pairs[of_left // wide], of_left % wide, met % wide
                a, b = which // places.shape[1], which % places.shape[1]
                yield pa.RecordBatch.from_pydict({
                    "lang": lang.dictionary.take(pa.array(places[0][a])), "one": pa.array(places[1][a], pa.int64()), "other": pa.array(places[1][b], pa.int64()),
                    "x": pa.array(values[x], pa.int64()), "y": pa.array(values[y], pa.int64()), "terms": pa.array(terms, pa.int64()),
                })
                at = end

    met = lists.where(F.size("counts") > 1).select("lang", "counts").mapInArrow(tally, "lang string, one long, other long, x long, y long, terms long")
    return met.groupBy("lang", "one", "other", "x", "y").agg(F.sum("terms").alias("terms"))


def audit(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source; other columns are left out).

    Part ``pair``: every other source of the language with the divergence summed over all kept terms. Part
    ``term``: the ``top`` terms that the source has more often than the language as a whole. A term is kept
    if at least ``least`` documents of the language have it. Nulls are empty strings; an empty table gives
    no rows, sources without terms still have their pairs, and one source alone has none. Ties go by item in
    order of UTF-8 bytes. Repeated rows count again.

    A term's list of counts has as many entries as the language has sources, like the rows of each source in
    the result.
    """
    counts = written(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least).drop("docs")
    cells = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"))
    langs = cells.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_n"])
    groups = written(groups.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")))
    cells = cells.join(groups, ["lang", "source"])

    lists = cells.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("sid", "n"))).alias("counts"))
    joint = joint_cells(lists)
    own = cells.groupBy("lang", "sid", "n").agg(F.count("*").alias("terms"))
    end = lambda name: groups.select("lang", "v", F.col("sid").alias(name), F.col("source").alias(f"source_{name}"), F.col("total").alias(f"total_{name}"))
    pairs = written(end("one").join(end("other").drop("v"), "lang").where("one < other"))  # as many as the result has
    key, none = ["lang", "one", "other"], F.lit(0).cast("long")
    cell = lambda x, y, n: F.struct(x.alias("x"), y.alias("y"), n.alias("terms"))
    x, y, n = F.col("x"), F.col("y"), F.col("terms")
    # A term in both is in one cell of the two and leaves the cells of one zero that the sources' own histograms put it in.
    both = joint.select(*key, F.explode(F.array(cell(x, y, n), cell(x, none, -n), cell(none, y, -n), cell(none, none, n))).alias("c"))
    parts = [both, pairs.select(*key, cell(none, none, F.col("v")).alias("c"))]
    for side in ("one", "other"):
        m = F.col("n")
        alone = cell(m, none, n) if side == "one" else cell(none, m, n)
        parts.append(pairs.select(*key).join(own.withColumnRenamed("sid", side), ["lang", side]).select(*key, F.explode(F.array(alone, cell(none, none, -n))).alias("c")))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    table = table.select(*key, "c.*").groupBy(*key, "x", "y").agg(F.sum("terms").alias("terms")).where("terms != 0")
    valued = table.join(pairs, key).withColumn("_f", divergence(share(F.col("x"), F.col("total_one"), F.col("v")), share(F.col("y"), F.col("total_other"), F.col("v"))))
    summed = valued.groupBy(*key).agg(F.sum(F.col("_f") * F.col("terms")).alias("value"))
    found = pairs.join(summed, key, "left").withColumn("value", F.coalesce("value", none))
    ways = F.array(*[F.struct(F.col(f"source_{a}").alias("source"), F.col(f"source_{b}").alias("item")) for a, b in (("one", "other"), ("other", "one"))])
    found = found.select("lang", "value", F.explode(ways).alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("all_n"), F.col("lang_n"), F.col("v"))
    terms = cells.withColumn("_p", p).withColumn("_q", q).where("_p > _q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("_p"), F.col("_q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(found).unionByName(ranked(terms).where(F.col("rank") <= top))


def op13_audit(spark, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and its ten most telling terms."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
