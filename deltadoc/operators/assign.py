"""One-to-one assignment of scored pairs: the best total, or the best pair first.

The best assignment has the greatest total margin above a threshold, so a row may stay alone rather than take a
poor partner. Pairs that rival no other pair are settled by joins; only rows with several candidates
reach the solver, a group at a time or, where a group has many candidates, by its connected parts. The solver
holds a part's candidates and nothing in proportion to rows times columns. A row or column may stand for
several equal ones (its room).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from deltadoc.operators.cut import cut

#: Candidates up to which a group is solved whole; parts of a group don't touch, so the result is the same.
WHOLE = 1000


def solve(rows: list[int], columns: list[int], margin: list[float], room_a: list[int], room_b: list[int]) -> list[int]:
    """How often each pair (rows[i], columns[i]) of margin[i] is taken, so that the total margin is greatest.

    Row r is taken room_a[r] times at most, column c room_b[c] times. Rows are added one by one along the
    cheapest path that ends at a column with room or at a row that is better left alone. Prices keep all reduced
    costs positive, so a path is found with a heap over the pairs that it meets. Of equal ends the column
    with room, then the first one, is taken; a margin of 0 is better than none.
    """
    cost = [-m for m in margin]
    near: list[list[int]] = [[] for _ in room_a]
    for i in sorted(range(len(rows)), key=lambda i: (rows[i], columns[i])):
        near[rows[i]].append(i)
    base = [min((cost[i] for i in own), default=0.0) for own in near]
    price = [0.0] * len(room_b)
    left_b = list(room_b)
    times = [0] * len(rows)
    holders: list[dict[int, None]] = [{} for _ in room_b]  # the pairs by which a column is taken
    for start, left in enumerate(room_a):
        while left > 0 and near[start]:
            reach: dict[int, float] = {}
            came: dict[int, int] = {}
            at_row, by, done, heap = {start: 0.0}, {}, {}, []
            end, end_cost, found = start, -base[start], -1  # the start itself left alone
            row, so_far = start, 0.0
            while True:
                alone = so_far - base[row]
                if alone < end_cost:
                    end, end_cost = row, alone
                for i in near[row]:
                    c = columns[i]
                    if c in done:
                        continue
                    through = max(so_far, so_far + cost[i] - base[row] - price[c])
                    if through <= end_cost and through < reach.get(c, np.inf):
                        reach[c], came[c] = through, i
                        heappush(heap, (through, left_b[c] == 0, c))
                row = -1
                while heap:
                    # Rows that hold the column are met one by one; the column comes back until all are.
                    d, full, c = heappop(heap)
                    if d > end_cost or d > reach[c]:
                        continue
                    if not full:
                        found, end_cost = c, d
                        break
                    done[c] = d
                    new = next((i for i in holders[c] if rows[i] not in at_row), None)
                    if new is None:
                        continue
                    heappush(heap, (d, full, c))
                    row, so_far = rows[new], d
                    at_row[row], by[row] = d, new
                    break
                if row < 0:
                    break
            for r, d in at_row.items():
                if d < end_cost:
                    base[r] += end_cost - d
            for c, d in done.items():
                if d < end_cost:
                    price[c] -= end_cost - d
            if found < 0 and end == start:
                break
            path, more = [], left
            if found >= 0:
                more, c = min(more, left_b[found]), found
            else:
                path.append((by[end], -1))
                c = columns[by[end]]
            while True:
                path.append((came[c], 1))
                r = rows[came[c]]
                if r == start:
                    break
                path.append((by[r], -1))
                c = columns[by[r]]
            more = min([more, *[times[i] for i, sign in path if sign < 0]])
            for i, sign in path:
                times[i] += sign * more
                if times[i]:
                    holders[columns[i]][i] = None
                else:
                    holders[columns[i]].pop(i, None)
            if found >= 0:
                left_b[found] -= more
            left -= more
    return times


def components(rest: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """``rest`` with ``_part``, the same number for all pairs of a ``group`` that are linked by rivals.

    Ends of pairs are nodes, even for ``a`` and odd for ``b``. Each round sends every node's neighbours to
    the least of them, first the larger ones and then the smaller ones, until nothing changes.
    """
    node_a, node_b = F.col(a).cast("long") * 2, F.col(b).cast("long") * 2 + 1
    at = lambda u, v: [*group, u.alias("_u"), v.alias("_v")]
    u, v, m = F.col("_u"), F.col("_v"), F.col("_m")
    edges, before = cut(rest.select(*at(F.greatest(node_a, node_b), F.least(node_a, node_b))).distinct()), None
    while True:
        both = edges.unionByName(edges.select(*at(v, u)))
        least = both.groupBy(*group, "_u").agg(F.least(F.min("_v"), u).alias("_m"))
        large = both.join(least, [*group, "_u"]).where("_v > _u").select(*at(v, m)).where("_u != _v").distinct()
        low = large.groupBy(*group, "_u").agg(F.min("_v").alias("_m"))
        small = large.join(low, [*group, "_u"]).select(*at(v, m))
        edges = cut(small.unionByName(low.select(*at(u, m))).where("_u != _v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*group, "_u", "_v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    parts = edges.select(*group, u.alias("_node"), v.alias("_part"))
    return rest.withColumn("_node", node_a).join(parts, [*group, "_node"], "left").withColumn("_part", F.coalesce("_part", "_node")).drop("_node")


def assign(scored: DataFrame, group: list[str], a: str, b: str, score: str, threshold: float, *, room: tuple[str, str] | None = None, mode: str = "best") -> DataFrame:
    """The rows of ``scored`` that are assigned, one for each ``a`` and ``b`` of a ``group`` at most.

    ``a`` and ``b`` are numbers in document order within the group; of equal totals the solver takes earlier
    columns for earlier rows. ``room`` names two columns with how many equal rows an ``a`` and a ``b`` stand for;
    the result then has ``times``, how often a row is taken. Mode ``greedy`` takes the best score first (see
    ``greedy``) and has no rooms.
    """
    rows = scored.where(F.col(score) >= threshold)
    if mode == "greedy":
        return greedy(rows, group, a, b, score)
    room_a, room_b = room or ("_room_a", "_room_b")
    if not room:
        rows = rows.withColumns({room_a: F.lit(1), room_b: F.lit(1)})
    count = lambda c: F.count("*").over(Window.partitionBy(*group, c))
    rows = cut(rows.withColumn("_na", count(a)).withColumn("_nb", count(b)))
    lone = rows.where("_na = 1 and _nb = 1").withColumn("times", F.least(room_a, room_b).cast("int")).drop("_na", "_nb")
    rest = rows.where("_na > 1 or _nb > 1").drop("_na", "_nb")
    wide = rest.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE).drop("_n")
    parts = rest.withColumn("_part", F.lit(0).cast("long"))
    if not wide.isEmpty():
        many = components(rest.join(wide, group, "left_semi"), group, a, b).select(parts.columns)
        parts = parts.join(wide, group, "left_anti").unionByName(many)
    found = lone.unionByName(_solved(parts, [*group, "_part"], a, b, score, threshold, room_a, room_b).select(lone.columns))
    return found if room else found.drop(room_a, room_b, "times")


def _solved(parts: DataFrame, key: list[str], a: str, b: str, score: str, threshold: float, room_a: str, room_b: str) -> DataFrame:
    """The rows of ``parts`` that ``solve`` takes, with ``times``; each ``key`` is a problem of its own.

    Problems are small and many, so they stream through a task in order instead of being a frame each; a task
    holds a batch, or the one problem that is longer.
    """
    at = [parts.columns.index(c) for c in (a, b, score, room_a, room_b)]
    keys = [parts.columns.index(c) for c in key]

    def taken(batch: pa.RecordBatch, names: list[tuple]) -> pa.RecordBatch:
        left, right, scores, rooms_a, rooms_b = (batch.column(k).to_pylist() for k in at)
        which, often = [], []
        for _, own in groupby(range(len(names)), names.__getitem__):
            own = list(own)
            here_a, here_b = {left[i]: rooms_a[i] for i in reversed(own)}, {right[i]: rooms_b[i] for i in reversed(own)}
            no_a, no_b = ({x: k for k, x in enumerate(sorted(here))} for here in (here_a, here_b))
            times = solve([no_a[left[i]] for i in own], [no_b[right[i]] for i in own], [scores[i] - threshold for i in own], [here_a[x] for x in no_a], [here_b[x] for x in no_b])
            which += [i for i, n in zip(own, times) if n > 0]
            often += [n for n in times if n > 0]
        some = batch.take(pa.array(which, pa.int64()))
        return pa.RecordBatch.from_arrays([*some.columns, pa.array(often, pa.int32())], names=[*batch.schema.names, "times"])

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last problem so far
        name = lambda batch, i: tuple(batch.column(k)[i].as_py() for k in keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and name(held[0], 0) == name(batch, batch.num_rows - 1):
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            names = list(zip(*(whole.column(k).to_pylist() for k in keys)))
            end = len(names) - 1
            while end > 0 and names[end - 1] == names[-1]:
                end -= 1
            if end:
                yield taken(whole.slice(0, end), names[:end])
            held = [whole.slice(end)]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield taken(whole, [name(whole, 0)] * whole.num_rows)

    rows = parts.repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(walk, StructType([*parts.schema.fields, StructField("times", IntegerType())]))


def greedy(rows: DataFrame, group: list[str], a: str, b: str, score: str) -> DataFrame:
    """What is taken when pairs are gone through by falling score, then by ``a``, then by ``b``, and each takes both its ends.

    A pair that comes first among all pairs of its ``a`` and of its ``b`` is taken whatever else happens. So each
    round takes all such pairs and drops those that meet them; the first pair of a group is always one.
    """
    first = lambda end, other: F.row_number().over(Window.partitionBy(*group, end).orderBy(F.desc(score), other)) == 1
    hit = lambda end: F.max("_taken").over(Window.partitionBy(*group, end))
    rest, taken = rows, []
    while True:
        marked = rest.withColumn("_taken", first(a, b)).withColumn("_taken", F.col("_taken") & first(b, a))
        marked = cut(marked.withColumn("_hit_b", hit(b)).withColumn("_hit_a", hit(a)))
        taken.append(marked.where("_taken").select(rows.columns))
        rest = marked.where("not _hit_a and not _hit_b").select(rows.columns)
        if rest.isEmpty():
            break
    found = taken[0]
    for more in taken[1:]:
        found = found.unionByName(more)
    return found


def spread(found: DataFrame, members: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """``found`` (with ``times``, each ``a`` and ``b`` standing for several rows) as pairs of single rows.

    ``members``: group, side (A or B), ``rep`` (the number in ``a`` or ``b``) and n. A rep's rows are dealt in order
    to its partners in theirs.
    """
    def from_to(end: str, other: str) -> Column:
        return F.coalesce(F.sum("times").over(Window.partitionBy(*group, end).orderBy(other).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    turn = members.withColumn("_turn", F.row_number().over(Window.partitionBy(*group, "side", "rep").orderBy("n")))
    own = lambda side, end: turn.where(F.col("side") == side).select(*group, F.col("rep").alias(end), F.col("_turn").alias(f"_turn_{end}"), F.col("n").alias(f"_n_{end}"))
    rows = found.withColumn(f"_turn_{a}", from_to(a, b)).withColumn(f"_turn_{b}", from_to(b, a))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times"))))
    for side, end in (("A", a), ("B", b)):
        rows = rows.withColumn(f"_turn_{end}", (F.col(f"_turn_{end}") + F.col("_k")).cast("int")).join(own(side, end), [*group, end, f"_turn_{end}"])
        rows = rows.withColumn(end, F.col(f"_n_{end}"))
    return rows.select([c for c in found.columns if c != "times"])
