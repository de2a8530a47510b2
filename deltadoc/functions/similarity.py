"""String similarity by longest common subsequences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import DoubleType

from deltadoc import fixed
from deltadoc.functions import text as T

#: Pairs whose shorter text has up to this many words of 64 characters go through the arrays together, so many at once.
_WORDS, _TOGETHER = 4, 512


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of one string's characters at a time."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_lengths(pairs: list[tuple[str, str]]) -> list[int]:
    """``lcs_length`` of each pair. Pairs of short texts go through arrays together, a place of the arrays each.

    What both begin with is part of a longest common subsequence, so it is left out by eight characters at a time.
    """
    found, begin = [0] * len(pairs), [0] * len(pairs)
    short: dict[int, list[int]] = {}
    pairs = list(pairs)
    for k, (a, b) in enumerate(pairs):
        n, most = 0, min(len(a), len(b)) - 8
        while n <= most and a[n : n + 8] == b[n : n + 8]:
            n += 8
        if n:
            begin[k] = n
            a, b = pairs[k] = a[n:], b[n:]
        words = -(-min(len(a), len(b)) // 64)
        if words > _WORDS:
            found[k] = lcs_length(a, b)
        elif words:
            short.setdefault(words, []).append(k)
    for words, own in short.items():
        own.sort(key=lambda k: max(map(len, pairs[k])))
        for at in range(0, len(own), _TOGETHER):
            some = own[at : at + _TOGETHER]
            for k, n in zip(some, _lcs_together([sorted(pairs[k], key=len) for k in some], words)):
                found[k] = n
    return [n + m for n, m in zip(begin, found)]


def _lcs_together(pairs: list[list[str]], words: int) -> list[int]:
    """``lcs_length`` of pairs (shorter text first, of up to ``words`` times 64 characters), one character of all pairs at a time."""
    n = len(pairs)
    texts = [t for side in zip(*pairs) for t in side]
    lengths = np.fromiter(map(len, texts), np.int64, 2 * n)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(chars.max()) + 1, np.int64)
    seen[chars] = 1
    codes = np.cumsum(seen)[chars]  # from 1 on; 0 fills the rest of shorter texts
    kinds = int(seen.sum()) + 1
    at = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    which, end = np.repeat(np.arange(2 * n), lengths), int(lengths[:n].sum())
    spots = which % n * kinds + codes
    places = [np.zeros(n * kinds, np.uint64) for _ in range(words)]
    for w, own in enumerate(places):
        here = slice(0, end) if words == 1 else np.flatnonzero(at[:end] // 64 == w)
        np.add.at(own, spots[here], np.uint64(1) << (at[here] % 64).astype(np.uint64))
    steps = np.repeat(np.arange(n)[None] * kinds, int(lengths[n:].max()), axis=0)
    steps[at[end:], which[end:] - n] = spots[end:]
    rows = [np.full(n, ~np.uint64(0)) for _ in range(words)]
    for step in steps:
        over = None
        for w, old in enumerate(rows):
            hit = places[w].take(step)
            hit &= old
            total = old + hit
            if words > 1:
                carry = total < old
                if over is not None:
                    total += over
                    carry |= total < over
                over = carry.astype(np.uint64)
            hit ^= old
            total |= hit
            rows[w] = total
    left = lengths[:n]
    common = np.zeros(n, np.int64)
    for w, row in enumerate(rows):
        bits = np.clip(left - 64 * w, 0, 64)
        mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
        common += np.bitwise_count(~row & mask)
    return common.tolist()


def ratio_of(a: str, b: str) -> float:
    """The reference's ratio: that of the first 3000 characters. No query uses it; ``ratios_of`` compares whole texts."""
    return 1.0 if a == b else ratios_of([(a[: fixed.COMPARE_CHARS], b[: fixed.COMPARE_CHARS])])[0]


def ratios_of(pairs: list[tuple[str, str]]) -> list[float]:
    """Twice the common length over both lengths of each pair of whole texts; 1 for two empty ones."""
    open_ = [k for k, (a, b) in enumerate(pairs) if a != b and a and b]
    found = [1.0 if a == b else 0.0 for a, b in pairs]
    for k, n in zip(open_, lcs_lengths([pairs[k] for k in open_])):
        a, b = pairs[k]
        found[k] = 2 * n / (len(a) + len(b))
    return found


def partial_of(a: str, b: str) -> float:
    """The best ratio of the shorter string with windows of the longer one, half a window apart, and its end."""
    if not a or not b:
        return 0.0
    a, b = sorted((a, b), key=len)
    n, best = len(a), 0.0
    if n < len(b):
        for at in range(0, len(b) - n + 1, max(1, n // 2)):
            best = max(best, _ratio(a, b[at : at + n]))
            if best >= 0.999:
                return best
    return max(best, _ratio(a, b[-n:]))


def _ratio(a: str, b: str) -> float:
    return 1.0 if a == b else 2 * lcs_length(a, b) / (len(a) + len(b))


def _each_once(a: pa.Array, b: pa.Array, measure: Callable[[list[tuple[str, str]]], list[float]]) -> pa.Array:
    """``measure`` of a list of pairs, for each different pair of a batch: headings and clauses come back again and again."""
    left, right = a.dictionary_encode(), b.dictionary_encode()
    codes = [x.indices.fill_null(len(x.dictionary)).to_numpy().astype(np.int64) for x in (left, right)]
    size = len(right.dictionary) + 1
    once, places = np.unique(codes[0] * size + codes[1], return_inverse=True)
    texts = [[*x.dictionary.to_pylist(), None] for x in (left, right)]
    pairs = [(texts[0][x], texts[1][y]) for x, y in zip((once // size).tolist(), (once % size).tolist())]
    known = [k for k, (x, y) in enumerate(pairs) if x is not None and y is not None]
    found: list[float | None] = [None] * len(pairs)
    for k, value in zip(known, measure([pairs[k] for k in known])):
        found[k] = value
    return pa.array(found, pa.float64()).take(pa.array(places))


@arrow_udf(DoubleType())
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each_once(a, b, ratios_of)


@pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_of(x, y) for x, y in zip(a, b)], dtype="float64")


def sorted_words(text: Column) -> Column:
    return F.array_join(F.sort_array(T.words(text)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_words(a), sorted_words(b))


def word_set(text: Column) -> Column:
    return F.sort_array(F.array_distinct(T.words(text)))


def set_ratios_of(pairs: list[tuple[str, str]]) -> list[float]:
    """The best ratio of the shared words with either side, and of both sides; a text is a sorted set of words, joined by blanks.

    Both sides begin with the shared words, whose length both have in common, so only the other words are searched.
    """
    words = {t: frozenset(t.split(" ")) if t else frozenset() for t in {t for p in pairs for t in p}}
    found, rests = [], []
    for a, b in pairs:
        left, right = words[a], words[b]
        shared = left & right
        if not left or not right:
            found.append(1.0 if a == b else 0.0)
        elif not shared:
            found.append((0, 0))
            rests.append((a, b))
        elif len(shared) in (len(left), len(right)):
            found.append(1.0)
        else:
            base = len("".join(shared)) + len(shared) - 1
            found.append((base, base + 1))
            rests.append((" ".join(sorted(left - shared)), " ".join(sorted(right - shared))))
    lengths = iter(zip(rests, lcs_lengths(rests)))
    for k, made in enumerate(found):
        if isinstance(made, tuple):
            (base, begin), ((x, y), n) = made, next(lengths)
            left, right = begin + len(x), begin + len(y)
            found[k] = max(2 * base / (base + min(left, right)), 2 * (begin + n) / (left + right))
    return found


@arrow_udf(DoubleType())
def set_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """``token_set_ratio`` of sets whose words are joined by blanks."""
    return _each_once(a, b, set_ratios_of)


#: Spark may not put a filter on the result in front of it, where the measure would be taken twice.
set_ratio = set_ratio.asNondeterministic()


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio of the shared words with either side, and of both sides; ``a`` and ``b``: ``word_set``s."""
    return set_ratio(F.array_join(a, " "), F.array_join(b, " "))


def family_of(heading: Column) -> Column:
    """Numbers of the families that a normalized heading belongs to."""
    hits = []
    for k, family in enumerate(fixed.HEADING_FAMILIES):
        inside = [F.contains(heading, F.lit(t)) for t in family if len(t) > 4]
        hit = heading.isin(*family)
        for x in inside:
            hit = hit | x
        hits.append(F.when(hit, F.lit(k)))
    return F.array_compact(F.array(*hits))


def heading_similarity(a: Column, b: Column) -> Column:
    """1 for equal headings, 0.5 for two empty ones; a shared family gives at least 0.9."""
    words = lambda x: F.array_join(word_set(x), " ")
    return heading_score(a, b, (words(a), family_of(a)), (words(b), family_of(b)))


def heading_score(a: Column, b: Column, of_a: tuple[Column, Column], of_b: tuple[Column, Column]) -> Column:
    """``heading_similarity`` from each heading's ``word_set``, joined by blanks, and ``family_of``, where those are columns already."""
    family = F.when(F.arrays_overlap(of_a[1], of_b[1]), 0.9).otherwise(0.0)
    return (
        F.when((a == "") & (b == ""), 0.5).when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
        .otherwise(F.greatest(set_ratio(of_a[0], of_b[0]), family))
    )


def position_similarity(order_a: Column, n_a: Column, order_b: Column, n_b: Column) -> Column:
    at = lambda o, n: o / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.0), 1 - F.abs(at(order_a, n_a) - at(order_b, n_b)) * 2)


def numbering_similarity(a: Column, b: Column) -> Column:
    pa, pb = F.split(a, r"\."), F.split(b, r"\.")
    tail = lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.size(pa) != F.size(pb), 0.1)
        .when((F.size(pa) > 1) & (tail(pa) == tail(pb)), 0.7).otherwise(0.2)
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / F.greatest(either, F.lit(1))).otherwise(0.0)


def lexical_similarity(a: Column, b: Column) -> Column:
    """Of match keys: the better of the plain ratio and 0.95 of the sorted one; an equal start of three words
    or more leaves it to the tails."""
    ta, tb = T.tokens(a), T.tokens(b)
    return lexical_score((a, sorted_words(a), ta), (b, sorted_words(b), tb), common_start(ta, tb))


def common_start(ta: Column, tb: Column) -> Column:
    """How many tokens both begin with."""
    same = F.zip_with(ta, tb, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shorter = F.least(F.size(ta), F.size(tb))
    return T.once(F.array_position(same, False) - 1, lambda first: F.when(first < 0, shorter).otherwise(F.least(first, shorter)).cast("int"))


def lexical_score(of_a: tuple[Column, Column, Column], of_b: tuple[Column, Column, Column], prefix: Column) -> Column:
    """``lexical_similarity`` from each key, its ``sorted_words`` and its tokens, and their ``common_start``, where those are columns already."""
    (a, sorted_a, ta), (b, sorted_b, tb) = of_a, of_b
    open_ = (prefix >= 3) & (prefix < F.least(F.size(ta), F.size(tb)))
    cut = lambda t: F.when(open_, F.array_join(F.slice(t, prefix + 1, F.size(t)), " "))
    base = F.greatest(ratio(a, b), ratio(sorted_a, sorted_b) * 0.95)
    return F.least(base, ratio(cut(ta), cut(tb)))  # null, which counts for nothing, where the start isn't equal
