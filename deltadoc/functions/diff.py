"""Word differences of two aligned texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.functions import pandas_udf

from deltadoc.functions.similarity import partial_of

OPS = K.ArrayType(K.StructType([K.StructField(n, K.StringType()) for n in ("op", "a", "b")]))
_piece = re.compile(r"\s+|\S+")


def _steps(a: list[str], b: list[str]) -> str:
    """One letter for each step from the start of both sequences: = for both, - for ``a`` only, + for ``b`` only.

    Equal items are always taken together; else ``a`` goes on where that loses nothing of the longest common
    subsequence. Of each end of ``a`` the bits of one integer say how that subsequence grows along ``b``.
    """
    n, m = len(a), len(b)
    places: dict[str, int] = {}
    for k, x in enumerate(reversed(b)):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << m) - 1
    rows = [full] * (n + 1)
    for i in range(n - 1, -1, -1):
        row = rows[i + 1]
        hit = row & places.get(a[i], 0)
        rows[i] = (row + hit | row - hit) & full
    common = lambda i, j: m - j - (rows[i] & (1 << m - j) - 1).bit_count()
    i = j = 0
    steps = []
    while i < n and j < m:
        if a[i] == b[j]:
            steps.append("=")
            i, j = i + 1, j + 1
        elif common(i + 1, j) >= common(i, j + 1):
            steps.append("-")
            i += 1
        else:
            steps.append("+")
            j += 1
    return "".join(steps) + "-" * (n - i) + "+" * (m - j)


def word_diff_of(a: str, b: str) -> list[tuple[str, str, str]]:
    """Runs (op, text in a, text in b) that rebuild both texts; case doesn't count as a difference."""
    left, right = _piece.findall(a), _piece.findall(b)
    names = {"=": "equal", "-": "delete", "+": "insert"}
    out: list[list[str]] = []
    i = j = 0
    for run in re.findall(r"=+|-+|\++", _steps([x.lower() for x in left], [x.lower() for x in right])):
        op = names[run[0]]
        x = "".join(left[i : i + len(run)]) if op != "insert" else ""
        y = "".join(right[j : j + len(run)]) if op != "delete" else ""
        i, j = i + len(run) * (op != "insert"), j + len(run) * (op != "delete")
        last = out[-1] if out else None
        gap = last and last[0] == "equal" and not last[1].strip() and len(out) > 1
        if last and (last[0], op) == ("delete", "insert"):
            last[0], last[2] = "replace", y
        elif last and last[0] == op != "equal":
            last[1], last[2] = last[1] + x, last[2] + y
        elif gap and op != "equal" and out[-2][0] == op:
            blank = out.pop()
            out[-1][1] += blank[1] + x
            out[-1][2] += blank[2] + y
        else:
            out.append([op, x, y])
    return [tuple(o) for o in out]


@pandas_udf(OPS)
def word_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([word_diff_of(x or "", y or "") for x, y in zip(a, b)])


def fragments(ops: Column, side: str) -> Column:
    """The changed pieces of one side (``a`` or ``b``), joined by blanks."""
    own = "delete" if side == "a" else "insert"
    texts = F.transform(F.filter(ops, lambda o: o.op.isin(own, "replace")), lambda o: F.trim(F.regexp_replace(o[side], r"^\s+|\s+$", "")))
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


@pandas_udf(K.IntegerType())
def residual_count(ops: pd.Series, covered: pd.Series) -> pd.Series:
    """Changed pieces with letters or digits that no value's source text explains."""

    def count(steps, texts) -> int:
        known = [t.lower() for t in (texts if texts is not None else [])]
        pieces = [p.strip().lower() for o in steps if o["op"] != "equal" for p in (o["a"], o["b"])]
        pieces = [p for p in pieces if p and any(map(str.isalnum, p))]
        free = [p for p in pieces if not any(p in c or c in p for c in known)]
        return sum(not any(partial_of(p, c) >= 0.9 for c in known) for p in free)

    return pd.Series([count(o, c) for o, c in zip(ops, covered)], dtype="int32")
