"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of a few measures of its text. Preference pairs (a document
with label 1, one with label 0) teach it: the loss is the logistic one of the difference of the two
documents' measures. The threshold is the quantile of all labelled documents' strengths that leaves the
share of label 0 below it; a score is the logistic function of the strength over that threshold, so 0.5
is the threshold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltadoc.llm.langid import held_out
from deltadoc.llm.tokens import slices

MEASURES = (
    "words", "word_length", "upper", "digits", "symbols", "symbol_words", "bars", "exclaims",
    "unique_words", "unique_pairs", "unique_lines", "top_word", "line_words", "stops", "letters", "long_words",
)
_symbol_end = re.compile(r"[^\w\s.,;:!?'\")\]-](?=\s|$)")
_space = re.compile(r"\s")


def measures(text: str | None) -> list[float]:
    """One number for each of ``MEASURES``; all zero for null and for a text without words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    if text.isascii():
        raw = text.encode()
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        digits = len(raw) - len(raw.translate(None, b"0123456789"))
        lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
        letters = upper + lower
    else:
        upper, digits, letters = sum(map(str.isupper, text)), sum(map(str.isdigit, text)), sum(map(str.isalpha, text))
    plain = text.count(".") + text.count(",")
    return [
        math.log1p(n), chars / n, upper / max(1, letters), digits / chars,
        max(0, chars - letters - digits - plain) / chars, len(_symbol_end.findall(text)) / n, text.count("|") / n,
        text.count("!") / n, len(counts) / n, len(set(zip(words, words[1:]))) / max(1, n - 1),
        len(set(lines)) / len(lines), max(counts.values()) / n, math.log1p(n / len(lines)), plain / n, letters / chars,
        sum(map((15).__lt__, map(len, words))) / n,
    ]


@dataclass
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strengths(x) - self.threshold, -700, 700)))


def bradley_terry(x: np.ndarray, label: np.ndarray, *, share: float | None = None, pairs: int = 20_000, l2: float = 1e-3, steps: int = 25, seed: int = 11) -> Ranker:
    """Newton's method on ``pairs`` random preference pairs.

    ``share``: of label 0 among all labelled documents, if the sample's differs. Without both labels all
    weights are 0 and each score is 0.5.
    """
    mean = x.mean(axis=0) if len(x) else np.zeros(len(MEASURES))
    spread = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(len(MEASURES))
    ranker = Ranker(mean, spread, np.zeros(len(mean)))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return ranker
    rng, z = np.random.default_rng(seed), (x - mean) / spread
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = ranker.weights
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1) / pairs + l2 * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    ranker.weights = w
    u = np.sort(ranker.strengths(x))
    k = (len(bad) / (len(good) + len(bad)) if share is None else share) * len(u)
    k = min(max(int(round(k)), 1), len(u) - 1)
    ranker.threshold = float((u[k - 1] + u[k]) / 2)
    return ranker


def measured(docs: DataFrame, ranker: Ranker | None = None, name: str | None = None, *, over: bool = True) -> DataFrame:
    """``docs`` with their measures (an array), or with the ranker's score, or its strength where not ``over``.

    The new column is called measures or score unless ``name`` is given; a column of that name is replaced.
    """
    from pyspark.sql import types as T

    name = name or ("score" if ranker else "measures")
    kind = T.DoubleType() if ranker else T.ArrayType(T.DoubleType())
    keep = [f for f in docs.schema.fields if f.name.lower() != name.lower()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list[float]] = []
            for _, _, texts in slices(b.column(b.schema.get_field_index("text"))):
                rows += map(measures, texts)
            x = np.array(rows, dtype=float).reshape(-1, len(MEASURES))
            last = pa.array(rows, pa.list_(pa.float64())) if ranker is None else pa.array(ranker.scores(x) if over else ranker.strengths(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, last], names=[*b.schema.names, name])

    return docs.select(*[f"`{f.name}`" for f in keep]).mapInArrow(run, T.StructType([*keep, T.StructField(name, kind)]))


def fit(docs: DataFrame, labels: DataFrame, *, sample_docs: int = 6000, seed: int = 11) -> Ranker:
    """A ranker from labels outside the held-out fold (crc32 of doc_id mod 3 is 1).

    Labels other than 0 and 1 and null ids are left out. Weights come from at most ``sample_docs`` labels by a
    hash of doc_id; texts join to these sampled ids only, whose number is bounded, so they may be broadcast.
    Where ids repeat, at most four times as many texts are taken, in order of ids and measures. The threshold
    is the quantile of the strengths of all labelled texts, of which there must be one of each label.
    """
    free = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id", 3, 1))
    free = free.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    taken = free.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "quality").limit(sample_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = measured(texts.join(F.broadcast(taken), "doc_id")).select("doc_id", "quality", "measures")
    rows = sample.orderBy("doc_id", "quality", "measures").limit(4 * sample_docs).collect()
    x = np.array([r.measures for r in rows], dtype=float).reshape(-1, len(MEASURES))
    ranker = bradley_terry(x, np.array([r.quality for r in rows], dtype=int))
    if not ranker.weights.any():
        return ranker
    # all texts are measured where they are read, as a join before it would shuffle them
    strengths = measured(texts, ranker, "u", over=False).select("doc_id", "u").join(free, "doc_id")
    sums = strengths.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("bad"), F.percentile_approx("u", [k / 2000 for k in range(2001)], 100_000).alias("at")).first()
    # the quantile among 2001 ones, each to one part in 100,000
    ranker.threshold = float(np.interp(sums.bad / sums.n * 2000, range(2001), sums.at))
    return ranker


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on); null and empty texts get a score too."""
    keep = docs.drop("predicted")
    return measured(keep, ranker).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranker = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select(F.col("doc_id").cast("long"), "text"), ranker).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
