"""Language identification by a byte convolutional network trained in numpy.

A text's bytes are cut into windows of fixed length (the last one padded with zeros). Each byte has an
embedding; filters of several widths run over a window, the largest answer of each filter is kept, and a
softmax over the languages follows. A text's distribution is the mean of its windows' ones, weighted by
their bytes, so every byte of a text counts.

Training takes a bounded sample of labelled documents and a few windows at random places of each.
In use, a filter's answer at a byte is a sum of table rows, one for each pair of neighbouring bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
WINDOW = 256
_maybe_letter = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numbers such as one half or a superscript two aren't letters."""
    return any(m[0].isalpha() for m in _maybe_letter.finditer(text))


@dataclass
class ByteNet:
    """Weights: embedding (256, e), a (width, e, filters) kernel and bias for each width, output (filters, languages)."""

    languages: list[str]
    embedding: np.ndarray
    kernels: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    window: int = WINDOW
    _tables: dict | None = None

    def params(self) -> list[np.ndarray]:
        return [self.embedding, *self.kernels.values(), *self.biases.values(), self.out, self.out_bias]

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width: offsets with a table of the filters' answers to a pair of bytes (or to one byte)."""
        if self._tables is None:
            made = {}
            for width, kernel in self.kernels.items():
                rows = [self.embedding @ k for k in kernel]
                rows[0] = rows[0] + self.biases[width]
                made[width] = [
                    (k, (rows[k][None, :, :] + rows[k + 1][:, None, :]).reshape(65536, -1) if k + 1 < width else rows[k])
                    for k in range(0, width, 2)
                ]
            self._tables = made
        return self._tables

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def answers(self, x: np.ndarray) -> np.ndarray:
        """The largest answer of each filter, (windows, filters); x: (windows, window) bytes."""
        n, length = x.shape
        pairs = x[:, :-1].astype(np.int32) | (x[:, 1:].astype(np.int32) << 8)
        best = []
        for width, tables in self.tables().items():
            span = length - width + 1
            acc = None
            for k, t in tables:
                index = (pairs if len(t) == 65536 else x)[:, k : k + span]
                got = t.take(index.reshape(-1), axis=0)
                acc = got if acc is None else np.add(acc, got, out=acc)
            best.append(acc.reshape(n, span, -1).max(axis=1))
        return np.maximum(np.concatenate(best, axis=1), 0)

    def probabilities(self, x: np.ndarray, chunk: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)))
        for a in range(0, len(x), chunk):
            z = self.answers(x[a : a + chunk]) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[a : a + chunk] = z / z.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability; ``und`` with 0.0 for null and for a text without letters."""
        result: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return result
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not known:
            return result
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in known]
        counts = np.array([-(-len(r) // self.window) for r in raw])
        x = np.frombuffer(b"".join(r.ljust(c * self.window, b"\0") for r, c in zip(raw, counts.tolist())), np.uint8)
        p = self.probabilities(x.reshape(-1, self.window))
        weights = np.full(len(p), float(self.window))
        ends = np.cumsum(counts)
        sizes = np.array([len(r) for r in raw])
        weights[ends - 1] = sizes - (counts - 1) * self.window
        mean = np.add.reduceat(p * weights[:, None], ends - counts, axis=0) / sizes[:, None]
        for i, k, s in zip(known, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist()):
            result[i] = self.languages[k], min(1.0, s)
        return result


def train(
    windows: np.ndarray, labels: np.ndarray, languages: list[str], *, embed: int = 8,
    widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, epochs: int = 4, batch: int = 64,
    rate: float = 0.01, seed: int = 5,
) -> ByteNet:
    """Adam on the cross entropy, each language with the same total weight. Equal inputs give equal weights."""
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = ByteNet(
        languages, f32(256, embed, scale=0.5), {w: f32(w, embed, filters, scale=(w * embed) ** -0.5) for w in widths},
        {w: np.zeros(filters, np.float32) for w in widths}, f32(len(widths) * filters, len(languages), scale=0.1),
        np.zeros(len(languages), np.float32), windows.shape[1] if windows.size else WINDOW,
    )
    if len(languages) < 2:
        net.out[:] = 0
        return net
    share = len(labels) / (len(languages) * np.maximum(1, np.bincount(labels, minlength=len(languages))))
    params, step = net.params(), 0
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            grads = _gradients(net, windows[rows], labels[rows], share[labels[rows]].astype(np.float32))
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: ByteNet, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    n, length = x.shape
    at, best = {}, []
    emb = net.embedding[x]
    for w, kernel in net.kernels.items():
        span = length - w + 1
        seen = np.concatenate([emb[:, k : k + span] for k in range(w)], axis=2)  # (n, span, w*e)
        acc = seen.reshape(n * span, -1) @ kernel.reshape(-1, kernel.shape[2])
        acc = acc.reshape(n, span, -1)
        at[w] = acc.argmax(axis=1)
        best.append(np.take_along_axis(acc, at[w][:, None, :], axis=1)[:, 0, :] + net.biases[w])
    raw = np.concatenate(best, axis=1)
    hidden = np.maximum(raw, 0)
    z = hidden @ net.out + net.out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    p = z / z.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    d = p * weight[:, None] / n
    d_out, d_out_bias = hidden.T @ d, d.sum(axis=0)
    d_hidden = (d @ net.out.T) * (raw > 0)
    d_emb, d_kernels, d_biases, begin = np.zeros_like(net.embedding), [], [], 0
    for w, kernel in net.kernels.items():
        filters = kernel.shape[2]
        g = d_hidden[:, begin : begin + filters]  # (n, filters)
        begin += filters
        d_kernel = np.empty_like(kernel)
        for k in range(w):
            seen = x[np.arange(n)[:, None], at[w] + k]  # (n, filters)
            d_kernel[k] = np.einsum("nfe,nf->ef", net.embedding[seen], g)
            np.add.at(d_emb, seen.reshape(-1), (g[:, :, None] * kernel[k].T[None]).reshape(-1, kernel.shape[1]))
        d_kernels.append(d_kernel)
        d_biases.append(g.sum(axis=0))
    return [d_emb, *d_kernels, *d_biases, d_out, d_out_bias]


def sample_windows(labelled: DataFrame, *, sample_docs: int = 2000, least: int = 20, most_languages: int = 200, windows: int = 4, window: int = WINDOW, seed: int = 5) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels of a bounded sample of the rows (doc_id, text, lang), by a hash of doc_id.

    Each of the ``most_languages`` most frequent languages gives its equal part of ``sample_docs`` rows, and
    ``least`` rows at least, or all that it has. Null texts, null languages and texts without letters are
    left out. The driver gets ``max(sample_docs, least * most_languages) * windows * window`` bytes at most.
    """
    known = labelled.where("text is not null and lang is not null").withColumn("lang", F.col("lang").cast("string"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    quota = max(least, sample_docs // max(1, len(sizes)))
    place = F.xxhash64(F.col("doc_id"), F.lit(seed))
    # a range of the hash with about twice each part, so that few texts are looked at
    limits = {r.lang: min(1.0, 2 * quota / r.n) for r in sizes}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("lang")) if limits else F.lit(0.0)
    known = known.where(F.pmod(place, F.lit(1_000_000_007)) < limit * 1_000_000_007)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for key, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                if not has_letter(text):
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                rng, room = np.random.default_rng(key & 0xFFFFFFFF), max(0, len(raw) - window)
                got.append((key, lang, b"".join(raw[a : a + window].ljust(window, b"\0") for a in sorted(rng.integers(0, room + 1, windows).tolist()))))
            cols = list(zip(*got)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({"key": pa.array(cols[0], pa.int64()), "lang": pa.array(cols[1], pa.string()), "windows": pa.array(cols[2], pa.binary())})

    taken = (
        known.select(place.alias("key"), "lang", "text").mapInArrow(cut, "key long, lang string, windows binary")
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "windows"))).where(F.col("rank") <= quota).collect()
    )
    unique = sorted({(r.lang, bytes(r.windows)) for r in taken})
    languages = sorted({lang for lang, _ in unique})
    number = {lang: k for k, lang in enumerate(languages)}
    x = np.frombuffer(b"".join(w for _, w in unique), np.uint8).reshape(-1, window)
    y = np.repeat([number[lang] for lang, _ in unique], windows).astype(np.int64)
    return x, y, languages


def identify(docs: DataFrame, net: ByteNet, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (with ``text``) and language and score for each row; columns of these ``names`` are replaced."""
    from pyspark.sql import types as T

    from deltadoc.llm.tokens import slices

    keep = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*keep, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[str, float]] = []
            for _, _, texts in slices(b.column(b.schema.get_field_index("text"))):
                found += net.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*b.schema.names, *names],
            )

    return docs.select(*[f"`{f.name}`" for f in keep]).mapInArrow(run, schema)


def held_out(doc_id, folds: int, fold: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold


def fit(docs: DataFrame, **options) -> ByteNet:
    """A net from ``docs`` (doc_id, text, lang) outside the held-out fold (crc32 of doc_id mod 4 is 2)."""
    free = docs.where(~F.coalesce(held_out("doc_id", 4, 2), F.lit(False)) & F.col("doc_id").isNotNull())
    x, y, languages = sample_windows(free.select("doc_id", "text", "lang"), **options)
    return train(x, y, languages)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs)
    return identify(docs.select(F.col("doc_id").cast("long"), "text"), net).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
