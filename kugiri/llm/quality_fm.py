"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words, hashed to WORDS buckets with weight log(1 + count), scaled to unit length; one bin
for each of the structure statistics in STATS; and its language and source, hashed. The pairwise term
sum over i<j of <v_i, v_j> x_i x_j is scored in time linear in the number of features, as half of
sum over factors of (sum v x)^2 - sum (v x)^2.

It is fitted on at most FIT_ROWS labelled documents drawn by a hash of doc_id (a documented bound; nothing else is bounded), of
which a quarter sets the threshold: as high as lets KEEP_RECALL of the good ones pass, CUT at most. All documents are scored.
A null or empty text scores 0 and is rejected. A null lang or source counts as an empty one, as do columns that aren't there.
Without labels of both kinds every text that isn't empty scores 1. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

FIT_ROWS = 6_000
KEEP_RECALL = 0.998
CUT = 0.5
WORDS, BINS, META, FACTORS, EPOCHS = 1 << 15, 16, 512, 8, 12
STATS = ("length", "upper", "digit", "symbol", "pipe", "exclaim", "newline", "space", "beyond ASCII", "word length", "distinct words")
SIZE = WORDS + BINS * len(STATS) + META
U = np.uint64
CLASS = np.zeros(256, dtype=np.int64)
for chars, k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"#$%&*+/<=>@[\\]^_`{}~", 3), (b"|", 4), (b"!", 5), (b"\n\r", 6), (b" \t", 7), (bytes(range(128, 256)), 8)):
    CLASS[list(chars)] = k


def statistics(t: core.Tokens, distinct: np.ndarray) -> np.ndarray:
    """A row for each text, columns as in STATS, as bins."""
    n = len(t.text_len)
    at = np.repeat(np.arange(n), t.text_len)
    where = np.ones(len(t.raw), dtype=bool)
    where[0] = False
    where[t.text_start + t.text_len] = False
    count = np.bincount(at * 9 + CLASS[t.raw[where]], minlength=9 * n).reshape(n, 9)[:, 1:]
    size, words = np.maximum(t.text_len, 1)[:, None], np.diff(t.first)
    share = np.clip(np.floor(16 + 1.5 * np.log2(np.maximum(count / size, 2.0**-11))), 0, 15)
    letters = np.bincount(t.of, weights=t.end - t.start, minlength=n)
    return np.column_stack([
        np.clip(np.floor(np.log2(np.maximum(t.text_len, 1))), 0, 15), share,
        np.clip(np.floor(letters / np.maximum(words, 1) * 1.5), 0, 15),
        np.clip(np.floor(15.99 * distinct / np.maximum(words, 1)), 0, 15),
    ]).astype(np.int64)


def features(texts: list[bytes], lang: list[str | None], source: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first feature of each text and the number of all, features, values)."""
    t, n = core.tokenize(texts), len(texts)
    key = np.sort(t.of.astype(np.int64) * WORDS + (t.hash >> U(49)).astype(np.int64))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    doc, idx = key[new] // WORDS, key[new] % WORDS
    x = np.log1p(np.diff(np.append(new, len(key))))
    x /= np.sqrt(np.bincount(doc, weights=x * x, minlength=n))[doc]
    stats = statistics(t, np.bincount(doc, minlength=n))
    k = stats.shape[1]
    extra = np.empty((n, k + 2), dtype=np.int64)
    extra[:, :k] = WORDS + np.arange(k) * BINS + stats
    for j, (what, values) in enumerate((("lang", lang), ("source", source))):
        h = core.tokenize([f"{what}{v or ''}".encode() for v in values])
        with np.errstate(over="ignore"):
            whole = np.array([core.mix(h.hash[a:b].cumsum())[-1] for a, b in zip(h.first[:-1], h.first[1:])], dtype=np.uint64)
        extra[:, k + j] = WORDS + BINS * k + (whole % U(META)).astype(np.int64)
    of = np.concatenate([doc, np.repeat(np.arange(n), k + 2)])
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(n + 1))
    return first, np.concatenate([idx, extra.ravel()])[order], np.concatenate([x, np.full(n * (k + 2), 0.5)])[order]


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray
    threshold: float = CUT

    def raw(self, first: np.ndarray, idx: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic, and sum v x of each text. Every text has features."""
        vx = self.v[idx] * x[:, None].astype(np.float32)
        total = np.add.reduceat(vx, first[:-1], axis=0).astype(np.float64)
        square = np.add.reduceat((vx * vx).sum(axis=1), first[:-1])
        return self.bias + np.add.reduceat(self.w[idx] * x, first[:-1]) + 0.5 * ((total * total).sum(axis=1) - square), total

    def probability(self, texts: list[bytes], lang: list, source: list) -> np.ndarray:
        z = self.raw(*features(texts, lang, source))[0]
        return np.where([bool(t) for t in texts], np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6), 0.0)


def fitted(first: np.ndarray, idx: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """By stochastic gradients scaled by their history, in an order that is always the same; the last quarter sets the threshold."""
    rng = np.random.default_rng(7)
    m = Model(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32))
    gw, gv, gb = np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2), 1e-2
    train = len(y) - len(y) // 4
    share = np.clip(y[:train].mean(), 0.02, 0.98)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for lo in range(0, train, 64):
            rows = order[lo : lo + 64]
            take = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            f = np.concatenate([[0], np.cumsum(first[rows + 1] - first[rows])])
            i, xi = idx[take], x[take]
            z, total = m.raw(f, i, xi)
            d = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            of = np.repeat(np.arange(len(rows)), np.diff(f))
            at, inv = np.unique(i, return_inverse=True)
            dx = d[of] * xi
            w = np.bincount(inv, weights=dx) + 1e-5 * m.w[at]
            v = np.column_stack([np.bincount(inv, weights=dx * (total[of, k] - m.v[i, k] * xi)) for k in range(FACTORS)]) + 1e-4 * m.v[at]
            gw[at] += w * w
            gv[at] += v * v
            gb += d.sum() ** 2
            m.w[at] -= 0.1 * w / np.sqrt(gw[at])
            m.v[at] -= (0.03 * v / np.sqrt(gv[at])).astype(np.float32)
            m.bias -= 0.1 * d.sum() / np.sqrt(gb)
    held = slice(train, len(y)) if y[train:].any() else slice(0, len(y))
    z = m.raw(first, idx, x)[0][held][y[held] > 0]
    m.threshold = min(CUT, float(np.round(1 / (1 + np.exp(-np.quantile(z, 1 - KEEP_RECALL))), 6)))
    return m


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    sample = core.labelled(docs, labels, "quality", rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in core.slices(b.column("text")):
                part = b.slice(lo, len(texts))
                first, idx, x = features(texts, part.column("lang").to_pylist(), part.column("source").to_pylist())
                ends = pa.array(first.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("y").cast(pa.int32()), pa.ListArray.from_arrays(ends, pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x.astype(np.float32)))], ["doc_id", "y", "idx", "x"])

    got = sample.mapInArrow(extract, "doc_id long, y int, idx array<int>, x array<float>").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", F.xxhash64("idx", "x")).toArrow().combine_chunks()
    if not got.num_rows or len(set(got.column("y").to_pylist())) < 2:
        return None
    idx, x = (got.column(c).combine_chunks() if isinstance(got.column(c), pa.ChunkedArray) else got.column(c) for c in ("idx", "x"))
    return fitted(np.append(0, np.cumsum(idx.value_lengths().to_numpy())), idx.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy().astype(np.float64), got.column("y").to_numpy().astype(np.float64))


def scored(docs: DataFrame, model: Model | None) -> Column:
    """The probability that a row of docs is good."""
    text = F.col("text").cast("string")
    if model is None:
        return F.when(F.length(text) > 0, 1.0).otherwise(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang, source = (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source"))

    def score(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for lo, part in core.slices(texts):
            out.append(shared.value.probability(part, langs.slice(lo, len(part)).to_pylist(), sources.slice(lo, len(part)).to_pylist()))
        return pa.array(np.concatenate(out))

    return F.arrow_udf(score, "double")(text, lang, source)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are rejected, columns as they are."""
    model = learn(docs, labels)
    return docs.where(scored(docs, model) >= (model.threshold if model else CUT))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p, keep) of every document."""
    model = learn(docs, labels)
    return docs.select("doc_id", scored(docs, model).alias("p")).withColumn("keep", F.col("p") >= (model.threshold if model else CUT))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return quality(core.table(spark, sf_dir, "documents"), core.table(spark, sf_dir, "labels"))
