"""Quality rules: logistic regression over hashed words and character 4-grams, with calibrated probabilities and fixed thresholds.

Words and character 4-grams (of the folded UTF-8 bytes, blanks included) are hashed to WORDS and CHARS buckets; each occurrence
adds its weight over the square root of the number of occurrences, so the score is one gather and one sum by segment for a whole
Arrow batch. The model is fitted on at most FIT_ROWS labelled rows drawn by a hash of doc_id (a documented bound); a third of
them, held out, calibrates the scores by a logistic curve. Every document is scored over its whole text.
From KEEP on a document is kept, below DROP dropped, else put up for review. A null or empty text has probability 0 and is
dropped. Without labels of both kinds every text that isn't empty has probability 1. Repeated rows score alike; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

FIT_ROWS = 4_000
KEEP, DROP = 0.5, 0.2
WORDS, CHARS = 1 << 16, 1 << 18
ROUNDS = 60
U = np.uint64


def occurrences(t: core.Tokens) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words and for character 4-grams: (first of each text, last + 1, bucket of each)."""
    d = t.data.astype(np.uint32)
    g = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
    g ^= g >> np.uint32(15)
    g = g * np.uint32(2654435761)
    return (t.first[:-1], t.first[1:], (t.hash >> U(48)).astype(np.int64)), (t.text_start, np.maximum(t.text_start, t.text_start + t.text_len - 3), WORDS + (g >> np.uint32(14)).astype(np.int64))


def sums(lo: np.ndarray, hi: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of values[lo:hi] of each text over the square root of their number."""
    some = np.flatnonzero(hi > lo)
    out = np.zeros(len(lo))
    if len(some):
        out[some] = np.add.reduceat(np.append(values, 0.0), np.column_stack([lo[some], hi[some]]).ravel())[::2] / np.sqrt(hi[some] - lo[some])
    return out


@dataclass
class Model:
    w: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, texts: list[bytes]) -> np.ndarray:
        return sum(sums(lo, hi, self.w[at]) for lo, hi, at in occurrences(core.tokenize(texts)))

    def probability(self, texts: list[bytes]) -> np.ndarray:
        z = np.clip(self.slope * self.raw(texts) + self.shift, -30, 30)
        return np.where([bool(t) for t in texts], np.round(1 / (1 + np.exp(-z)), 6), 0.0)


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over z, by Newton's method, with targets drawn in by one row of each kind."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, s = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [(r * z).sum(), r.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fitted(first: np.ndarray, idx: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """By gradient descent with momentum over all training rows; kinds weigh the same."""
    train = len(y) - len(y) // 3
    cut = first[train]
    i, xi, of, yt = idx[:cut], x[:cut], np.repeat(np.arange(train), np.diff(first[: train + 1])), y[:train]
    share = np.clip(yt.mean(), 0.02, 0.98)
    weight = np.where(yt > 0, 0.5 / share, 0.5 / (1 - share)) / train
    w, bias, m1, m2 = np.zeros(WORDS + CHARS, dtype=np.float32), 0.0, np.zeros(WORDS + CHARS), np.zeros(WORDS + CHARS)
    for k in range(1, ROUNDS + 1):
        z = np.bincount(of, weights=w[i] * xi, minlength=train) + bias
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yt)
        g = np.bincount(i, weights=d[of] * xi, minlength=WORDS + CHARS) + 1e-6 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= (0.02 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        bias -= 0.5 * d.sum()
    model = Model(w.astype(np.float64))
    z = np.bincount(np.repeat(np.arange(len(y)), np.diff(first)), weights=model.w[idx] * x, minlength=len(y))
    held = slice(train, len(y)) if 0 < y[train:].mean() < 1 else slice(0, len(y))
    model.slope, model.shift = calibration(z[held], y[held])
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in core.slices(b.column("text")):
                parts, t = [], core.tokenize(texts)
                blocks = occurrences(t)
                for k in range(len(texts)):
                    got = [np.unique(at[a[k] : e[k]], return_counts=True) + (max(1, e[k] - a[k]),) for a, e, at in blocks]
                    parts.append((np.concatenate([i for i, _, _ in got]).astype(np.int32), np.concatenate([c / np.sqrt(n) for _, c, n in got]).astype(np.float32)))
                ends = pa.array(np.append(0, np.cumsum([len(i) for i, _ in parts])).astype(np.int32))
                same = b.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([same.column("doc_id").cast(pa.int64()), same.column("y").cast(pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([i for i, _ in parts]))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x for _, x in parts])))], ["doc_id", "y", "idx", "x"])

    got = core.labelled(docs, labels, "quality", rows).mapInArrow(extract, "doc_id long, y int, idx array<int>, x array<float>").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", F.xxhash64("idx", "x")).toArrow()
    if not got.num_rows or len(set(got.column("y").to_pylist())) < 2:
        return None
    idx, x = got.column("idx").combine_chunks(), got.column("x").combine_chunks()
    return fitted(np.append(0, np.cumsum(idx.value_lengths().to_numpy())), idx.flatten().to_numpy(), x.flatten().to_numpy(), got.column("y").to_numpy().astype(np.float64))


def scored(docs: DataFrame, model: Model | None) -> Column:
    """The calibrated probability that a row of docs is good."""
    text = F.col("text").cast("string")
    if model is None:
        return F.when(F.length(text) > 0, 1.0).otherwise(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(shared.value.probability(part) for _, part in core.slices(texts))]))

    return F.arrow_udf(score, "double")(text)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p, decision, keep) of every document; keep: it isn't dropped."""
    got = docs.select("doc_id", scored(docs, learn(docs, labels)).alias("p"))
    return got.select("doc_id", "p", F.when(F.col("p") >= KEEP, "keep").when(F.col("p") < DROP, "drop").otherwise("review").alias("decision"), (F.col("p") >= DROP).alias("keep"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(core.table(spark, sf_dir, "documents"), core.table(spark, sf_dir, "labels"))
