"""What the operators share: tokens of whole Arrow batches as numpy arrays, stable hashes, samples of labelled rows, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, table, written  # noqa: F401

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text that are held as arrays at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Word bytes are ASCII letters, digits and every byte of a character beyond ASCII; only ASCII letters are folded.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: The same tokens in DuckDB, for a column {0}.
SQL_TOKENS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(32))


@dataclass
class Tokens:
    """Tokens of a slice of texts. data: the folded bytes, a blank after each text; of: each token's text; first: each text's first token, with the number of tokens at the end."""

    data: np.ndarray
    raw: np.ndarray
    text_start: np.ndarray
    text_len: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of: np.ndarray
    first: np.ndarray


_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        _powers[:] = []
        for b in (BASE, BASE_INV):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            _powers.append(np.cumprod(a))
    return _powers


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) with at most limit bytes each, or one longer text; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lo, size, part = 0, 0, []
    for i, t in enumerate(texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()):
        t = t or b""
        if part and size + len(t) > limit:
            yield lo, part
            lo, size, part = i, 0, []
        part.append(t)
        size += len(t) + 1
    if part:
        yield lo, part


def tokenize(texts: list[bytes]) -> Tokens:
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    data = LOWER[raw]
    length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_start = np.concatenate([[1], 1 + np.cumsum(length + 1)])[:-1]
    edge = np.diff(WORD[data].view(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    p, inv = powers(len(data))
    with np.errstate(over="ignore"):
        total = np.cumsum((data.astype(np.uint64) + U(1)) * p[: len(data)])
        h = mix((total[end - 1] - total[start - 1]) * inv[start])
    of = np.searchsorted(text_start, start, side="right") - 1
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    return Tokens(data, raw, text_start, length, start, end, h, of, first)


def grams(t: Tokens, n: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; of a text with fewer than n words, that of all its words."""
    h = t.hash
    with np.errstate(over="ignore"):
        g = h[: max(0, len(h) - n + 1)].copy()
        for k in range(1, n):
            g = mix(g + U(k)) + h[k : len(h) - n + 1 + k]
        g = mix(g)
    out = []
    for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist()):
        if b - a >= n:
            s = np.sort(g[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            v = h[a : a + 1].copy()
            with np.errstate(over="ignore"):
                for k in range(a + 1, b):
                    v = mix(v + U(k - a)) + h[k : k + 1]
                out.append(mix(v ^ U(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def labelled(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """At most rows labelled documents, in the order of a hash of doc_id: (doc_id, text, lang, source, y). A document whose labels disagree has the larger one. Only the labels drawn, a number that rows bounds, are broadcast."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(target).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    cols = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("doc_id", "text", "lang", "source")]
    return docs.select(*cols).where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
