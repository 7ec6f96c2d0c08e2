"""Byte-level BPE encoding and decoding as a tree reduction over a monoid.

A text is an element (text, tokens, token lengths); joining neighbours is the monoid's operation. encode() halves a text until
parts of LEAF characters are left, encodes these and joins them up the tree. A join encodes anew only a window around the seam,
which grows on either side until it ends where a character that isn't white space is followed by one that is: no match of the
pattern reaches across such a place or depends on what is beyond it (words, numbers and signs end there, and a run of white
space begins there), so the tokens outside the window are those of the whole text. A side without such a place is in the window
as a whole. decode() halves the tokens and concatenates their bytes up the tree.

The result is that of encoding the whole text at once. A null text has null tokens, an empty one none. Repeated rows have the
same tokens each; columns other than doc_id and text are ignored. The vocabulary is a file of ranks, its path a parameter; it
is read on the driver and broadcast (its size is that of the file).
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 2048
#: White space as the pattern's \s has it; Python's \s has four control characters more.
SEAM = re.compile("(?<=[^\t-\r \x85\xa0  -     　])(?=[\t-\r \x85\xa0  -     　])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, leaf: int = LEAF):
        self.whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = {v: k for k, v in ranks.items()}
        self.leaf = leaf

    def cut(self, text: str, tokens: list[int], at: int, from_end: bool) -> int:
        """The number of tokens before character at, counted from the nearer end."""
        size, k = len((text[at:] if from_end else text[:at]).encode()), 0
        length = self.bytes
        while size > 0:
            size -= len(length[tokens[-1 - k] if from_end else tokens[k]])
            k += 1
        if size:
            raise ValueError("a token reaches across a stable place")
        return len(tokens) - k if from_end else k

    def join(self, a: tuple[str, list[int]], b: tuple[str, list[int]]) -> tuple[str, list[int]]:
        left, right = a[0], b[0]
        if not left or not right:
            return a if left else b
        at = end = None
        span = 64
        while at is None:  # the last stable place of the left side, the character at the seam being unknown
            lo = max(0, len(left) - span)
            found = [m.start() for m in SEAM.finditer(left, lo) if m.start() > lo or not lo]
            at = found[-1] if found else 0 if not lo else None
            span *= 4
        span = 64
        while end is None:
            m = SEAM.search(right, 0, min(len(right), span))
            end = m.start() if m else len(right) if span >= len(right) else None
            span *= 4
        i, j = self.cut(left, a[1], at, True), self.cut(right, b[1], end, False) if end < len(right) else len(b[1])
        return left + right, a[1][:i] + self.whole(left[at:] + right[:end]) + b[1][j:]

    def element(self, text: str) -> tuple[str, list[int]]:
        if len(text) <= self.leaf:
            return text, self.whole(text)
        half = len(text) // 2
        return self.join(self.element(text[:half]), self.element(text[half:]))

    def encode(self, text: str) -> list[int]:
        return self.element(text)[1]

    def joined_bytes(self, tokens: list[int]) -> bytes:
        if len(tokens) <= self.leaf:
            return b"".join(map(self.bytes.__getitem__, tokens))
        half = len(tokens) // 2
        return self.joined_bytes(tokens[:half]) + self.joined_bytes(tokens[half:])

    def decode(self, tokens: list[int]) -> str:
        """Bytes that are no UTF-8, which only tokens not made by encode() give, become U+FFFD."""
        return self.joined_bytes(tokens).decode("utf-8", "replace")


def codec_of(spark, vocabulary: str, leaf: int):
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    held: list[Codec] = []

    def get() -> Codec:
        if not held:
            held.append(Codec(shared.value, leaf=leaf))
        return held[0]

    return get


def lists(values: list[np.ndarray | None]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *(v for v in values if v is not None)])
    offsets = np.append(0, np.cumsum([0 if v is None else len(v) for v in values]))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append([v is None for v in values], False)), pa.array(flat))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(doc_id, tokens, n_tokens)."""
    get = codec_of(docs.sparkSession, vocabulary, leaf)

    def run(texts: pa.Array) -> pa.Array:
        codec = get()
        return lists([None if t is None else np.array(codec.encode(t), dtype=np.int32) for t in (x.as_py() for x in texts)])

    got = docs.select("doc_id", F.arrow_udf(run, "array<int>")(F.col("text").cast("string")).alias("tokens"))
    return got.withColumn("n_tokens", F.when(F.col("tokens").isNotNull(), F.size("tokens")))


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens); null tokens are a null text."""
    get = codec_of(tokens.sparkSession, vocabulary, leaf)

    def run(rows: pa.Array) -> pa.Array:
        codec = get()
        return pa.array([None if t is None else codec.decode(t) for t in rows.to_pylist()], pa.string())

    return tokens.select("doc_id", F.arrow_udf(run, "string")("tokens").alias("text"))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they decode to its text."""
    get = codec_of(spark, VOCABULARY, LEAF)

    def run(texts: pa.Array) -> pa.Array:
        codec = get()
        got: list[np.ndarray | None] = []
        same: list[bool | None] = []
        for t in (x.as_py() for x in texts):  # one text's lists at a time: of a batch only packed numbers are held
            tokens = None if t is None else codec.encode(t)
            same.append(None if t is None else codec.decode(tokens) == t)
            got.append(None if t is None else np.array(tokens, dtype=np.int32))
        return pa.StructArray.from_arrays([lists(got), pa.array([None if g is None else len(g) for g in got], pa.int32()), pa.array(same, pa.bool_())], ["tokens", "n_tokens", "round_trip"])

    docs = core.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.arrow_udf(run, "struct<tokens array<int>, n_tokens int, round_trip boolean>")("text").alias("s")).select("doc_id", "s.*")
