"""Language-model scoring by compression: zstandard sizes under an in-domain and under a general dictionary.

Both dictionaries are raw content: every word of two bytes or more that occurs more than once in their corpus, those that take the
most bytes last, where they are the cheapest to refer to. Neither corpus is sampled and neither dictionary has a bound: they grow
with the vocabulary, and the match finder's tables and window with them. The general corpus is every document; the in-domain
corpus is every labelled document of good quality that is not toxic. Words are counted for both in one pass. A text's score is
(general - in_domain) / general, of its whole compressed sizes: positive where the in-domain dictionary predicts it better.
bits_per_byte is the in-domain cross-entropy.

A null or empty text has null sizes and scores. An empty corpus gives an empty dictionary. Repeated rows score alike, and count
each in the corpus. Words that take as many bytes are in the order of the words. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np

from . import core

#: Dictionaries up to this size are used with the level's own tables and window, larger ones with tables and a window that match.
DICTIONARY_BYTES = 112_640
#: The most that a prepared dictionary of the fast strategies can hold; with a larger one the next strategy is used.
FAST_BYTES = (1 << 24) - 2
#: Longer texts are compressed as streams: otherwise the dictionary's tables are copied for each.
COPIED = 16_384
LEVEL = 3


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, good) of a partition of (text, good): in all texts and in the good ones."""
    total: dict[int, list[int]] = {}
    word: dict[int, bytes] = {}
    for b in batches:
        flags = b.column(1).to_numpy(zero_copy_only=False)
        for lo, texts in core.slices(b.column(0)):
            t = core.tokenize(texts)
            h, at, where, n = np.unique(t.hash, return_index=True, return_inverse=True, return_counts=True)
            good = np.bincount(where[flags[lo + t.of]], minlength=len(h))
            text = t.data.tobytes()
            for x, a, e, k, g in zip(h.tolist(), t.start[at].tolist(), t.end[at].tolist(), n.tolist(), good.tolist()):
                if x in total:
                    total[x][0] += k
                    total[x][1] += g
                else:
                    total[x] = [k, g]
                    word[x] = text[a:e]
    items = list(total.items())
    for lo in range(0, len(items), 50_000):
        part = items[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([word[x] for x, _ in part], pa.binary()), *(pa.array([v[k] for _, v in part], pa.int64()) for k in (0, 1))], ["word", "n", "good"])


def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(b.column(0).to_pylist())], pa.large_binary())], ["words"])


def dictionary(words: DataFrame, n: str) -> bytes:
    """The words that occur more than once by the count n. They are sorted and strung together by the executors; only the dictionary comes to the driver."""
    best = words.where(F.col(n) > 1).orderBy(F.col(n) * F.length("word"), F.col("word").desc()).select("word")
    return b" ".join(best.mapInArrow(strung, "words binary").toArrow().column("words").to_pylist())


def dictionaries(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes]:
    """The in-domain one and the general one."""
    good = labels.groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("good")).where("good and doc_id is not null")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    told = texts.join(good.hint("shuffle_hash"), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    each = told.mapInArrow(counts, "word binary, n long, good long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    words = core.written(each.where("n > 1 and length(word) > 1"))
    return dictionary(words, "good"), dictionary(words, "n")


def parameters(level: int, most: int) -> zstandard.ZstdCompressionParameters:
    """Of both compressions, for the larger dictionary's size: its words are found again only if the tables have room for them."""
    own = zstandard.ZstdCompressionParameters.from_level(level)
    more: dict[str, int] = {}
    if most > DICTIONARY_BYTES:
        bits = most.bit_length()
        more = {"window_log": max(own.window_log, min(bits, 27)), "hash_log": max(own.hash_log, min(bits - 1, 26)), "chain_log": max(own.chain_log, min(bits - 2, 26))}
        if most > FAST_BYTES and own.strategy <= zstandard.STRATEGY_DFAST:
            more["strategy"] = zstandard.STRATEGY_GREEDY
    return zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False, **more)


class Sizer:
    def __init__(self, raw: bytes, params: zstandard.ZstdCompressionParameters):
        known = None
        if len(raw) >= 8:
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
        self.compress = zstandard.ZstdCompressor(compression_params=params, dict_data=known).compress
        self.stream = zstandard.ZstdCompressor(compression_params=params, dict_data=known).compressobj

    def size(self, text: bytes) -> int:
        if len(text) <= COPIED:
            return len(self.compress(text))
        s = self.stream()
        return len(s.compress(text)) + len(s.flush())

    def sizes(self, texts: list[bytes | None]) -> list[int | None]:
        return [self.size(t) if t else None for t in texts]


#: Of the model that this worker used last: large dictionaries are prepared once for all of its tasks.
_held: dict[str, list[Sizer]] = {}


def lm_score(docs: DataFrame, labels: DataFrame, level: int = LEVEL) -> DataFrame:
    """(doc_id, in_domain, general, score, bits_per_byte) of every document."""
    raw = dictionaries(docs, labels)
    shared, model = docs.sparkSession.sparkContext.broadcast(raw), uuid.uuid4().hex

    def measure(texts: pa.Array) -> pa.Array:
        if model not in _held:
            _held.clear()
            params = parameters(level, max(map(len, shared.value)))
            _held[model] = [Sizer(r, params) for r in shared.value]
        raw = texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
        return pa.StructArray.from_arrays([pa.array(s.sizes(raw), pa.int64()) for s in _held[model]], ["in_domain", "general"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    got = texts.select("doc_id", F.octet_length("text").alias("n"), F.arrow_udf(measure, "struct<in_domain long, general long>")("text").alias("s"))
    return got.select(
        "doc_id", "s.in_domain", "s.general",
        ((F.col("s.general") - F.col("s.in_domain")) / F.col("s.general")).alias("score"),
        (F.lit(8.0) * F.col("s.in_domain") / F.expr("nullif(n, 0)")).alias("bits_per_byte"),
    )


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_score(core.table(spark, sf_dir, "documents"), core.table(spark, sf_dir, "labels"))
