"""From boundaries to tokens with character and byte offsets.

An expression over arrays that picks by position inside a lambda is evaluated anew for each element, so tokens are cut in Arrow
batches: linear in the text, without a shuffle, and the same for streams. A batch is cut in parts of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batch import Texts, over_parts
from ..functions.chars import CODES, OTHER, types_of, types_of_wide
from ..functions.sentence import NONE, UNKNOWN, WORD

_TOKEN = pa.struct([("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("byte_start", pa.int32()), ("byte_end", pa.int32())])


def known_spans(n: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of a text of n characters start and end, without those that hold an unknown mark."""
    ends = np.append(np.flatnonzero(marks == WORD) + 1, n)
    starts = np.append(0, ends[:-1])
    if (marks == UNKNOWN).any():
        inside = np.append(0, np.cumsum(marks == UNKNOWN))
        known = inside[ends - 1] == inside[starts]
        return starts[known], ends[known]
    return starts, ends


def _cut(texts: Texts, marks: np.ndarray) -> pa.Array:
    """The tokens of each text; of a null one null. marks: for each character that of the boundary behind it."""
    word = marks == WORD
    word[texts.ends] = True
    ends = np.flatnonzero(word) + 1
    starts = np.append(0, ends)[:-1]
    count = np.append(0, np.cumsum(word))
    low, high = texts.at[starts], texts.at[ends]
    surface = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.append(low, len(texts.raw)).astype(np.int32)), pa.py_buffer(texts.raw.tobytes())])
    before = count[np.append(texts.first, len(word))]
    if (marks == UNKNOWN).any():
        inside = np.append(0, np.cumsum(marks == UNKNOWN))
        known = inside[ends - 1] == inside[starts]
        before = np.append(0, np.cumsum(known))[before]
        starts, ends, low, high, surface = starts[known], ends[known], low[known], high[known], surface.filter(pa.array(known))
    n = np.diff(before)
    from_char, from_byte = np.repeat(texts.first, n), np.repeat(texts.edge[:-1], n)
    numbers = [pa.array(x.astype(np.int32)) for x in (starts - from_char, ends - from_char, low - from_byte, high - from_byte)]
    offsets = pa.array(before.astype(np.int32), mask=None if texts.valid.all() else np.append(~texts.valid, False))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([surface, *numbers], fields=list(_TOKEN)))


TOKENS = "array<struct<surface string, start int, end int, byte_start int, byte_end int>>"


def marked(texts: pa.Array, marks: pa.Array) -> tuple[Texts, np.ndarray]:
    """Texts and the marks of their boundaries, those with null marks as null ones."""
    if marks.null_count:
        texts = pa.compute.if_else(marks.is_valid(), texts, pa.scalar(None, texts.type))
    if texts.null_count:
        marks = pa.compute.filter(marks, texts.is_valid())
    t = Texts(texts)
    return t, t.spread(marks)


def token_array(text: Column, boundaries: Column) -> Column:
    """(surface, start, end, byte_start, byte_end) of each token between word boundaries, those that hold an unknown mark left out; null where either is null, none of an empty text."""
    return over_parts(lambda texts, marks: _cut(*marked(texts, marks)), TOKENS, text, boundaries)


def joined(text: Column, boundaries: Column) -> Column:
    """The tokens of a text, blanks, backslashes and slashes escaped, apart by blanks; null where either is null. Without unknown marks."""

    def run(texts: pa.Array, marks: pa.Array) -> pa.Array:
        t, m = marked(texts, marks)
        return t.joined(m == WORD)

    return over_parts(run, "string", text, boundaries)


class Rules:
    """The rules that letters name, on marks. D R H T K O: no boundary between two characters of this type; G: none inside a grapheme cluster; breaks: first of all one before and after each line break. wide: types are those of the full-width text."""

    def __init__(self, codes: str, breaks: bool = False, wide: bool = False):
        if bad := set(codes) - set(CODES) - {"G"}:
            raise ValueError(f"invalid wsconst codes: {''.join(sorted(bad))}")
        self.clusters, self.breaks, self.wide = "G" in codes, breaks, wide
        self.same = np.zeros(OTHER + 1, dtype=bool)
        self.same[[CODES[c] for c in codes if c != "G"]] = True

    def sources(self, text: Column) -> list[Column]:
        """What apply() needs besides: the lengths of the clusters of a text that may have some of several characters. Below U+0300 only a line break has."""
        lengths = F.transform(F.regexp_extract_all(text, F.lit("\\X"), F.lit(0)), F.length)
        return [F.when(text.rlike("\\r\\n|[^\\x{0}-\\x{2FF}]"), lengths)] if self.clusters else []

    def apply(self, t: Texts, marks: np.ndarray | None = None, clusters: pa.Array | None = None) -> np.ndarray:
        """The marks of the boundary behind each character; from all boundaries where none are given."""
        marks = np.full(len(t.points), WORD, dtype=np.int8) if marks is None else marks
        if self.breaks:
            at = (t.points == 10) | (t.points == 13)
            marks[:-1][at[:-1] | at[1:]] = WORD
        if self.same.any():
            kind = (types_of_wide if self.wide else types_of)(t.points)
            marks[:-1][(kind[1:] == kind[:-1]) & self.same[kind[1:]]] = NONE
        if clusters is not None and len(length := clusters.flatten()):
            some = np.flatnonzero(np.repeat(clusters.is_valid().to_numpy(zero_copy_only=False), t.last - t.first))
            inside = np.ones(len(some), dtype=bool)
            inside[np.cumsum(length.to_numpy(zero_copy_only=False)) - 1] = False
            marks[some[inside]] = NONE
        marks[t.ends] = NONE
        return marks


def rule_token_array(text: Column, codes: str, wide: bool = False) -> Column:
    """token_array() of all boundaries but those between two characters of one type that the codes name (D R H T K O), without arrays of characters and marks on the way. wide: types are those of the full-width text."""
    if "G" in codes:
        raise ValueError("invalid wsconst codes: G")
    rules = Rules(codes, wide=wide)

    def run(texts: pa.Array) -> pa.Array:
        t = Texts(texts)
        return _cut(t, rules.apply(t))

    return over_parts(run, TOKENS, text)


def rule_boundaries(text: Column, codes: str, breaks: bool = False) -> Column:
    """All boundaries but those that the rules take away, array<int>."""
    rules = Rules(codes, breaks)

    def run(texts: pa.Array, *clusters: pa.Array) -> pa.Array:
        t = Texts(texts)
        return t.listed(rules.apply(t, None, *clusters).astype(np.int32))

    return over_parts(run, "array<int>", text, *rules.sources(text))


def rewritten(text: Column, boundaries: Column, codes: str, breaks: bool = False) -> Column:
    """The boundaries of a text after the rules; null where either is null."""
    rules = Rules(codes, breaks)

    def run(texts: pa.Array, marks: pa.Array, *clusters: pa.Array) -> pa.Array:
        t, m = marked(texts, marks)
        if clusters and not t.valid.all():
            clusters = (pa.compute.if_else(pa.array(t.valid), clusters[0], pa.scalar(None, clusters[0].type)),)
        return t.listed(rules.apply(t, m, *clusters).astype(np.int32))

    return over_parts(run, "array<int>", text, boundaries, *rules.sources(text))


def rule_words(text: Column, codes: str, breaks: bool = False) -> Column:
    """struct<tokenized, n_tokens> of the tokens by rules, as joined(): one pass over the bytes, no array of tokens."""
    rules = Rules(codes, breaks)

    def run(texts: pa.Array, *clusters: pa.Array) -> pa.Array:
        t = Texts(texts)
        word = rules.apply(t, None, *clusters) == WORD
        count = np.append(0, np.cumsum(word))
        n = count[t.last] - count[t.first] + (t.last > t.first)
        return pa.StructArray.from_arrays([t.joined(word), pa.array(n.astype(np.int64), mask=~t.valid)], ["tokenized", "n_tokens"])

    return over_parts(run, "struct<tokenized string, n_tokens long>", text, *rules.sources(text))


def spans(n: Column, boundaries: Column) -> Column:
    """(start, end) of the tokens, without their surfaces: on the JVM, linear where no mark is unknown. n: number of characters."""
    ends = F.concat(F.filter(F.transform(boundaries, lambda b, i: F.when(b == WORD, i + 1)), lambda x: x.isNotNull()), F.when(n > 0, F.array(n)).otherwise(F.array().cast("array<int>")))
    starts = F.concat(F.array(F.lit(0)), ends)
    pairs = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))), lambda p: p["end"].isNotNull())
    known = F.filter(pairs, lambda p: ~F.array_contains(F.slice(boundaries, p["start"] + 1, p["end"] - p["start"] - 1), UNKNOWN))
    return F.when(F.array_contains(boundaries, UNKNOWN), known).otherwise(pairs)


def token_table(df: DataFrame, keys: list[str], text: Column, boundaries: Column, offsets: bool = False) -> DataFrame:
    """A row for each token: keys, pos, surface, start, end; with offsets also byte_start, byte_end and position_length, the number of the text's tokens. A text without characters has no rows."""
    return token_rows(df, keys, token_array(text, boundaries), offsets)


def token_rows(df: DataFrame, keys: list[str], tokens: Column, offsets: bool = False) -> DataFrame:
    """token_table() of arrays of tokens."""
    # an inner explode would have the optimiser filter on the size of the array first, which runs the cutting twice
    got = df.select(*keys, tokens.alias("_t")).select(*keys, F.size("_t").alias("position_length"), F.posexplode_outer("_t").alias("pos", "t")).where("pos is not null")
    more = ["t.byte_start", "t.byte_end", "position_length"] if offsets else []
    return got.select(*keys, "pos", "t.surface", "t.start", "t.end", *more)
