"""Arrow arrays of texts as numpy arrays, in parts of bounded size.

A batch may hold ten thousand long texts, and several numbers for each of their characters fill the memory of a worker. Functions
over texts take a batch part by part, and return a batch for each part, so what they hold is bounded by a part or one long text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text in a part, unless a single text has more.
PART = 1 << 18


def _edges(a: pa.Array) -> np.ndarray:
    """Where the texts of an array begin and end in its bytes."""
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    if not len(a):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(a.buffers()[1], dtype=kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)


def parts(a: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of the texts of an array, each of limit bytes at most or of one text."""
    edge, lo, limit = _edges(a), 0, limit or PART
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def over_parts(run: Callable[..., pa.Array], kind: str, text: Column, *more: Column) -> Column:
    """The column that run(texts, *more) gives, called for each part of a batch. kind: its type."""

    def each(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo, hi in parts(batch[0]) if len(batch[0]) else [(0, 0)]:
                yield run(*(x.slice(lo, hi - lo) for x in batch))

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from each((x,) for x in batches)

    return F.arrow_udf(each if more else one, kind)(text, *more)


class Texts:
    """Texts side by side; a null one is as an empty one.

    raw, points: bytes and code points of all; at: where each character begins in raw, and the end; edge: where each text begins
    in raw, and the end; first, last: the characters of each text; valid: whether it is none of the null ones.
    """

    def __init__(self, a: pa.Array):
        self.valid = a.is_valid().to_numpy(zero_copy_only=False)
        if a.null_count:
            a = a.fill_null("")
        edge = _edges(a)
        data = a.buffers()[2] if len(a) else None
        self.raw = np.frombuffer(data, dtype=np.uint8)[edge[0] : edge[-1]] if data is not None and edge[-1] > edge[0] else np.zeros(0, dtype=np.uint8)
        self.edge = edge - edge[0]
        self.points = np.frombuffer(self.raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        if len(self.points) == len(self.raw):
            self.at = np.arange(len(self.raw) + 1)
            where = self.edge
        else:
            self.at = np.append(np.flatnonzero((self.raw & 0xC0) != 0x80), len(self.raw))
            where = np.searchsorted(self.at, self.edge)
        self.first, self.last = where[:-1], where[1:]

    def __len__(self) -> int:
        return len(self.edge) - 1

    @property
    def of(self) -> np.ndarray:
        """The text of each character."""
        return np.repeat(np.arange(len(self)), self.last - self.first)

    @property
    def ends(self) -> np.ndarray:
        """The last character of each text that has any."""
        return self.last[self.last > self.first] - 1

    def inner(self) -> np.ndarray:
        """For each character whether another of its text follows, so that a boundary is behind it."""
        out = np.ones(len(self.points), dtype=bool)
        out[self.ends] = False
        return out

    def spread(self, lists: pa.Array) -> np.ndarray:
        """Arrays with an entry for each boundary as one array over the characters; 0 behind the last of a text."""
        out, inner = np.zeros(len(self.points), dtype=np.int64), self.inner()
        values = lists.flatten().to_numpy(zero_copy_only=False)
        if len(values) != np.count_nonzero(inner):
            raise ValueError("a text of n characters has n - 1 boundaries")
        out[inner] = values
        return out

    def listed(self, values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
        """The other way: an array for each text with the values behind all its characters but the last."""
        valid = self.valid if valid is None else valid
        n = np.maximum(self.last - self.first - 1, 0)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32), mask=None if valid.all() else np.append(~valid, False)), pa.array(values[self.inner()]))

    def characters(self) -> pa.Array:
        return pa.Array.from_buffers(pa.string(), len(self.points), [None, pa.py_buffer(self.at.astype(np.int32)), pa.py_buffer(self.raw.tobytes())])

    def joined(self, word: np.ndarray) -> pa.Array:
        """Each text with a blank for each boundary and a backslash before blanks, backslashes and slashes of its own. word: for each character whether a word ends with it."""
        escaped = (self.raw == 0x20) | (self.raw == 0x5C) | (self.raw == 0x2F)
        blank = np.zeros(len(self.raw), dtype=bool)
        blank[self.at[np.flatnonzero(word & self.inner()) + 1]] = True
        more = np.append(0, np.cumsum(escaped.astype(np.int8) + blank.astype(np.int8), dtype=np.int64))
        out = np.full(len(self.raw) + int(more[-1]), 0x5C, dtype=np.uint8)
        to = np.arange(len(self.raw)) + more[1:]
        out[to] = self.raw
        out[(to - 1 - escaped)[blank]] = 0x20
        edge = (self.edge + more[self.edge]).astype(np.int32)
        # a blank that comes before a text's first character belongs to no text: there are none, as words end behind inner characters
        return pa.Array.from_buffers(pa.string(), len(self), [None if self.valid.all() else pa.array(self.valid).buffers()[1], pa.py_buffer(edge), pa.py_buffer(out.tobytes())])
