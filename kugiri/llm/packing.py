"""Packing along a space-filling curve.

Each document's words are hashed; every hash gives a sign in each of DIMS dimensions, and the summed signs over the square root
of the number of words are the document's place. Places are laid on a grid of 2**BITS steps between the least and the largest
of all documents, and the cell's Hilbert index is the key of a range sort. Documents are then laid end to end along the curve
and cut every CAPACITY words, so that each sequence but the last is full and holds neighbours; a document on a cut goes on in
the next sequence. Where a document starts follows from sums over partitions, so the result is the same for any partitioning.

Only doc_id, place and number of words are sorted; texts stay where they are. Ties of the key are in the order of doc_id, with
null first; repeated rows are packed each. A document without words (null, empty) is in no sequence. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import core

CAPACITY = 4096
DIMS, BITS = 3, 10
U = np.uint64


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, texts in core.slices(batch.column(1)):
            t = core.tokenize(texts)
            n = np.diff(t.first)
            some = np.flatnonzero(n)
            h = core.mix(t.hash ^ U(0x1234567))
            xs = [np.add.reduceat(((h >> U(k)) & U(1)).astype(np.int64) * 2 - 1, t.first[:-1][some]) / np.sqrt(n[some]) if len(some) else np.zeros(0) for k in range(DIMS)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)).take(pa.array(some)), pa.array(n[some].astype(np.int64)), *(pa.array(np.round(x, 9)) for x in xs)], ["doc_id", "n", *(f"x{k}" for k in range(DIMS))])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of the rows of cells, by Skilling's transposition of axes."""
    x = cells.T.astype(np.int64).copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b) & 1
    return out


def keys(batches: Iterator[pa.RecordBatch], lo: list[float], hi: list[float]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = [np.clip(np.floor((b.column(f"x{k}").to_numpy() - lo[k]) / max(hi[k] - lo[k], 1e-12) * (1 << BITS)), 0, (1 << BITS) - 1) for k in range(DIMS)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), pa.array(hilbert(np.column_stack(step), BITS))], ["doc_id", "n", "key"])


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, doc_id, n, within): the words of the partition before each document, in the order of the rows."""
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n").to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, dtype=np.int32)), b.column("doc_id"), b.column("n"), pa.array(ends - n)], ["part", "doc_id", "n", "within"])
        total = int(ends[-1]) if len(ends) else total


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(seq, pos, doc_id, start, length): from word start on, length words of the document are at word pos of sequence seq."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = docs.sparkSession
    placed = core.written(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").mapInArrow(places, "doc_id long, n long, " + ", ".join(f"x{k} double" for k in range(DIMS)))
    )
    ends = placed.agg(*(f(f"x{k}") for f in (F.min, F.max) for k in range(DIMS))).first()
    lo, hi = ([x or 0.0 for x in part] for part in (ends[:DIMS], ends[DIMS:]))
    sorted_ = core.written(
        placed.mapInArrow(lambda it: keys(it, lo, hi), "doc_id long, n long, key long")
        .repartitionByRange("key", "doc_id")
        .sortWithinPartitions("key", "doc_id", "n")
        .mapInArrow(running, "part int, doc_id long, n long, within long")
    )
    sums = sorted_.groupBy("part").agg(F.sum("n").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    c = F.lit(capacity).cast("long")
    at = sorted_.join(F.broadcast(before), "part").select("doc_id", "n", (F.col("before") + F.col("within")).alias("at"))
    cut = at.select("doc_id", "n", "at", F.explode(F.sequence(F.expr(f"at div {capacity}L"), F.expr(f"(at + n - 1) div {capacity}L"))).alias("seq"))
    start = F.greatest(F.lit(0), F.col("seq") * c - F.col("at"))
    stop = F.least(F.col("n"), (F.col("seq") + 1) * c - F.col("at"))
    return cut.select("seq", (F.col("at") + start - F.col("seq") * c).alias("pos"), "doc_id", start.alias("start"), (stop - start).alias("length"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(core.table(spark, sf_dir, "documents"))
