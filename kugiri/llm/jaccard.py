"""Near-duplicate join: Jaccard similarity of word 3-gram sets by count-vector R-trees.

Every document is the set of its distinct word 3-grams (48-bit hashes). Documents with one and the same set are a class of
copies, and its least doc_id stands for it. The join is exact: no pair of classes that reaches the threshold is lost, and no cell,
partner list or candidate list is capped.

The index has two levels. Its directory: grams that one set alone holds are left out, and with them all sets that have fewer
than threshold * size others; the rest are put in one global order, by the number of sets that hold a gram and by which these
are. Sets that reach the threshold have one of the first size - needed + 1 in common. All grams that the same sets hold are one
cell; the cells whose least member is the same are one tile, so a set is in few tiles. Within a tile (a large one is cut in parts,
each pair of parts a unit of work) the grams are hashed into groups; the counts of a set's groups are its point, and a packed
R-tree over the points is joined with itself: pairs of nodes whose corner minima, summed, can't reach the needed overlap are
dropped, then pairs of points, and the rest is verified on the whole sets. A pair counts in the least of its common tiles.

Grams travel in packed lists, one for each range of hashes and batch of documents; a gram that several sets of a batch hold is one
entry of the batch's list, so a hot gram has at most one entry a batch. No row holds more than a batch of documents.

Null, empty and wordless texts have no 3-grams: each such document is a class of its own without links. A text of one or two words
has one gram, the text itself. Rows with a null doc_id are left out. Rows that repeat a doc_id count once, with the least of their
sets. Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

THRESHOLD = 0.5
N = 3
GRAM_BITS = 48
#: Grams of one batch of documents, at least PER_LIST for each list, and bytes of grams of one part of a tile: the memory that a task needs.
BATCH, PER_LIST, PART = 1 << 19, 16, 2 << 20
LEAF = 16
GROUPS = 16384
U = np.uint64
LIST, HEADER, FURTHER = 0, 1, 2


def least_overlap(a, b, threshold: float):
    """The least number of common grams with which sets of a and b grams reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


# packed lists


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of one length, each of so many bytes a number, byte by byte so that what is alike is side by side."""
    planes = [np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() for c, width in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(raw: bytes, *widths: int) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    n, at, out = len(data) // sum(widths), 0, []
    for width in widths:
        full = np.zeros((n, 8), dtype=np.uint8)
        full[:, :width] = data[at : at + n * width].reshape(width, n).T
        out.append(full.view("<u8").ravel())
        at += n * width
    return out


def rises(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def six(g: np.ndarray) -> bytes:
    return np.ascontiguousarray(g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(raw) -> np.ndarray:
    full = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    full[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return full.view("<u8").ravel()


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, dtype=np.int64)


def holder(batch: int, own: np.ndarray) -> np.ndarray:
    """A hash of a set of a batch."""
    return core.mix(core.mix(np.array([batch], dtype=np.uint64) + U(0x5EED)) + own.astype(np.uint64))


def listed(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """(key, batch, kind, payload) of batches of documents: a header, lists of grams by range of hashes, and the further holders of grams that the batch has more than once."""
    part, seq, most = TaskContext.get().partitionId(), 0, max(BATCH, PER_LIST * ranges)
    ids: list[np.ndarray] = []
    sets: list[np.ndarray] = []
    total = 0
    for b in batches:
        for lo, texts in core.slices(b.column(1)):
            ids.append(b.column(0).slice(lo, len(texts)).to_numpy())
            for g in core.grams(core.tokenize(texts), N):
                g = g >> U(64 - GRAM_BITS)
                g = g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else g
                sets.append(g)
                total += len(g)
            if total >= most:
                yield flushed(part << 32 | seq, np.concatenate(ids), sets, ranges)
                seq, ids, sets, total = seq + 1, [], [], 0
    if sets:
        yield flushed(part << 32 | seq, np.concatenate(ids), sets, ranges)


def flushed(batch: int, ids: np.ndarray, sets: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    size = np.array([len(g) for g in sets], dtype=np.int64)
    some = np.flatnonzero(size)
    h = np.zeros((2, len(sets)), dtype=np.uint64)
    if len(some):
        flat, at = np.concatenate(sets), (np.cumsum(size) - size)[some]
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x51, 0x77)):
                h[k][some] = np.add.reduceat(core.mix(flat + U(salt << 48)), at)
    # equal sets of the batch are listed once, with the least doc_id
    order = some[np.lexsort((ids[some], h[1][some], h[0][some]))]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[0][order[1:]] != h[0][order[:-1]]) | (h[1][order[1:]] != h[1][order[:-1]])
    first = np.zeros(len(sets), dtype=np.int64)
    first[order[new]] = np.arange(1, new.sum() + 1)  # 0: not the first of its set
    home = int(core.mix(np.array([batch], dtype=np.uint64))[0] % U(ranges))
    key, kind, payload = [home], [HEADER], [pack((ids.view(np.uint64), 8), (h[0], 8), (h[1], 8), (size, 4), (first, 4))]
    if len(order):
        own = order[new]
        g, d = np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own), dtype=np.int64), size[own])
        by = np.argsort(g, kind="stable")
        g, d = g[by], d[by]
        at = runs(g)
        count, at = np.diff(at), at[:-1]
        with np.errstate(over="ignore"):
            held = np.where(count > 1, np.add.reduceat(holder(batch, d), at), U(0))
        more = np.ones(len(g), dtype=bool)
        more[at] = False
        if more.any():
            key, kind, payload = [*key, home], [*kind, FURTHER], [*payload, pack((rises(g[more]), 6), (d[more], 4))]
        g, d = g[at], d[at]
        edge = np.searchsorted((g >> U(GRAM_BITS - 32)) * U(ranges) >> U(32), np.arange(ranges + 1, dtype=np.uint64))
        for r in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            s = slice(edge[r], edge[r + 1])
            key.append(r)
            kind.append(LIST)
            payload.append(pack((rises(g[s]), 6), (d[s], 4), (count[s], 4), (held[s], 8)))
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array([batch] * len(key), pa.int64()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["key", "batch", "kind", "payload"])


REPLY = ["batch", "kind", "payload"]


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each batch learns of its lists: which grams several sets hold, how many, and a hash of which; headers and further holders pass through."""
    lists: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        kinds = b.column(2).to_numpy()
        if (rest := np.flatnonzero(kinds != LIST)).size:
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(rest)) for k in (1, 2, 3)], REPLY)
        for i in np.flatnonzero(kinds == LIST).tolist():
            batch = b.column(1)[i].as_py()
            g, d, count, held = unpack(b.column(3)[i].as_buffer(), 6, 4, 4, 8)
            lists.append((np.cumsum(g, dtype=np.uint64), d.astype(np.uint32), count.astype(np.uint32), np.where(count > 1, held, holder(batch, d)), np.full(len(g), batch)))
    if not lists:
        return
    g, d, count, held, batch = (np.concatenate(x) for x in zip(*lists))
    lists.clear()
    order = np.argsort(g, kind="stable")
    at = runs(g[order])
    with np.errstate(over="ignore"):
        sets, cell = np.add.reduceat(count[order], at[:-1], dtype=np.int64), core.mix(np.add.reduceat(held[order], at[:-1]))
    rank = np.minimum(np.rint(7 * np.log2(sets)), 255).astype(np.uint64)
    keep = np.repeat(sets > 1, np.diff(at))
    which = np.repeat(np.arange(len(sets)), np.diff(at))[keep]
    rows = order[keep]
    by = np.lexsort((g[rows], cell[which], d[rows], batch[rows]))
    rows, which = rows[by], which[by]
    at = runs(batch[rows]).tolist()
    got = [(int(batch[rows[lo]]), pack((rises(d[rows[lo:hi]].astype(np.uint64)), 4), (g[rows[lo:hi]], 6), (cell[which[lo:hi]], 8), (rank[which[lo:hi]], 1))) for lo, hi in zip(at, at[1:])]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([LIST] * len(got), pa.int32()), pa.array([x for _, x in got], pa.binary())], REPLY)


SETS = "doc_id long, h1 long, h2 long, n int, cells array<long>, n_index int, grams binary"


def assembled(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Each batch's documents, from rows in the order of batch: the hash and size of a document's set, and of the first of each set with enough shared grams these and its cells, those of the prefix of the smaller partner first."""
    now, rows = None, []
    for b in batches:
        for batch, kind, payload in zip(*(b.column(k).to_pylist() for k in range(3))):
            if batch != now and rows:
                yield documents(rows, threshold)
                rows = []
            now = batch
            rows.append((kind, payload))
    if rows:
        yield documents(rows, threshold)


def documents(rows: list[tuple[int, bytes]], threshold: float) -> pa.RecordBatch:
    ids, h1, h2, size, first = unpack(next(p for k, p in rows if k == HEADER), 8, 8, 8, 4, 4)
    n_sets = int(first.max(initial=0))
    doc = np.zeros(n_sets, dtype=np.int64)
    doc[first[first > 0].astype(np.int64) - 1] = np.flatnonzero(first > 0)
    parts = [unpack(p, 4, 6, 8, 1) for k, p in rows if k == LIST]
    cells: list = [None] * len(ids)
    grams: list = [None] * len(ids)
    n_index: list = [None] * len(ids)
    if parts:
        d, g, cell, rank = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts]), *(np.concatenate([x[k] for x in parts]) for k in (1, 2, 3))
        for k, p in rows:
            if k == FURTHER:
                more, own = unpack(p, 6, 4)
                more = np.cumsum(more, dtype=np.uint64)
                by = np.argsort(g)
                at = by[np.searchsorted(g[by], more)]
                d, g, cell, rank = (np.concatenate(x) for x in ((d, own), (g, more), (cell, cell[at]), (rank, rank[at])))
        by = np.lexsort((g, cell, rank, d))
        d, g, cell = d[by].astype(np.int64), g[by], cell[by]
        edge = np.searchsorted(d, np.arange(n_sets + 1))
        need = np.ceil(threshold * size[doc] - 1e-9).astype(np.int64)
        index = np.ceil(2 * threshold / (1 + threshold) * size[doc] - 1e-9).astype(np.int64)
        for i in np.flatnonzero(np.diff(edge) >= need).tolist():
            lo, hi = edge[i], edge[i + 1]
            own = cell[lo : hi - need[i] + 1]
            own = own[runs(own)[:-1]]
            small = cell[lo : max(lo, hi - index[i] + 1)]
            row = doc[i]
            cells[row], n_index[row], grams[row] = own.view(np.int64), len(runs(small)) - 1, six(np.sort(g[lo:hi]))
    null = size == 0
    return pa.RecordBatch.from_arrays(
        [pa.array(ids.view(np.int64)), pa.array(h1.view(np.int64), mask=null), pa.array(h2.view(np.int64), mask=null), pa.array(size.astype(np.int32)), pa.array(cells, pa.list_(pa.int64())), pa.array(n_index, pa.int32()), pa.array(grams, pa.binary())],
        ["doc_id", "h1", "h2", "n", "cells", "n_index", "grams"],
    )


# the tree


def point(g: np.ndarray) -> np.ndarray:
    """Counts of the grams in groups, two to four groups a gram, GROUPS at most: of sets with little in common most of the mass falls apart."""
    bits = min(max(len(g), 1).bit_length() + 1, GROUPS.bit_length() - 1)
    return narrow(np.bincount((g >> U(16)).astype(np.int64) & ((1 << bits) - 1), minlength=1 << bits))


def narrow(count: np.ndarray) -> np.ndarray:
    return count.astype(np.uint8 if count.max() < 256 else np.int32)


def folded(p: np.ndarray, n: int) -> np.ndarray:
    return p if len(p) == n else narrow(p.reshape(-1, n).sum(axis=0, dtype=np.int64))


class Roots:
    """Connected sets of rows: each row's root, the smaller part relabelled at each union."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.of[i] != self.of[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            x, y = self.of[x], self.of[y]
            if x != y:
                if len(self.members[x]) < len(self.members[y]):
                    x, y = y, x
                moved = self.members.pop(y)
                self.of[moved] = x
                self.members[x] += moved


def bounded(points: list[np.ndarray], totals: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of rows, paired, whose summed minima reach the overlap that the threshold needs. Points of unlike numbers of groups are folded to the fewest; totals: the sizes of the sets."""
    # sets within reach of one another are of the same or of neighbouring classes of size
    reach = np.floor(np.log(totals) / np.log(1 / threshold) + 1e-9).astype(np.int64) if threshold < 1 else totals
    for c in np.unique(reach):
        rows = np.flatnonzero((reach == c) | (reach == c + 1))
        if len(rows) > 1:
            own = reach[rows] == c
            n = min(len(points[r]) for r in rows)
            tree = Tree(np.stack([folded(points[r], n) for r in rows]), totals[rows])
            for i, j in tree.pairs(threshold):
                keep = own[i] | own[j]
                yield rows[i[keep]], rows[j[keep]]


class Tree:
    """A packed tree over count vectors: rows are put in an order by splitting at the median of the coordinate that varies most, LEAF rows make a leaf, two nodes a node. A node has its corner of largest counts and its least total."""

    def __init__(self, points: np.ndarray, totals: np.ndarray):
        self.points, self.totals = points, totals
        self.order = np.arange(len(totals))
        self.nodes: list[tuple[np.ndarray, int, int, int, int, int]] = []
        self.build(0, len(totals))

    def build(self, lo: int, hi: int) -> int:
        rows = self.order[lo:hi]
        p = self.points[rows]
        left = right = -1
        if hi - lo > LEAF:
            axis, half = p.var(axis=0).argmax(), (hi - lo) // 2
            by = np.lexsort((rows, self.totals[rows])) if (spread := self.totals[rows]).max() > 1.5 * spread.min() else np.argsort(p[:, axis], kind="stable")
            self.order[lo:hi] = rows[by]
            left, right = self.build(lo, lo + half), self.build(lo + half, hi)
        self.nodes.append((p.max(axis=0), int(self.totals[rows].min()), lo, hi, left, right))
        return len(self.nodes) - 1

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of rows, paired, whose summed minima reach the overlap that the threshold needs."""
        todo = [(len(self.nodes) - 1, len(self.nodes) - 1)]
        while todo:
            x, y = todo.pop()
            (hx, sx, xl, xh, xa, xb), (hy, sy, yl, yh, ya, yb) = self.nodes[x], self.nodes[y]
            if x != y and np.minimum(hx, hy).sum(dtype=np.int64) < least_overlap(sx, sy, threshold):
                continue
            if xa < 0 and ya < 0:
                a, b = self.order[xl:xh], self.order[yl:yh]
                bound = np.minimum(self.points[a][:, None, :], self.points[b][None, :, :]).sum(axis=2, dtype=np.int64)
                i, j = np.nonzero(bound >= least_overlap(self.totals[a][:, None], self.totals[b][None, :], threshold))
                if x == y:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield a[i], b[j]
            elif x == y:
                todo += [(xa, xa), (xb, xb), (xa, xb)]
            elif ya < 0 or xa >= 0 and xh - xl >= yh - yl:
                todo += [(xa, y), (xb, y)]
            else:
                todo += [(x, ya), (x, yb)]


#: Bytes of the bits of a unit's sets; a unit with more compares sorted sets.
BITS = 32 << 20


class Overlap:
    """Common members of pairs of sets. member: numbers of what they hold, of: the set of each."""

    def __init__(self, member: np.ndarray, of: np.ndarray, n: int, most: int):
        width = (most + 7) // 8
        self.sets = self.bits = None
        if n * width <= BITS:
            self.bits = np.zeros((n, width), dtype=np.uint8)
            np.bitwise_or.at(self.bits, (of, member >> 3), (1 << (member & 7)).astype(np.uint8))
        else:
            by = np.lexsort((member, of))
            edge = np.searchsorted(of[by], np.arange(n + 1))
            self.sets = [member[by][lo:hi] for lo, hi in zip(edge.tolist(), edge[1:].tolist())]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=np.int64)
        if self.bits is not None:
            step = max(1, (4 << 20) // max(1, self.bits.shape[1]))
            for lo in range(0, len(a), step):
                out[lo : lo + step] = np.bitwise_count(self.bits[a[lo : lo + step]] & self.bits[b[lo : lo + step]]).sum(axis=1, dtype=np.int64)
            return out
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = self.sets[i], self.sets[j]
            if len(x) > len(y):
                x, y = y, x
            if len(x):
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                out[k] = (y[at] == x).sum()
        return out


def linked(ids: np.ndarray, size: np.ndarray, grams: list[np.ndarray], parts: np.ndarray | None, lesser: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, similarities) of the pairs of a unit that reach the threshold: those of different parts where these are given, and not those that a lesser tile has."""
    n = len(ids)
    _, name, held = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), [len(g) for g in grams])
    some = held[name] > 1  # what one set of the unit holds alone is in no overlap
    number = (np.cumsum(held > 1) - 1)[name[some]]
    edge = np.append(0, np.cumsum(np.bincount(of[some], minlength=n)))
    flat = np.concatenate(grams)[some]
    points = [point(flat[lo:hi]) for lo, hi in zip(edge.tolist(), edge[1:].tolist())]
    overlap = Overlap(number, of[some], n, int((held > 1).sum()))
    before = None
    if sum(map(len, lesser)):
        tiles, tile = np.unique(np.concatenate(lesser), return_inverse=True)
        before = Overlap(tile, np.repeat(np.arange(n), [len(x) for x in lesser]), n, len(tiles))
    for a, b in bounded(points, size, threshold):
        if parts is not None:
            keep = parts[a] != parts[b]
            a, b = a[keep], b[keep]
        both = overlap.common(a, b)
        s = both / (size[a] + size[b] - both)
        keep = s >= threshold
        a, b, s = a[keep], b[keep], s[keep]
        if before is not None and len(a):
            keep = before.common(a, b) == 0
            a, b, s = a[keep], b[keep], s[keep]
        if len(a):
            yield a, b, s


UNIT = ["tile", "i", "j", "part", "doc", "n", "copies", "lesser", "grams"]
PAIRS, LINKS = "doc_a long, doc_b long, jaccard double", "doc long, links long, least long"


def units(batches: Iterator[pa.RecordBatch], threshold: float, pairs: bool) -> Iterator[pa.RecordBatch]:
    """PAIRS or, for each set of a unit that has links in it, LINKS, from rows of UNIT in the order of unit."""

    def joined(now: tuple | None, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        part, ids, size, copies = (np.array(x, dtype=np.int64) for x in list(zip(*rows))[:4])
        links, roots = np.zeros(len(rows), dtype=np.int64), Roots(len(rows))
        for a, b, s in linked(ids, size, [unsix(r[5]) for r in rows], part if now[1] != now[2] else None, [np.array(r[4], dtype=np.int64) for r in rows], threshold):
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b])), pa.array(s)], ["doc_a", "doc_b", "jaccard"])
                continue
            links += np.bincount(a, weights=copies[b], minlength=len(rows)).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=len(rows)).astype(np.int64)
            roots.union(a, b)
        if (some := np.flatnonzero(links)).size:
            least = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(least, roots.of, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(least[roots.of[some]])], ["doc", "links", "least"])

    now, rows = None, []
    for b in batches:
        for tile, i, j, *row in zip(*(b.column(k).to_pylist() for k in range(len(UNIT)))):
            if (tile, i, j) != now:
                yield from joined(now, rows)
                now, rows = (tile, i, j), []
            rows.append(row)
    yield from joined(now, rows)


def ranges_of(docs: DataFrame) -> int:
    """Partitions of the lists: four for each of the session's, so that one takes little memory; up to sixteen where the input's files, by their size, would make large ones."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 4 * own if size >> 50 else max(4 * own, min(size >> 22, 16 * own))  # a plan without statistics claims exabytes


def found(docs: DataFrame, threshold: float, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, h1, h2) of each document; (h1, h2, rep, copies) of each class; PAIRS or LINKS of the classes' least documents."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    ranges = ranges_of(texts)
    lists = texts.mapInArrow(lambda it: listed(it, ranges), "key int, batch long, kind int, payload binary")
    known = lists.repartition(ranges, "key").mapInArrow(shared, "batch long, kind int, payload binary")
    each = core.written(known.repartition(ranges, "batch").sortWithinPartitions("batch").mapInArrow(lambda it: assembled(it, threshold), SETS))
    # one set a document, one document a set
    own = core.written(each.groupBy("doc_id").agg(F.min(F.expr("if(n > 0, struct(h1, h2), null)")).alias("h")).select("doc_id", "h.h1", "h.h2"))
    classes = core.written(own.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    sets = each.where("grams is not null").drop("doc_id").join(classes, ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    sets = core.written(sets.select(F.col("rep").alias("doc"), "n", "copies", "cells", "n_index", "grams", (F.octet_length("grams")).cast("long").alias("bytes")))
    held = sets.select("doc", "n_index", F.posexplode("cells").alias("at", "cell")).select("doc", "cell", (F.col("at") < F.col("n_index")).alias("small"))
    least = held.groupBy("cell").agg(F.min("doc").alias("tile"), F.count("*").alias("k"), F.max("small").alias("small")).where("k > 1 and small").select("cell", "tile")
    placed = core.written(held.select("doc", "cell").join(least, "cell").select("doc", "tile").distinct())
    parts = placed.join(sets.select("doc", "bytes"), "doc").groupBy("tile").agg(F.ceil(F.sum("bytes") / PART).cast("int").alias("parts"))
    tiles = placed.join(parts, "tile").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("tile", "parts"))).alias("tiles"))
    rows = sets.join(tiles, "doc").select("doc", "n", "copies", "grams", F.transform("tiles", lambda t: t.tile).alias("lesser"), F.posexplode("tiles").alias("at", "t"))
    rows = rows.withColumn("part", F.expr("cast(pmod(xxhash64(doc, t.tile), t.parts) as int)"))
    rows = rows.select(F.col("t.tile").alias("tile"), "part", "doc", "n", "copies", F.expr("slice(lesser, 1, at)").alias("lesser"), "grams", F.explode(F.expr("sequence(0, t.parts - 1)")).alias("other"))
    rows = rows.select("tile", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), *UNIT[3:])
    return own, classes, rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j").mapInArrow(lambda it: units(it, threshold, pairs), PAIRS if pairs else LINKS)


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: every pair of classes of copies that reaches the threshold, each class by its least doc_id."""
    return found(docs, threshold, True)[2]


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of each document: see the module. class_id: the least doc_id that links lead to; n_links: how many other documents reach the threshold with it, copies among them. docs: doc_id integer, text string."""
    own, classes, links = found(docs, threshold, False)
    links = core.written(links)
    led = groups(links.select(F.col("doc").alias("doc_a"), F.col("least").alias("doc_b"))).select(F.col("doc_id").alias("rep"), "keep")
    total = links.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("links"))
    whole = classes.join(total, "rep", "left").join(led, "rep", "left")
    whole = whole.select("h1", "h2", F.coalesce("keep", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return own.join(whole, ["h1", "h2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, columns as they are, with the least doc_id of each class; rows with a null doc_id stay, as do all rows of a doc_id that stays."""
    gone = jaccard_join(docs, threshold).where("class_id <> doc_id")
    return docs.alias("a").join(gone.select("doc_id").alias("b"), F.col("a.doc_id") == F.col("b.doc_id"), "left_anti")


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, keep): for each document of a pair the least doc_id that pairs lead to. Alternates large and small stars until no edge changes; each round is a table in the shared folder."""
    edges = core.written(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct())

    def tally(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = tally(edges)
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = core.written(small)
        if (now := tally(edges)) == seen:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("keep"))
        seen = now


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(core.table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE o AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, {core.SQL_TOKENS.format("text")} AS w FROM o WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w WHERE len(w) > 0),
m AS (SELECT s, min(doc_id) AS rep, count(*) AS copies, list(doc_id) AS docs FROM s GROUP BY s),
g AS (SELECT rep, copies, len(s) AS n, unnest(s) AS g FROM m),
p AS (SELECT a.rep AS a, b.rep AS b, b.copies AS copies, a.n AS na, b.n AS nb, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT a, b, copies FROM p WHERE c / (na + nb - c) >= {THRESHOLD}),
r(a, b) AS (SELECT rep, rep FROM m UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
d AS (SELECT a, sum(copies) AS links FROM e GROUP BY a),
x AS (SELECT unnest(m.docs) AS doc_id, l.class_id, coalesce(d.links, 0) + m.copies - 1 AS n_links FROM m JOIN l ON l.a = m.rep LEFT JOIN d ON d.a = m.rep)
SELECT DISTINCT o.doc_id, coalesce(x.class_id, o.doc_id) AS class_id, CAST(coalesce(x.n_links, 0) AS BIGINT) AS n_links FROM o LEFT JOIN x USING (doc_id)
"""
