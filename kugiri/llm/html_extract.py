"""HTML extraction by minimum-cut labelling.

A page's text blocks are the nodes of a graph. The costs of a classifier over each block are the capacities to the terminals;
neighbours in the text and neighbours below one parent element are joined by edges, weaker the further apart they are in the
document tree. The source side of the least cut is the content: the labelling with the least sum of costs and of cut edges.
Blocks whose terminal outweighs all their edges are labelled first, which leaves the least cut as it is; augmenting paths
settle the rest. Capacities are whole numbers, so the cut is exact; of several least cuts it is the one with the least content.

The classifier is a logistic regression over the length, links, punctuation, element, place and neighbours of a block, fitted on
the blocks of at most FIT_PAGES pages, drawn by a hash of page_id (a documented bound), that stand in an element which says what
it holds (article, main, nav, footer, ...; an advertisement's class). What the labels are read from (the features TOLD) is kept
out of the fit, so that pages without such elements are told by the rest; where a page has them, they add their weight in PRIOR.
With no such block in the sample PRIOR is used.

A null page has null text; one without text has empty text and no blocks. Pages are read to their end. Repeated rows are
extracted each; columns other than page_id, url and html are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .html import Block, read

FIT_PAGES = 2_000
ADJACENT, SIBLING, SCALE = 1.0, 0.5, 1000
GOOD = frozenset(("article", "main"))
POOR = frozenset(("nav", "footer", "aside", "header", "form", "menu"))
HINT = re.compile(r"(?:^|[\W_])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|menu|nav\w*|footer|sidebar|cookie\w*|breadcrumbs?|share|social|comments?|related|newsletter)(?:$|[\W_])")
STOP = re.compile(r"[.!?;:,]")
#: bias, log words, links, punctuation, heading, paragraph, list or table, in content element, in boilerplate element, hint, a title comes later, share of the page before it, last, log words before and behind, links beside, sign of rights
PRIOR = np.array([-1.5, 0.8, -3.0, 3.0, 0.5, 0.8, -0.5, 2.0, -3.0, -3.0, -1.0, 0.0, -0.5, 0.1, 0.1, -0.5, -2.0])
TOLD = slice(7, 10)
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights\b|tous droits\b|alle rechte\b|todos los derechos\b)", re.I)


def told(b: Block) -> tuple[bool, bool, bool]:
    """Whether the elements around a block say content, boilerplate, or hint at the latter; worked out once an element."""
    if b.node is None:
        return False, False, False
    todo, at = [], b.node
    while at and "told" not in at.kept:
        todo.append(at)
        at = at.parent
    got = at.kept["told"] if at else (False, False, False)
    for node in reversed(todo):
        got = node.kept["told"] = (got[0] or node.tag in GOOD, got[1] or node.tag in POOR, got[2] or bool(node.hint and HINT.search(node.hint)))
    return got


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block of a page."""
    n = len(blocks)
    words = [b.text.count(" ") + 1 for b in blocks]
    size = [min(np.log1p(w), 6.0) for w in words]
    links = [b.linked / len(b.text) for b in blocks]
    tags = [b.node.tag if b.node else "" for b in blocks]
    title = max((i for i, t in enumerate(tags) if t == "h1"), default=-1)
    chars = np.cumsum([0, *(len(b.text) for b in blocks)])
    out = np.zeros((n, len(PRIOR)))
    for i, b in enumerate(blocks):
        beside = [links[k] for k in (i - 1, i + 1) if 0 <= k < n]
        out[i] = (
            1.0, size[i], links[i], min(len(STOP.findall(b.text)) / words[i], 1.0), tags[i] in ("h1", "h2", "h3", "h4"), tags[i] in ("p", "blockquote", "pre"), tags[i] in ("li", "td", "th", "dt", "dd", "option", "button"),
            *told(b), i < title, chars[i] / max(chars[-1], 1), i == n - 1 and n > 1, size[i - 1] if i else 0.0, size[i + 1] if i + 1 < n else 0.0, sum(beside) / max(len(beside), 1), bool(RIGHTS.match(b.text)),
        )
    return out


def weak_label(x: np.ndarray) -> float | None:
    return 0.0 if x[8] or x[9] else 1.0 if x[7] else None


def edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out[i - 1, i] = out.get((i - 1, i), 0) + ADJACENT / (1 + apart(blocks[i - 1], b))
        parent = b.node.parent.number if b.node and b.node.parent else 0
        if parent in last:
            out[last[parent], i] = out.get((last[parent], i), 0) + SIBLING
        last[parent] = i
    return [(i, j, round(w * SCALE)) for (i, j), w in out.items()]


def apart(a: Block, b: Block) -> int:
    """Steps between the elements of two blocks in the document tree."""
    x, y, steps = a.node, b.node, 0
    while x is not y:
        if y is None or x is not None and x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return steps


def least_cut(source: list[int], sink: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source side. source: what it costs to be on the sink side; sink: to be on the source side."""
    n = len(source)
    net = [s - t for s, t in zip(source, sink)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in joined:
        if w and i != j:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:  # a node that its terminal decides, whatever the others are
        i = todo.pop()
        if side[i] is None and abs(net[i]) > sum(near[i].values()):
            side[i] = net[i] > 0
            for j, w in near[i].items():
                net[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:  # augmenting paths over residual capacities
        cap = {i: dict(near[i]) for i in rest}
        out_, in_ = {i: max(net[i], 0) for i in rest}, {i: max(-net[i], 0) for i in rest}
        while True:
            before: dict[int, int] = {i: -1 for i in rest if out_[i] > 0}
            queue, end = list(before), None
            for i in queue:
                if in_[i] > 0:
                    end = i
                    break
                for j, c in cap[i].items():
                    if c > 0 and j not in before:
                        before[j] = i
                        queue.append(j)
            if end is None:
                break
            path = [end]
            while before[path[-1]] >= 0:
                path.append(before[path[-1]])
            flow = min([in_[end], out_[path[-1]], *(cap[b][a] for a, b in zip(path, path[1:]))])
            in_[end] -= flow
            out_[path[-1]] -= flow
            for a, b in zip(path, path[1:]):
                cap[b][a] -= flow
                cap[a][b] = cap[a].get(b, 0) + flow
        for i in rest:
            side[i] = i in before
    return [bool(x) for x in side]


def labelled(html: str, weights: np.ndarray) -> list[tuple[Block, bool]]:
    blocks = read(html)
    if not blocks:
        return []
    z = np.clip(features(blocks) @ weights, -20, 20)
    good, poor = np.rint(np.logaddexp(0, z) * SCALE).astype(int).tolist(), np.rint(np.logaddexp(0, -z) * SCALE).astype(int).tolist()
    return list(zip(blocks, least_cut(good, poor, edges(blocks))))


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, drawn towards PRIOR; those of TOLD are PRIOR's."""
    if not len(y) or y.min() == y.max():
        return PRIOR
    w, x = PRIOR.copy(), x.copy()
    x[:, TOLD] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + len(y) * 1e-3 * np.eye(len(w)), x.T @ (p - y) + len(y) * 1e-3 * (w - PRIOR))
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return np.round(w, 6)


def learn(pages: DataFrame, rows: int = FIT_PAGES) -> np.ndarray:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(f.tolist(), y) for h in b.column(0).to_pylist() for f in features(read(h)) if (y := weak_label(f)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in got], pa.list_(pa.float64())), pa.array([y for _, y in got], pa.float64())], ["x", "y"])

    # ids alone are drawn, then broadcast, so that no task gathers pages
    picked = pages.where("html is not null and page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(rows)
    drawn = pages.where("html is not null").join(F.broadcast(picked), "page_id").select("html")
    got = drawn.mapInArrow(extract, "x array<double>, y double").orderBy("x", "y").toPandas()
    return fitted(np.array(got.x.tolist()).reshape(len(got), len(PRIOR)), got.y.to_numpy())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_blocks, n_content)."""
    weights = learn(pages)

    def run(rows: pa.Array) -> pa.Array:
        out: tuple[list, list, list] = ([], [], [])
        for h in rows.to_pylist():
            got = labelled(h, weights) if h is not None else None
            out[0].append(None if got is None else "\n".join(b.text for b, good in got if good))
            out[1].append(None if got is None else len(got))
            out[2].append(None if got is None else sum(good for _, good in got))
        return pa.StructArray.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["text", "n_blocks", "n_content"])

    got = pages.select("page_id", "url", F.arrow_udf(run, "struct<text string, n_blocks int, n_content int>")(F.col("html").cast("string")).alias("s"))
    return got.select("page_id", "url", "s.*")


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(core.table(spark, sf_dir, "pages"))
