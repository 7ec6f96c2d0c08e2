"""Training: features as tables, linear solvers, quantised weights, models for boundaries and tags.

A corpus is a table of sentences, or a list of them. Features are exact and relational. Boundaries that have the same features
and the same mark are one weighted instance. The solver asks for sums over all instances at each step: a few instances are summed
where the solver is, many (driver_entries) by the executors, where they stay. Tags are solved by the executors, a surface a group
of weighted instances. Solvers are linear classifiers with a regularised constant feature, as numbered in SOLVERS; their optimum,
not their path, is what is defined. The multiclass hinge has all classes in one problem, the others each against the rest; where
unknown marks are a class, it is a third one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import char_type, chars, code_points, ngrams, types_of
from ..functions.sentence import SENTENCE, Sentence
from ..sources.tables import sized, written
from ..sources.text import default_tag_rows
from .model import Model, TagModel

QUANTUM = 32767
#: number: (loss, penalty)
SOLVERS = {0: ("logistic", "l2"), 1: ("squared hinge", "l2"), 2: ("squared hinge", "l2"), 3: ("hinge", "l2"), 4: ("multiclass hinge", "l2"), 5: ("squared hinge", "l1"), 6: ("logistic", "l1"), 7: ("logistic", "l2")}


@dataclass(frozen=True)
class Config:
    char_window: int = 3
    char_n: int = 3
    type_window: int = 3
    type_n: int = 3
    dict_n: int = 4
    eps: float = 0.01
    cost: float = 1.0
    solver: int = 5
    unknown_as_class: bool = False
    #: Features of all instances from which on the sums of the boundary solver are the executors'.
    driver_entries: int = 5_000_000

    def __post_init__(self):
        if self.dict_n < 1:
            raise ValueError("dict_n must be at least 1")
        if self.solver not in SOLVERS:
            raise ValueError(f"solver must be one of {sorted(SOLVERS)}")


def boundary_features(df: DataFrame, key: str, text: Column, config: Config) -> DataFrame:
    """(key, b, kind, gram, rel, n): character (c) and type (t) n-grams of each boundary with their number. Texts of one character have none. Each n-gram goes to the boundaries whose window holds it."""
    base = df.select(F.col(key), chars(text).alias("_c")).where(F.size("_c") > 1).select(key, "_c", F.transform("_c", lambda c: char_type(c).cast("string")).alias("_t"), F.size("_c").alias("_n"))
    out = None
    for kind, units, window, most in (("c", "_c", config.char_window, config.char_n), ("t", "_t", config.type_window, config.type_n)):
        for k in range(1, most + 1) if window else ():
            each = base.select(key, "_n", F.posexplode(ngrams(F.col(units), k)).alias("j", "gram"))
            lo, hi = F.greatest(F.col("j") + k - 1 - window, F.lit(0)), F.least(F.col("j") - 1 + window, F.col("_n") - 2)
            part = each.where(lo <= hi).select(key, "j", "gram", F.explode(F.sequence(lo, hi)).alias("b")).select(key, "b", F.lit(kind).alias("kind"), "gram", (F.col("j") - F.col("b") - 1).alias("rel"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no n-grams of either kind")
    return out.groupBy(key, "b", "kind", "gram", "rel").agg(F.count("*").alias("n"))


def dict_features(df: DataFrame, key: str, text: Column, words: DataFrame, dict_n: int) -> DataFrame:
    """(key, b, kind, len, n): for each word of the dictionary in the text L before it, I inside, R behind it; lengths above dict_n count as dict_n. words: word. Joined on the substrings of the lengths that words have."""
    lengths = [r.n for r in words.select(F.length("word").alias("n")).distinct().orderBy("n").collect()] or [1]
    base = df.where(F.length(text) > 0).select(F.col(key), chars(text).alias("_c")).withColumn("_n", F.size("_c"))
    of = lambda k: F.transform(ngrams(F.col("_c"), k), lambda g, i: F.struct(i.alias("s"), (i + k).alias("e"), g.alias("word")))
    hit = base.select(key, "_n", F.explode(F.concat(*map(of, lengths))).alias("_x")).select(key, "_n", "_x.*")
    hit = hit.join(sized(words.select("word").distinct()), "word")
    cell = lambda b, kind: F.struct(b.cast("int").alias("b"), F.lit(kind).alias("kind"))
    s, e = F.col("s"), F.col("e")
    none = F.array().cast("array<struct<b int, kind string>>")
    cells = F.concat(
        F.when(s > 0, F.array(cell(s - 1, "L"))).otherwise(none),
        F.when(e - s > 1, F.transform(F.sequence(s, e - 2), lambda b: cell(b, "I"))).otherwise(none),
        F.when(e < F.col("_n"), F.array(cell(e - 1, "R"))).otherwise(none),
    )
    return hit.select(key, F.least(e - s, F.lit(dict_n)).alias("len"), F.explode(cells).alias("c")).select(key, "c.*", "len").groupBy(key, "b", "kind", "len").agg(F.count("*").alias("n"))


def tag_features(sentences: list[Sentence], config: Config) -> Iterator[tuple[str, list[str | None], list[tuple[str, str, int]]]]:
    """(surface, tags, features) of each token; a feature (c or t, gram, rel) is an n-gram of up to char_n or type_n more characters that holds the token, rel its end behind the token's."""
    for s in sentences:
        types = "".join(map(str, types_of(code_points(s.text))))
        for a, b in s.tokens():
            got = []
            for kind, source, most in (("c", s.text, config.char_n), ("t", types, config.type_n)):
                for k in range(b - a + 1, b - a + most + 1):
                    got += [(kind, source[j : j + k], j + k - b) for j in range(max(0, b - k), min(a, len(source) - k) + 1)]
            yield s.text[a:b], s.tags_at(b - 1), got


#: What sums(u, f) gives: the instances' features, times f(margins under each column of u, classes, counts).
Sums = Callable[[np.ndarray, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def products(first: np.ndarray, idx: np.ndarray, x: np.ndarray, cls: np.ndarray, count: np.ndarray) -> Sums:
    """Of instances in arrays; the last row of u is that of the constant feature."""
    n, of = len(cls), np.repeat(np.arange(len(cls)), np.diff(first))

    def sums(u: np.ndarray, f) -> np.ndarray:
        z = np.column_stack([np.bincount(of, weights=c[idx] * x, minlength=n) + c[-1] for c in u.T])
        d = f(z, cls, count)
        return np.column_stack([np.append(np.bincount(idx, weights=c[of] * x, minlength=len(u) - 1), c.sum()) for c in d.T])

    return sums


#: The executors' parts of a sum are multiples of this, so that their sum is the same in any order.
GRAIN = 2.0**-24


def spread_products(rows: DataFrame) -> Sums:
    """Of a table (cls, features, count): each task has its own instances, and only sums by feature, as many as weights, come to the driver."""
    spark = rows.sparkSession

    def sums(u: np.ndarray, f) -> np.ndarray:
        shared = spark.sparkContext.broadcast(u)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(shared.value)
            for b in batches:
                total += products(*arrays(b))(shared.value, lambda z, c, n: np.round(f(z, c, n) / GRAIN) * GRAIN)
            some = np.flatnonzero(total.any(axis=1))
            for lo in range(0, len(some), 100_000):
                ids = some[lo : lo + 100_000]
                for k in range(total.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), k)), pa.array(total[ids, k])], ["id", "k", "g"])

        out = np.zeros_like(u)
        got = rows.mapInArrow(part, "id long, k long, g double").groupBy("id", "k").agg(F.sum("g").alias("g")).toArrow()
        out[got.column("id").to_numpy(), got.column("k").to_numpy()] = got.column("g").to_numpy()
        shared.unpersist()
        return out

    return sums


def arrays(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """(first feature of each instance and the number of all, ids, values, classes, counts) of rows (cls, features, count)."""
    f = rows.column("features")
    f = f.combine_chunks() if isinstance(f, pa.ChunkedArray) else f
    size = np.nan_to_num(f.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = f.flatten()
    return np.append(0, np.cumsum(size)), flat.field("id").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(float), rows.column("cls").to_numpy().astype(np.int64), rows.column("count").to_numpy().astype(float)


def slopes(loss: str) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The derivative of the losses by the margins. Of the multiclass hinge there is a margin for each class; of the others one, class 1 being on its positive side."""

    def one(m: np.ndarray) -> np.ndarray:
        if loss == "logistic":
            return -1 / (1 + np.exp(np.clip(m, -50, 50)))
        return -2 * np.maximum(1 - m, 0) if loss == "squared hinge" else -np.clip((1 - m) / SMOOTH, 0, 1)

    def joint(z: np.ndarray, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        own = np.zeros_like(z)
        own[np.arange(len(z)), cls] = 1
        m = (z + 1 - own) / SMOOTH
        p = np.exp(m - m.max(axis=1, keepdims=True))
        return count[:, None] * (p / p.sum(axis=1, keepdims=True) - own)

    def apart(z: np.ndarray, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        y = np.where(cls == 1, 1.0, -1.0)[:, None]
        return count[:, None] * one(y * z) * y

    return joint if loss == "multiclass hinge" else apart


SMOOTH = 0.01


def descend(sums: Sums, n_features: int, classes: int, bound: float, solver: int, cost: float, eps: float, rounds: int = 1000) -> np.ndarray:
    """Weights, a column for each class that has its own, the last row of the constant feature: least penalty + cost * sum of losses, by accelerated proximal gradients (hinge losses smoothed over SMOOTH). bound: the sum of the instances' squared norms, which no eigenvalue exceeds."""
    loss, penalty = SOLVERS[solver]
    smooth = {"logistic": 0.25, "squared hinge": 2.0, "hinge": 1 / SMOOTH, "multiclass hinge": 0.5 / SMOOTH}[loss]
    slope = slopes(loss)
    # power iterations come from below
    v = np.random.default_rng(3).normal(size=(n_features + 1, 1))
    top = 1.0
    for _ in range(20):
        v = sums(v, lambda z, cls, count: count[:, None] * z)
        top = np.linalg.norm(v)
        v /= top
    step = 1 / (cost * smooth * min(1.1 * top, bound) + (penalty == "l2"))
    w = u = np.zeros((n_features + 1, classes if loss == "multiclass hinge" else 1))
    t, start = 1.0, None
    for _ in range(rounds):
        g = cost * sums(u, slope)
        new = u - step * (g + (u if penalty == "l2" else 0))
        if penalty == "l1":
            new = np.sign(new) * np.maximum(np.abs(new) - step, 0)
        change = np.linalg.norm(new - u) / step
        start = start or max(change, 1e-12)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
        if change <= eps * 0.01 * start:
            break
    return w


def solve(first: np.ndarray, idx: np.ndarray, x: np.ndarray, cls: np.ndarray, classes: int, n_features: int, solver: int, cost: float, eps: float, count: np.ndarray | None = None) -> np.ndarray:
    """The weights of each class, a row each with the constant feature last: jointly by the multiclass hinge, else each class against the rest."""
    count = np.ones(len(cls)) if count is None else count
    bound = float((count * (np.bincount(np.repeat(np.arange(len(cls)), np.diff(first)), weights=x * x, minlength=len(cls)) + 1)).sum())
    if SOLVERS[solver][0] == "multiclass hinge":
        return descend(products(first, idx, x, cls, count), n_features, classes, bound, solver, cost, eps).T
    return np.array([descend(products(first, idx, x, (cls == k).astype(np.int64), count), n_features, 2, bound, solver, cost, eps)[:, 0] for k in range(classes)])


def quantised(w: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, float]:
    """Whole numbers up to QUANTUM in size, cut towards zero, and the unit."""
    unit = max(np.abs(w).max(initial=0) / QUANTUM, floor)
    if unit == 0:
        raise ValueError("InvalidModelError: all weights are zero")
    return np.trunc(w / unit).astype(np.int64), unit


def assembled(weights: dict[tuple[str, int], int], window: int) -> list[tuple[str, list[int]]]:
    """n-grams with their weights in place: that of rel at window - len - rel of 2 window - len + 1; zero weights are left out, and n-grams with none else."""
    out: dict[str, list[int]] = {}
    for (gram, rel), w in weights.items():
        if w:
            out.setdefault(gram, [0] * (2 * window - len(gram) + 1))[window - len(gram) - rel] = w
    return sorted(out.items())


def assembled_dictionary(words: list[str], buckets: dict[tuple[str, int], int], dict_n: int) -> list[tuple[str, list[int], str]]:
    """Every word with the weights of its length, those without any included: the dictionary that is dumped has all words."""
    out = []
    for word in sorted(set(words)):
        k = min(len(word), dict_n)
        l, i, r = (buckets.get((kind, k), 0) for kind in "LIR")
        out.append((word, [l, *[i] * (len(word) - 1), r], ""))
    return out


def instances(corpus: DataFrame, words: DataFrame | None, config: Config) -> tuple[DataFrame, DataFrame]:
    """(id, kind, gram, rel, len) of each feature, and (cls, features, count) of each instance: the mark of a boundary (1: one of words), its features (id, n) in order, and how many boundaries are so. corpus: line (unique), s."""
    text, known = F.col("s.text"), F.col("m").isin(0, 1) | F.lit(config.unknown_as_class)
    marks = corpus.select("line", F.posexplode("s.boundaries").alias("b", "m")).where(known).select("line", "b", F.col("m").cast("int").alias("cls"))
    rows = boundary_features(corpus, "line", text, config).withColumn("len", F.lit(0))
    if words is not None:
        rows = rows.unionByName(dict_features(corpus, "line", text, words, config.dict_n).withColumns({"gram": F.lit(""), "rel": F.lit(0)}))
    name = ["kind", "gram", "rel", "len"]
    kept = rows.join(marks, ["line", "b"])
    # as many as the model's weights, which are of a size to be broadcast
    names = corpus.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(sorted(tuple(r) for r in kept.select(*name).distinct().collect()))], "id int, kind string, gram string, rel int, len int")
    each = kept.join(names, name).groupBy("line", "b").agg(F.sort_array(F.collect_list(F.struct("id", F.col("n").cast("long").alias("n")))).alias("features"))
    return names, marks.join(each, ["line", "b"], "left").groupBy("cls", "features").agg(F.count("*").alias("count"))


def sentences_table(spark, sentences: list[Sentence]) -> DataFrame:
    """(line, s) of sentences in a list."""
    rows = [(i, (s.text, list(s.boundaries), [None if t is None else list(t) for t in s.tags], s.n_tags, None)) for i, s in enumerate(sentences)]
    return spark.createDataFrame(rows, f"line long, s {SENTENCE}")


def train(spark, corpus: DataFrame | list[Sentence], words: DataFrame | list[str] = (), tag_dictionary: DataFrame | list[Sentence] = (), config: Config = Config()) -> Model:
    """A model from annotated sentences: a list, or a table of line (unique, its order that of the corpus) and s, the sentence. words: word; tag_dictionary: as corpus. Unknown marks are left out, or with unknown_as_class are no word boundaries."""
    corpus = sentences_table(spark, corpus) if isinstance(corpus, list) else corpus.select("line", "s")
    if not isinstance(words, DataFrame):
        words = spark.createDataFrame([(w,) for w in words], "word string")
    words = words.select("word").where("word <> ''").distinct()
    if isinstance(tag_dictionary, (list, tuple)):
        tag_dictionary = sentences_table(spark, list(tag_dictionary))
    named, rows = instances(corpus, words, config)
    rows = written(rows)
    size = rows.agg(F.collect_set("cls").alias("marks"), F.sum(F.size("features")).alias("entries"), F.sum(F.col("count") * (1 + F.aggregate(F.coalesce("features", F.expr("array()").cast("array<struct<id int, n bigint>>")), F.lit(0.0), lambda a, f: a + f["n"] * f["n"]))).alias("bound")).first()
    if 1 not in size.marks:
        raise ValueError("the corpus has no word boundary")
    names = [tuple(r)[1:] for r in named.orderBy("id").collect()]
    joint, marks = SOLVERS[config.solver][0] == "multiclass hinge", sorted(size.marks)
    if joint:  # classes are those that there are
        rows = rows.withColumn("cls", F.array_position(F.lit(marks), F.col("cls")) - 1)
    sums = spread_products(rows) if (size.entries or 0) > config.driver_entries else products(*arrays(rows.toArrow().sort_by("count")))
    w = descend(sums, len(names), len(marks), float(size.bound), config.solver, config.cost, config.eps)
    w, _ = quantised(w[:, marks.index(1) if joint else 0])
    by = {k: {(g, r): int(w[n]) for n, (kind, g, r, _) in enumerate(names) if kind == k} for k in "ct"}
    buckets = {(kind, k): int(w[n]) for n, (kind, _, _, k) in enumerate(names) if kind in "LIR"}
    return Model(
        int(w[-1]), config.char_window, config.type_window, assembled(by["c"], config.char_window), assembled(by["t"], config.type_window),
        assembled_dictionary([r.word for r in words.collect()], buckets, config.dict_n), train_tags(corpus, tag_dictionary, config),
    )


TOKENS = "line long, pos int, surface string, tags array<string>, features array<struct<kind string, gram string, rel int>>"


def tagged_tokens(corpus: DataFrame, config: Config) -> DataFrame:
    """(line, pos, surface, tags, features) of each token between word boundaries; features: as tag_features has them, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for line, text, marks, tags in f.itertuples(index=False):
                sentence = Sentence(text, list(marks), [None if t is None else list(t) for t in tags])
                sentence.n_tags = max([0, *(len(t) for t in sentence.tags if t)])
                out += [(line, i, surface, t, sorted(set(got))) for i, (surface, t, got) in enumerate(tag_features([sentence], config))]
            yield pd.DataFrame(out, columns=["line", "pos", "surface", "tags", "features"])

    return corpus.select("line", "s.text", "s.boundaries", "s.tags").where("text is not null").mapInPandas(run, TOKENS)


TAGGED = "token string, tags array<array<string>>, bias array<int>, grams array<struct<kind string, gram string, rel int, weights array<int>>>"


def tag_models(tokens: DataFrame, config: Config) -> DataFrame:
    """(token, tags, bias, grams) of each surface of tokens that has tags. Tokens with the same tags and features are counted before they are brought together by surface."""
    each = tokens.groupBy("surface", "tags", "features").agg(F.count("*").alias("n"), F.min(F.struct("line", "pos")).alias("at")).select("surface", "tags", "features", "n", "at.line", "at.pos")

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["line", "pos"])
        rows = [(list(tags), [tuple(g.values()) if isinstance(g, dict) else tuple(g) for g in got], n) for tags, got, n in zip(f["tags"], f["features"], f["n"])]
        got = tag_model(f["surface"].iloc[0], rows, config)
        return pd.DataFrame([got] if got else [], columns=["token", "tags", "bias", "grams"])

    return each.groupBy("surface").applyInPandas(fit, TAGGED)


def tag_model(surface: str, rows: list[tuple[list[str | None], list[tuple[str, str, int]], int]], config: Config) -> tuple | None:
    """The row of TAGGED of a surface from its (tags, features, count) in the order of the corpus, None if none has a tag."""
    width = max(len(t) for t, _, _ in rows)
    slots = [list(dict.fromkeys(t[j] for t, _, _ in rows if j < len(t) and t[j] is not None)) for j in range(width)]
    if not any(slots):
        return None
    grams: dict[tuple[str, str, int], list[int]] = {}
    bias: list[int] = []
    for j, names in enumerate(slots):
        if len(names) < 2:
            continue
        own = [(t[j], f, n) for t, f, n in rows if j < len(t) and t[j] is not None]
        ids = {k: i for i, k in enumerate(sorted({g for _, f, _ in own for g in f}))}
        idx = np.array([ids[g] for _, f, _ in own for g in f], dtype=np.int64)
        first, count = np.append(0, np.cumsum([len(f) for _, f, _ in own])), np.array([n for _, _, n in own], dtype=float)
        ws = solve(first, idx, np.ones(len(idx)), np.array([names.index(t) for t, _, _ in own]), len(names), len(ids), config.solver, config.cost, config.eps, count)
        q, _ = quantised(ws, 1e-6)
        for g, i in ids.items():
            grams.setdefault(g, [0] * len(bias)).extend([0] * (len(bias) - len(grams.get(g, []))))
            grams[g].extend(int(v) for v in q[:, i])
        bias.extend(int(v) for v in q[:, -1])
    return surface, slots, bias, [(*g, w + [0] * (len(bias) - len(w))) for g, w in sorted(grams.items()) if any(w)]


def train_tags(corpus: DataFrame, tag_dictionary: DataFrame, config: Config) -> list[TagModel]:
    """The tag models of the surfaces of a corpus, then those of surfaces that only the tag dictionary has, with the tags of their first occurrence."""
    tokens = tagged_tokens(corpus, config)
    pick = lambda grams, k: [(g.gram, g.rel, list(g.weights)) for g in grams if g.kind == k]
    out = [TagModel(r.token, [list(t) for t in r.tags], list(r.bias), pick(r.grams, "c"), pick(r.grams, "t")) for r in tag_models(tokens, config).orderBy("token").collect()]
    more = default_tag_rows(tagged_tokens(tag_dictionary, config).select("line", "pos", "surface", "tags"), tokens.select("surface"))
    return out + [TagModel(r.surface, [[t] if t else [] for t in r.tags], []) for r in more.orderBy("surface").collect()]
