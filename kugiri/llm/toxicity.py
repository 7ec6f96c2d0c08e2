"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon holds whole words and stems. Each term's Levenshtein automaton runs over all terms at once: a state is a set of
(trie node, errors), made deterministic step by step and remembered, so a word is looked up in time linear in its length and
most words die within a few letters. Terms of up to 4 letters allow no error, up to 7 one, longer ones two; stems under 6
letters none, others one; the first letter must be right. Beside these, two swapped letters are one error in any term but a
stem under 6 letters, as are a doubled letter in a term of up to 4 letters and a wrong, missing or further first letter in one of
LONG letters or more. Digits and signs that stand for letters are read as those.

The lexicon is LEXICON and what the labels teach: in at most FIT_ROWS labelled documents, the word beginnings that occur in at
least max(MIN_SUPPORT, 1 % of the toxic ones) toxic texts that aren't copies and at most 2 % as many clean ones. Misspellings that
occur in labelled clean documents are ordinary words, and don't count.

A match weighs 1, less 0.3 for each error; inside quotation marks a quarter, soon after a reporting word half (quotation); near
a second-person pronoun one and a half times (abuse), so that one misspelt term is enough there. Of a reporting word and a
second-person pronoun, that one counts which comes later. A document's score is the largest sum within WINDOW words; it is
rejected from THRESHOLD on. A null or empty text has score 0 and is kept. Repeated rows are scored alike. Rows with a null
doc_id are scored too. The text is read to its end, whatever its length.

Quotations are paired over the whole text, whatever their length. An opening mark that repeats at the start of a line goes on with
the quotation that is open; marks without a partner count for nothing. A straight mark opens after a blank or bracket, closes
before one, and where both or neither hold it does what is due; one that opens again replaces the one that was left open.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "retard", "bastard", "bitch")
FIT_ROWS = 20_000
MIN_SUPPORT = 8
WINDOW = 60
DOUBTFUL = 0.6
LONG = 8
THRESHOLD = 1.0
REMEMBERED = 400_000
WORDS = re.compile(r"\w+(?:[@$!*]+\w+)*")
MARKS = re.compile("[“”„«»‘’\"]")
CLOSERS = {"”": "“„", "“": "„", "»": "«", "’": "‘"}
LEET = str.maketrans("013457@$!*", "oieastasi*", "_")
REPORTING = frozenset("said says called calls quote quoted quoting term word slur insult wrote writes reported definition dit appelé mot sagte nannte wort dijo llamó palabra".split())
SECOND = frozenset("you your youre u ur yourself tu toi vous du dich dir ihr usted vosotros".split())
END = "\0"


def allowed(length: int, stem: bool) -> int:
    if stem:
        return 0 if length < 6 else 1
    return 0 if length <= 4 else 1 if length <= 7 else 2


class Matcher:
    """The union of the terms' Levenshtein automata, run along their trie. terms: (letters, whether a stem)."""

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.child: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, int, bool]] = {}
        self.most: list[int] = [0]
        for word, stem in sorted(set(terms)):
            node, most = 0, allowed(len(word), stem)
            for c in word:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], most)
            self.ends[node] = (most, len(word), stem or self.ends.get(node, (0, 0, False))[2])
        self.forget()

    def forget(self) -> None:
        """The states that were made; they are made again as words ask for them."""
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.step: list[dict[str, int]] = [{}]
        self.found: list[int | None] = [None]
        self.moves = 0
        self.start = self.state({(0, 0)})

    def state(self, raw: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        todo = list(raw)
        while todo:  # with the letters that are left out
            node, e = todo.pop()
            if e > self.most[node] and node or best.get(node, 9) <= e:
                continue
            best[node] = e
            if node:
                todo += [(x, e + 1) for x in self.child[node].values()]
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            hit = [e for n, e in key if n in self.ends and e <= self.ends[n][0]]
            self.found.append(min(hit) if hit else None)
        return self.ids[key]

    def advance(self, s: int, c: str) -> int:
        raw: set[tuple[int, int]] = set()
        for node, e in self.sets[s]:
            if node in self.ends and self.ends[node][2] and e <= self.ends[node][0]:
                raw.add((node, e))  # a stem has its end
            for letter, x in self.child[node].items():
                if letter == c:
                    raw.add((x, e))
                elif node:
                    raw.add((x, e + 1))
            if node:
                raw.add((node, e + 1))
        self.step[s][c] = to = self.state(raw) if raw else 0
        self.moves += 1
        return to

    def errors(self, word: str) -> int | None:
        """The least number of errors with which a term is found, None if none is."""
        if self.moves > REMEMBERED:
            self.forget()
        s, step = self.start, self.step
        for c in word:
            to = step[s].get(c)
            s = self.advance(s, c) if to is None else to
            if not s:
                return None
        return self.found[s]


class Slips:
    """Words that are one error from a term although the automaton gives them more or none: see the module."""

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.whole: set[str] = set()
        self.begin: set[str] = set()
        self.tails: set[str] = set()
        self.long: set[str] = set()
        for w, stem in terms:
            if stem and len(w) < 6:
                continue
            (self.begin if stem else self.whole).update(v for k in range(len(w) - 1) if (v := w[:k] + w[k + 1] + w[k] + w[k + 2 :]) != w)
            if not stem and len(w) <= 4:
                self.whole.update(w[:k] + w[k] + w[k:] for k in range(len(w)))
            if not stem and len(w) >= LONG:
                self.tails.add(w[1:])
                self.long.add(w)
        self.lengths = sorted({len(w) for w in self.begin})

    def one(self, word: str) -> bool:
        return word in self.whole or word in self.tails or word[1:] in self.tails or word[1:] in self.long or any(word[:n] in self.begin for n in self.lengths)


def words_of(text: str) -> list[str]:
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return WORDS.findall(text.lower())


def plain(word: str) -> str:
    return word if word.isalpha() else word if word.isdigit() else word.translate(LEET)


def quotations(text: str) -> list[tuple[int, int]]:
    """The outermost spans between marks that pair, in order."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    n: Counter = Counter()

    def close(kinds: str, end: int) -> None:
        while True:
            kind, at = stack.pop()
            n[kind] -= 1
            if kind in kinds:
                break
        while out and out[-1][0] >= at:
            out.pop()
        out.append((at, end))

    for m in MARKS.finditer(text):
        c, at = m.group(), m.start()
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        fresh = before in ("", "\n")
        if c == "’" and after.isalnum():
            continue
        if c == '"':
            opens = (not before or before.isspace() or before in "([{-–—“„«‘") and bool(after) and not after.isspace()
            closes = bool(before) and not before.isspace() and not after.isalnum()
            if n[c] and (closes or not opens):
                close(c, at + 1)
            elif opens or not closes:
                if n[c] and fresh:
                    continue
                while n[c]:  # the one left open, and what opened within it
                    kind, _ = stack.pop()
                    n[kind] -= 1
                stack.append((c, at))
                n[c] += 1
            continue
        kinds = CLOSERS.get(c, "")
        if any(n[k] for k in kinds):
            close(kinds, at + 1)
        elif c in "“„«‘" and not (n[c] and fresh):
            stack.append((c, at))
            n[c] += 1
    return out


class Scorer:
    def __init__(self, terms: Iterable[tuple[str, bool]], doubtful: Iterable[tuple[str, bool]], ordinary: frozenset[str]):
        self.terms, self.doubtful, self.ordinary = frozenset(terms), frozenset(doubtful), ordinary
        self.matcher, self.exact = Matcher(self.terms), Matcher(self.doubtful)
        self.slips = Slips(self.terms)
        self.clean: set[str] = set()

    def match(self, word: str) -> float:
        e = self.matcher.errors(p := plain(word))
        if e != 0 and e != 1 and self.slips.one(p):
            e = 1
        if e is None or e and p in self.ordinary:
            return DOUBTFUL if self.doubtful and self.exact.errors(p) == 0 else 0.0
        return 1 - 0.3 * e

    def score(self, text: str | None) -> tuple[float, int, int]:
        """The score, the number of matches, and how many of them are quoted."""
        if not text:
            return 0.0, 0, 0
        new = set(words_of(text)) - self.clean
        hits = {w: x for w in new if (x := self.match(w))}
        if len(self.clean) > REMEMBERED:
            self.clean.clear()
        self.clean.update(new.difference(hits))
        if not hits:
            return 0.0, 0, 0
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower()
        spans = quotations(text)
        at = list(WORDS.finditer(text))
        found, quoted, q = [], 0, 0
        for i, m in enumerate(at):
            if x := hits.get(m.group()):
                while q < len(spans) and spans[q][1] <= m.start():
                    q += 1
                near = [at[k].group() for k in range(max(0, i - 5), min(len(at), i + 4))]
                if q < len(spans) and spans[q][0] <= m.start():
                    x, quoted = x * 0.25, quoted + 1
                elif (said := max((k for k, w in enumerate(near[: min(i, 5)]) if w in REPORTING), default=-1)) >= 0 and SECOND.isdisjoint(near[said:]):
                    x, quoted = x * 0.5, quoted + 1
                elif not SECOND.isdisjoint(near):
                    x *= 1.5
                found.append((i, x))
        best, total, lo = 0.0, 0.0, 0
        for i, x in found:
            total += x
            while found[lo][0] <= i - WINDOW:
                total -= found[lo][1]
                lo += 1
            best = max(best, total)
        return round(best, 6), len(found), quoted


def beginnings(texts: Iterable[str | None], of: frozenset[str] | None, most: int) -> Counter:
    """In how many texts each beginning of a word occurs, from 4 letters up to most, the whole word with END; only those in of."""
    got: Counter = Counter()
    for t in texts:
        seen: set[str] = set()
        for w in set(map(plain, words_of(t or ""))):
            w += END
            seen.update(w[:k] for k in range(4, min(len(w), most) + 1)) if of is None else seen.update(p for k in range(4, min(len(w), most) + 1) if (p := w[:k]) in of)
        got.update(seen)
    return got


def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With the least hash of each text's word 3-grams, which near copies mostly have in common: a term needs support in texts of their own."""
    for b in batches:
        for lo, texts in core.slices(b.column(0)):
            least = [int(g[0]) - (1 << 63) if len(g) else 0 for g in core.grams(core.tokenize(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), b.column(1).slice(lo, len(texts)).cast(pa.int32()), pa.array(least, pa.int64())], ["text", "y", "family"])


def counted(rows: DataFrame, of: frozenset[str] | None, most: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch], of=of) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for b in batches:
            got += beginnings(b.column(0).to_pylist(), of, most)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["p", "n"])

    return rows.select("text").mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))


def chosen(toxic: dict[str, int], clean: dict[str, int], support: float, most: float) -> set[tuple[str, bool]]:
    """Terms from the counts of beginnings: the shortest that are all but only in toxic texts, each drawn out as long as nearly all of its texts go on alike."""
    pure = {p for p, n in toxic.items() if n >= support and clean.get(p, 0) <= most * n}
    longer: dict[str, list[str]] = {}
    for p in toxic:
        longer.setdefault(p[:-1], []).append(p)
    out = set()
    for p in pure:
        if any(p[:k] in pure for k in range(4, len(p))):
            continue
        while (far := max(longer.get(p, []), key=lambda x: (toxic[x], x), default=None)) and toxic[far] >= 0.97 * toxic[p]:
            p = far
        out.add((p.rstrip(END), not p.endswith(END)))
    return out


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seeds: Iterable[str] = LEXICON) -> Scorer:
    """The scorer: see the module. Without labelled documents it has the seeds alone."""
    terms: set[tuple[str, bool]] = {(w, False) for w in seeds}
    doubtful: set[tuple[str, bool]] = set()
    sample = core.written(core.labelled(docs, labels, "toxic", rows).select("text", "y").mapInArrow(families, "text string, y int, family long").groupBy("y", "family").agg(F.min("text").alias("text")))
    bad, good = sample.where("y = 1"), sample.where("y = 0")
    n = bad.count()
    support = max(MIN_SUPPORT, 0.01 * n)
    toxic, most = {}, 24
    while n >= support:  # until no beginning of most letters is frequent, so that no longer one is
        toxic = {r.p: r.n for r in counted(bad, None, most).where(F.col("n") >= 0.5 * support).collect()}
        if not any(len(p) == most for p in toxic):
            break
        most *= 2
    if toxic:
        keep = frozenset(p for p, k in toxic.items() if k >= support)
        clean = {r.p: r.n for r in counted(good, keep, most).collect()}
        terms |= chosen(toxic, clean, support, 0.02)
        doubtful = chosen(toxic, clean, support, 0.15) - terms

    def misspelt(batches: Iterator[pa.RecordBatch], terms=frozenset(terms)) -> Iterator[pa.RecordBatch]:
        m, slips, seen, out = Matcher(terms), Slips(terms), set(), set()
        for b in batches:
            new = {plain(w) for t in b.column(0).to_pylist() for w in set(words_of(t or ""))} - seen
            seen |= new
            out |= {w for w in new if (e := m.errors(w)) or e is None and slips.one(w)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["w"])

    return Scorer(terms, doubtful, frozenset(r.w for r in good.select("text").mapInArrow(misspelt, "w string").distinct().collect()))


def scored(spark, scorer: Scorer, text: Column) -> Column:
    """A struct of score, hits and quoted."""
    shared = spark.sparkContext.broadcast((scorer.terms, scorer.doubtful, scorer.ordinary))
    held: list[Scorer] = []

    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(*shared.value))
        got = [held[0].score(t) for t in texts.to_pylist()]
        a, b, c = zip(*got) if got else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(a, pa.float64()), pa.array(b, pa.int32()), pa.array(c, pa.int32())], ["score", "hits", "quoted"])

    # declared so, it isn't run once more for each filter on its result
    return F.arrow_udf(score, "struct<score double, hits int, quoted int>").asNondeterministic()(text)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are rejected, columns as they are."""
    spark = docs.sparkSession
    return docs.where(scored(spark, learn(docs, labels), F.col("text"))["score"] < THRESHOLD)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, hits, quoted, toxic) of the documents that are rejected."""
    got = docs.select("doc_id", scored(docs.sparkSession, learn(docs, labels), F.col("text")).alias("s"))
    return got.where(F.col("s.score") >= THRESHOLD).select("doc_id", "s.score", "s.hits", "s.quoted", F.lit(True).alias("toxic"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(core.table(spark, sf_dir, "documents"), core.table(spark, sf_dir, "labels"))
