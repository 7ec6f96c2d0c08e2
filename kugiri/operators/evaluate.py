"""Evaluation of one segmentation against another, by boundary and by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batch import Texts, over_parts
from ..functions.sentence import WORD
from .segment import Rules, known_spans


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a.cast("double") / b)


def _prf(df: DataFrame, hits: str, system: str, reference: str) -> DataFrame:
    p, r = _ratio(F.col(hits), F.col(system)), _ratio(F.col(hits), F.col(reference))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _summed(df: DataFrame, counts: Column) -> DataFrame:
    """The sums of the fields of a struct of numbers; no row of boundaries is shuffled."""
    got = df.select(counts.alias("_k")).select("_k.*")
    return got.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in got.columns))


def _sums_of(t: Texts, *masks: np.ndarray) -> list[pa.Array]:
    """How many of the characters of each text are in each mask."""
    sums = (np.append(0, np.cumsum(m)) for m in masks)
    return [pa.array(s[t.last] - s[t.first]) for s in sums]


CHAR, WORDS = ["tp", "tn", "fp", "fn"], ["c", "r", "s"]


def _char_prf(counts: DataFrame) -> DataFrame:
    return _prf(counts.withColumns({"n_sys": F.col("tp") + F.col("fp"), "n_ref": F.col("tp") + F.col("fn")}), "tp", "n_sys", "n_ref").drop("n_sys", "n_ref")


def _word_prf(counts: DataFrame) -> DataFrame:
    return _prf(counts.select(F.col("c").alias("n_cor"), F.col("s").alias("n_sys"), F.col("r").alias("n_ref")), "n_cor", "n_sys", "n_ref")


def eval_char(df: DataFrame, reference: Column, system: Column) -> DataFrame:
    """Counts of boundaries that are and aren't word boundaries in both arrays, and precision, recall, F1 (NaN where nothing is to divide by). Counted within each row, in Arrow batches, as far as the shorter array goes; a row with a null array doesn't count."""

    def run(reference: pa.Array, system: pa.Array) -> pa.Array:
        ok = reference.is_valid().to_numpy(False) & system.is_valid().to_numpy(False)
        out = np.zeros((4, len(ok)), dtype=np.int64)
        for i in np.flatnonzero(ok).tolist():
            r, s = reference[i].values, system[i].values
            n = min(len(r), len(s))
            r, s = r.slice(0, n), s.slice(0, n)
            known = r.is_valid().to_numpy(False) & s.is_valid().to_numpy(False) if r.null_count or s.null_count else slice(None)
            r, s = (x.fill_null(0).to_numpy(zero_copy_only=False)[known] == 1 for x in (r, s))
            both, one, two = np.count_nonzero(r & s), np.count_nonzero(r), np.count_nonzero(s)
            out[:, i] = both, len(r) - one - two + both, two - both, one - both
        return pa.StructArray.from_arrays([pa.array(x) for x in out], CHAR)

    return _char_prf(_summed(df, F.arrow_udf(run, "struct<tp long, tn long, fp long, fn long>")(reference, system)))


def eval_char_rules(df: DataFrame, text: Column, reference: str, system: str) -> DataFrame:
    """eval_char() of the boundaries that two sets of rules give: one pass over the texts, without arrays of boundaries."""
    rules = Rules(reference), Rules(system)

    def run(texts: pa.Array, *clusters: pa.Array) -> pa.Array:
        t = Texts(texts)
        r, s = (x.apply(t, None, *(clusters if x.clusters else ())) == WORD for x in rules)
        return pa.StructArray.from_arrays(_sums_of(t, r & s, ~r & ~s & t.inner(), ~r & s, r & ~s), CHAR)

    sources = next((x.sources(text) for x in rules if x.clusters), [])
    return _char_prf(_summed(df, over_parts(run, "struct<tp long, tn long, fp long, fn long>", text, *sources)))


def eval_word_rules(df: DataFrame, text: Column, reference: str, system: str) -> DataFrame:
    """eval_word() of the words that two sets of rules give, in one pass as eval_char_rules()."""
    rules = Rules(reference), Rules(system)

    def run(texts: pa.Array, *clusters: pa.Array) -> pa.Array:
        t = Texts(texts)
        starts = []
        for x in rules:
            word = x.apply(t, None, *(clusters if x.clusters else ())) == WORD
            word[t.ends] = True
            end = np.flatnonzero(word)
            of = np.full(len(word), -1, dtype=np.int64)  # for each character that ends a word where this starts
            of[end] = np.append(0, end + 1)[:-1]
            starts.append(of)
        r, s = starts
        return pa.StructArray.from_arrays(_sums_of(t, (r == s) & (r >= 0), r >= 0, s >= 0), WORDS)

    sources = next((x.sources(text) for x in rules if x.clusters), [])
    return _word_prf(_summed(df, over_parts(run, "struct<c long, r long, s long>", text, *sources)))


def eval_word(df: DataFrame, reference: Column, system: Column, tagged: bool = False) -> DataFrame:
    """Words of two arrays of structs (start, end, and tags where these are to agree): one is right where the other array has the same. Arrays of a row are intersected within the row, as strings or numbers, which are hashed."""

    def keyed(c: Column) -> Column:
        if tagged:
            return F.transform(c, lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"), p["tags"]))
        return F.transform(c, lambda p: F.shiftleft(p["start"].cast("long"), 32) + p["end"])

    got = df.select(F.size(F.array_intersect(keyed(reference), keyed(system))).alias("c"), F.size(reference).alias("r"), F.size(system).alias("s"))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    return _prf(got.agg(total("c").alias("n_cor"), total("s").alias("n_sys"), total("r").alias("n_ref")), "n_cor", "n_sys", "n_ref")


def eval_word_marks(df: DataFrame, n: Column, reference: Column, system: Column) -> DataFrame:
    """eval_word, without tags, of two arrays of boundaries over texts of n characters: one pass over Arrow batches counts the words that both have. A row with a null array doesn't count."""

    def run(n: pa.Array, reference: pa.Array, system: pa.Array) -> pa.Array:
        out = np.zeros((3, len(n)), dtype=np.int64)
        ok = n.is_valid().to_numpy(False) & reference.is_valid().to_numpy(False) & system.is_valid().to_numpy(False)
        for i in np.flatnonzero(ok).tolist():
            if size := n[i].as_py():
                keys = [(a.astype(np.int64) << 32) + b for a, b in (known_spans(size, x[i].values.to_numpy(zero_copy_only=False)) for x in (reference, system))]
                out[:, i] = len(np.intersect1d(*keys, assume_unique=True)), len(keys[0]), len(keys[1])
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["c", "r", "s"])

    return _word_prf(_summed(df, F.arrow_udf(run, "struct<c long, r long, s long>")(n.cast("int"), reference, system)))
