"""Steps over parts of Arrow batches: against plain loops, and their plans."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from kugiri import catalog
from kugiri.functions.batch import Texts, parts
from kugiri.functions.chars import code_points, types_of
from kugiri.operators import evaluate, filters, predict, segment
from kugiri.plans import pipeline
from kugiri.sources import tables

RNG = random.Random(7)
TEXTS = ["", None, "a", "/", " \\/ ", "\r\n", "12ab１２", "é 👏🏽\r\n", *("".join(RNG.choice(["the ", "tion", "é", "12", "\r\n", "a/b", "\\", "日本", "é", "👏🏽", "x"]) for _ in range(RNG.randint(1, 40))) for _ in range(30))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def only_parts(df):
    """Whether every Python function of the plan takes batches part by part, and no array is walked by a lambda."""
    kinds = re.findall(r"ArrowEvalPython .*, (\d+)\s*$", p := plan(df), re.M)
    return kinds and set(kinds) == {str(PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)} and "lambdafunction" not in p


def words(t, codes):
    """By a loop, without clusters."""
    out = [t[0]]
    for a, b in zip(t, t[1:]):
        k, m = types_of(code_points(a + b)).tolist()
        if k == m and "DRHTKO"[k - 1] in codes:
            out[-1] += b
        else:
            out.append(b)
    return out


def test_parts_are_bounded_and_whole():
    a = pa.array([*TEXTS, "x" * 100, *TEXTS]).slice(3)
    got = list(parts(a, 64))
    assert [x for lo, hi in got for x in range(lo, hi)] == list(range(len(a)))
    assert all(hi == lo + 1 or sum(len((x or "").encode()) for x in a.slice(lo, hi - lo).to_pylist()) <= 64 for lo, hi in got)
    for lo, hi in got:
        t, rows = Texts(a.slice(lo, hi - lo)), a.slice(lo, hi - lo).to_pylist()
        assert ["".join(map(chr, t.points[x:y])) for x, y in zip(t.first, t.last)] == [x or "" for x in rows] and t.valid.tolist() == [x is not None for x in rows]


def test_exploded_scores_neither_shuffle_nor_explode(docs, monkeypatch):  # F1
    spark, m = docs.sparkSession, catalog.LATIN
    rows = []
    for most in (1 << 20, 1):
        monkeypatch.setattr(tables, "BROADCAST_BYTES", most)
        got = predict.exploded_scores(docs, m.tables(spark), m.bias, m.char_window, m.type_window)
        assert ("Generate" in plan(got)) == (most == 1)
        rows.append(sorted(tuple(r) for r in got.collect()))
    assert rows[0] == rows[1] and rows[0]


def test_predicted_words_in_parts(docs):  # F2
    got = pipeline.predict(docs, catalog.LATIN, norm=False)
    assert only_parts(got.select("tokenized"))
    for r in got.select("text", "boundaries", "tokenized").collect():
        if r.text:
            cut = "".join(re.sub(r"([ \\/])", r"\\\1", c) + " " * (b == 1) for c, b in zip(r.text, [*r.boundaries, 0]))
            assert r.tokenized == cut
        else:
            assert r.tokenized == ""


@pytest.mark.parametrize("name", ["tok_wsconst_d", "tok_wsconst_r", "tok_wsconst_dr", "flagship", "tok_offsets", "eval_char", "eval_word", "transfer_documents", "score_lines_documents", "predict_tokens_latin"])
def test_queries_run_in_parts(spark, sf_dir, name):  # F2, F3, F5, F6, F7, F9, F10, F11, F14, F15
    got = catalog.QUERIES[name](spark, sf_dir)
    assert only_parts(got)


@pytest.mark.parametrize("name", ["tok_chain", "score_boundary_latin", "pattern_tagger_documents"])
def test_python_in_parts(spark, sf_dir, name):  # F12, F13, F16
    kinds = re.findall(r"ArrowEvalPython .*, (\d+)\s*$", plan(catalog.QUERIES[name](spark, sf_dir)), re.M)
    assert kinds == [str(PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)]


@pytest.mark.parametrize("codes", ["", "D", "R", "DR", "DRHTKO"])
def test_rule_words(docs, codes):  # F3, F6, F9
    for r in docs.select("text", segment.rule_words(F.col("text"), codes).alias("x"), segment.rule_boundaries(F.col("text"), codes).alias("b")).collect():
        if r.text:
            want = words(r.text, codes)
            assert r.x.tokenized == " ".join(re.sub(r"([ \\/])", r"\\\1", w) for w in want) and r.x.n_tokens == len(want)
            assert sum(r.b) == len(want) - 1 and len(r.b) == len(r.text) - 1
        else:
            assert (r.x.tokenized, r.x.n_tokens, r.b) == (r.text, None if r.text is None else 0, None if r.text is None else [])


def test_clusters_stay_whole(docs):  # F12
    rules = segment.rule_words(F.col("text"), "DRG", True)
    got = docs.where("text <> ''").select("text", rules.alias("x"), F.regexp_extract_all("text", F.lit("\\X"), F.lit(0)).alias("g")).collect()
    for r in got:
        want, at = [], 0
        for g in r.g:
            k, m = (types_of(code_points(r.text[at - 1 : at + 1])).tolist() if at else (0, 1))
            want[len(want) - (k == m and k < 3) :] = [(want[-1] if k == m and k < 3 else "") + g]
            at += len(g)
        assert r.x.tokenized == " ".join(re.sub(r"([ \\/])", r"\\\1", w) for w in want)


def test_counts_of_ngrams_and_words(docs):  # F4, F8, F17
    texts = [t for t in TEXTS if t]
    for lengths, types in (([2], False), ([3], True), ([1, 3, 4, 5], False)):
        got = predict.gram_counts(docs, F.col("text"), lengths, types)
        assert "Generate" not in plan(got)
        units = ["".join(map(str, types_of(code_points(t)))) if types else t for t in texts]
        assert {r.g: r.n for r in got.collect()} == Counter(u[i : i + n] for u in units for n in lengths for i in range(len(u) - n + 1))
    found = predict.word_counts(docs, F.col("text"), docs.sparkSession.createDataFrame([("the",), ("tt",), ("é12",), ("日",), ("",)], "word string"))
    assert {r.word: r.n for r in found.collect()} == {w: n for w in ("the", "tt", "é12", "日") if (n := sum(t.startswith(w, i) for t in texts for i in range(len(t))))}


def test_counts_by_tables_are_those_by_sorting(monkeypatch):
    code = np.random.default_rng(3).integers(0, 50, 400)
    a = [*predict._ranked(code, 50), *predict._counts(code, 50)]
    monkeypatch.setattr(predict, "COUNTED", 10)
    b = [*predict._ranked(code, 50), *predict._counts(code, 50)]
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_evaluation_by_rules_is_that_of_arrays(docs):  # F5, F7
    b = {c: segment.rule_boundaries(F.col("text"), c) for c in ("DR", "D", "RG")}
    for x, y in (("DR", "D"), ("D", "RG")):
        assert evaluate.eval_char_rules(docs, F.col("text"), x, y).first() == evaluate.eval_char(docs, b[x], b[y]).first()
        assert evaluate.eval_word_rules(docs, F.col("text"), x, y).first() == evaluate.eval_word_marks(docs, F.length("text"), b[x], b[y]).first()


def test_rewriting_keeps_unknown_marks(spark):
    df = spark.createDataFrame([("12a\nb", [2, 2, 2, 2]), (None, [1]), ("ab", None), ("a", [])], "t string, b array<int>")
    got = [r.x for r in df.coalesce(1).select(segment.rewritten(F.col("t"), F.col("b"), "D", True).alias("x")).collect()]
    assert got == [[0, 2, 1, 1], None, None, []]
    assert filters.linebreaks(F.split("t", ""), F.col("b")) is not None


def test_searched_trie_is_that_of_tables(monkeypatch):  # F2, F13
    rng = np.random.default_rng(1)
    patterns = [(tuple(rng.integers(1, 5, n).tolist()), int(rng.integers(-3, 2)), rng.integers(-5, 6, int(rng.integers(1, 5))).tolist()) for n in rng.integers(1, 5, 25)]
    n = rng.integers(0, 9, 40)
    letters, last, of = rng.integers(1, 6, n.sum()), np.cumsum(n), np.repeat(np.arange(40), n)
    got = []
    for most in (1 << 22, 0):
        monkeypatch.setattr(predict, "DENSE", most)
        out = np.zeros(len(letters), dtype=np.int64)
        trie = predict.Trie(patterns)
        assert (trie.next is None) == (most == 0)
        trie.add(letters, of, last - n, last, out)
        got.append(out.tolist())
    assert got[0] == got[1]


@pytest.fixture(scope="module")
def one_file(tmp_path_factory):
    """Folders with a table each of documents and conversations: a file or a folder of one file, of one row group or many."""
    rng, out = random.Random(2), {}
    texts = ["".join(rng.choice("abcXYZ0123456789 ./\\\n") for _ in range(700)) for _ in range(2500)]
    ids = pa.array(range(len(texts)), pa.int64())
    for folder in (False, True):
        for size in (len(texts), 250):
            d = out[folder, size < len(texts)] = tmp_path_factory.mktemp("one")
            for name, t in {"documents": {"doc_id": ids, "text": texts}, "conversations": {"conv_id": ids, "turn": ids, "text": texts}}.items():
                if folder:
                    (d / f"{name}.parquet").mkdir()
                pq.write_table(pa.table(t), d / f"{name}.parquet" / "part-0.parquet" if folder else d / f"{name}.parquet", use_dictionary=False, row_group_size=size)
    return texts, out


@pytest.mark.parametrize("name, pattern", [("tok_wsconst_dr", "[0-9]+|[A-Za-z]+|(?s:.)"), ("tok_wsconst_r", "[A-Za-z]+|(?s:.)"), ("tok_chain", "[0-9]+|[A-Za-z]+|(?s:.)")])
def test_a_row_group_with_most_rows_is_dealt_out(spark, one_file, monkeypatch, name, pattern):  # F6, F9, F12
    monkeypatch.setattr(tables, "SMALL_FILE", 0)
    texts, folders = one_file
    want = [(i, " ".join(re.sub(r"([ \\/])", r"\\\1", w) for w in x), len(x)) for i, x in enumerate(re.findall(pattern, t) for t in texts)]
    for (_, many), d in folders.items():
        got = catalog.QUERIES[name](spark, str(d))
        assert ("Repartition" in plan(got)) == (not many)
        rows = got.withColumn("p", F.spark_partition_id()).collect()
        assert many or len(tasks := Counter(r.p for r in rows)) >= 4 and max(tasks.values()) < len(texts) / 2
        assert sorted((r[0], r.tokenized, r.n_tokens) for r in rows) == want
