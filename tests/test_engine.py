import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kugiri.catalog import GOLDENS, LATIN, SPEC
from kugiri.functions import sentence as S
from kugiri.functions.chars import FULLWIDTH, char_type, code_points, fullwidth, type_string, types_of, widened
from kugiri.operators import filters, predict, train
from kugiri.operators.model import Model, TagModel
from kugiri.plans import pipeline
from kugiri.sources import binary, text

letters = st.text(alphabet=st.sampled_from(list("ab /\\-|日カ🤌")), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(letters, st.randoms())
def test_formats_round_trip(t, rng):
    s = S.Sentence(t, [rng.choice([0, 1]) for _ in t[1:]], [None] * len(t))
    for a, b in s.tokens():
        if rng.random() < 0.5:
            s.tags[b - 1] = ["x/ y", None, "-|"][: rng.randint(1, 3)]
    s.padded()
    for write, parse in ((S.write_tokenized, S.parse_tokenized), (S.write_partial, S.parse_partial)):
        back = parse(write(s))
        assert (back.text, back.boundaries) == (s.text, s.boundaries)
        assert [S._trimmed(x) for x in back.tags] == [S._trimmed(x) for x in s.tags]


def test_full_width(spark):
    assert len(FULLWIDTH) == 96
    t = "".join(map(chr, range(32, 127))) + "～－―─–｢｣､･｡"
    r = spark.createDataFrame([(t,)], "t string").select(fullwidth(F.col("t")).alias("w"), type_string(F.col("t")).alias("k")).first()
    assert r.w == widened(t) and len(r.w) == len(t) and r.w[13] == "−"
    assert r.k == "".join(map(str, types_of(code_points(t))))


def test_types_agree(spark):
    points = [*range(0x30, 0x7F), 0x3040, 0x3096, 0x3097, 0x30A0, 0x30FA, 0x30FB, 0x30FC, 0xFF66, 0xFF9F, 0x3400, 0x4DC0, 0x20000, 0x2CEAF, 0x2FA1F, 0x2FA20, 0xE9]
    rows = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string").select("p", char_type(F.col("c")).alias("t"), type_string(F.col("c")).alias("s")).collect()
    assert all(r.t == types_of(np.array([r.p]))[0] == int(r.s) for r in rows)


def brute_scores(m, t):
    types = "".join(map(str, types_of(code_points(t))))
    out = [m.bias] * (len(t) - 1)
    for source, grams, window in ((t, m.char_ngrams, m.char_window), (types, m.type_ngrams, m.type_window)):
        for g, w in grams:
            for e in range(len(g), len(t) + 1):
                if source[e - len(g) : e] == g:
                    for k, x in enumerate(w):
                        if 0 <= (b := e - 1 - window + k) < len(out):
                            out[b] += x
    for d, w, _ in m.dictionary:
        for s in range(len(t) - len(d) + 1):
            if t.startswith(d, s):
                for k, x in enumerate(w):
                    if 0 <= (b := s - 1 + k) < len(out):
                        out[b] += x
    return out


def test_scores_against_the_definition(spark):
    texts = ["the nation the que. 12 é", "e", "", "th" * 3000, "on on on"]
    for m in (LATIN, *(g[0] for g in GOLDENS.values())):
        rows = spark.createDataFrame(list(enumerate([*texts, None, "a\0b", "我らは全世界の国民"])), "i int, t string").coalesce(1).select("i", "t", predict.scores(spark, m, F.col("t")).alias("s")).collect()
        for r in rows:
            if r.t is None or "\0" in r.t or not r.t:
                assert r.s is None or r.s == []
            else:
                assert list(r.s) == brute_scores(m, r.t)


def test_both_forms_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["the nation the que. 12 é", "e", "on on on", "zz"])], "doc_id long, text string")
    a = {(r.doc_id, r.b, r.score) for r in predict.exploded_scores(df, LATIN.tables(spark), LATIN.bias, LATIN.char_window, LATIN.type_window).collect()}
    b = {(r.doc_id, r.b, r.score) for r in df.select("doc_id", F.posexplode(predict.scores(spark, LATIN, F.col("text"))).alias("b", "score")).collect()}
    assert a == b


F8 = Model(1, 3, 3, [("この人", [1, 2, 3, 4]), ("人だ", [5, 6, 7, 8, 9])], [], [("人", [10, 11], ""), ("火星", [12, 13, 14], "")], [
    TagModel("人", [["a", "b", "c"]], [0, 0, 0], [("の人", 0, [15, 16, 17]), ("の人", 1, [18, 19, 20]), ("人は", 1, [21, 22, 23]), ("人は", 3, [24, 25, 26]), ("火星人", 0, [27, 28, 29])], [("35", 0, [10, 11, 12])])])


def test_tag_scores(spark):
    c = predict.Compiled.of(F8)
    t = "この人は火星人だ"
    assert brute_scores(F8, t) == [3, 14, 16, 13, 19, 31, 19]
    # type n-grams count only with a type scorer
    assert c.class_scores(t, "33535553", 3, "人") == [36, 38, 40] and c.class_scores(t, "33535553", 7, "人") == [27, 28, 29]
    assert c.class_scores(t, "33535553", 1, "x") is None


def test_predict_plan(spark):
    df = spark.createDataFrame([(0, "この人は地球人だ"), (1, ""), (2, None), (3, "a\0b"), (4, "人")], "id int, text string")
    got = {r.id: r for r in pipeline.predict(df, SPEC, predict_tags=True, scores=True, tag_scores=True).collect()}
    assert got[0].tokenized == "この 人/名詞/ヒト は 地球/名詞/チキュー 人/接尾辞/ジン だ"
    assert got[0].score_lines[0] == "0:この -22" and got[0].tag_score_lines[1] == "人\t名詞:76,接尾辞:4\tジン:4,ヒト:82"
    assert got[1].tokenized == got[2].tokenized == got[3].tokenized == "" and got[4].tokenized.startswith("人/")


def test_evaluate_plan(spark):
    lines = spark.createDataFrame([("この 人 は 地球 人 だ",), ("",), ("人",)], "line string")
    r = pipeline.evaluate(lines, SPEC).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (5, 0, 0, 1.0)
    w = pipeline.evaluate(lines, SPEC, metric="word").first()
    assert (w.n_cor, w.n_sys, w.n_ref) == (7, 7, 7)
    tagged = spark.createDataFrame([("この 人/名詞/ヒト は 地球/名詞/チキュー 人/名詞/ジン だ",)], "line string")
    assert pipeline.evaluate(tagged, SPEC, metric="word", predict_tags=True).first().n_cor == 5
    with pytest.raises(ValueError):
        pipeline.evaluate(lines, SPEC, metric="x")


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo\rthree\n\nfour".encode())
    assert [r.line for r in text.read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two\rthree", "", "four"]


@pytest.mark.parametrize("solver", [0, 1, 3, 4, 5, 6])
def test_training_segments_its_corpus(spark, solver):
    lines = ["まぁ/副詞 社長/名詞 は/助詞 火星/名詞 猫/名詞 だ/助動詞", "火星/名詞 猫/名詞 の/助詞 生態/名詞", "猫/名詞 は/助詞 は/動詞 は/助詞 だ/助動詞"]
    corpus = [S.parse_tokenized(x) for x in lines]
    model = train.train(spark, corpus, ["火星", "猫"], [S.parse_tokenized("犬/名詞 猫/動詞")], train.Config(solver=solver, cost=10.0))
    got = [r.tokenized for r in pipeline.predict(spark.createDataFrame([(s.text,) for s in corpus], "text string"), model, norm=False).collect()]
    assert got == [S.write_tokenized(S.Sentence(s.text, s.boundaries)) for s in corpus]
    tags = {t.token: t.tags for t in model.tag_models}
    assert tags["犬"] == [["名詞"]] and tags["猫"] == [["名詞"]] and tags["は"] == [["助詞", "動詞"]]
    assert max(abs(w) for _, ws in model.char_ngrams for w in ws) <= train.QUANTUM


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.lists(st.lists(st.integers(1, 6), max_size=9), max_size=6), st.integers(0, 1 << 30))
def test_table_of_type_windows_is_the_trie(window, texts, seed):
    rng = np.random.default_rng(seed)
    grams = {tuple(rng.integers(1, 7, rng.integers(1, 2 * window + 1)).tolist()) for _ in range(12)}
    patterns = [(g, len(g) - 1 - window, rng.integers(-9, 9, 2 * window - len(g) + 1).tolist()) for g in sorted(grams)]
    assert predict.Windows.fit(patterns, window)
    n = np.array([len(t) for t in texts], dtype=np.int64)
    letters, last, of = np.array([x for t in texts for x in t], dtype=np.int64), np.cumsum(n), np.repeat(np.arange(len(n)), n)
    got, want = np.zeros(len(letters), dtype=np.int64), np.zeros(len(letters), dtype=np.int64)
    predict.Windows(patterns, window).add(letters, of, last - n, last, got)
    predict.Trie(patterns).add(letters, of, last - n, last, want)
    assert got.tolist() == want.tolist()


def test_sums_of_executors_are_those_of_the_driver(spark):
    corpus = [S.parse_tokenized(x) for x in ("まぁ 社長 は 火星 猫 だ", "火星 猫 の 生態")]
    names, rows = train.instances(train.sentences_table(spark, corpus), None, train.Config())
    here, there, n = train.products(*train.arrays(rows.toArrow())), train.spread_products(rows.repartition(3)), names.count()
    u = np.random.default_rng(5).normal(size=(n + 1, 2))
    for f in (train.slopes("multiclass hinge"), lambda z, cls, count: count[:, None] * z):
        assert np.abs(here(u, f) - there(u, f)).max() < 1e-5
    assert (there(u, f) == train.spread_products(rows.coalesce(1))(u, f)).all()


def test_training_on_executors(spark):
    corpus = [S.parse_tokenized(x) for x in ("あい う", "う あい")]
    models = [train.train(spark, corpus, config=train.Config(char_window=1, char_n=1, type_window=0, solver=1, eps=10.0, driver_entries=k)) for k in (0, 10_000)]
    assert models[0].char_ngrams and models[0].bias == pytest.approx(models[1].bias, abs=2)
    for (a, x), (b, y) in zip(models[0].char_ngrams, models[1].char_ngrams, strict=True):
        assert a == b and x == pytest.approx(y, abs=2)


def test_multiclass_hinge_is_joint():
    rng = np.random.default_rng(0)
    x = (rng.random((120, 12)) < 0.3).astype(float)
    cls = (x @ rng.normal(size=(12, 3))).argmax(axis=1)
    first, idx = np.append(0, np.cumsum((x > 0).sum(axis=1))), np.nonzero(x)[1]
    w = train.solve(first, idx, np.ones(len(idx)), cls, 3, 12, 4, 1.0, 0.001)

    def loss(w):
        z = x @ w[:, :-1].T + w[:, -1]
        return 0.5 * (w**2).sum() + ((z + 1 - np.eye(3)[cls]).max(axis=1) - z[np.arange(120), cls]).sum()

    assert np.abs(w.sum(axis=0)).max() < 1e-6  # no class is favoured as a whole
    assert min(loss(w + rng.normal(size=w.shape) * s) for s in (0.001, 0.01, 0.1) for _ in range(100)) > 0.998 * loss(w)
    apart = train.solve(first, idx, np.ones(len(idx)), cls, 3, 12, 3, 1.0, 0.001)
    assert loss(w) < loss(apart)


def test_unknown_marks_as_a_class(spark):
    corpus = [S.parse_partial("あ|い-う い|う")]
    plain, third = (train.train(spark, corpus, config=train.Config(solver=4, cost=10.0, unknown_as_class=k)) for k in (False, True))
    assert plain.char_ngrams != third.char_ngrams


def test_training_errors(spark):
    with pytest.raises(ValueError):
        train.train(spark, [S.parse_tokenized("一語")])
    with pytest.raises(ValueError):
        train.Config(dict_n=0)


def test_binary_numbers():
    for n in (0, 1, -1, 125, -126, 250, 251, 65535, 65536, -(2**31), 2**31 - 1):
        assert binary.Reader(binary._signed(n)).signed() == n
    with pytest.raises(binary.InvalidModel):
        binary.decode(b"no header")


def test_trie_format():
    chars = "人だDK"
    p = lambda f, *v: struct.pack("<" + f, *v)
    string = lambda s: p("I", len(s)) + b"".join(p("H", chars.index(c) + 1) for c in s)
    numbers = lambda v: p("I", len(v)) + b"".join(p("h", x) for x in v)

    def trie(words, entries, n_dicts=1):
        out = p("BI", n_dicts, len(words) + 1)
        out += p("II", 0, len(words)) + b"".join(p("HI", chars.index(w) + 1, i + 1) for i, w in enumerate(words)) + p("IB", 0, 0)
        out += b"".join(p("II", 0, 0) + p("II", 1, i) + p("B", 1) for i in range(len(words)))
        return out + p("I", len(entries)) + b"".join(entries)

    none = p("BI", 0, 0)
    lookup = p("B", 1) + trie("人", [numbers([1, 2, 3, 4])]) + trie("K", [numbers([5, 6, 7])]) + none + numbers([8, 9, 10]) + numbers([-3]) + numbers([]) + numbers([])
    linear = p("I", 2) + p("B", 1) + p("ii", 1, 2) + p("Bd", 1, 1.0) + lookup
    entry = string("だ") + p("B", 1)
    data = b"tag\n" + p("BBI", 1, 0, 0) + p("BBBBBBdB", 1, 3, 1, 3, 1, 1, 0.1, 5) + chars.encode() + b"\0" + linear + trie("だ", [entry]) + none
    m = binary.convert(data)
    assert m == Model(-3, 1, 1, [("人", [1, 2])], [("5", [5, 6])], [("だ", [8, 10], "")])


def python_runs(df):
    """How many Arrow evaluations the plan has."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_token_and_score_functions_run_once(spark, tmp_path):
    from kugiri import catalog

    rows = [(1, "the ent. 12", "en", "s", 0), (2, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "the ent")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("flagship", "tok_offsets", "pattern_tagger_documents", "score_boundary_latin", "score_type_only", "eval_word"):
        assert python_runs(catalog.QUERIES[name](spark, str(tmp_path))) == 1, name
    df = spark.createDataFrame([(1, "a\nb")], "id int, text string")
    assert python_runs(pipeline.search_tokens(df, Model(bias=1), ["id"])) == 2  # scores, then tokens


def test_predict_keeps_the_columns_of_its_input(spark):
    df = spark.createDataFrame([(1, "この人", 7, 8)], "id int, text string, _x int, _scores int")
    r = pipeline.predict(df, SPEC).first()
    assert (r._x, r._scores) == (7, 8) and r.tokenized == "この 人"


def test_dictionary_keeps_words_without_weights():
    assert train.assembled_dictionary(["ab", "cde"], {("L", 2): 1}, 4) == [("ab", [1, 0, 0], ""), ("cde", [0, 0, 0, 0], "")]


def test_words_by_marks_are_those_by_spans(spark):
    from kugiri.operators import evaluate, segment

    rows = [(5, [1, 0, 1, 0], [1, 1, 1, 0]), (3, [2, 0], [1, 0]), (1, [], []), (0, [], []), (4, None, [0, 0, 0]), (3, [1, 2], [1, 0])]
    df = spark.createDataFrame(rows, "n int, r array<int>, s array<int>")
    a = evaluate.eval_word_marks(df, F.col("n"), F.col("r"), F.col("s")).first()
    b = evaluate.eval_word(df.where("r is not null"), segment.spans(F.col("n"), F.col("r")), segment.spans(F.col("n"), F.col("s"))).first()
    assert a == b and a.n_cor == 4


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from kugiri.sources.tables import shared_dir

    nothing = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: nothing)))
    assert shared_dir(spark).startswith("file:")


def test_model_headers_and_files(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(binary.encode(SPEC))
    assert binary.read_model(spark, f"file://{tmp_path}/m.bin") == SPEC
    with pytest.raises(binary.InvalidModel, match="version mismatch"):
        binary.decode(binary.encode(SPEC, header=b"another 1\n"))


def test_rules_in_one_pass_are_the_chain(spark):
    from kugiri.functions.chars import chars
    from kugiri.operators import filters, segment

    texts = ["12 ab １２ＡＢ カナかな漢字－-ー\r\n👏🏽é", "a", "", None, "ーｰ－―ア", "0" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for codes in ("", "D", "DR", "DRHTKO"):
        for wide in (False, True):
            c = chars(fullwidth(F.col("t")) if wide else F.col("t"))
            b = filters.chain(c, F.array_repeat(F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), codes, True)
            rows = df.select(segment.rule_token_array(F.col("t"), codes, wide).alias("x"), segment.token_array(F.col("t"), b).alias("y")).collect()
            assert all(r.x == r.y for r in rows if r.y is not None) and rows[3].x is None and rows[2].x == []
    with pytest.raises(ValueError):
        segment.rule_token_array(F.col("t"), "G")


def test_small_sides_are_broadcast_by_their_size(spark, monkeypatch):
    from kugiri.sources import tables

    tokens = spark.createDataFrame([("この", [None]), ("は", [None])], "surface string, tags array<string>")
    rules = spark.createDataFrame([("は", ["助詞"])], "surface string, tags array<string>")
    plans, rows = [], []
    for most in (1 << 20, 1):
        monkeypatch.setattr(tables, "BROADCAST_BYTES", most)
        got = filters.pattern_tags(tokens, rules)
        plans.append(got._jdf.queryExecution().optimizedPlan().toString())
        rows.append(sorted(tuple(r) for r in got.select("surface", F.get("tags", F.lit(0))).collect()))
    assert rows[0] == rows[1] == [("この", None), ("は", "助詞")]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]
    assert tables.sized(rules.limit(0)).count() == 0
