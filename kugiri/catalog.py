"""The queries over the engine's own operators, and the SQL that gives the same rows.

Queries over tables read whole tables; those over literals hold the cases whose results are known.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__
from .functions import sentence as S
from .functions.chars import char_type, chars, fullwidth, sql_fullwidth, sql_type, type_string
from .operators import evaluate, filters, predict, segment, train
from .operators.model import Model, TagModel, dump_dictionary, load_dictionary
from .plans import pipeline
from .sources import binary, text
from .sources.tables import shared_dir, table
from .streaming import stream

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: A small model of Latin texts, over which the scores of whole tables are held against SQL.
LATIN = Model(
    -3, 3, 2,
    [("e ", [0, 2, 9, -1, 0]), (" ", [1, 0, 6, 7, 0, -2]), ("th", [0, 3, -7, -2, 1]), ("on", [2, 0, -4, 1, 0]), ("é", [-1, 2, 0, -5, 3, 1]), (". ", [0, 0, 8, 4, 0]), ("ent", [1, -2, -6, 3])],
    [("22", [1, -6, 2]), ("26", [0, 7, 3]), ("62", [2, 6, -1]), ("6", [1, 2, 3, -1]), ("1", [-1, -8, -8, 2])],
    [("the", [5, -9, -9, 4], ""), ("tion", [-3, -6, -6, -6, 2], ""), ("que", [4, -5, -5, 6], "")],
)
SPEC = Model(
    5, 3, 3, [("この人", [1, -2, 3, 4]), ("人だ", [-5, 6, 7, 8, 9])], [("335", [10, -11, 12, 13]), ("53", [-14, 15, 16, 17, -18])], [("人", [19, 20], ""), ("地球", [21, -22, 23], "")],
    [TagModel("人", [["名詞", "接尾辞"], ["ジン", "ヒト"]], [40, 41, 42, 43], [("は地球人", 0, [-32, 33, 34, -35])], [("353", 1, [36, -37, -38, 39])]), TagModel("地球", [["名詞"], ["マンホーム", "チキュー"]], [46, 47], [("は地球人", 1, [-44, 45])], [])],
)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def literal(columns: list[str], rows: list[tuple]) -> str:
    def q(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ") AS t(" + ", ".join(f'"{c}"' for c in columns) + ")"


EXPLODED = "SELECT {keys}, unnest(string_split({text}, '')) AS c, generate_subscripts(string_split({text}, ''), 1) AS i FROM {table} WHERE {text} <> ''"
TYPES = f"array_to_string(list_transform(string_split({{0}}, ''), lambda c: {sql_type('c')}), '')"
DIGITS, LETTERS = "[0-9０-９]+", "[A-Za-zＡ-Ｚａ-ｚ]+"
ESCAPED = r"regexp_replace({0}, '([ \\/])', '\\\1', 'g')"


def exploded(keys: str, column: str, name: str) -> str:
    return EXPLODED.format(keys=keys, text=column, table=name)


# characters


@query("char_type_hist", f"SELECT {sql_type('c')} AS type, count(*) AS n FROM ({exploded('doc_id', 'text', 'documents')}) GROUP BY 1")
def char_type_hist(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select(F.explode(chars(F.col("text"))).alias("c")).groupBy("c").count()
    return each.groupBy(char_type(F.col("c")).alias("type")).agg(F.sum("count").alias("n"))


@query("char_type_by_lang", f"SELECT lang, {sql_type('c')} AS type, count(*) AS n FROM ({exploded('lang', 'text', 'documents')}) GROUP BY 1, 2")
def char_type_by_lang(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("lang", F.explode(chars(F.col("text"))).alias("c")).groupBy("lang", "c").count()
    return each.groupBy("lang", char_type(F.col("c")).alias("type")).agg(F.sum("count").alias("n"))


@query("fullwidth_documents", f"SELECT doc_id, {sql_fullwidth('text')} AS wide FROM documents")
def fullwidth_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fullwidth(F.col("text")).alias("wide"))


@query("fullwidth_pages", f"SELECT page_id, {sql_fullwidth('html')} AS wide FROM pages")
def fullwidth_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fullwidth(F.col("html")).alias("wide"))


@query("type_runs", f"SELECT CAST(r[1] AS INT) AS type, count(*) AS runs, max(length(r)) AS longest, CAST(sum(length(r)) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all({TYPES.format('text')}, '1+|2+|3+|4+|5+|6+')) AS r FROM documents WHERE text <> '') GROUP BY 1")
def type_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(type_string(F.col("text")), F.lit("1+|2+|3+|4+|5+|6+"), F.lit(0))).alias("r"))
    return runs.groupBy(F.substring("r", 1, 1).cast("int").alias("type")).agg(F.count("*").alias("runs"), F.max(F.length("r")).cast("long").alias("longest"), F.sum(F.length("r")).alias("n"))


_golden_text = "Rustで良いプログラミング体験を！"


@query("char_types_golden", literal(["i", "type"], list(enumerate([2, 2, 2, 2, 3, 5, 3, *[4] * 7, 5, 5, 3, 6]))))
def char_types_golden(spark, sf_dir):
    return spark.createDataFrame([(_golden_text,)], "text string").select(F.posexplode(F.transform(chars(F.col("text")), char_type)).alias("i", "type"))


# segmentation by rules


def _rules(spark, sf_dir, name: str, key: list[str], codes: str, breaks: bool = False) -> DataFrame:
    df = table(spark, sf_dir, name).where("text <> ''")
    return df.select(*key, segment.rule_words(F.col("text"), codes, breaks).alias("x")).select(*key, "x.*")


def _rules_sql(name: str, key: str, pattern: str) -> str:
    found = f"regexp_extract_all(text, '{pattern}')"
    return f"SELECT {key}, array_to_string(list_transform(l, lambda x: {ESCAPED.format('x')}), ' ') AS tokenized, len(l) AS n_tokens FROM (SELECT {key}, {found} AS l FROM {name} WHERE text <> '')"


for _codes, _pattern in (("D", f"{DIGITS}|(?s:.)"), ("R", f"{LETTERS}|(?s:.)"), ("DR", f"{DIGITS}|{LETTERS}|(?s:.)")):
    QUERIES[f"tok_wsconst_{_codes.lower()}"] = lambda spark, sf_dir, c=_codes: _rules(spark, sf_dir, "documents", ["doc_id"], c)
    ORACLE[f"tok_wsconst_{_codes.lower()}"] = _rules_sql("documents", "doc_id", _pattern)


@query("tok_chain", _rules_sql("conversations", "conv_id, turn", f"{DIGITS}|{LETTERS}|(?s:.)"))
def tok_chain(spark, sf_dir):
    return _rules(spark, sf_dir, "conversations", ["conv_id", "turn"], "DRG", True)


_span_sql = f"""
WITH l AS (SELECT conv_id, turn, regexp_extract_all(text, '{DIGITS}|{LETTERS}|(?s:.)') AS l FROM conversations WHERE text <> ''),
t AS (SELECT conv_id, turn, len(l) AS position_length, unnest(l) AS surface, generate_subscripts(l, 1) - 1 AS pos FROM l),
o AS (SELECT *, sum(length(surface)) OVER w AS "end", sum(strlen(surface)) OVER w AS byte_end FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos))
SELECT conv_id, turn, CAST(pos AS INT) AS pos, surface, CAST("end" - length(surface) AS INT) AS start, CAST("end" AS INT) AS "end", CAST(byte_end - strlen(surface) AS INT) AS byte_start, CAST(byte_end AS INT) AS byte_end, CAST(position_length AS INT) AS position_length FROM o
"""


@query("tok_offsets", _span_sql)
def tok_offsets(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").where("text <> ''")
    return segment.token_rows(df, ["conv_id", "turn"], segment.rule_token_array(F.col("text"), "DR"), offsets=True)


@query("stream_tokens", f"SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS surface FROM (SELECT conv_id, turn, regexp_extract_all(text, '{DIGITS}|{LETTERS}|(?s:.)') AS l FROM conversations WHERE text <> '')")
def stream_tokens(spark, sf_dir):
    schema = table(spark, sf_dir, "conversations").schema
    path = f"{sf_dir}/conversations.parquet"
    import os

    rows = spark.readStream.schema(schema).parquet(path if os.path.isdir(path) else f"{sf_dir}/conversations*.parquet")
    got = stream.rule_tokens(rows, ["conv_id", "turn"], "text").select("conv_id", "turn", "pos", "surface")
    return stream.run_to_table(got)


_filter_cases = [(0, "5 00 0", "D"), (1, "20 21 年 8 月 2 4 日", "D"), (2, "これ は 手 👏 🏽 で す", "G"), (3, "前の行\r\n次の行", "L"), (4, "A B c 1 2 あ い", "RDH"), (5, "👨 ‍ 👩 ‍ 👦", "G")]
_filter_results = [(0, "5000"), (1, "2021 年 8 月 24 日"), (2, "これ は 手 👏🏽 で す"), (3, "前の行 \r \n 次の行"), (4, "ABc 12 あい"), (5, "👨‍👩‍👦")]


@query("filters_golden", literal(["id", "tokenized"], _filter_results))
def filters_golden(spark, sf_dir):
    df = spark.createDataFrame(_filter_cases, "id int, line string, codes string").withColumn("s", S.from_tokenized(F.col("line"))).withColumn("c", chars(F.col("s.text")))
    out = None
    for codes in sorted({c for _, _, c in _filter_cases}):
        b = filters.linebreaks(F.col("c"), F.col("s.boundaries")) if codes == "L" else filters.chain(F.col("c"), F.col("s.boundaries"), codes)
        part = df.where(F.col("codes") == codes).withColumn("s", F.col("s").withField("boundaries", b)).select("id", S.to_tokenized(F.col("s")).alias("tokenized"))
        out = part if out is None else out.unionByName(part)
    return out


# formats

_tokenized_cases = ["まぁ 社長 は 火星 猫 だ", "Rust//ラスト で 良い/形容詞/イイ プログラミング 体験 を ！//ビックリ", "火星 猫 の 生態 ( M \\  et\\ al. )", "改行 に \\\\n を 用い る", "品詞 に \\/ を 用い る", "", "a\0b", " a", "a ", "a  b", "/a", "\\"]
_tokenized_rows = [
    ("まぁ社長は火星猫だ", "0,1,0,1,1,0,1,1", 0, None), ("Rustで良いプログラミング体験を！", "0,0,0,1,1,0,1,0,0,0,0,0,0,1,0,1,1", 2, None), ("火星猫の生態(M et al.)", "0,1,1,1,0,1,1,1,1,0,0,0,0,0,1", 0, None),
    ("改行に\\nを用いる", "0,1,1,0,1,1,0,1", 0, None), ("品詞に/を用いる", "0,1,1,1,1,0,1", 0, None),
    *((None, None, None, f"InvalidArgumentError: tokenized_text: {m}") for m in ("must contain at least one character", "must not contain NULL", "must not start with a whitespace", "must not end with a whitespace", "must not contain consecutive whitespaces", "a slash must follow a character", "must contain at least one character")),
]
_partial_cases = ["火-星 猫|の|生-態", "火-星-猫|の| |生-態|\\-n", "ま-ぁ|社-長|は|火-星 猫|だ", "a-", "a?b", "A/x-B//y"]
_partial_rows = [("火星猫の生態", "0,2,1,1,0", 0, None), ("火星猫の 生態\\n", "0,0,1,1,1,0,1,0", 0, None), ("まぁ社長は火星猫だ", "0,1,0,1,1,0,2,1", 0, None), (None, None, None, "InvalidArgumentError: partial_annotation_text: invalid annotation"), (None, None, None, "InvalidArgumentError: partial_annotation_text: contains an invalid boundary character: '?'"), ("AB", "0", 2, None)]


def _parsed(spark, cases, parse):
    df = spark.createDataFrame(list(enumerate(cases)), "id int, line string").withColumn("s", parse(F.col("line")))
    return df.select("id", "s.text", F.array_join(F.transform("s.boundaries", lambda b: b.cast("string")), ",").alias("marks"), "s.n_tags", "s.error")


@query("parse_tokenized", literal(["id", "text", "marks", "n_tags", "error"], [(i, *r) for i, r in enumerate(_tokenized_rows)]))
def parse_tokenized(spark, sf_dir):
    return _parsed(spark, _tokenized_cases, S.from_tokenized)


@query("parse_partial", literal(["id", "text", "marks", "n_tags", "error"], [(i, *r) for i, r in enumerate(_partial_rows)]))
def parse_partial(spark, sf_dir):
    return _parsed(spark, _partial_cases, S.from_partial)


@query("write_tokenized", literal(["id", "tokenized"], [(0, _tokenized_cases[0]), (1, _tokenized_cases[1]), (2, "火星 猫 の 生態 ( M \\  et\\ al. )"), (3, _tokenized_cases[3]), (4, _tokenized_cases[4])]))
def write_tokenized(spark, sf_dir):
    df = spark.createDataFrame(list(enumerate(_tokenized_cases[:5])), "id int, line string")
    return df.select("id", S.to_tokenized(S.from_tokenized(F.col("line"))).alias("tokenized"))


@query("write_partial", literal(["id", "partial"], [(0, "ま-ぁ/副詞/マー|良-い/形容詞/ヨイ|だ-ろ-う/助動詞/ダロー"), (1, "火-星|猫")]))
def write_partial(spark, sf_dir):
    df = spark.createDataFrame([(0, "まぁ/副詞/マー 良い/形容詞/ヨイ だろう/助動詞/ダロー"), (1, "火星 猫")], "id int, line string")
    return df.select("id", S.to_partial(S.from_tokenized(F.col("line"))).alias("partial"))


@query("tokens_unknown_skip", literal(["id", "surface", "start", "end"], [(0, "の", 3, 4), (0, "生態", 4, 6), (2, "まぁ", 0, 2), (2, "社長", 2, 4), (2, "は", 4, 5), (2, "だ", 8, 9), (3, "a", 0, 1), (3, "e", 4, 5)]))
def tokens_unknown_skip(spark, sf_dir):
    df = spark.createDataFrame([(0, _partial_cases[0]), (2, _partial_cases[2]), (3, "a|b c|d|e".replace("c|d", "c d"))], "id int, line string").withColumn("s", S.from_partial(F.col("line")))
    return segment.token_table(df, ["id"], F.col("s.text"), F.col("s.boundaries")).drop("pos")


@query("raw_sentences", "SELECT doc_id, length(text) AS n, greatest(length(text) - 1, 0) AS unknown FROM documents WHERE text <> ''")
def raw_sentences(spark, sf_dir):
    s = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", S.from_raw(F.col("text")).alias("s"))
    return s.select("doc_id", F.length("s.text").cast("long").alias("n"), F.size(F.filter("s.boundaries", lambda b: b == S.UNKNOWN)).cast("long").alias("unknown"))


_lines_sql = "SELECT count(*) AS lines, CAST(sum(length(l)) AS BIGINT) AS characters, count(*) FILTER (l = '') AS empty FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '\\r$', '') AS l FROM documents WHERE text IS NOT NULL)"


@query("read_lines", _lines_sql)
def read_lines(spark, sf_dir):
    """The texts of documents as files of lines, read back."""
    path = shared_dir(spark)
    table(spark, sf_dir, "documents").where("text is not null").select("text").write.text(path, lineSep="\n")
    lines = text.read_lines(spark, path)
    return lines.agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"), F.count_if(F.col("line") == "").alias("empty"))


@query("transfer_documents", f"SELECT doc_id, text, CAST(len(regexp_extract_all(text, '{DIGITS}|{LETTERS}|(?s:.)')) AS BIGINT) AS n_tokens FROM documents WHERE text <> ''")
def transfer_documents(spark, sf_dir):
    """Boundaries that rules find on the full-width text, on the text as it was."""
    df = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", fullwidth(F.col("text")).alias("wide")).withColumn("b", segment.rule_boundaries(F.col("wide"), "DR"))
    df = df.select("doc_id", S.transfer(F.struct(F.col("wide").alias("text"), F.col("b").alias("boundaries")), F.col("text")).alias("s"))
    # the marks are 0 and 1
    return df.select("doc_id", F.col("s.text").alias("text"), (F.size(F.array_remove("s.boundaries", 0)) + 1).cast("long").alias("n_tokens"))


@query("transfer_unlike", literal(["id", "text"], [(0, "ab"), (1, None)]))
def transfer_unlike(spark, sf_dir):
    df = spark.createDataFrame([(0, "ＡＢ", "ab"), (1, "ＡＢ", "abc")], "id int, wide string, text string")
    return df.select("id", S.transfer(S.from_raw(F.col("wide")), F.col("text"))["text"].alias("text"))


@query("reset_tags", literal(["id", "tokenized", "n_tags"], [(0, "まぁ 良い", 2), (1, "火星 猫", 2)]))
def reset_tags(spark, sf_dir):
    df = spark.createDataFrame([(0, "まぁ/副詞/マー 良い/形容詞"), (1, "火星 猫")], "id int, line string")
    s = S.reset_tags(S.from_tokenized(F.col("line")), 2)
    return df.select("id", S.to_tokenized(s).alias("tokenized"), s["n_tags"].alias("n_tags"))


@query("substrings", "SELECT doc_id, substring(text, 3, 5) AS part, substring(text, CAST(length(text) AS INT) - 1, 2) AS last FROM documents WHERE length(text) >= 7")
def substrings(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").where("length(text) >= 7").select("doc_id", S.substring(F.col("text"), 2, 7).alias("part"), S.substring(F.col("text"), n - 2, n).alias("last"))


# matching and scoring


@query("ngram_char", f"SELECT g, count(*) AS n FROM (SELECT c || lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ({exploded('doc_id', 'text', 'documents')})) WHERE g IS NOT NULL GROUP BY g")
def ngram_char(spark, sf_dir):
    return predict.gram_counts(table(spark, sf_dir, "documents"), F.col("text"), [2])


@query("ngram_type", f"SELECT g, count(*) AS n FROM (SELECT t || lead(t) OVER w || lead(t, 2) OVER w AS g FROM (SELECT doc_id, i, CAST({sql_type('c')} AS VARCHAR) AS t FROM ({exploded('doc_id', 'text', 'documents')})) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL GROUP BY g")
def ngram_type(spark, sf_dir):
    return predict.gram_counts(table(spark, sf_dir, "documents"), F.col("text"), [3], types=True)


_words = ["the", "tion", "on", "que", "ein", "os", "aa"]
_words_sql = "(VALUES " + ", ".join(f"('{w}')" for w in _words) + ") AS d(word)"


@query("dict_match", f"SELECT word, count(*) AS n FROM (SELECT doc_id, i, c || coalesce(lead(c) OVER w, '') || coalesce(lead(c, 2) OVER w, '') || coalesce(lead(c, 3) OVER w, '') AS g FROM ({exploded('doc_id', 'text', 'documents')}) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) JOIN {_words_sql} ON starts_with(g, word) GROUP BY word")
def dict_match(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in _words], "word string")
    return predict.word_counts(table(spark, sf_dir, "documents"), F.col("text"), words)


def _weights_sql(m: Model) -> str:
    rows = [("c", g, len(g) - 1 - m.char_window + k, x) for g, w in m.char_ngrams for k, x in enumerate(w) if x]
    rows += [("c", g, k - 1, x) for g, w, _ in m.dictionary for k, x in enumerate(w) if x]
    rows += [("t", g, len(g) - 1 - m.type_window + k, x) for g, w in m.type_ngrams for k, x in enumerate(w) if x]
    return "(VALUES " + ", ".join(f"('{k}', '{g}', {o}, {x})" for k, g, o, x in rows) + ") AS w(kind, g, o, x)"


def _scores_sql(keys: str, source: str, m: Model) -> str:
    """CTEs c (keys, i from 0, c, n) and s (keys, b, score)."""
    return f"""
c AS (SELECT {keys}, c, i - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM ({exploded(keys, 'text', source)})),
t AS (SELECT {keys}, i, n, c, CAST({sql_type('c')} AS VARCHAR) AS t FROM c),
f AS (SELECT {keys}, i, n, c || coalesce(lead(c) OVER w, '') || coalesce(lead(c, 2) OVER w, '') || coalesce(lead(c, 3) OVER w, '') AS cg, t || coalesce(lead(t) OVER w, '') || coalesce(lead(t, 2) OVER w, '') AS tg FROM t WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
g AS (SELECT {keys}, i, n, 'c' AS kind, left(cg, k) AS g FROM f, (VALUES (1), (2), (3), (4)) AS l(k) WHERE length(cg) >= k UNION ALL SELECT {keys}, i, n, 't', left(tg, k) FROM f, (VALUES (1), (2), (3)) AS l(k) WHERE length(tg) >= k),
a AS (SELECT {keys}, i + o AS b, sum(x) AS x FROM g JOIN {_weights_sql(m)} USING (kind, g) WHERE i + o BETWEEN 0 AND n - 2 GROUP BY ALL),
s AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.i AS b, c.c AS c, c.n AS n, {m.bias} + coalesce(x, 0) AS score FROM c LEFT JOIN a ON {' AND '.join(f'c.{k.strip()} = a.{k.strip()}' for k in keys.split(','))} AND c.i = a.b)"""


def _scored(spark, sf_dir: str) -> DataFrame:
    """Documents that have boundaries. A filter on the scores themselves would be pushed below them, and run them twice."""
    return table(spark, sf_dir, "documents").where((F.length("text") > 1) & (F.instr("text", "\0") == 0))


@query("score_boundary_latin", f"WITH {_scores_sql('doc_id', 'documents', LATIN)} SELECT doc_id, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, max(score) AS highest, min(score) AS lowest, count(*) FILTER (score > 0) AS above FROM s WHERE b <= n - 2 GROUP BY doc_id")
def score_boundary_latin(spark, sf_dir):
    s = _scored(spark, sf_dir).select("doc_id", predict.scores(spark, LATIN, F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("s").alias("highest"), F.array_min("s").alias("lowest"), F.size(F.filter("s", lambda x: x > 0)).cast("long").alias("above"))


@query("score_exploded", ORACLE["score_boundary_latin"])
def score_exploded(spark, sf_dir):
    s = predict.exploded_scores(_scored(spark, sf_dir), LATIN.tables(spark), LATIN.bias, LATIN.char_window, LATIN.type_window)
    total = s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max("score").alias("highest"), F.min("score").alias("lowest"), F.count_if(F.col("score") > 0).alias("above"))
    return total


_type_only = Model(LATIN.bias, 0, LATIN.type_window, [], LATIN.type_ngrams, [])


@query("score_type_only", f"WITH {_scores_sql('doc_id', 'documents', _type_only)} SELECT doc_id, CAST(sum(score * (b % 97)) AS BIGINT) AS weighted FROM s WHERE b <= n - 2 GROUP BY doc_id")
def score_type_only(spark, sf_dir):
    s = _scored(spark, sf_dir).select("doc_id", predict.scores(spark, _type_only, F.col("text")).alias("s"))
    return s.select("doc_id", F.aggregate(F.transform("s", lambda x, i: x * (i % 97)), F.lit(0).cast("long"), lambda a, x: a + x).alias("weighted"))


@query("predict_tokens_latin", f"WITH {_scores_sql('doc_id', 'documents', LATIN)} SELECT doc_id, string_agg({ESCAPED.format('c')} || CASE WHEN b <= n - 2 AND score > 0 THEN ' ' ELSE '' END, '' ORDER BY b) AS tokenized FROM s GROUP BY doc_id")
def predict_tokens_latin(spark, sf_dir):
    return pipeline.predict(table(spark, sf_dir, "documents").where("text <> ''"), LATIN, norm=False).select("doc_id", "tokenized")


_lines_of = ["0:この -22", "1:の人 54", "2:人は 58", "3:は地 43", "4:地球 -54", "5:球人 68", "6:人だ 48"]


@query("score_lines", literal(["pos", "line"], list(enumerate(_lines_of))))
def score_lines(spark, sf_dir):
    got = pipeline.predict(spark.createDataFrame([("この人は地球人だ",)], "text string"), SPEC, scores=True)
    return got.select(F.posexplode("score_lines").alias("pos", "line"))


@query("score_lines_documents", f"WITH {_scores_sql('doc_id', 'documents', LATIN)}, p AS (SELECT doc_id, b, n, score, c || lead(c) OVER (PARTITION BY doc_id ORDER BY b) AS pair FROM s) SELECT doc_id, string_agg(b || ':' || pair || ' ' || score, chr(10) ORDER BY b) AS lines FROM p WHERE b <= n - 2 GROUP BY doc_id")
def score_lines_documents(spark, sf_dir):
    return pipeline.predict(_scored(spark, sf_dir), LATIN, scores=True, norm=False).select("doc_id", F.array_join("score_lines", "\n").alias("lines"))


_tag_lines = ["この", "人\t名詞:76,接尾辞:4\tジン:4,ヒト:82", "は", "地球\t名詞:0\tマンホーム:2,チキュー:92", "人\t名詞:8,接尾辞:74\tジン:76,ヒト:8", "だ"]


@query("tag_score_lines", literal(["pos", "line"], list(enumerate(_tag_lines))))
def tag_score_lines(spark, sf_dir):
    got = pipeline.predict(spark.createDataFrame([("この人は地球人だ",)], "text string"), SPEC, tag_scores=True)
    return got.select(F.posexplode("tag_score_lines").alias("pos", "line"))


_text = "我らは全世界の国民"
GOLDENS = {
    "F1": (SPEC, "この人は地球人だ", [-22, 54, 58, 43, -54, 68, 48]),
    "F3": (Model(1, 3, 3, [("我ら", [1, 2, 3, 4, 5]), ("全世界", [6, 7, 8, 9]), ("国民", [10, 11, 12, 13, 14]), ("世界", [15, 16, 17, 18, 19]), ("界", [20, 21, 22, 23, 24, 25])], [], [("全世界", [26, 27, 28, 29], ""), ("世界", [30, 31, 32], ""), ("世", [33, 34], "")]), _text, [4, 5, 73, 135, 141, 122, 55, 38]),
    "F4": (Model(2, 2, 2, [("我ら", [1, 2, 3]), ("全世界", [4, 5]), ("国民", [6, 7, 8]), ("世界", [9, 10, 11]), ("界", [12, 13, 14, 15])], [], [("全世界", [16, 17, 18, 19], ""), ("世界", [20, 21, 22], ""), ("世", [23, 24], "")]), _text, [4, 5, 18, 87, 93, 68, 23, 9]),
    "F5": (Model(3, 3, 3, [("我ら", [1, 2, 3, 4, 5]), ("全世界", [6, 7, 8, 9]), ("国民", [10, 11, 12, 13, 14]), ("世界", [15, 16, 17, 18, 19]), ("界", [20, 21, 22, 23, 24, 25])], [], [("全世界", [26, 27, 28, 29], ""), ("世界", [30, 31, 32], ""), ("世", [33, 34], ""), ("世界の国民", [35, 36, 37, 38, 39, 40], ""), ("は全世界", [41, 42, 43, 44, 45], "")]), _text, [6, 48, 117, 215, 223, 206, 95, 79]),
    "F6": (Model(1, 3, 4, [], [("53", list(range(1, 8))), ("555", list(range(8, 14))), ("55", list(range(14, 21))), ("5", list(range(21, 29)))], []), _text, [87, 135, 144, 174, 182, 192, 202, 148]),
    "F7a": (Model(2, 3, 3, [], [("53", list(range(1, 6))), ("555", list(range(6, 10))), ("55", list(range(10, 15))), ("5", list(range(15, 21)))], []), _text, [38, 66, 102, 84, 106, 139, 103, 74]),
    "F7b": (Model(3, 3, 2, [], [("53", [1, 2, 3]), ("555", [4, 5]), ("55", [6, 7, 8]), ("5", [9, 10, 11, 12])], []), _text, [16, 27, 28, 50, 57, 45, 43, 31]),
}


@query("score_goldens", literal(["id", "b", "score"], [(k, b, s) for k, (_, _, want) in GOLDENS.items() for b, s in enumerate(want)]))
def score_goldens(spark, sf_dir):
    out = None
    for k, (m, t, _) in GOLDENS.items():
        part = spark.createDataFrame([(k, t)], "id string, text string").select("id", F.posexplode(predict.scores(spark, m, F.col("text"))).alias("b", "score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("predict_golden", literal(["tokenized"], [("この// 人/名詞/ヒト は 地球/名詞/チキュー 人/接尾辞/ジン だ".replace("//", ""),)]))
def predict_golden(spark, sf_dir):
    return pipeline.predict(spark.createDataFrame([("この人は地球人だ",)], "text string"), SPEC, predict_tags=True).select("tokenized")


@query("tag_candidates", literal(["token", "slot", "tag", "score"], [("人@2", 0, "名詞", 76), ("人@2", 0, "接尾辞", 4), ("人@2", 1, "ジン", 4), ("人@2", 1, "ヒト", 82), ("人@6", 0, "名詞", 8), ("人@6", 0, "接尾辞", 74), ("人@6", 1, "ジン", 76), ("人@6", 1, "ヒト", 8), ("地球@5", 0, "名詞", 0), ("地球@5", 1, "マンホーム", 2), ("地球@5", 1, "チキュー", 92)]))
def tag_candidates(spark, sf_dir):
    df = spark.createDataFrame([("この人は地球人だ",)], "text string").withColumn("b", predict.boundaries(predict.scores(spark, SPEC, F.col("text"))))
    df = df.withColumn("spans", F.transform(segment.token_array(F.col("text"), F.col("b")), lambda t: F.struct(t["start"], t["end"]))).withColumn("c", predict.tag_candidates(spark, SPEC, F.col("text"), F.col("spans")))
    each = df.select("text", F.explode(F.arrays_zip("spans", "c")).alias("x")).select(F.expr("concat(substring(text, x.spans.start + 1, x.spans.end - x.spans.start), '@', x.spans.end - 1)").alias("token"), F.posexplode("x.c").alias("slot", "s"))
    return each.select("token", "slot", F.explode("s").alias("y")).select("token", "slot", "y.tag", "y.score")


@query("pattern_tagger", literal(["pos", "surface", "tags"], [(0, "これ", "名詞,ソレ"), (1, "は", "助詞,ワ"), (2, "テスト", "名詞,テスト"), (3, "です", "助動詞,デス")]))
def pattern_tagger(spark, sf_dir):
    tokens = spark.createDataFrame([(0, "これ", ["名詞", "ソレ"]), (1, "は", [None, None]), (2, "テスト", ["名詞", None]), (3, "です", [None, "デス"])], "pos int, surface string, tags array<string>")
    rules = spark.createDataFrame([("これ", ["代名詞", "コレ"]), ("は", ["助詞", "ワ"]), ("テスト", ["名詞", "テスト"]), ("です", ["助動詞", "デス"])], "surface string, tags array<string>")
    return filters.pattern_tags(tokens, rules).select("pos", "surface", F.array_join("tags", ",").alias("tags"))


@query("pattern_tagger_documents", f"WITH l AS (SELECT unnest(regexp_extract_all(text, '{DIGITS}|{LETTERS}|(?s:.)')) AS surface FROM documents WHERE text <> '') SELECT CASE surface WHEN 'the' THEN 'article' WHEN 'of' THEN 'preposition' WHEN 'que' THEN 'pronoun' END AS tag, count(*) AS n FROM l GROUP BY 1")
def pattern_tagger_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").where("text <> ''")
    tokens = segment.token_rows(df, ["doc_id"], segment.rule_token_array(F.col("text"), "DR")).withColumn("tags", F.array(F.lit(None).cast("string")))
    rules = spark.createDataFrame([("the", ["article"]), ("of", ["preposition"]), ("que", ["pronoun"])], "surface string, tags array<string>")
    return filters.pattern_tags(tokens, rules).groupBy(F.get("tags", F.lit(0)).alias("tag")).agg(F.count("*").alias("n"))


# dictionaries, models, search

@query("dict_replace_effect", literal(["b", "change"], [(b, {3: -10000, 4: 10000}.get(b, 0)) for b in range(10)]))
def dict_replace_effect(spark, sf_dir):
    before = Model(7, 3, 3, [("外国", [1, -2, 3, -4, 5])], [("55", [4, -3, 2, -1, 6])], [])
    d = shared_dir(spark)
    dump_dictionary(before.with_dictionary([("参政権", [0, -10000, 10000, 0], 'edited, "by hand"')]), spark, f"{d}/dict")
    after = before.with_dictionary(load_dictionary(spark, f"{d}/dict"), strict=True)
    df = spark.createDataFrame([("外国人参政権と政権交代",)], "text string")
    return df.select(F.posexplode(F.zip_with(predict.scores(spark, after, F.col("text")), predict.scores(spark, before, F.col("text")), lambda a, b: a - b)).alias("b", "change"))


@query("model_formats", literal(["format", "same"], [("binary", True), ("compressed", True), ("tables", True)]))
def model_formats(spark, sf_dir):
    d = shared_dir(spark)
    SPEC.write(spark, f"{d}/model")
    same = Model.read(spark, f"{d}/model") == SPEC
    return spark.createDataFrame([("binary", binary.decode(binary.encode(SPEC, level=None)) == SPEC), ("compressed", binary.decode(binary.encode(SPEC)) == SPEC), ("tables", same)], "format string, same boolean")


@query("search_tokens", literal(["id", "pos", "surface", "byte_start", "byte_end", "position_length"], [(1, 0, "123456", 0, 6, 3), (1, 1, "円", 6, 9, 3), (1, 2, "🤌🏿", 9, 17, 3), (2, 0, "a", 0, 1, 3), (2, 1, "\n", 1, 2, 3), (2, 2, "b", 2, 3, 3)]))
def search_tokens(spark, sf_dir):
    df = spark.createDataFrame([(1, "123456円🤌🏿"), (2, "a\nb"), (3, ""), (4, None)], "id int, text string")
    return pipeline.search_tokens(df, Model(bias=1), ["id"], wsconst="DG").select("id", "pos", "surface", "byte_start", "byte_end", "position_length")


@query("dictionary_words", literal(["word"], [(w,) for w in ("の", "は", "火星", "猫", "生態")]))
def dictionary_words(spark, sf_dir):
    return text.dictionary_words(spark.createDataFrame([("火星 猫 の 生態",), ("猫 は 火星",), ("",)], "line string"))


@query("default_tags", literal(["surface", "tag"], [("猫", "名詞")]))
def default_tags(spark, sf_dir):
    tokens = spark.createDataFrame([(0, 0, "猫", ["名詞"]), (0, 1, "は", ["助詞"]), (1, 0, "猫", ["動詞"]), (1, 1, "火星", [None])], "line int, pos int, surface string, tags array<string>")
    return text.default_tag_rows(tokens, spark.createDataFrame([("は",)], "surface string")).select("surface", F.get("tags", F.lit(0)).alias("tag"))


_trie_chars = "人だDK"


def _trie_model() -> bytes:
    """A model of the trie format with one n-gram of each kind and a dictionary word."""
    import struct

    p = lambda f, *v: struct.pack("<" + f, *v)
    string = lambda s: p("I", len(s)) + b"".join(p("H", _trie_chars.index(c) + 1) for c in s)
    numbers = lambda v: p("I", len(v)) + b"".join(p("h", x) for x in v)

    def trie(words: str, entries: list[bytes], n_dicts: int = 1) -> bytes:
        out = p("BI", n_dicts, len(words) + 1)
        out += p("II", 0, len(words)) + b"".join(p("HI", _trie_chars.index(w) + 1, i + 1) for i, w in enumerate(words)) + p("IB", 0, 0)
        out += b"".join(p("II", 0, 0) + p("II", 1, i) + p("B", 1) for i in range(len(words)))
        return out + p("I", len(entries)) + b"".join(entries)

    none = p("BI", 0, 0)
    # the word is in both dictionaries, so its weights are those of both
    lookup = p("B", 1) + trie("人", [numbers([1, 2, 3, 4])]) + trie("K", [numbers([5, 6, 7])]) + none + numbers([8, 9, 10, 20, 30, 40]) + numbers([-3]) + numbers([]) + numbers([])
    linear = p("I", 2) + p("B", 1) + p("ii", 1, 2) + p("Bd", 1, 1.0) + lookup
    data = p("BBI", 1, 0, 0) + p("BBBBBBdB", 1, 3, 1, 3, 1, 1, 0.1, 5) + _trie_chars.encode() + b"\0" + linear
    return b"tag\n" + data + trie("だ", [string("だ") + p("B", 3)], 2) + none


@query("convert", literal(["kind", "pattern", "weights"], [("bias", "", "-3"), ("char", "人", "1 2"), ("dict", "だ", "28 50"), ("type", "5", "5 6")]))
def convert(spark, sf_dir):
    m = binary.convert(_trie_model())
    rows = [("bias", "", [m.bias]), *(("char", g, w) for g, w in m.char_ngrams), *(("type", g, w) for g, w in m.type_ngrams), *(("dict", d, w) for d, w, _ in m.dictionary)]
    return spark.createDataFrame([(k, g, " ".join(map(str, w))) for k, g, w in rows], "kind string, pattern string, weights string")


@query("version", literal(["version"], [(__version__,)]))
def version(spark, sf_dir):
    return spark.createDataFrame([(__version__,)], "version string")


# training

_config = train.Config(char_window=2, char_n=2, type_window=2, type_n=2)


@query("feat_boundary", f"""
WITH c AS (SELECT item_id, c, CAST({sql_type('c')} AS VARCHAR) AS t, i - 1 AS i, count(*) OVER (PARTITION BY item_id) AS n FROM ({exploded('item_id', 'text', 'benchmark')})),
g AS (SELECT item_id, n, i, 1 AS k, c AS cg, t AS tg FROM c UNION ALL SELECT item_id, n, i, 2, c || lead(c) OVER w, t || lead(t) OVER w FROM c WINDOW w AS (PARTITION BY item_id ORDER BY i)),
b AS (SELECT g.*, i - 1 + d AS b FROM g, (VALUES (-2), (-1), (0), (1), (2)) AS x(d) WHERE cg IS NOT NULL),
f AS (SELECT *, i - b - 1 AS rel FROM b WHERE b BETWEEN 0 AND n - 2 AND i >= b - 1 AND i + k <= b + 3)
SELECT kind, gram, CAST(rel AS INT) AS rel, count(*) AS n FROM (SELECT 'c' AS kind, cg AS gram, rel FROM f UNION ALL SELECT 't', tg, rel FROM f) GROUP BY ALL""")
def feat_boundary(spark, sf_dir):
    got = train.boundary_features(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), _config)
    return got.groupBy("kind", "gram", "rel").agg(F.sum("n").alias("n"))


@query("feat_dict", literal(["b", "kind", "len", "n"], [(0, "I", 2, 1), (1, "R", 2, 1), (0, "I", 3, 1), (1, "I", 3, 1), (2, "R", 3, 1), (2, "L", 3, 1), (3, "I", 3, 1), (4, "I", 3, 1), (5, "R", 3, 1)]))
def feat_dict(spark, sf_dir):
    words = spark.createDataFrame([("これ",), ("これは",), ("テスト",)], "word string")
    return train.dict_features(spark.createDataFrame([(0, "これはテストです")], "id int, text string"), "id", F.col("text"), words, 4).drop("id")


_feature_words = ["the", "tion", "on", "que", "ation", "e"]


@query("feat_dict_benchmark", f"""
WITH c AS (SELECT item_id, text, length(text) AS n, unnest(range(0, length(text))) AS s FROM benchmark WHERE text <> ''),
h AS (SELECT item_id, n, s, s + length(word) AS e, least(length(word), 4) AS len FROM c JOIN (VALUES {", ".join(f"('{w}')" for w in _feature_words)}) AS d(word) ON substring(text, CAST(s + 1 AS INT), CAST(length(word) AS INT)) = word),
f AS (SELECT 'L' AS kind, len FROM h WHERE s > 0 UNION ALL SELECT 'I', len FROM (SELECT len, unnest(range(s, e - 1)) FROM h) UNION ALL SELECT 'R', len FROM h WHERE e < n)
SELECT kind, CAST(len AS INT) AS len, count(*) AS n FROM f GROUP BY ALL""")
def feat_dict_benchmark(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in _feature_words], "word string")
    got = train.dict_features(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), words, 4)
    return got.groupBy("kind", "len").agg(F.sum("n").alias("n"))


@query("feat_tag", literal(["pos", "surface", "tag", "kind", "gram", "rel"], [
    (0, "の", "助詞", "c", "の猫", 1), (0, "の", "助詞", "t", "35", 1), (1, "猫", "名詞", "c", "の猫", 0), (1, "猫", "名詞", "c", "猫は", 1), (1, "猫", "名詞", "t", "35", 0), (1, "猫", "名詞", "t", "53", 1),
    (2, "は", None, "c", "猫は", 0), (2, "は", None, "t", "53", 0),
]))
def feat_tag(spark, sf_dir):
    tokens = train.tagged_tokens(train.sentences_table(spark, [S.parse_tokenized("の/助詞 猫/名詞 は")]), train.Config(char_n=1, type_n=1))
    return tokens.select("pos", "surface", F.get("tags", F.lit(0)).alias("tag"), F.explode("features").alias("f")).select("pos", "surface", "tag", "f.*")


_tagged = ["猫/名詞 は/助詞 火星/名詞 だ/助動詞", "火星/名詞 の/助詞 猫/名詞", "猫/動詞 だ/助動詞", "の/助詞 猫/名詞 は/助詞"]


@query("train_tag", literal(["line"], [(x,) for x in _tagged]))
def train_tag(spark, sf_dir):
    """Of a corpus in a table; its own tags are predicted again."""
    lines = spark.createDataFrame(list(enumerate(_tagged)), "line long, text string")
    corpus = lines.select("line", S.from_tokenized(F.col("text")).alias("s"))
    model = train.train(spark, corpus, config=train.Config(cost=10.0))
    return pipeline.predict(corpus.select(F.col("s.text").alias("text")), model, predict_tags=True, norm=False).select(F.col("tokenized").alias("line"))


@query("train_documents", "SELECT CAST(count(*) AS BIGINT) AS texts, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(0 AS BIGINT) AS wrong FROM benchmark WHERE text <> ''")
def train_documents(spark, sf_dir):
    """Boundaries that a rule gives, learnt from the table of benchmark texts: the model gives every one of them again."""
    df = table(spark, sf_dir, "benchmark").where("text <> ''").select(F.col("item_id").alias("line"), S.from_raw(F.col("text")).alias("s"))
    corpus = df.withColumn("s", F.col("s").withField("boundaries", segment.rule_boundaries(F.col("s.text"), "R")))
    model = train.train(spark, corpus, config=train.Config(char_window=1, char_n=1, type_window=1, type_n=2, cost=10.0, eps=0.001))
    got = corpus.select("s", predict.boundaries(predict.scores(spark, model, F.col("s.text"))).alias("b"))
    wrong = F.size(F.filter(F.zip_with("s.boundaries", "b", lambda x, y: x != y), lambda x: x))
    return got.agg(F.count("*").alias("texts"), F.sum(F.length("s.text")).alias("characters"), F.sum(wrong.cast("long")).alias("wrong"))


@query("quantize_assemble", literal(["gram", "weights"], [("あ", "0 -8191 0 32767 0 0"), ("あい", "0 0 16383 0 0")]))
def quantize_assemble(spark, sf_dir):
    w, _ = train.quantised(np.array([-0.25, 1.0, 0.5, 0.00001, 0.0]))
    got = train.assembled({("あ", 1): int(w[0]), ("あ", -1): int(w[1]), ("あい", -1): int(w[2]), ("い", 2): int(w[3]), ("う", 0): int(w[4])}, 3)
    return spark.createDataFrame([(g, " ".join(map(str, x))) for g, x in got], "gram string, weights string")


_corpus = ["まぁ 社長 は 火星 猫 だ", "火星 猫 の 生態", "社長 の 猫 は 火星 だ"]


@query("train_resegment", literal(["line"], [(x,) for x in _corpus]))
def train_resegment(spark, sf_dir):
    model = train.train(spark, [S.parse_tokenized(x) for x in _corpus])
    df = spark.createDataFrame([(S.parse_tokenized(x).text,) for x in _corpus], "text string")
    return pipeline.predict(df, model).select(F.col("tokenized").alias("line"))


@query("assemble_dict", literal(["word", "weights"], [("ab", "1 2 3"), ("abcdef", "4 5 5 5 5 5 6"), ("x", "0 0")]))
def assemble_dict(spark, sf_dir):
    buckets = {("L", 2): 1, ("I", 2): 2, ("R", 2): 3, ("L", 4): 4, ("I", 4): 5, ("R", 4): 6}
    got = train.assembled_dictionary(["abcdef", "ab", "x", "ab"], buckets, 4)
    return spark.createDataFrame([(w, " ".join(map(str, x))) for w, x, _ in got], "word string, weights string")


# evaluation


_pairs_sql = f"SELECT doc_id, {sql_type('c')} AS a, lead({sql_type('c')}) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM ({exploded('doc_id', 'text', 'documents')})"


@query("eval_char", f"""
WITH m AS (SELECT NOT (a = b AND a IN (1, 2)) AS r, NOT (a = b AND a = 1) AS s FROM ({_pairs_sql}) WHERE b IS NOT NULL),
k AS (SELECT count(*) FILTER (r AND s) AS tp, count(*) FILTER (NOT r AND NOT s) AS tn, count(*) FILTER (NOT r AND s) AS fp, count(*) FILTER (r AND NOT s) AS fn FROM m),
p AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM k) SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM p""")
def eval_char(spark, sf_dir):
    return evaluate.eval_char_rules(table(spark, sf_dir, "documents").where("text <> ''"), F.col("text"), "DR", "D")


_tokens_of = "SELECT doc_id, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY j) AS e, length(x) AS n FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, regexp_extract_all(text, '{0}') AS l FROM documents WHERE text <> ''))"


@query("eval_word", f"""
WITH r AS ({_tokens_of.format(f"{DIGITS}|{LETTERS}|(?s:.)")}), s AS ({_tokens_of.format(f"{DIGITS}|(?s:.)")}),
k AS (SELECT (SELECT count(*) FROM r JOIN s USING (doc_id, e, n)) AS n_cor, (SELECT count(*) FROM s) AS n_sys, (SELECT count(*) FROM r) AS n_ref),
p AS (SELECT *, n_cor / n_sys AS precision, n_cor / n_ref AS recall FROM k) SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM p""")
def eval_word(spark, sf_dir):
    return evaluate.eval_word_rules(table(spark, sf_dir, "documents").where("text <> ''"), F.col("text"), "DR", "D")


_eval_lines = ["この 人/名詞/ヒト は 地球/名詞/チキュー 人/名詞/ジン だ", "", "人"]


@query("eval_flags", literal(["metric", "tags", "hits", "system", "reference"], [("char", False, 5, 5, 5), ("word", False, 7, 7, 7), ("word", True, 5, 7, 7)]))
def eval_flags(spark, sf_dir):
    """Both measures, by word also with tags: of the last sentence's only word the model has tags, the line has none."""
    lines = spark.createDataFrame([(x,) for x in _eval_lines], "line string")
    char = pipeline.evaluate(lines, SPEC).select(F.lit("char").alias("metric"), F.lit(False).alias("tags"), F.col("tp").alias("hits"), (F.col("tp") + F.col("fp")).alias("system"), (F.col("tp") + F.col("fn")).alias("reference"))
    for tags in (False, True):
        word = pipeline.evaluate(lines, SPEC, metric="word", predict_tags=tags)
        char = char.unionByName(word.select(F.lit("word").alias("metric"), F.lit(tags).alias("tags"), F.col("n_cor").alias("hits"), F.col("n_sys").alias("system"), F.col("n_ref").alias("reference")))
    return char


def flagship(spark, sf_dir: str) -> DataFrame:
    """Documents to full width, rule segmentation, token table with offsets, counts by language."""
    df = table(spark, sf_dir, "documents").where("text <> ''")
    tokens = segment.token_rows(df, ["lang", "doc_id"], segment.rule_token_array(F.col("text"), "DR", wide=True), offsets=True)
    return tokens.groupBy("lang").agg(F.count("*").alias("tokens"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"), F.max("position_length").alias("longest"))


QUERIES["flagship"] = flagship
ORACLE["flagship"] = f"""
SELECT lang, count(*) AS tokens, CAST(sum(strlen(t)) AS BIGINT) AS bytes, CAST(max(n) AS INT) AS longest
FROM (SELECT lang, unnest(l) AS t, len(l) AS n FROM (SELECT lang, regexp_extract_all(text, '{DIGITS}|{LETTERS}|(?s:.)') AS l FROM documents WHERE text <> '')) GROUP BY lang"""
