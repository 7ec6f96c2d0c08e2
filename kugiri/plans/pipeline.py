"""Whole tasks: predict, evaluate, search tokens. Each is a plan over columns; invalid texts give nulls, not failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import fullwidth
from ..functions.sentence import from_tokenized
from ..operators import predict as P
from ..operators.evaluate import eval_char, eval_word
from ..operators.model import Model
from ..operators.segment import joined, spans, token_array, token_table


#: Begins the names of intermediate columns.
OWN = "_kugiri_"


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, "([ \\\\/])", "\\\\$1")


def predict(docs: DataFrame, model: Model, text: str = "text", wsconst: str = "", predict_tags: bool = False, scores: bool = False, tag_scores: bool = False, norm: bool = True) -> DataFrame:
    """docs with columns boundaries, spans, tags (with predict_tags) and tokenized; with scores or tag_scores also the lines of these.

    Scored on the full-width text unless norm is off; boundaries and tags then stand on the text as it is. Texts that are
    empty, null or hold NUL have null boundaries and an empty tokenized text. Columns of docs that are named as these are
    replaced; all others stay.
    """
    spark, raw = docs.sparkSession, F.col(text)
    ok = (F.length(raw) > 0) & (F.instr(raw, "\0") == 0)
    wide = fullwidth(raw) if norm else raw
    got = docs.withColumn(OWN + "wide", F.when(ok, wide)).withColumn("boundaries", P.marks(spark, model, F.col(OWN + "wide"), wsconst))
    got = got.withColumn(OWN + "tokens", token_array(F.when(ok, raw), F.col("boundaries"))).withColumn("spans", F.transform(OWN + "tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))))
    n_tags = max([0, *(len(t.tags) for t in model.tag_models)])
    if predict_tags or tag_scores:
        got = got.withColumn(OWN + "cands", P.tag_candidates(spark, model, F.col(OWN + "wide"), F.col("spans"))).withColumn("tags", P.tags_of(F.col(OWN + "cands"), n_tags))
    if predict_tags:
        mark = lambda tags: F.regexp_replace(F.array_join(F.transform(tags, lambda t: F.concat(F.lit("/"), F.coalesce(_escaped(t), F.lit("")))), ""), "(?<!\\\\)/+$", "")
        words = F.zip_with(OWN + "tokens", "tags", lambda t, tags: F.concat(_escaped(t["surface"]), mark(tags)))
        whole = F.array_join(words, " ")
    else:
        whole = joined(F.when(ok, raw), F.col("boundaries"))
    got = got.withColumn("tokenized", F.coalesce(whole, F.lit("")))
    if scores:
        got = got.withColumn("score_lines", P.score_lines(spark, model, F.col(OWN + "wide")))
    if tag_scores:
        pair = lambda x: F.concat(x["tag"], F.lit(":"), x["score"].cast("string"))
        got = got.withColumn("tag_score_lines", F.zip_with(OWN + "tokens", OWN + "cands", lambda t, c: F.concat(t["surface"], F.array_join(F.transform(c, lambda slot: F.concat(F.lit("\t"), F.array_join(F.transform(slot, pair), ","))), ""))))
    return got.drop(*(c for c in got.columns if c.startswith(OWN)))


def evaluate(lines: DataFrame, model: Model, metric: str = "char", wsconst: str = "", predict_tags: bool = False, norm: bool = True) -> DataFrame:
    """Measures of the model on tokenized lines; empty ones are passed over, one that can't be parsed is an error. Words agree in tags only where tags are predicted."""
    if metric not in ("char", "word"):
        raise ValueError("metric must be char or word")
    s = lines.where("line <> ''").select(from_tokenized(F.col("line")).alias("s")).select(F.when(F.col("s.error").isNull(), F.col("s")).otherwise(F.raise_error(F.col("s.error"))).alias("s"))
    got = predict(s.select("s", F.col("s.text").alias("text")), model, wsconst=wsconst, predict_tags=predict_tags, norm=norm)
    if metric == "char":
        return eval_char(got, F.col("s.boundaries"), F.col("boundaries"))
    n_tags = max([0, *(len(t.tags) for t in model.tag_models)])
    reference = spans(F.length("text"), F.col("s.boundaries"))
    if not predict_tags:
        return eval_word(got, reference, F.col("spans"))
    none = F.array_repeat(F.lit(None).cast("string"), n_tags)
    key = lambda t: F.regexp_replace(F.array_join(F.transform(F.coalesce(t, none), lambda x: F.coalesce(_escaped(x), F.lit(""))), "/"), "/+$", "")
    ends = F.filter(F.zip_with(F.concat(F.col("s.boundaries"), F.array(F.lit(1))), "s.tags", lambda b, t: F.struct(b.alias("b"), t.alias("t"))), lambda x: x["b"] == 1)
    ref = F.zip_with(reference, ends, lambda p, x: F.struct(p["start"].alias("start"), p["end"].alias("end"), key(x["t"]).alias("tags")))
    return eval_word(got, ref, F.zip_with("spans", "tags", lambda p, t: F.struct(p["start"].alias("start"), p["end"].alias("end"), key(t).alias("tags"))), tagged=True)


def search_tokens(docs: DataFrame, model: Model, keys: list[str], text: str = "text", wsconst: str = "") -> DataFrame:
    """Tokens for a search index: byte offsets on the text as it is, position, and position_length, the number of the text's tokens. Line breaks are split first, then wsconst; an empty text has no tokens."""
    raw = F.col(text)
    got = docs.where((F.length(raw) > 0) & (F.instr(raw, "\0") == 0))  # on the text: a filter on what is scored would score twice
    got = got.withColumn(OWN + "wide", fullwidth(raw)).withColumn(OWN + "b", P.marks(docs.sparkSession, model, F.col(OWN + "wide"), wsconst, breaks=True))
    return token_table(got, keys, raw, F.col(OWN + "b"), offsets=True)
