"""Lines of text files as tables, and dictionary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentence import from_tokenized
from ..operators.segment import token_array


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(line): split at line feeds alone, one carriage return at the end taken off."""
    reader = spark.readStream if stream else spark.read
    return reader.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\\r\\z", "").alias("line"))


def dictionary_words(lines: DataFrame) -> DataFrame:
    """(word): the distinct tokens of tokenized lines, in order."""
    s = lines.select(from_tokenized(F.col("line")).alias("s")).where("s.text is not null")
    return s.select(F.explode_outer(token_array(F.col("s.text"), F.col("s.boundaries"))).alias("t")).select(F.col("t.surface").alias("word")).where("word is not null").distinct().orderBy("word")


def default_tag_rows(tokens: DataFrame, corpus: DataFrame) -> DataFrame:
    """(surface, tags) of the first occurrence of each surface of tokens (line, pos, surface, tags) that has a tag and isn't a surface of corpus."""
    first = tokens.groupBy("surface").agg(F.min_by("tags", F.struct("line", "pos")).alias("tags"))
    return first.where(F.exists("tags", lambda t: t.isNotNull())).join(corpus.select("surface").distinct(), "surface", "left_anti")
