"""Boundary rewriting: rules over characters, types and boundaries, in one pass over Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import sized
from .segment import rewritten


def chain(chars: Column, boundaries: Column, codes: str, breaks: bool = False) -> Column:
    """The filters that the letters name (G: graphemes); breaks: line breaks first of all. The others only take boundaries away, so their order is of no matter. chars: an array of characters; rewritten() takes the text itself."""
    return rewritten(F.array_join(chars, ""), boundaries, codes, breaks)


def wsconst(chars: Column, boundaries: Column, codes: str) -> Column:
    """No boundary between two characters of one type that the codes name (D R H T K O)."""
    return chain(chars, boundaries, codes)


def linebreaks(chars: Column, boundaries: Column) -> Column:
    """A boundary before and after each line break."""
    return chain(chars, boundaries, "", True)


def graphemes(chars: Column, boundaries: Column) -> Column:
    """No boundary inside an extended grapheme cluster."""
    return chain(chars, boundaries, "G")


def pattern_tags(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens with the null tags of those whose surface has a rule filled from it. rules: (surface, tags), surfaces distinct. Rules of a small measured size are broadcast, else both sides are shuffled by surface."""
    some = rules.select(F.col("surface"), F.col("tags").alias("rule"))
    filled = F.transform(F.col("tags"), lambda t, i: F.coalesce(t, F.get(F.col("rule"), i)))
    return tokens.join(sized(some), "surface", "left").withColumn("tags", filled).drop("rule")
