"""Corpus preparation: toxicity, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents, with the rows that they keep; the last
returns the sequences. A stage's models are fitted on the labelled rows among its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kugiri.llm import core, jaccard, packing, quality_fm, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, core.table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_fm.keep_good(docs, core.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class that near duplicates connect, the least doc_id stays. Documents without links stay, those with a null doc_id among them."""
    return jaccard.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near duplicates", drop_copies), ("packing", pack)]
#: The classifiers and the curve are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = core.written(docs)
    return docs
