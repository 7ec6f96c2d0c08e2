"""The array form on streams: no state, no shuffle, so a stream of lines gives the rows that a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.segment import rule_boundaries, rule_token_array, token_rows, token_table
from ..sources.tables import shared_dir


def rule_tokens(lines: DataFrame, keys: list[str], text: str, codes: str = "DR", breaks: bool = True) -> DataFrame:
    """Tokens by rules alone, of a stream or a batch."""
    some = lines.where(F.length(text) > 0)
    if "G" not in codes:  # all boundaries are there from the start, those at line breaks too
        return token_rows(some, keys, rule_token_array(F.col(text), codes))
    return token_table(some, keys, F.col(text), rule_boundaries(F.col(text), codes, breaks))


def run_to_table(stream: DataFrame) -> DataFrame:
    """The rows that a stream gives for what is there now, as a table in the shared folder, where its checkpoint is too."""
    spark = stream.sparkSession
    path = shared_dir(spark)
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(path)
