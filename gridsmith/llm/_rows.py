"""Rows with a number of their own, so that rows of one doc_id, or of none, can be told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm._scratch import written


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __row, a number of the row that is fixed once."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()))


def best_row(docs: DataFrame) -> list[Column]:
    """The columns of the order in which one row of a component is kept, for a table of keyed(): doc_id, nulls last, then all of the row."""
    doc = F.col("doc_id").cast("long")
    return [doc.isNull().alias("none"), doc.alias("doc"), F.xxhash64(*(c for c in docs.columns if c != "__row")).alias("whole"), F.col("__row").alias("row")]
