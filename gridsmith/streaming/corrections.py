"""Corrections as a stream: the current text of each cell, kept up to date as edits arrive (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "table_id long, cell_id string, created_at timestamp, seq long, after string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def latest_texts(log: DataFrame) -> DataFrame:
    """cell_id, text, edits: the last edit of each cell so far; max_by keeps one row of state a cell."""
    last = F.struct("created_at", "seq")
    return log.groupBy("table_id", "cell_id").agg(F.max_by("after", last).alias("text"), F.count("*").alias("edits"))


def edits_per_window(log: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Edits of each table by day; a day closes, and its state goes, once the watermark is past it."""
    return log.withWatermark("created_at", late).groupBy(F.window("created_at", width), "table_id").agg(F.count("*").alias("edits"))


def start(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return result.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
