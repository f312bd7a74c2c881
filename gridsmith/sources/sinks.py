"""Sinks: an append-only store with the latest row of each key on top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(rows: DataFrame, root: str, name: str, batch: int) -> None:
    """Adds rows as one partition; a batch that is written again replaces itself, so a retry is harmless."""
    rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def current(spark: SparkSession, root: str, name: str, keys: list[str]) -> DataFrame:
    """The row of the latest batch for each key."""
    d = spark.read.parquet(f"{root}/{name}")
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return d.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "batch")
