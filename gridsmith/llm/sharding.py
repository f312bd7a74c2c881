"""Sharding by jump consistent hashing.

A document's shard follows from its key and the number of shards alone: no ring table is kept, and one more shard
takes documents only into itself, about 1/(n+1) of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm._scratch import written
from gridsmith.llm._words import U64, mixed


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys, by the published generator: jump ahead while the next jump stays below shards."""
    state = mixed(keys.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15))
    at, nxt = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    while (go := nxt < shards).any():
        at[go] = nxt[go]
        state[go] = state[go] * U64(2862933555777941757) + U64(1)
        draw = ((state[go] >> U64(33)) + U64(1)).astype(np.float64)
        nxt[go] = np.minimum((at[go] + 1) * (float(1 << 31) / draw), float(1 << 40)).astype(np.int64)
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long column; a null key has the shard of key 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 1 and text_crc32 the unsigned CRC-32 of these bytes; a null text
    counts as none.  grown_shard is the shard with one more.  slot counts 0, 1, ... within a shard by ascending
    key, null first.  Rows that share a key share a shard and have slots of their own.  An empty table gives none;
    other columns are left out, whatever their names.

    Slots come in two steps, so that no task holds a shard: rows are dealt into key ranges, each range numbers its
    own rows of a shard, and the ranges before it are added up from their counts.
    """
    bare = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    rows = bare.select(
        "__key",
        (F.coalesce(F.octet_length("__text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("__text", F.lit(""))).cast("long").alias("text_crc32"),
    )
    rows = rows.repartitionByRange("__key", "text_crc32").withColumn("range", F.spark_partition_id())
    rows = rows.withColumns({"shard": shard_of(F.col("__key"), shards), "grown_shard": shard_of(F.col("__key"), shards + 1)})
    rows = written(rows)
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("range", "shard").orderBy("__key", "size", "text_crc32")
    out = rows.withColumn("__own", F.row_number().over(own)).join(counts, ["range", "shard"])
    return out.select(
        F.col("__key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("__own") - 1).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", name: str = "shard") -> None:
    """The documents themselves, all columns, in folders `name`=0, 1, ... of a Parquet table at path.

    Rows of a null key go to the shard of key 0, rows that share a key to one shard; an empty table writes no folder.  A
    column of docs called like the folders, in any case of letters, is a ValueError: choose another name.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {name}")
    docs.withColumn(name, shard_of(F.col(key), shards)).write.partitionBy(name).parquet(path)
