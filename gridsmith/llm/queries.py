"""The queries of this package, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm import embedding_dedup, html_text, importance, kmeans, language_id, mixing, packing, periodic_runs, quality_rules, sharding, simhash, substring, token_files
from gridsmith.llm.sql import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).withColumn("shard_words", F.array_join("shard_words", ","))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language_id.held_out()
    profiles = language_id.learn_profiles(docs.filter(~held & F.col("doc_id").isNotNull()))
    return language_id.identify(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def _repeating(docs: DataFrame) -> DataFrame:
    """docs, the texts of a tenth of the doc_ids made periodic from one word on; no doc_id: as it is."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    @F.pandas_udf("string")
    def repeat(text: pd.Series, g: pd.Series) -> pd.Series:
        def one(t: str | None, g: int) -> str | None:
            if t is None or not (words := word.findall(t)):
                return None
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            return " ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])

        return pd.Series([one(t, int(x)) for t, x in zip(text, g, strict=True)], dtype=object)

    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    text, g = F.when(h % 10 == 0, F.col("text")), F.coalesce(F.floor(h / 10), F.lit(0))
    return docs.select("doc_id", F.coalesce(repeat(text, g), F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(_repeating(_table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    found = found.withColumn("best", F.aggregate("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best)))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kmeans.cluster_vectors(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("centroid_sha256", kmeans.centroid_sha256()).drop("centroid")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_best_fit_packing, op3_html_extraction, op4_simhash, op5_token_files, op6_substring_dedup,
        op7_importance_resampling, op8_jump_sharding, op9_source_mixing, op10_embedding_dedup,
        op11_language_id, op12_periodic_runs, op13_centroid_clustering,
    )
}
ORACLES = SQL
