"""A training corpus from raw documents, in five stages, each on all that the one before it kept.

All stages take empty tables, null ids, null and empty texts, repeated rows and further columns, which all but the last
give back as they are.  Each row is a document of its own, but where a stage says that rows of a doc_id go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridsmith.llm import importance, mixing, packing, shingles, substring
from gridsmith.llm._scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps, fitted on the labels table.

    Rows of a doc_id, or of none, stay or go together; texts that are null or empty have weight 0; with no labels all stay.
    """
    return importance.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates: word 5-shingles, Jaccard 0.8.

    A null doc_id comes last; rows that are equal in all columns are one; texts without words are one group.
    """
    return shingles.one_of_each(docs, k=5, threshold=0.8)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of 20 words or more that also start earlier.

    Each row has what is left of its own text.  Documents of which nothing is left go; null and empty texts stay.
    """
    return substring.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source; documents without words stay once.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of 4096 tokens; a null text counts as empty."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_duplicates), ("substring dedup", substrings), ("source mixing", mix), ("best-fit packing", pack)]
#: tokenization, fingerprints of shingles and seeded sampling are not SQL's; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
