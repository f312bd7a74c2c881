"""Quality classifier by importance resampling.

Two generative models over hashed word uni- and bigrams, one of target documents and one of all documents, weigh each
document by the ratio of its probabilities, the product over its n-grams; Gumbel top-k then samples without
replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm._scratch import partitions, written
from gridsmith.llm._words import U64, Texts, mixed, slices, windows

BUCKET_BITS = 20
SLICE_BYTES = 1 << 20
PART_BITS = 12


def _features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text's number) of each word and each pair of neighbouring words, A-Z lower-cased."""
    h, (doc, _) = texts.hashes(lower=True), texts.positions()
    pair = windows(h, 2)
    inside = doc[1:] == doc[:-1]
    shift = U64(64 - BUCKET_BITS)
    return np.concatenate([h >> shift, pair[inside] >> shift]).astype(np.int64), np.concatenate([doc, doc[1:][inside]])


def target_sample(labels: DataFrame, limit: int = 50_000, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(doc_id of at most `limit` target documents, one row with good and all): what the target model is fitted on.

    Good is quality 1 in all rows of a doc_id; target documents are good and not toxic in any.  A larger table is
    sampled by a seeded hash of doc_id.
    """
    good, clean = F.min(F.coalesce("quality", F.lit(0))) == 1, F.max(F.coalesce("toxic", F.lit(0))) == 0
    each = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good"), (good & clean).alias("target"))
    share = each.agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("all"))
    return each.filter("target").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit).select("doc_id"), share


def log_ratios(docs: DataFrame, target: DataFrame, prior: float = 16.0) -> np.ndarray:
    """For each of 2^20 buckets the log ratio of target to raw probability.

    Raw counts are over all documents, target counts over those in target (at most target_sample()'s limit, so they
    may be broadcast).  With both counted at the target's size, each model has `prior` occurrences of every bucket
    beforehand, so a bucket that was hardly seen says little: log((aim + prior) / (raw x all aim / all raw + prior)).
    The array has a fixed size, whatever the input's.
    """
    n, parts = 1 << BUCKET_BITS, 1 << (BUCKET_BITS - PART_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for batch in batches:
            is_target = batch.column(1).to_numpy(zero_copy_only=False)
            for at, texts in slices(batch.column(0), SLICE_BYTES):
                bucket, doc = _features(texts)
                np.add.at(raw, bucket, 1)
                np.add.at(aim, bucket[is_target[at + doc]], 1)
        for p in np.flatnonzero(raw.reshape(parts, -1).any(1)).tolist():
            both = np.stack([x.reshape(parts, -1)[p] for x in (raw, aim)]).astype("<i4")
            planes = np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T)  # high bytes are zeros and compress
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([planes.tobytes()], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
                got = np.ascontiguousarray(planes.T).view("<i4").reshape(2, -1).astype(np.int64)
                sums[p] = sums[p] + got if p in sums else got
        for p, both in sums.items():
            at = np.flatnonzero(both[0])
            yield pa.RecordBatch.from_arrays([pa.array((p << PART_BITS) + at), pa.array(both[0, at]), pa.array(both[1, at])], names=["bucket", "raw", "aim"])

    marked = docs.join(F.broadcast(target.withColumn("__t", F.lit(True))), docs["doc_id"].cast("long") == target["doc_id"], "left")
    packed = marked.select(docs["text"].cast("string").alias("text"), F.coalesce("__t", F.lit(False)).alias("t")).mapInArrow(count, "part int, counts binary")
    counts = written(packed.repartition(min(parts, partitions(docs.sparkSession)), "part").mapInArrow(add, "bucket long, raw long, aim long"))
    total = counts.agg(F.sum("raw").alias("r"), F.sum("aim").alias("a")).first()
    out = np.zeros(n)
    if total["a"]:
        expected = F.col("raw") * (total["a"] / total["r"])
        rows = counts.select("bucket", F.log((F.col("aim") + prior) / (expected + prior)).alias("v")).toArrow()  # at most 2^20 rows
        out[rows["bucket"].to_numpy()] = rows["v"].to_numpy()
    return out


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise of each id, from a seeded hash."""
    key = mixed(ids.astype(np.int64).view(U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    return -np.log(-np.log(((key >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)))


def importance_resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11, limit: int = 50_000, prior: float = 16.0) -> DataFrame:
    """A row for each document: doc_id, log_weight, sample_key, rank, kept.

    log_weight is the sum of log ratios over the text's uni- and bigrams; a text without words, or null, has 0.
    sample_key is log_weight plus Gumbel noise from a seeded hash of doc_id; the k largest are kept, k = share of all
    documents, rounded up: a sample without replacement in proportion to exp(log_weight).  share None takes the
    share of good documents, toxic or not, among the labelled ones; the target model is fitted on those that are not
    toxic.  Of equal keys the smaller doc_id goes first, null last; rows that share a doc_id have the same noise.
    Without labels every weight is 0 and all documents stay.  An empty table gives none; other columns are left out,
    whatever their names.

    Ranks come in two steps: ranges of sample_key are counted, and only rows of one range are put in order together.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target, of_labels = target_sample(labels, limit, seed)
    if share is None:
        got = of_labels.first()
        share = (got["good"] or 0) / got["all"] if got["all"] else 1.0
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, target, prior))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, texts in slices(batch.column(1), SLICE_BYTES):
                bucket, doc = _features(texts)
                weight = np.bincount(doc, ratios.value[bucket], len(texts))
                own = ids.slice(at, len(texts))
                key = weight + gumbel(own.fill_null(-1).to_numpy(), seed)
                yield pa.RecordBatch.from_arrays([own, pa.array(weight), pa.array(key)], names=["doc_id", "log_weight", "sample_key"])

    keyed = written(docs.mapInArrow(weigh, "doc_id long, log_weight double, sample_key double"))  # once, though its ranges are sampled
    order = [F.desc("sample_key"), F.asc_nulls_last("doc_id")]
    ranged = written(keyed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rows = ranged.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy(*order))).join(counts, "range")
    rank = (F.col("before") + F.col("own")).cast("long")
    return rows.select("doc_id", "log_weight", "sample_key", rank.alias("rank"), (rank <= F.ceil(F.lit(share) * F.col("all"))).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is kept; rows that share a doc_id stay or go together."""
    kept = importance_resample(docs, labels, **settings).groupBy("doc_id").agg(F.max("kept").alias("__kept")).filter("__kept")
    kept = kept.select(F.col("doc_id").alias("__doc"))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__doc"]), "left_semi")
