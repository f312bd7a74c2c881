"""Centroid clustering in exact integers, with Hamerly's bounds.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of that to the second-nearest.
When centroids move, the upper bound grows by its centroid's drift and the lower one shrinks by the largest drift of
all.  While the upper bound is below the lower one, the vector stays where it is, unseen.  Other vectors tighten the
upper bound by one exact distance, and if that is not enough, all centroids are scanned in integers.

Vectors lie in blocks of up to 1024, one row each, in a table bucketed by block number.  Bounds are a table of their
own with the same buckets, so that a round joins them without a shuffle, reads the vectors and writes bounds only: 17
bytes a vector.  A block's bounds row also has by how much its moved vectors change the sums of the centroids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm._scratch import dropped, partitions, scratch_dir, written

BLOCK = 1024
LARGEST = 1 << 27  # of a component's size: squared distances of 64 such components fit into 63 bits
UP, DOWN = 1 + 2.0**-50, 1 - 2.0**-50  # more than what a square root and a sum can be off


class _Bucketed:
    """A table bucketed by block in the shared folder, known to the session's catalogue until it is dropped."""

    def __init__(self, rows: DataFrame, buckets: int) -> None:
        self.name, self._path = f"gridsmith_{uuid.uuid4().hex}", scratch_dir(rows.sparkSession)
        rows.write.bucketBy(buckets, "block").format("parquet").option("path", self._path).saveAsTable(self.name)
        self.rows = rows.sparkSession.table(self.name)
        self.rows._scratch_path = self._path

    def drop(self) -> None:
        self.rows.sparkSession.sql(f"drop table {self.name}")
        dropped(self.rows)


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, xs (dims components as little-endian 32-bit integers floor(scale * x)), of the vectors that are kept.

    Kept are those of exactly dims components, none null or not finite.  Components whose integer is beyond 2^27 in
    size are taken for not finite, as their squared distances do not fit into a long.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            right = np.flatnonzero(sizes == dims)
            flat = lists.take(pa.array(right)).flatten()
            xs = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null is NaN
            with np.errstate(invalid="ignore", over="ignore"):
                xs = np.floor(scale * xs)
                good = (np.abs(xs) <= LARGEST).all(1)
            raw = np.ascontiguousarray(xs[good].astype("<i4"))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right[good])), packed], names=["vec_id", "xs"])

    bare = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("xs"))
    return bare.mapInArrow(convert, "vec_id long, xs binary")


def first_centroids(kept: DataFrame, k: int = 8, seed: int = 3) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; of equal ones, and of null ids, which go last, by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.orderBy(F.asc_nulls_last(order), "xs").limit(k).select("xs").collect()
    return np.array([np.frombuffer(r["xs"], "<i4") for r in rows], np.int64)


def _distances(xs: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    diff = xs - centroid
    return np.einsum("ij,ij->i", diff, diff)


def scanned(xs: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, the smaller number of equal ones; exact squared distance; squared distance of the second-nearest) of each vector."""
    every = np.stack([_distances(xs, c) for c in centroids], 1)
    own = every.argmin(1)
    at = np.arange(len(xs))
    least = every[at, own]
    every[at, own] = np.iinfo(np.int64).max
    return own, least, every.min(1)


def assigned(xs: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> int:
    """Moves own, upper and lower to these centroids, in place, and gives the number of vectors that were scanned whole.

    drift is how far each centroid has moved, rounded up.
    """
    upper[:] = (upper + drift[own]) * UP
    lower[:] = np.maximum((lower - drift.max()) * DOWN, 0)
    near = np.flatnonzero(upper >= lower)
    for c in np.unique(own[near]).tolist():
        mine = near[own[near] == c]
        upper[mine] = np.sqrt(_distances(xs[mine], centroids[c]).astype(np.float64)) * UP
    near = near[upper[near] >= lower[near]]
    if len(near):
        own[near], least, second = scanned(xs[near], centroids)
        upper[near], lower[near] = np.sqrt(least.astype(np.float64)) * UP, np.sqrt(second.astype(np.float64)) * DOWN
    return len(near)


def _changes(xs: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> bytes | None:
    """By how much each centroid's sums and count change (k rows of dims + 1 longs), or None if nothing moved."""
    moved = np.arange(len(xs)) if before is None else np.flatnonzero(before != after)
    if not len(moved):
        return None
    out = np.zeros((k, xs.shape[1] + 1), np.int64)
    with_one = np.concatenate([xs[moved], np.ones((len(moved), 1), np.int64)], 1)
    for c in range(k):
        out[c] += with_one[after[moved] == c].sum(0)
        if before is not None:
            out[c] -= with_one[before[moved] == c].sum(0)
    return out.tobytes()


def _summed(spark: SparkSession, bounds: DataFrame, k: int, width: int) -> np.ndarray:
    """The changes of all blocks together: a task adds those that it reads, and k * width sums meet."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * width, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                out += np.frombuffer(raw.as_py(), np.int64)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["at", "n"])

    parts = bounds.filter("changes is not null").select("changes").mapInArrow(add, "at long, n long")
    out = np.zeros(k * width, np.int64)
    for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most k * width rows
        out[r["at"]] = r["n"]
    return out.reshape(k, width)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """A row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid.

    Vectors become integers (see integer_vectors(), which says which are kept).  Centroids start as first_centroids().
    Each round gives every vector to the nearest centroid by squared distance, of equal ones the smaller number, then
    replaces each centroid that has vectors by the floor of their mean.  After the rounds vectors are assigned once
    more: cluster and distance (squared) are of that, cluster_inertia and inertia the distances summed over a cluster
    and over all (null where they pass a long), centroid the final components.

    With fewer than k kept vectors there are as many centroids; with none, as in an empty table, no rows.  Rows that
    share a vec_id, or have none, are vectors of their own.  Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, dims, scale)
    centroids = first_centroids(kept, k, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return _with_totals(spark.createDataFrame([], schema), centroids)
    k = len(centroids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(part.column(1).to_pylist())], pa.binary())], names=["ids", "xs"])

    blocks = kept.mapInArrow(pack, "ids array<long>, xs binary").withColumn("block", F.monotonically_increasing_id())
    blocks = written(blocks)  # block numbers are fixed from here on
    buckets = _buckets(blocks, partitions(spark))
    table = _Bucketed(blocks.repartition(buckets, "block"), buckets)
    dropped(blocks)
    width, bounds, sums, drift = dims + 1, None, np.zeros((k, dims + 1), np.int64), np.zeros(k)
    for _ in range(rounds):
        new = _Bucketed(_joined(table, bounds).mapInArrow(_round(centroids, drift, dims), "block long, own binary, upper binary, lower binary, scanned long, changes binary"), buckets)
        if bounds is not None:
            bounds.drop()
        bounds = new
        sums += _summed(spark, bounds.rows, k, width)
        moved = np.where(sums[:, -1:] > 0, sums[:, :-1] // np.maximum(sums[:, -1:], 1), centroids)
        drift, centroids = np.sqrt(_distances(moved, centroids).astype(np.float64)) * UP, moved
    out = written(_joined(table, bounds).mapInArrow(_last(centroids, drift, dims), schema))
    for t in (table, bounds):
        if t is not None:
            t.drop()
    return _with_totals(out, centroids)


def _buckets(blocks: DataFrame, at_least: int) -> int:
    """So many that a bucket holds about 256 blocks (64 MB), and one for each partition of a shuffle at most needed."""
    n = blocks.select(F.count("block")).first()[0]
    return max(1, min(n, max(at_least, -(-n // 256))))


def _joined(table: _Bucketed, bounds: _Bucketed | None) -> DataFrame:
    if bounds is None:
        none = F.lit(None).cast("binary")
        return table.rows.select("block", "ids", "xs", none.alias("own"), none.alias("upper"), none.alias("lower"))
    return table.rows.hint("merge").join(bounds.rows.select("block", "own", "upper", "lower"), "block").select("block", "ids", "xs", "own", "upper", "lower")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    """(block, ids, xs, own, upper, lower) of each row; the last three are None before the first round."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, ids, xs, own, upper, lower = (batch.column(c)[row].as_py() for c in range(6))
            xs = np.frombuffer(xs, "<i4").reshape(-1, dims).astype(np.int64)
            if own is None:
                yield block, ids, xs, None, None, None
            else:
                yield block, ids, xs, np.frombuffer(own, "<i4").astype(np.int64), np.frombuffer(upper).copy(), np.frombuffer(lower).copy()


def _moved(xs: np.ndarray, own: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    if own is None:
        own, least, second = scanned(xs, centroids)
        return own, np.sqrt(least.astype(np.float64)) * UP, np.sqrt(second.astype(np.float64)) * DOWN, len(xs)
    own = own.copy()
    return own, upper, lower, assigned(xs, own, upper, lower, centroids, drift)


def _round(centroids: np.ndarray, drift: np.ndarray, dims: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, xs, before, upper, lower in _blocks(batches, dims):
            own, upper, lower, n = _moved(xs, before, upper, lower, centroids, drift)
            row = [block, own.astype("<i4").tobytes(), upper.tobytes(), lower.tobytes(), n, _changes(xs, before, own, len(centroids))]
            types = [pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["block", "own", "upper", "lower", "scanned", "changes"])

    return assign


def _last(centroids: np.ndarray, drift: np.ndarray, dims: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, xs, before, upper, lower in _blocks(batches, dims):
            own, *_ = _moved(xs, before, upper, lower, centroids, drift)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.astype(np.int32)), pa.array(_distances(xs, centroids[own]))], names=["vec_id", "cluster", "distance"])

    return assign


def _with_totals(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    of = {r["cluster"]: int(r["n"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # a row for each centroid
    fits = lambda n: n if n < 1 << 63 else None
    each = [(i, fits(of.get(i, 0)), fits(sum(of.values())), c.tolist()) for i, c in enumerate(centroids)]
    each = rows.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_sha256(centroid: str = "centroid") -> F.Column:
    """Lowercase hex SHA-256 of the components as decimal integers, joined by commas."""
    return F.sha2(F.array_join(F.col(centroid).cast("array<string>"), ",").cast("binary"), 256)

