"""Near-duplicates by the Jaccard similarity of word shingles.

Candidates are linked by their SimHash fingerprints, which at 4 bits brings together half of the pairs of similarity 0.95 and
a thirtieth of those of 0.8, or share a cell of five min-hashes, of twenty; a pair of similarity 0.8 shares none with
a chance of 0.0004.  Candidates are compared by whole sets of shingles, and only what these join is a group: where
candidates join more shingles than a task should hold, cells are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm._components import components
from gridsmith.llm._scratch import dropped, partitions, written
from gridsmith.llm._words import U64, Texts, mixed, slices, windows
from gridsmith.llm.simhash import links

CELLS, ROWS = 20, 5
_MUL = mixed(np.arange(1, CELLS * ROWS + 1, dtype=U64)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: Texts, k: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its runs of k words, each once, A-Z lower-cased; of all its words if there are fewer."""
    hashes = texts.hashes(lower=True)
    every, w = windows(hashes, k), texts.word_offsets.tolist()
    return [np.unique(every[a : b - k + 1]) if b - a >= k else windows(hashes[a:b], b - a)[: b - a] for a, b in zip(w[:-1], w[1:], strict=True)]


def cells(sets: list[np.ndarray]) -> np.ndarray:
    """A row of CELLS keys for each set, none of which is empty."""
    if not sets:
        return np.zeros((0, CELLS), U64)
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> U64(32)).astype(np.uint32)
    lens = np.array([len(x) for x in sets])
    starts = np.cumsum(lens) - lens
    out = np.empty((CELLS, len(sets)), U64)
    for c in range(CELLS):
        key = np.full(len(sets), c, U64)
        for m in _MUL[c * ROWS : (c + 1) * ROWS]:
            key = mixed(key * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(low * m + high, starts))
        out[c] = key
    return out.T


def linked(sets: list[np.ndarray], threshold: float) -> tuple[list[int], list[int]]:
    """Links that join what is linked at `threshold` or more, fewer than len(sets); a linked one leaves the rest once it is reached."""
    size = np.array([len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    postings = owner[np.argsort(column, kind="stable")]
    many = np.bincount(column)
    first, begin = np.cumsum(many) - many, np.cumsum(size) - size
    left = np.ones(len(sets), bool)
    a, b = [], []
    for root in range(len(sets)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            at = queue.pop()
            mine = column[begin[at] : begin[at] + size[at]]
            n = many[mine]
            place = np.arange(int(n.sum())) + np.repeat(first[mine] - (np.cumsum(n) - n), n)
            both = np.bincount(postings[place], minlength=len(sets))
            near = np.flatnonzero(left & (both > 0))
            near = near[both[near] / (size[near] + size[at] - both[near]) >= threshold]
            left[near] = False
            got = near.tolist()
            a += [at] * len(got)
            b += got
            queue += got
    return a, b


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """A bit is set if over half of the hashes have it; of none: zero."""
    if not len(hashes):
        return U64(0)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # 64 bytes a hash at once
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def _identified(docs: DataFrame) -> DataFrame:
    """docs with two hashes of the whole row: rows that share both are equal in every column."""
    return docs.withColumns({"__w1": F.xxhash64(*docs.columns), "__w2": F.xxhash64(F.lit(1), *docs.columns)})


def _sketches(rows: DataFrame, k: int) -> DataFrame:
    names = ["none", "doc", "w1", "w2", "key", "size", "fp", "cells"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(4)):
                sets = shingle_sets(texts, k)
                size = np.array([len(x) for x in sets], np.int64)
                key = np.array([mixed(x + U64(len(x))).sum(dtype=U64) for x in sets], U64)
                fp = np.array([fingerprint(x) for x in sets], U64)
                offsets = np.concatenate([[0], np.cumsum((size > 0) * CELLS)])
                found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cells([x for x in sets if len(x)]).reshape(-1).view(np.int64)))
                columns = [batch.column(i).slice(at, len(texts)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(key.view(np.int64)), pa.array(size), pa.array(fp.view(np.int64)), found], names=names)

    doc = F.col("doc_id").cast("long")
    bare = rows.select(doc.isNull().alias("none"), doc.alias("doc"), F.col("__w1").alias("w1"), F.col("__w2").alias("w2"), F.col("text").cast("string").alias("text"))
    return bare.mapInArrow(each, "none boolean, doc long, w1 long, w2 long, key long, size long, fp long, cells array<long>")


def _candidates(nodes: DataFrame, bits: int) -> DataFrame:
    """a, b: keys of nodes that share a cell, a fingerprint or a link of fingerprints, or are joined by such pairs."""
    each = nodes.select("key", F.explode("cells").alias("cell"))
    shared = each.groupBy("cell").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least != most").select("cell", "least")
    in_cell = each.join(shared, "cell").select(F.col("key").alias("a"), F.col("least").alias("b"))
    least = written(nodes.groupBy("fp").agg(F.min("key").alias("least")))
    same = nodes.select("key", "fp").join(least, "fp").select(F.col("key").alias("a"), F.col("least").alias("b"))
    one, two = (least.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}")) for x in "ab")
    near = links(least.select("fp"), bits).join(one, "a").join(two, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return in_cell.unionByName(same).unionByName(near).filter("a != b").distinct()


def _sets(rows: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """key, packed: the set of shingles of each member, from the row that stands for it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                packed = pa.array([x.tobytes() for x in shingle_sets(texts, k)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), packed], names=["key", "packed"])

    own = members.select(F.col("w1").alias("__w1"), F.col("w2").alias("__w2"), F.col("key").alias("__key"))
    texts = rows.select("__w1", "__w2", F.col("text").cast("string").alias("text")).join(own, ["__w1", "__w2"])
    return texts.select(F.col("__key").alias("key"), "text").mapInArrow(sets, "key long, packed binary")


def _compared(dealt: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """dealt (key, of) -> a, b: similar keys of one `of`, enough of them to join all such."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            a, b = linked([np.frombuffer(x, U64) for x in packed], threshold) if len(keys) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in x], pa.int64()) for x in (a, b)], names=["a", "b"])

        of, keys, packed = None, [], []
        for batch in batches:
            for group, key, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if group != of:
                    yield done()
                    of, keys, packed = group, [], []
                keys.append(key)
                packed.append(x)
        yield done()

    groups = dealt.join(sets, "key").select("of", "key", "packed").repartition(partitions(dealt.sparkSession), "of").sortWithinPartitions("of")
    return groups.mapInArrow(compare, "a long, b long")


def _chunks(size: Column, limit: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / limit)).cast("int")


def _chunk(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("key"), chunks).cast("int")


def with_smallest(pairs: DataFrame, limit: int) -> DataFrame:
    """pairs (key, size, b) -> key, of: each key with its b, and a b once for every `limit` shingles of its keys."""
    chunks = pairs.groupBy("b").agg(_chunks(F.sum("size"), limit).alias("chunks"))
    dealt = pairs.join(chunks, "b").select("key", F.xxhash64("b", _chunk(F.col("chunks"))).alias("of"))
    own = chunks.select(F.col("b").alias("key"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    return dealt.unionByName(own.select("key", F.xxhash64("key", "chunk").alias("of")))


def by_cell(nodes: DataFrame, limit: int) -> DataFrame:
    """nodes (key, size, fp, cells, label) -> key, of: any two of one cell or fingerprint and of different labels meet.

    A cell whose nodes have one label is done.  In others the label with most shingles need not meet itself: the rest
    is dealt to chunks of `limit` shingles, each of which meets all chunks of the rest and all of that label.
    """
    each = nodes.select("key", "size", "label", F.explode(F.concat("cells", F.array("fp"))).alias("cell"))
    labels = each.groupBy("cell", "label").agg(F.sum("size").alias("size")).groupBy("cell")
    top = labels.agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("n")).filter("n > 1")
    most = F.col("top.size")
    top = top.select("cell", F.col("top.label").alias("main"), _chunks(most, limit).alias("mains"), _chunks(F.col("all") - most, limit).alias("rests"))
    every = each.join(top, "cell").withColumn("in_main", F.expr("label = main"))
    every = every.withColumn("chunk", _chunk(F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))))
    rests, mains = (F.sequence(F.lit(0), F.col(x) - 1) for x in ("rests", "mains"))
    unit = lambda rest, other: F.xxhash64("cell", rest, other)  # noqa: E731  (chunks of the main label count -1, -2, ...)
    of_main = F.transform(rests, lambda i: unit(i, -1 - F.col("chunk")))
    others = F.filter(rests, lambda i: i != F.col("chunk"))
    of_rest = F.concat(F.transform(mains, lambda j: unit(F.col("chunk"), -1 - j)), F.transform(others, lambda i: unit(F.least(i, "chunk"), F.greatest(i, "chunk"))))
    return every.select("key", F.explode(F.when(F.col("in_main"), of_main).otherwise(of_rest)).alias("of"))


def similar(rows: DataFrame, nodes: DataFrame, k: int, threshold: float, bits: int, limit: int) -> DataFrame:
    """a, b: keys of nodes whose sets are similar, enough of them to join all that are; a written table.

    What candidates join is compared as a whole where it has at most `limit` shingles.  Larger groups, which false
    candidates may have chained, are compared by candidates: first each node with the smallest one of each of its cells,
    then, cell by cell, nodes that are not joined yet.
    """
    candidates = written(_candidates(nodes, bits))
    found = components(candidates)
    joined = written(nodes.join(found, nodes["key"] == found["node"]).drop("node"))
    fits = joined.groupBy("component").agg((F.sum("size") <= limit).alias("fits"))
    members = written(joined.join(fits, "component"))
    whole, large = members.filter("fits"), members.filter("not fits")
    out = _compared(whole.select("key", F.col("component").alias("of")), _sets(rows, whole, k), threshold)
    done = [candidates, joined, members]
    if not large.isEmpty():
        sets = written(_sets(rows, large, k))
        pairs = candidates.withColumnRenamed("a", "key").join(large.select("key", "size"), "key")
        first = written(_compared(with_smallest(pairs, limit), sets, threshold))
        labels = components(first)
        named = large.join(labels.withColumnRenamed("component", "label"), large["key"] == labels["node"], "left")
        named = written(named.select("key", "size", "fp", "cells", F.coalesce("label", "key").alias("label")))
        out = out.unionByName(first).unionByName(_compared(by_cell(named, limit), sets, threshold))
        done += [sets, first, named]
    out = written(out)
    for table in done:
        dropped(table)
    return out


def one_of_each(docs: DataFrame, k: int = 5, threshold: float = 0.8, bits: int = 4, limit: int = 500_000) -> DataFrame:
    """One row of docs, all columns, of each group that pairs of similarity `threshold` or more join.

    The similarity is the Jaccard index of the sets of k-word shingles, A-Z lower-cased, by 64-bit hashes; texts without
    words, null ones too, are alike.  The row with the smallest doc_id stays, a null one only where no other is there;
    of rows that share it the one with the smallest hash.  Each row is a document of its own, whatever its doc_id; rows
    that are equal in every column are one.  A task holds twice `limit` shingles, or two documents.
    """
    rows = _identified(docs)
    first = F.first(F.struct("w1", "w2", "size", "fp", "cells")).alias("node")
    nodes = written(_sketches(rows, k).groupBy("key").agg(F.min(F.struct("none", "doc", "w1", "w2")).alias("best"), first).select("key", "best", "node.*"))
    found = components(similar(rows, nodes.drop("best"), k, threshold, bits, limit))
    best = nodes.join(found, nodes["key"] == found["node"], "left").groupBy(F.coalesce("component", "key").alias("c")).agg(F.min("best").alias("best"))
    kept = written(best.select(F.col("best.w1").alias("__w1"), F.col("best.w2").alias("__w2")))
    return rows.join(kept, ["__w1", "__w2"], "left_semi").dropDuplicates(["__w1", "__w2"]).select(*docs.columns)
