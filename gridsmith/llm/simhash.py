"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of the segments, each 0, 1 or 2, are a point
whose Manhattan distance to another's is at most the Hamming distance.  Of two points at distance 4 or less the first
16 coordinates are 2 apart at most or the last 16 are 1 apart at most.  Each half is range-joined on the integer grid
under its radius: a point stands in its own cell and visits those at one step, where two points meet that are up to
two steps apart, or at one step up only, which does for one step.  That is some 25 and 13 cells.  Who meets in a cell is compared
under the Manhattan bound of all coordinates, and what is left is verified by exact Hamming distance.

Two random fingerprints meet in one given cell with a chance of 1 / 6.4 million: a fingerprint is compared with some
38 N / 6.4 million others of N distinct ones, 6 at a million and 6000, some microseconds, at a billion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm._components import components
from gridsmith.llm._rows import best_row, keyed
from gridsmith.llm._runs import chunk_pairs, runs
from gridsmith.llm._scratch import dropped, partitions, written
from gridsmith.llm._words import LOWER, U64, slices

SIDE = 16
_POWERS = 3 ** np.arange(SIDE, dtype=np.int64)


def fingerprint(words: bytes, starts: np.ndarray, ends: np.ndarray, k: int, seed: int = 42) -> int:
    """Of words joined by one space in `words`, at starts and ends: a bit is set if over half the shingles' hashes have it."""
    n = len(starts)
    if not n:
        return 0
    digest, m = xxhash.xxh64_intdigest, max(1, n - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 1 << 16):  # 64 bytes a shingle at once, however long the text
        to = min(at + (1 << 16), m)
        hashes = np.array([digest(words[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[min(k, n) - 1 :][at:to].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of each row; A-Z lower-cased, whole texts, no words: 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, texts in slices(batch.column(1)):
                out = np.zeros(len(texts), U64)
                lower = LOWER[texts.buf]
                # words and one space after each, of all texts in one buffer
                lens = texts.ends - texts.starts
                to = np.cumsum(lens + 1)
                joined = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
                if len(to):
                    inside = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
                    joined[inside + np.repeat(to - lens - 1, lens)] = lower[inside + np.repeat(texts.starts, lens)]
                data, ends, w = joined.tobytes(), to - 1, texts.word_offsets.tolist()
                starts = ends - lens
                for i, (a, b) in enumerate(zip(w[:-1], w[1:], strict=True)):
                    out[i] = fingerprint(data, starts[a:b], ends[a:b], k)
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(texts)), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bare.mapInArrow(each, "doc_id long, fp long")


def popcount_code(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments in unary (0: 00, 1: 01, 2: 11): their Hamming distance is the counts' Manhattan distance."""
    low = U64(0x5555555555555555)
    one, both = (fp | (fp >> U64(1))) & low, (fp & (fp >> U64(1))) & low
    return one | (both << U64(1))


def radii(bits: int) -> tuple[int, int]:
    """The Manhattan radii of the two halves: of two points within bits, one half is within its own."""
    return bits // 2, (bits - 1) // 2 if bits else 0


def grid_cells(fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, which of fp) of both halves: own cells, those one step up, and for radius 2 those one step down."""
    counts = np.stack([np.bitwise_count((fp >> U64(2 * i)) & U64(3)) for i in range(2 * SIDE)], 1).astype(np.int64)
    every = np.arange(len(fp))
    for half, radius in enumerate(radii(bits)):
        part = counts[:, half * SIDE : (half + 1) * SIDE]
        own = part @ _POWERS + half * 3**SIDE
        yield own, every
        for i in range(SIDE if radius else 0):
            up = np.flatnonzero(part[:, i] < 2)
            yield own[up] + _POWERS[i], up
            if radius > 1:
                down = np.flatnonzero(part[:, i] > 0)
                yield own[down] - _POWERS[i], down


def spanning(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked among fp, fewer than len(fp): a linked one leaves the rest once it is reached."""
    code, rest = popcount_code(fp), np.arange(len(fp))
    a, b = [], []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(code[rest] ^ code[at]) <= bits  # the Manhattan bound
            near[near] = np.bitwise_count(fp[rest[near]] ^ fp[at]) <= bits
            if near.any():
                got = rest[near].tolist()
                a += [at] * len(got)
                b += got
                queue += got
                rest = rest[~near]
    return fp[a].view(np.int64), fp[b].view(np.int64)


_SCHEMA = "a long, b long, cell long, chunk int, fps binary"


def _row(a=(), b=(), cell=None, chunk=None, fps=None) -> pa.RecordBatch:
    n = max(len(a), 1) if fps is not None or len(a) else 0
    cols = [pa.array(a if len(a) else [None] * n, pa.int64()), pa.array(b if len(a) else [None] * n, pa.int64())]
    cols += [pa.array([x] * n, t) for x, t in ((cell, pa.int64()), (chunk, pa.int32()), (fps, pa.binary()))]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "cell", "chunk", "fps"])


def links(distinct: DataFrame, bits: int = 4, limit: int = 20_000) -> DataFrame:
    """distinct fp (long, each once) -> a, b: pairs at `bits` or fewer differing bits that join all that are linked.

    A cell of more than `limit` fingerprints is cut into chunks, and each two chunks are compared in a task of their
    own; nothing is left out.
    """
    if not 0 <= bits <= 5:
        raise ValueError("bits must be from 0 to 5")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(at, 20_000).to_numpy()
                cell, which = (np.concatenate(x) for x in zip(*grid_cells(fp.view(U64), bits), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[which])], names=["cell", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, chunk in runs(batches, limit):
            fp = np.ascontiguousarray(table.column(1).to_numpy()).view(U64)
            if chunk >= 0:
                yield _row(cell=table.column(0)[0].as_py(), chunk=chunk, fps=fp.tobytes())
                continue
            lens = np.diff(np.append(starts, len(fp)))
            small = np.repeat((lens > 1) & (lens <= 16), lens)
            no = np.repeat(np.arange(len(lens)), lens)[small]
            x = fp[small]
            code = popcount_code(x)
            for lag in range(1, 16):
                i = np.flatnonzero(no[lag:] == no[:-lag])
                if not len(i):
                    break
                i = i[np.bitwise_count(code[i] ^ code[i + lag]) <= bits]
                i = i[np.bitwise_count(x[i] ^ x[i + lag]) <= bits]
                if len(i):
                    yield _row(x[i].view(np.int64), x[i + lag].view(np.int64))
            for k in np.flatnonzero(lens > 16).tolist():
                a, b = spanning(fp[starts[k] : starts[k] + lens[k]], bits)
                if len(a):
                    yield _row(a, b)

    def compare_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                both = np.unique(np.frombuffer(one.as_py() + (two.as_py() or b""), U64))
                a, b = spanning(both, bits)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    n = partitions(distinct.sparkSession)
    dealt = distinct.select("fp").mapInArrow(cells, "cell long, fp long").repartition(n, "cell").sortWithinPartitions("cell")
    found = written(dealt.mapInArrow(compare, _SCHEMA))
    out = found.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    chunks = found.filter("fps is not null").select("cell", "chunk", "fps")
    if not chunks.isEmpty():
        each_two = chunk_pairs(chunks, "cell", "chunk", "fps").select("one", "two").repartition(n)
        out = out.unionByName(each_two.mapInArrow(compare_chunks, "a long, b long")).distinct()
    return out


def near_duplicates(docs: DataFrame, k: int = 4, bits: int = 4) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of `bits` or fewer differing bits, itself included.
    Texts without words, null ones too, have fingerprint zero and link like any other.  Equal fingerprints are one
    node, so copies cost nothing; rows that share a doc_id are documents of their own.  A null doc_id is never the
    smallest while another is there.  An empty table gives none; other columns are left out, whatever their names.
    """
    marked = written(fingerprints(docs, k))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes, bits))
    # a row for each fingerprint; its component's smallest doc_id
    whole = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    whole = written(whole)
    least = whole.groupBy("c").agg(F.min("least").alias("component_id"))
    whole = whole.join(least, "c").select(F.col("fp").alias("fp2"), "component_id")
    out = marked.join(whole, marked["fp"] == whole["fp2"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, k: int = 4, bits: int = 4) -> DataFrame:
    """One row of docs, all columns, of each component: that with the smallest doc_id, a null one only where no other is there.

    Each row is a document of its own, whatever its doc_id; of a component's rows that share it the one with the
    smallest hash stays.
    """
    rows = keyed(docs)
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), k, bits).select(F.col("doc_id").alias("row"), "component_id")
    best = rows.select(*best_row(rows)).join(found, "row").groupBy("component_id").agg(F.min(F.struct("none", "doc", "whole", "row")).alias("best"))
    return rows.join(best.select(F.col("best.row").alias("__row")), "__row", "left_semi").select(*docs.columns)
