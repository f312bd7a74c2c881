"""Best-fit packing by sum of squares.

Documents become token ids; only a document longer than a sequence is cut.  Each piece goes where the sum over
residual gaps of (open sequences with that gap) squared becomes smallest, so that no gap piles up.  Pieces are
dealt by hash into groups of some million tokens that are packed apart, largest first.  What the groups leave
unfilled is taken apart and packed again in fewer groups, until one is left or no sequence is saved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm._bpe import SLICE_BYTES, default_path, encoder
from gridsmith.llm._scratch import written
from gridsmith.llm._words import slices


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, taken in the given order; every length is from 1 to capacity.

    Placing length s into a gap g changes the sum by (2 N[g - s] + 1) - (2 N[g] - 1), with N of gap 0 counted as
    none, and a new sequence by 2 N[capacity - s] + 1.  Of equal changes the smallest gap is taken, an open
    sequence before a new one.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[s:]) + s
        best, gap = (2 * count[capacity - s] + 1) * (s < capacity), -1
        if len(gaps):
            left = gaps - s
            change = np.where(left > 0, 2 * count[left] + 1, 0) - 2 * count[gaps] + 1
            k = int(change.argmin())
            if change[k] <= best:
                gap = int(gaps[k])
        if gap < 0:
            b, used, gap = used, used + 1, capacity
        else:
            b = open_at[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = b, capacity - gap
        if gap > s:
            open_at[gap - s].append(b)
            count[gap - s] += 1
    return sequence, offset


PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, copy (tells rows of one doc_id apart), piece, start, length, ids_crc32, and the ids if asked for."""
    at = tokenizer or default_path()
    names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            keys = batch.column(0)
            for row, texts in slices(batch.column(1), SLICE_BYTES):
                ids, offsets = encoder(at).encode(texts)
                lens = np.diff(offsets) + 1
                begins = np.cumsum(lens) - lens
                every = np.full(int(lens.sum()), end_id, "<u4")
                stays = np.ones(len(every), bool)
                stays[begins + lens - 1] = False
                every[stays] = ids
                n = -(-lens // capacity)
                doc = np.repeat(np.arange(len(lens)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(lens[doc] - start, capacity)
                raw, first = memoryview(every.tobytes()), begins[doc] + start
                sums = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [
                    keys.slice(row, len(lens)).take(pa.array(doc)), pa.array(part + done + doc), pa.array(piece.astype(np.int32)),
                    pa.array(start), pa.array(length), pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(every)), pa.int32()), pa.array(every.astype(np.int64))))
                done += len(lens)
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids"][: len(columns)])

    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bare.mapInArrow(cut, PIECES + ", ids array<long>" * with_ids)


def _packed(cut: DataFrame, groups: int, no: int, capacity: int) -> DataFrame:
    """The pieces of cut, packed in so many groups: sequence_id, offset and room, what is left of the sequence."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        group = table["group"].to_numpy()
        edge = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            part = table.slice(a, b - a)
            length = part["length"].to_numpy()
            sequence, offset = sum_of_squares(length, capacity)
            room = capacity - np.bincount(sequence, length).astype(np.int64)[sequence]
            base = (no << 56) + (int(group[a]) << 28)
            out = part.drop_columns(["group"]).append_column("sequence_id", pa.array(base + sequence))
            yield from out.append_column("offset", pa.array(offset)).append_column("room", pa.array(room)).to_batches()

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(no)), F.lit(groups)).cast("int"))
    dealt = dealt.repartitionById(groups, "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(place, PIECES + ", sequence_id long, offset long, room long")


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False, group_tokens: int = 1 << 20) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for.

    A document is its whole text's ids, then end_id; a null text counts as empty.  Rows that share a doc_id are
    documents of their own.  Every sequence is filled from offset 0 without a gap.  An empty table gives none;
    other columns are left out, whatever their names.  The number of sequences does not depend on the settings of
    the cluster: a group has some `group_tokens` tokens, up to 16 times as many where unfilled sequences meet.
    """
    cut = written(pieces(docs, capacity, tokenizer, end_id, with_ids))
    light = cut.drop("ids")
    groups, no, done = max(1, -(-(light.agg(F.sum("length")).first()[0] or 0) // group_tokens)), 0, []
    now = written(_packed(light, groups, no, capacity))
    while groups > 1:
        unfilled = F.col("room") * 64 > capacity
        # each sequence has one piece at offset 0
        tokens, count = now.filter(unfilled).agg(F.sum("length"), F.sum((F.col("offset") == 0).cast("int"))).first()
        fewer = -(-(tokens or 0) // (16 * group_tokens))
        if not 0 < fewer < groups:
            break
        no += 1
        again = written(_packed(now.filter(unfilled).select(light.columns), fewer, no, capacity))
        if again.filter("offset = 0").count() >= count:
            break
        done.append(now.filter(~unfilled))
        now, groups = again, fewer
    for x in done:
        now = now.unionByName(x)
    if with_ids:
        now = now.join(cut.select("copy", "piece", "ids"), ["copy", "piece"])
    return now.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")
