"""Token-ID output as patched frame-of-reference blocks.

A table of segments, in ascending document order.  A segment holds the ids of a run of whole documents:

* payload: blocks of 256 ids (the last may be shorter) one after another;
* block_starts: the byte in payload where each block starts, so that any block can be read on its own;
* doc_ids, n_tokens: the documents of the segment and how many ids each has;
* part, part_start: the file part, and the ids of the part before this segment.

A block is: count and width (2 bytes: count - 1, width), exceptions (2 bytes), minimum (4 bytes), the offsets from
the minimum packed at `width` bits, least significant bit first, then the positions of the exceptions (1 byte
each) and what is left of their offsets above `width` bits (4 bytes each).  The width is that which the given
percentile of the block's offsets needs; larger ones are the exceptions.  Numbers are little-endian.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.llm._bpe import SLICE_BYTES, default_path, encoder
from gridsmith.llm._scratch import scratch_dir
from gridsmith.llm._words import slices

BLOCK = 256
HEAD = np.dtype([("last", "u1"), ("width", "u1"), ("exceptions", "<u2"), ("minimum", "<u4")])
SEGMENT_SCHEMA = "part int, part_start long, doc_ids array<long>, n_tokens array<long>, block_starts array<int>, payload binary"
_ARROW = pa.schema([
    ("part", pa.int32()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
    ("block_starts", pa.list_(pa.int32())), ("payload", pa.binary()),
])


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack(ids: np.ndarray, percentile: float = 95.0) -> tuple[bytes, np.ndarray]:
    """payload and block_starts of ids (uint32)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", np.zeros(0, np.int32)
    counts = np.full(blocks, BLOCK)
    counts[-1] = n - BLOCK * (blocks - 1)
    square = np.full((blocks, BLOCK), ids[-1], np.uint32)
    square.reshape(-1)[:n] = ids
    lowest = square.min(1)
    rest = square - lowest[:, None]
    rank = min(int(np.ceil(BLOCK * percentile / 100)), BLOCK) - 1
    width = _widths(np.partition(rest, rank, axis=1)[:, rank])
    big = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    big[-1, counts[-1] :] = False
    n_big = big.sum(1)
    head = np.zeros(blocks, HEAD)
    head["last"], head["width"], head["exceptions"], head["minimum"] = counts - 1, width, n_big, lowest
    packed_len = -(-counts * width // 8)
    sizes = HEAD.itemsize + packed_len + 5 * n_big
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    heads = head.view(np.uint8).reshape(blocks, HEAD.itemsize)
    out[starts[:, None] + np.arange(HEAD.itemsize)] = heads
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        low = rest[of].astype("<u4", copy=False).view(np.uint8).reshape(len(of), BLOCK, 4)
        if w % 8 == 0:
            body = low[:, :, : w // 8].reshape(len(of), BLOCK * w // 8)
        else:
            bits = np.unpackbits(low, axis=2, bitorder="little")[:, :, :w]
            body = np.packbits(bits.reshape(len(of), BLOCK * w), axis=1, bitorder="little")
        full = counts[of] == BLOCK
        out[(starts[of[full]] + HEAD.itemsize)[:, None] + np.arange(body.shape[1])] = body[full]
        for k in np.flatnonzero(~full):  # the last, shorter one
            at = starts[of[k]] + HEAD.itemsize
            out[at : at + packed_len[of[k]]] = body[k, : packed_len[of[k]]]
    row, col = np.nonzero(big)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_big) - n_big, n_big)
        at = starts[row] + HEAD.itemsize + packed_len[row]
        out[at + nth] = col
        over = (rest[row, col] >> width[row].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(at + n_big[row] + 4 * nth)[:, None] + np.arange(4)] = over
    return out.tobytes(), starts.astype(np.int32)


def unpack(payload: bytes, block_starts: np.ndarray) -> np.ndarray:
    """The ids that pack() was given, or those of the blocks whose starts are given."""
    starts = np.asarray(block_starts, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    data = np.frombuffer(payload, np.uint8)
    head = np.ascontiguousarray(data[starts[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).reshape(-1)
    counts, width = head["last"].astype(np.int64) + 1, head["width"].astype(np.int64)
    n_big = head["exceptions"].astype(np.int64)
    packed_len = -(-counts * width // 8)
    square = np.zeros((len(starts), BLOCK), np.uint32)
    padded = np.concatenate([data, np.zeros(32 * BLOCK // 8, np.uint8)])
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        body = padded[(starts[of] + HEAD.itemsize)[:, None] + np.arange(BLOCK * w // 8)]
        if w % 8 == 0:
            wide = np.zeros((len(of), BLOCK, 4), np.uint8)
            wide[:, :, : w // 8] = body.reshape(len(of), BLOCK, w // 8)
            square[of] = wide.reshape(len(of), BLOCK * 4).view("<u4")
            continue
        bits = np.zeros((len(of), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(body, axis=1, bitorder="little").reshape(len(of), BLOCK, w)
        square[of] = np.packbits(bits, axis=2, bitorder="little").reshape(len(of), BLOCK * 4).view("<u4")
    if n_big.any():
        row = np.repeat(np.arange(len(starts)), n_big)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_big) - n_big, n_big)
        at = starts[row] + HEAD.itemsize + packed_len[row]
        over = np.ascontiguousarray(data[(at + n_big[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        square[row, data[at + nth]] |= over << width[row].astype(np.uint32)
    square += head["minimum"][:, None]
    return square[np.arange(BLOCK)[None, :] < counts[:, None]]


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, segment_ids: int = 1 << 18, percentile: float = 95.0) -> None:
    """Encodes each whole text, appends end_id, and writes segments at path in ascending doc_id order, null first.

    A null text counts as empty: it has the end id alone.  Rows that share a doc_id all stay, in the order of a hash
    of their texts, and may lie in several parts; only equal rows stay together.  An
    empty table writes an empty table.  A segment closes after segment_ids ids, or holds one longer document.
    Columns other than doc_id and text are left out, whatever their names.
    """
    at = tokenizer or default_path()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0)
            for row, texts in slices(batch.column(1), SLICE_BYTES):
                ids, offsets = encoder(at).encode(texts)
                lens = np.diff(offsets) + 1
                ends = np.cumsum(lens)
                every = np.full(int(ends[-1]), end_id, np.uint32)
                stays = np.ones(len(every), bool)
                stays[ends - 1] = False
                every[stays] = ids
                a, rows = 0, []
                while a < len(texts):
                    base = int(ends[a] - lens[a])
                    b = max(a + 1, int(np.searchsorted(ends, base + segment_ids, "right")))
                    payload, starts = pack(every[base : int(ends[b - 1])], percentile)
                    rows.append((part, done, keys.slice(row + a, b - a).to_pylist(), lens[a:b], starts, payload))
                    done += int(ends[b - 1]) - base
                    a = b
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows that share a doc_id, null ones above all, need not be one range; a key of 8 bytes, as ranges are told by a sample
    keyed = bare.withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if asked for, from the files.

    ids_crc32 is the unsigned CRC-32 of a document's ids as little-endian unsigned 32-bit integers.
    """
    schema = "part int, doc_id long, part_at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, part_start, doc_ids, n_tokens, starts, payload = (batch.column(name)[row] for name in SEGMENT_NAMES)
                ids = unpack(payload.as_py(), starts.values.to_numpy())
                lens = n_tokens.values.to_numpy()
                ends = np.cumsum(lens)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                columns = [pa.array(np.full(len(lens), part.as_py(), np.int32)), doc_ids.values, pa.array(part_start.as_py() + ends - lens), n_tokens.values, pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(ends - lens, ends[-1]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "part_at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = stored.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file part
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = stored.select(*SEGMENT_NAMES).mapInArrow(documents, schema).join(totals, "part")
    return out.select("doc_id", (F.col("before") + F.col("part_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


SEGMENT_NAMES = ["part", "part_start", "doc_ids", "n_tokens", "block_starts", "payload"]


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """write_token_files() into the shared folder, then read_token_files() of it."""
    path = scratch_dir(docs.sparkSession)
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
