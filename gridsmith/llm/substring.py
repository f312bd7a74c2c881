"""Exact substring dedup by fixed-block anchors.

Every tenth run of ten words of a document is a reference block; blocks do not overlap.  Every rolling run of ten
words of every document probes the index of blocks.  A repeat of 20 words holds a whole block of each of its places, so
each place has a hit; around the hits the repeat is extended to whole runs of 20 words, which are compared
themselves.  What is left is the union of those that also start earlier: the maximal exact repeats.

Index and probes meet packed: a slice of text sends, for each range of hashes, one row of arrays.  A bucket is a range
that fits into a task's memory.  Where there are more than FAN buckets, rows go in two steps: to wide ranges first, where
each task parts its share into the buckets, so that a row always holds some hundred windows and no task writes to all
buckets.  A passage that many documents share costs one window a slice, and then one window a task of the first step.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridsmith.llm._words import U64, mixed, slices, windows

NULL_ID, LEAST_ID = -(1 << 63), -(1 << 62)
FAN = 2048  # buckets that one slice writes to directly
MOST_PARTITIONS = 10_000  # of a shuffle; beyond, a task takes its buckets one after the other
_PACKED = "bucket int, hits boolean, payload binary"


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of integers, byte by byte, so that zeros stand together and compress."""
    return np.ascontiguousarray(x.astype("<i8" if x.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = np.frombuffer(data, np.uint8), 0

    def take(self, n: int, size: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :size] = self.data[self.at : self.at + n * size].reshape(size, n).T
        self.at += n * size
        return out.view("<i8").reshape(-1)


def _pack(docs: np.ndarray, place: np.ndarray, hashes: np.ndarray | None, width: int) -> bytes:
    """Windows in runs of one document and rising places: docs is a matrix of one or two key columns, row by window."""
    change = np.concatenate([[True], (docs[1:] != docs[:-1]).any(1) | (place[1:] < place[:-1])])
    first = np.flatnonzero(change)
    counts = np.diff(np.append(first, len(place)))
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    out = [np.array([len(place), len(first), docs.shape[1]], "<i8").tobytes()]
    out += [_planes(np.diff(docs[first, c], prepend=0) if c == 0 else docs[first, c], 8) for c in range(docs.shape[1])]
    out += [_planes(counts, 4), _planes(step, 4)]
    return b"".join(out + ([_planes(hashes, width)] if hashes is not None else []))


def _unpack(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    n, m, columns = np.frombuffer(data[:24], "<i8").tolist()
    r = _Reader(data[24:])
    docs = np.stack([np.cumsum(r.take(m, 8)) if c == 0 else r.take(m, 8) for c in range(columns)], 1)
    counts, step = r.take(m, 4), r.take(n, 4)
    whole = np.cumsum(step)
    first = np.cumsum(counts) - counts
    place = whole - np.repeat(whole[first] - step[first], counts)
    return np.repeat(docs, counts, 0), place, r.take(n, width).view(U64) if r.at < len(r.data) else None


def _rows(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    bucket, hits, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(hits, pa.bool_()), pa.array(payload, pa.binary())], names=["bucket", "hits", "payload"])


class _Deal:
    """n buckets, and the wide ranges of them that rows go to first where there are many."""

    def __init__(self, n: int) -> None:
        self.n, self.partitions = n, min(n, MOST_PARTITIONS)
        self.wide = math.isqrt(n - 1) + 1 if n > FAN else 0
        self.tasks = max(1, -(-self.partitions // self.wide)) if self.wide else 0  # for each wide range

    def first(self, bucket: np.ndarray, salt: int) -> np.ndarray:
        """Where windows of these buckets go from a slice or task; salt tells its rows of a range from others'."""
        if not self.wide:
            return bucket.astype(np.int32)
        return (bucket * self.wide // self.n * self.tasks + salt % self.tasks).astype(np.int32)

    def exchange(self, packed: DataFrame, part: Callable) -> DataFrame:
        """packed rows (bucket, hits, payload) in one task for each bucket, or its buckets in order."""
        if self.wide:
            packed = packed.repartitionById(self.wide * self.tasks, "bucket").mapInArrow(part, _PACKED)
        if self.partitions == self.n:
            return packed.repartitionById(self.n, "bucket")
        at = (F.col("bucket").cast("long") * self.partitions / self.n).cast("int")
        return packed.repartitionById(self.partitions, at).sortWithinPartitions("bucket")


def _each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bool, bytes]]]:
    """The rows of one bucket after the other."""
    held, now = [], None
    for batch in batches:
        for bucket, hits, payload in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append((hits, payload))
    if held:
        yield held


def _some(batches: Iterator[pa.RecordBatch], limit: int = 64 << 20) -> Iterator[list[tuple[bool, bytes]]]:
    """Rows of at most so many bytes together, or one."""
    held, size = [], 0
    for batch in batches:
        for hits, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            held.append((hits, payload))
            size += len(payload)
            if size > limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _hit_rows(rows: list[tuple[bool, bytes]], width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(keys, places) of the rows that are hits already."""
    got = [_unpack(x, width)[:2] for hits, x in rows if hits]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else None


def _by_bucket(bucket: np.ndarray, docs: np.ndarray, place: np.ndarray, hashes: np.ndarray, width: int) -> list[tuple[int, bool, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, docs, place, hashes = bucket[order], docs[order], place[order], hashes[order]
    edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
    return [(int(bucket[a]), False, _pack(docs[a:b], place[a:b], hashes[a:b], width)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _by_group(docs: np.ndarray, place: np.ndarray, deal: _Deal) -> Iterator[pa.RecordBatch]:
    """Windows packed for each group of documents, by the first key column."""
    if len(place):
        group = deal.first((mixed(np.ascontiguousarray(docs[:, 0]).view(U64)) % U64(deal.n)).astype(np.int64), int(place[0]))
        order = np.lexsort([place, *docs.T[::-1], group])
        docs, place, group = docs[order], place[order], group[order]
        edge = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
        yield _rows([(int(group[a]), True, _pack(docs[a:b], place[a:b], None, 0)) for a, b in zip(edge[:-1], edge[1:], strict=True)])


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary value for each count, of so many rows of data."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * (data.nbytes // max(1, len(data)))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _of_documents(column: pa.Array, kind: type, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the row, record) for all records in a column of _binary() values; null has none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, count=len(column) + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    records = raw.view(kind).reshape(-1, width)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // (width * np.dtype(kind).itemsize)), records


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of one group of documents after the other, each once, by document and place."""
    for rows in _each_bucket(batches):
        docs, place = _hit_rows(rows, 0)
        order = np.lexsort([place, *docs.T[::-1]])
        docs, place = docs[order], place[order]
        new = np.concatenate([[True], (docs[1:] != docs[:-1]).any(1) | (place[1:] != place[:-1])])
        yield docs[new], place[new]


def _hits_of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, packed: a row for each document with the places of its hits (int32)."""
    for found in _collected(batches):
        ids, place = found[0][:, 0], found[1].astype("<i4")
        first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids[first]), _binary(place[:, None], np.diff(np.append(first, len(ids)))).cast(pa.binary())], names=["id", "packed"])


def _late_of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, packed: a row for each document with runs of late windows (text hash, first and last place, int64)."""
    for docs, place in _collected(batches):
        new = np.concatenate([[True], (docs[1:] != docs[:-1]).any(1) | (place[1:] != place[:-1] + 1)])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(place)) - 1
        ids, record = docs[at, 0], np.stack([docs[at, 1], place[at], place[last]], 1).astype("<i8")
        first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids[first]), _binary(record, np.diff(np.append(first, len(ids)))).cast(pa.binary())], names=["id", "packed"])


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = False, bucket_bytes: int = 16 << 20) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256; if asked for, kept_text, text and row, the other columns of docs.

    A word goes if a run of `window` words that covers it also starts earlier: in a smaller doc_id, or further up in
    the same document.  Runs are judged on the input.  Rows of one doc_id stand in the order of a hash of their
    texts; rows that agree in both are one document and give equal results.  A null doc_id comes before all others; such
    rows stand in the order of another hash of their texts, by which they are dealt to all tasks (each is held as a long
    below -2^62, which no document may have).  A null text has no words.  An empty table gives none; other columns are left out, whatever their names.

    Runs are told apart by 64-bit hashes.  Windows are dealt by hash into buckets for each `bucket_bytes` of text, and
    a task holds those of a bucket, some 20 bytes a word, whatever the cluster's settings.  A window that all documents
    share comes once from each slice of 4 MB of text, not once from each document, and where there are over 2048 buckets
    once from each task of the first step.  All rows of one doc_id that is not null are in one task.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    half = window // 2
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).cast("long")).first()[0] or 0
    n = max(1, -(-size // bucket_bytes))
    deal = _Deal(n)
    low = U64((1 << 31) - 1)

    def keyed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, object]]:
        batch = batch.take(pa.compute.sort_indices(batch.column(0)))
        for at, texts in slices(batch.column(1)):
            yield batch, at, texts

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, at, texts in keyed(batch):
                doc, place = texts.positions()
                h = windows(texts.hashes(), half)
                ok = doc[half - 1 :] == doc[: len(h)]
                h, doc, place = h[ok], doc[: len(ok)][ok], place[: len(ok)][ok]
                if not len(h):
                    continue
                ids = rows.column(0).to_numpy()[at + doc]
                block = place % half == 0
                again = pd.Index(h).duplicated(keep=False)
                anchored = again & np.isin(h, h[again & block])
                sent = ~anchored
                sent[anchored] = ~pd.Index(h[anchored]).duplicated()
                block |= anchored
                bucket, salt = bucket_of(h), int(h[0] & low)
                own = [(int(deal.first(bucket[:1], salt)[0]), True, _pack(ids[anchored, None], place[anchored], None, 0))] if anchored.any() else []
                marked = (h << U64(1)) | block.astype(U64)
                if not deal.wide:
                    marked &= U64((1 << 40) - 1)  # windows of a bucket are told apart by less
                yield _rows(own + _by_bucket(deal.first(bucket, salt)[sent], ids[sent, None], place[sent], marked[sent], 8 if deal.wide else 5))

    def bucket_of(h: np.ndarray) -> np.ndarray:
        return ((h >> U64(32) & low) * U64(n) >> U64(31)).astype(np.int64)

    def part_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of windows that this task sees more than once, one goes on to its bucket; the others have their hit if a block is among them."""
        for rows in _some(batches):
            out = []
            if found := _hit_rows(rows, 0):
                out.append((int(mixed(found[0][:1, 0].view(U64))[0] % U64(n)), True, _pack(*found, None, 0)))
            got = [_unpack(x, 8) for hits, x in rows if not hits]
            if got:
                docs, place, marked = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.argsort(marked)
                key = marked[order] >> U64(1)
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(first, len(key)))
                has = (marked[order[first + size - 1]] & U64(1)).astype(bool)  # blocks come last in their run
                told = order[np.repeat((size > 1) & has, size)]
                if len(told):
                    out.append((int(bucket_of(marked[told[:1]] >> U64(1))[0]), True, _pack(docs[told], place[told], None, 0)))
                # one of each run with a block goes on, and all others, which may still meet one
                go = np.concatenate([order[np.repeat(~has, size)], order[first[has] + size[has] - 1]])
                h = marked[go] >> U64(1)
                out += _by_bucket(bucket_of(h), docs[go], place[go], marked[go] & U64((1 << 40) - 1), 5)
            yield _rows(out)

    def part_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _some(batches):
            docs, place = _hit_rows(rows, 0)
            group = (mixed(np.ascontiguousarray(docs[:, 0]).view(U64)) % U64(n)).astype(np.int64)
            order = np.lexsort([place, *docs.T[::-1], group])
            docs, place, group = docs[order], place[order], group[order]
            edge = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
            yield _rows([(int(group[a]), True, _pack(docs[a:b], place[a:b], None, 0)) for a, b in zip(edge[:-1], edge[1:], strict=True)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_bucket(batches):
            if found := _hit_rows(rows, 0):
                yield from _by_group(*found, deal)
            got = [_unpack(x, 5) for hits, x in rows if not hits]
            if not got:
                continue
            docs, place, short = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(short)
            key = short[order] >> U64(1)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            has = (short[order[first + size - 1]] & U64(1)).astype(bool)  # blocks come last in their run
            at = order[np.repeat((size > 1) & has, size)]
            yield from _by_group(docs[at], place[at], deal)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, at, texts in keyed(batch):
                doc, place = texts.positions()
                h = windows(texts.hashes(), half)
                starts = len(h) - half
                if starts <= 0:
                    continue
                ids = rows.column(0).to_numpy()[at : at + len(texts)]
                of, hit = _of_documents(rows.column(2).slice(at, len(texts)), np.int32, 1)
                hit = hit[:, 0].astype(np.int64)
                fits = hit <= texts.n_words[of] - half  # those of another row of this doc_id may lie beyond
                of, hit = texts.word_offsets[of[fits]], hit[fits]
                size = len(doc) + 1  # marks of windows that hold a hit
                near = np.bincount(of + np.maximum(hit - half, 0), minlength=size) - np.bincount(of + hit + 1, minlength=size)
                ok = (np.cumsum(near)[:starts] > 0) & (doc[window - 1 :] == doc[:starts])
                s = np.flatnonzero(ok)
                if not len(s):
                    continue
                text_hash = np.array([xxhash.xxh64_intdigest(texts.text(i)) for i in range(len(texts))], U64).view(np.int64)
                whole = mixed(h[s] * U64(0x9E3779B97F4A7C15) + h[s + half])
                keys = np.stack([ids[doc[s]], text_hash[doc[s]]], 1)
                yield from first_of(whole, keys, place[s])

    def first_of(whole: np.ndarray, keys: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of equal windows the earliest goes on to the others' bucket; the rest repeat it."""
        yield _rows(earliest(whole, keys, place, deal.first))

    def earliest(whole: np.ndarray, keys: np.ndarray, place: np.ndarray, to: Callable) -> list[tuple[int, bool, bytes]]:
        late = _late(whole, keys, place)
        bucket = to(((whole >> U64(32)) * U64(n) >> U64(32)).astype(np.int64), int(whole[0] & low))
        own = [(int(bucket[0]), True, _pack(keys[late], place[late], None, 0))] if late.any() else []
        first = ~late
        return own + _by_bucket(bucket[first], keys[first], place[first], whole[first], 8)

    def part_wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _some(batches):
            out = []
            if found := _hit_rows(rows, 8):
                out.append((int(mixed(found[0][:1, 0].view(U64))[0] % U64(n)), True, _pack(*found, None, 0)))
            got = [_unpack(x, 8) for hits, x in rows if not hits]
            if got:
                keys, place, whole = (np.concatenate(x) for x in zip(*got, strict=True))
                out += earliest(whole, keys, place, lambda bucket, salt: bucket)
            yield _rows(out)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_bucket(batches):
            if found := _hit_rows(rows, 8):
                yield from _by_group(*found, deal)
            got = [_unpack(x, 8) for hits, x in rows if not hits]
            if got:
                keys, place, whole = (np.concatenate(x) for x in zip(*got, strict=True))
                late = _late(whole, keys, place)
                yield from _by_group(keys[late], place[late], deal)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "text", "row"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                of, run = _of_documents(batch.column(2).slice(at, len(texts)), np.int64, 3)
                own = np.zeros(len(texts), np.int64)
                for i in np.unique(of).tolist():
                    own[i] = np.array(xxhash.xxh64_intdigest(texts.text(i)), U64).view(np.int64)
                mine = run[:, 0] == own[of]
                base, run, size = texts.word_offsets[of[mine]], run[mine], len(texts.starts) + 1
                gone = np.bincount(base + run[:, 1], minlength=size) - np.bincount(base + run[:, 2] + window, minlength=size)
                stays = np.cumsum(gone)[:-1] == 0
                data, ends, offsets = joined(texts, stays)
                lens = [(int(ends[a - 1]) + 1 if a else 0, int(ends[b - 1]) if b > a else -1) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                kept = [data[a:b] if b >= 0 else b"" for a, b in lens]
                columns = [
                    batch.column(0).slice(at, len(texts)), pa.array(texts.n_words.astype(np.int64)), pa.array((texts.n_words - np.diff(offsets)).astype(np.int64)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                ]
                if with_text:
                    columns += [pa.array(kept, pa.binary()).cast(pa.string()), batch.column(1).slice(at, len(texts)), batch.column(3).slice(at, len(texts))]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    # a native expression: with a UDF in it Spark would not see that the three readers of `dealt` share one exchange
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), 2))
    # dealt once: probing, extending and finishing read the same exchange, as they read the same columns
    row = [F.struct(*[c for c in docs.columns if c != "text"], F.col("text").isNull().alias("__no_text")).alias("row")] if with_text else []
    names_in = ["row"] if with_text else []
    dealt = docs.select(key.alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *row).repartition(deal.partitions, "id")

    def met(packed: DataFrame, part: Callable, then: Callable, merge: Callable) -> DataFrame:
        """Windows go to the task of their hashes, what is found to that of a group of documents; a row for each document."""
        each = deal.exchange(packed, part).mapInArrow(then, _PACKED)
        return deal.exchange(each, part_groups).mapInArrow(merge, "id long, packed binary")

    hits = met(dealt.mapInArrow(probe, _PACKED), part_probes, meet, _hits_of_documents)
    late = met(dealt.join(hits, "id").select("id", "text", "packed", *names_in).mapInArrow(extend, _PACKED), part_wholes, decide, _late_of_documents)
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, text string" * with_text)
    if with_text:
        schema = schema.add("row", dealt.schema["row"].dataType)
    out = dealt.join(late, "id", "left").select("id", "text", "packed", *names_in).mapInArrow(finish, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") >= LEAST_ID, F.col("doc_id")))


def _late(whole: np.ndarray, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether an equal window starts earlier; a window that is there twice, key and place alike, is one."""
    out = np.zeros(len(whole), bool)
    order = np.argsort(whole)
    same = whole[order[1:]] == whole[order[:-1]]
    some = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(whole) else order
    some = some[np.lexsort([place[some], keys[some, 1], keys[some, 0], whole[some]])]
    w = whole[some]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    lead = some[np.repeat(first, np.diff(np.append(first, len(w))))]
    out[some] = ~((keys[some] == keys[lead]).all(1) & (place[some] == place[lead]))
    return out


def joined(texts, stays: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words that stay, with one space after each, of all texts; where each word ends; word offsets of the texts."""
    starts, ends = texts.starts[stays], texts.ends[stays]
    lens = ends - starts
    to = np.cumsum(lens + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    inside = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[inside + np.repeat(to - lens - 1, lens)] = texts.buf[inside + np.repeat(starts, lens)]
    return out.tobytes(), to - 1, np.concatenate([[0], np.cumsum(stays)])[texts.word_offsets]


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs, all columns, with the kept words joined by one space where words went; documents of which nothing is left go.

    Each row has what is kept of its own text, whatever other rows of its doc_id lose.
    """
    found = remove_repeats(docs, window, with_text=True)
    lost = F.col("n_removed") > 0
    text = F.when(lost, F.col("kept_text")).when(~F.col("row.__no_text"), F.col("text"))
    columns = [text.alias("text") if c == "text" else F.when(lost, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return found.filter(~lost | (F.col("kept_text") != "")).select(*columns)
