"""Periodic runs of words by Main-Lorentz divide and conquer.

Words are interned: equal words have equal ids.  Each block of a text is cut at its midpoint; a run of period q that
crosses the midpoint m shows as a match of the words from m with those from m - q or m + q on, forwards and backwards.
How far these matches reach for every q is the Z-function of the midpoint, of both halves and both directions.  Runs
that do not cross m lie in one half, where the same is done.

All blocks of one level, of all texts of a slice, are looked at together in numpy.  A period is followed only where
the words next to the midpoint match; the Z-values of what is left come from rolling hashes by galloping, and every
run is compared word by word before it counts, so that a collision of hashes cannot make or stretch one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm._words import U64, Texts, mixed, slices

PAIRS = 1 << 20  # (midpoint, period) pairs that are looked at together
_BASE = U64(0x9E3779B97F4A7C15)


def interned(texts: Texts) -> np.ndarray:
    """A number for each word of a slice, the same for equal words only."""
    lens = texts.ends - texts.starts
    inside = np.zeros(len(texts.buf) + 1, np.int8)
    inside[texts.starts] += 1
    inside[texts.ends] -= 1
    packed = np.ascontiguousarray(texts.buf[np.cumsum(inside[:-1], dtype=np.int8).view(bool)])
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


class _Reach:
    """How far the words from i and j on, or up to i and j, are equal: never too short, too long only if hashes collide."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.power = np.cumprod(np.concatenate([[U64(1)], np.full(n, _BASE, U64)]), dtype=U64)
        self.sums = np.concatenate([[U64(0)], np.cumsum(mixed(ids.astype(U64) + U64(1)) * self.power[:n], dtype=U64)])

    def _same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[i + size] - self.sums[i]) * self.power[j - i] == self.sums[j + size] - self.sums[j]

    def _longest(self, most: np.ndarray, same) -> np.ndarray:
        """The largest size up to most for which same holds, as it holds for all smaller ones: doubled, then halved."""
        low, step = np.zeros(len(most), np.int64), 1
        open_ = np.arange(len(most))
        while len(open_):
            to = np.minimum(low[open_] + step, most[open_])
            good = same(open_, to)
            low[open_[good]] = to[good]
            open_ = open_[good & (to < most[open_])]
            step *= 2
        high = np.minimum(most, low + step)  # same is false above high
        while len(at := np.flatnonzero(low < high)):
            to = (low[at] + high[at] + 1) // 2
            good = same(at, to)
            low[at[good]], high[at[~good]] = to[good], to[~good] - 1
        return low

    def forwards(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._longest(end - j, lambda at, size: self._same(i[at], j[at], size))

    def backwards(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self._longest(i - begin, lambda at, size: self._same(i[at] - size, j[at] - size, size))


def _confirmed(ids: np.ndarray, begin: int, end: int, anchor: int, q: int) -> tuple[int, int]:
    """The part of [begin, end) around anchor that has period q, word by word."""
    bad = np.flatnonzero(ids[begin : end - q] != ids[begin + q : end])
    if not len(bad):
        return begin, end
    k = int(np.searchsorted(bad, anchor - begin))
    if k < len(bad) and bad[k] == anchor - begin:
        return begin, begin
    return begin + (int(bad[k - 1]) + 1 if k else 0), (begin + int(bad[k]) + q) if k < len(bad) else end


def find_runs(ids: np.ndarray, offsets: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of every maximal run of the texts whose words are ids[offsets[t]:offsets[t + 1]].

    A run has its smallest period q, at least max(min_length, min_exponent * q) words and cannot be made longer.
    min_exponent is at least 3: then a run that crosses a midpoint m holds a match of m with m - q or of m with m + q,
    and two runs of different periods that share a whole block cannot both be long.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be at least 3")
    reach: _Reach | None = None
    found = np.zeros((0, 5), np.int64)  # text, begin, end, q, in words of the slice; and the anchor
    text = np.flatnonzero(np.diff(offsets) >= min_length)
    low, high = offsets[text].astype(np.int64), offsets[text + 1].astype(np.int64)
    most = (high - low) // min_exponent  # the longest period that is looked for in each block
    while len(text):
        mid, new = (low + high) // 2, []
        for blocks, q in _pairs(most):
            m, t = mid[blocks], text[blocks]
            for at in (m - q, m):
                hit = np.flatnonzero(ids[at] == ids[np.minimum(at + q, len(ids) - 1)])
                i, p, first, last = at[hit], q[hit], offsets[t[hit]], offsets[t[hit] + 1]
                inside = i + p < last
                hit, i, p, first, last = (x[inside] for x in (hit, i, p, first, last))
                need = np.maximum(min_length - p, (min_exponent - 1) * p)  # matches in a row
                ahead, behind = np.ones(len(i), bool), np.ones(len(i), bool)
                for step in (1, 2):  # of need >= 5 matches in a row two at least lie on one side of i
                    to, back = i + step, i - step
                    ahead &= (to + p < last) & (ids[to.clip(max=len(ids) - 1)] == ids[(to + p).clip(max=len(ids) - 1)])
                    behind &= (back >= first) & (ids[back.clip(min=0)] == ids[(back + p).clip(min=0)])
                some = (ahead | behind) if min_length >= 6 else np.ones(len(i), bool)
                hit, i, p, first, last, need = (x[some] for x in (hit, i, p, first, last, need))
                if not len(i):
                    continue
                reach = reach or _Reach(ids)
                f, b = reach.forwards(i, i + p, last), reach.backwards(i, i + p, first)
                good = f + b >= need
                rows = np.stack([t[hit], i - b, i + p + f, p, i], 1)[good]
                new += _checked(ids, rows, min_length, min_exponent)
        if new:
            found = _smallest(np.concatenate([found, *new]))
        inside_q = _periods_around(found, low, high)
        text, low, high = (np.concatenate(x) for x in ((text, text), (low, mid), (mid, high)))
        # a block within a run of period w has no other run of a period of w / (min_exponent - 1) or more
        rest = np.where(inside_q > 0, (inside_q - 1) // (min_exponent - 1), high[: len(inside_q)] - low[: len(inside_q)])
        most = np.minimum((high - low) // min_exponent, np.concatenate([rest, rest]))
        keep = (high - low >= min_length) & (most > 0)
        text, low, high, most = (x[keep] for x in (text, low, high, most))
    out = np.stack([found[:, 0], found[:, 1] - offsets[found[:, 0]], found[:, 2] - found[:, 1], found[:, 3]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _pairs(most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block, period) for each period from 1 to most of each block, PAIRS at a time."""
    ends = np.cumsum(most)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, PAIRS):
        n = np.arange(at, min(at + PAIRS, total))
        block = np.searchsorted(ends, n, "right")
        yield block, n - (ends[block] - most[block]) + 1


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row of each (text, begin, end): that of the smallest period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])] if len(rows) else rows


def _checked(ids: np.ndarray, rows: np.ndarray, min_length: int, min_exponent: int) -> list[np.ndarray]:
    """The runs among rows (text, begin, end, q, anchor), word by word.

    The smallest period of each interval is compared first; where it holds, it settles the interval.  Where hashes
    misled, the part around the anchor that does hold counts, and the next period of the interval is compared.
    """
    out, rows = [], rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    while len(rows):
        first = np.concatenate([[True], (rows[1:, 1:3] != rows[:-1, 1:3]).any(1)])
        told, group = rows[first], np.cumsum(first) - 1
        held = told.copy()
        for r in held:
            r[1], r[2] = _confirmed(ids, int(r[1]), int(r[2]), int(r[4]), int(r[3]))
        out.append(held[held[:, 2] - held[:, 1] >= np.maximum(min_length, min_exponent * held[:, 3])])
        misled = (held != told).any(1)
        rows = rows[~first & misled[group]]
    return out


def _periods_around(found: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each block the period of a found run that holds all of it, or 0.

    Of the runs that begin at or before a block, the one that ends last is looked at.
    """
    if not len(found):
        return np.zeros(len(low), np.int64)
    rows = found[np.argsort(found[:, 1], kind="stable")]
    at = np.searchsorted(rows[:, 1], low, "right") - 1
    furthest = np.maximum.accumulate(rows[:, 2])
    which = np.maximum.accumulate(np.where(rows[:, 2] == furthest, np.arange(len(rows)), 0))
    best = rows[which[at.clip(min=0)]]
    return np.where((at >= 0) & (best[:, 2] >= high), best[:, 3], 0)


def _joined(texts: Texts, kept: np.ndarray) -> pa.Array:
    """Of each text its kept words, joined by one space."""
    doc, _ = texts.positions()
    lens, doc = (texts.ends - texts.starts)[kept], doc[kept]
    starts = texts.starts[kept]
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    sizes = lens + ~first  # with the space before the word
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    spaces = np.zeros(len(out), bool)
    spaces[(ends - sizes)[~first]] = True
    at = np.arange(int(lens.sum())) + np.repeat(starts - (np.cumsum(lens) - lens), lens)
    out[~spaces] = texts.buf[at]
    bytes_of = np.bincount(doc, sizes, len(texts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(bytes_of)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(out))


def collapse_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """A row for each document: doc_id, n_words, runs (start, length, period of each, by start, then period), text.

    A run is a stretch of words with smallest period q and at least max(min_length, min_exponent * q) words that no
    neighbouring word extends.  Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0 in their document.  text holds the words
    that no run contains after its first q ones, joined by one space.

    A null or empty text has no words, no runs and an empty text.  Rows that share a doc_id, or have none, are documents
    of their own.  An empty table gives none; other columns are left out, whatever their names.  A task holds one batch
    of rows and the words of 4 MB of text, or of one longer text.
    """
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids = interned(texts)
                runs = find_runs(ids, texts.word_offsets, min_length, min_exponent)
                begin = texts.word_offsets[runs[:, 0]] + runs[:, 1]
                drop = np.zeros(len(ids) + 1, np.int64)
                np.add.at(drop, begin + runs[:, 3], 1)
                np.add.at(drop, begin + runs[:, 2], -1)
                kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
                listed = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(item))
                offsets = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
                columns = [batch.column(0).slice(at, len(texts)), pa.array(texts.n_words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), listed), _joined(texts, kept).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "text"])

    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bare.mapInArrow(collapse, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, text string")
