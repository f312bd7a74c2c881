"""Vectorised word work on Arrow batches of texts: spans, 64-bit hashes, rolling windows.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text.  The bytes of many
texts lie in one buffer, as Arrow keeps them; numpy walks that buffer instead of Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SLICE_BYTES = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: each input bit moves every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_STEP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


_LOW = _powers(0xD6E8FEB86659FD93, _STEP)


def hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans, which follow one another without overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    longest = int(lens.max())
    if longest <= 64:  # column by column, each over the spans that reach it
        out, order = np.zeros(len(starts), U64), np.argsort(lens.astype(np.uint8), kind="stable")
        at, reach = starts[order], np.searchsorted(lens[order], np.arange(longest), "right")
        for j in range(longest):
            k = reach[j]
            out[k:] += _BYTE[buf[at[k:] + j]] * _LOW[j]
        back = np.empty_like(out)
        back[order] = out
        out = back
    else:
        begins = np.cumsum(lens) - lens
        at = np.arange(int(lens.sum())) - np.repeat(begins, lens)
        term = _BYTE[buf[at + np.repeat(starts, lens)]]
        if longest > _STEP:
            term *= _powers(0xA0761D6478BD642F, longest // _STEP + 1)[at // _STEP]
            at %= _STEP
        term *= _LOW[at]
        out = np.add.reduceat(term, begins)
    return mixed(out + lens.astype(U64) * U64(0x9E3779B97F4A7C15))


class Texts:
    """Some whole texts in one byte buffer: byte offsets, and the word spans of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        self.buf, self.offsets = buf, offsets
        word = ~SPACE[buf]
        first, last = word.copy(), word.copy()
        if len(buf):
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            full = np.flatnonzero(offsets[1:] > offsets[:-1])
            a, b = offsets[full], offsets[full + 1] - 1
            first[a], last[b] = word[a], word[b]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of text i: word_offsets[i] to word_offsets[i + 1]
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.word_offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever it stands."""
        return hashed(LOWER[self.buf] if lower else self.buf, self.starts, self.ends)

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: its text's number, its place there from 0."""
        doc = np.repeat(np.arange(len(self)), self.n_words)
        return doc, np.arange(len(self.starts)) - np.repeat(self.word_offsets[:-1], self.n_words)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; runs that cross texts are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U64(0x9FB21C651E98DF25)
        out += hashes[j : j + n]
    return mixed(out)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, Texts) for runs of whole texts of at most limit bytes each, or one longer text; null is empty."""
    for chunk_at, chunk in _chunks(texts):
        if chunk.null_count:
            chunk = chunk.fill_null("")
        chunk = chunk.cast(pa.large_string())
        _, offs, data = chunk.buffers()
        offsets = np.frombuffer(offs, np.int64, count=len(chunk) + 1, offset=chunk.offset * 8) if len(chunk) else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield chunk_at + at, Texts(whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


def _chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    at = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        yield at, chunk
        at += len(chunk)
