"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams of a language by rank.  A text gets the language whose profile has
its own most frequent n-grams at the nearest ranks: the sum over them of how far each is out of place.

n-grams are one to three code points of lower-cased words of letters, with one blank before and after each word.  They
are told apart exactly: three code points fit into one 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_TEXTS = 256  # texts that are counted together, and
MOST_BYTES = 4 << 20  # their bytes, but for one longer text
MOST_COUNTS = 1 << 20  # n-grams whose counts a task of learning holds before it passes them on
CODE = 21  # bits of a code point


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-cased letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = ord(low) if len(low := x.lower()) == 1 else ord(low[0])
    return out


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, n-gram, count) of each n-gram of each text, by text and n-gram; at most MOST_TEXTS texts."""
    codes = np.frombuffer("\0".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.int32)
    ends = np.cumsum([len(t or "") + 1 for t in texts])  # with the break between texts
    letters = _letters()[codes]
    word = letters > 0
    stays = word.copy()  # letters, and one blank after each word
    stays[1:] |= word[:-1]
    at = np.flatnonzero(stays)
    doc = np.searchsorted(ends, at, "right")
    chars = np.concatenate([[0], letters[at], [0]])  # a word at the very end or start has its blank as well
    doc = np.concatenate([doc[:1], doc, doc[-1:]])
    alphabet, small = np.unique(chars, return_inverse=True)  # 0, the blank, is the smallest
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    bits = max(1, int(len(alphabet)).bit_length())  # of an n-gram's letter, counted from 1; 0 is none
    small, alphabet = small.astype(np.int64) + 1, np.concatenate([[0], alphabet])
    blank = small == 1
    one, two, three = small[~blank], (small[:-1] << bits) | small[1:], (small[:-2] << 2 * bits) | (small[1:-1] << bits) | small[2:]
    of_two, of_three = ~(blank[:-1] & blank[1:]), ~blank[1:-1]
    keys = np.concatenate([one, two[of_two], three[of_three]])
    # a bigram of a blank and a letter belongs to the letter's text
    docs = np.concatenate([doc[~blank], np.where(blank[:-1], doc[1:], doc[:-1])[of_two], doc[1:-1][of_three]])
    keys |= docs << (3 * bits)
    keys.sort()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count, keys = np.diff(np.append(starts, len(keys))), keys[starts]
    doc, mask = keys >> (3 * bits), (1 << bits) - 1
    gram = np.zeros(len(keys), np.int64)
    for k in (2, 1, 0):
        part = (keys >> (k * bits)) & mask
        gram = np.where(part > 0, (gram << CODE) | (alphabet[part] + 1), gram)
    return doc, gram, count.astype(np.int64)


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) for runs of rows of at most MOST_TEXTS and MOST_BYTES, or one longer text."""
    sizes = np.append(0, np.cumsum(texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pandas().str.len().to_numpy(np.int64))) if len(texts) else np.zeros(1)
    at = 0
    while at < len(texts):
        to = min(at + MOST_TEXTS, max(at + 1, int(np.searchsorted(sizes, sizes[at] + MOST_BYTES, "right")) - 1))
        yield at, texts.slice(at, to - at).to_pylist()
        at = to


def top(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, n-gram, rank from 0) of each text's `size` most frequent n-grams; of equal counts the smaller n-gram first."""
    if not len(doc):
        return doc, gram, count
    by_gram = np.lexsort((gram, -count, doc)) if int(count.max()).bit_length() + int(doc.max()).bit_length() + len(doc).bit_length() > 62 else None
    if by_gram is None:  # rows are in order of text; of one text and count, numbers of rows that go by n-gram decide
        place = np.empty(len(doc), np.int64)
        place[np.argsort(gram, kind="stable")] = np.arange(len(doc))
        width = len(doc).bit_length()
        most = int(count.max())
        key = ((doc << most.bit_length() | (most - count)) << width) | place
        by_gram = np.argsort(key)
    doc, gram = doc[by_gram], gram[by_gram]
    first = np.searchsorted(doc, doc, "left")
    rank = np.arange(len(doc)) - first
    keep = rank < size
    return doc[keep], gram[keep], rank[keep]


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_profiles(docs: DataFrame, size: int = 1000, per_language: int = 20_000, seed: int = 3, most_languages: int = 1000) -> DataFrame:
    """lang, gram, rank (from 0): the `size` most frequent n-grams of each lang over docs with text and lang.

    Of a lang with more than per_language documents about that many are learned from, whole, chosen by a seeded hash of
    doc_id.  Of equal counts the smaller n-gram goes first.  Rows without lang or text are left out; rows that share a
    doc_id are chosen together.  More than most_languages languages are a ValueError: their sizes are sent to all tasks.
    """
    docs = docs.filter("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    sizes = docs.sparkSession.createDataFrame([tuple(r) for r in sizes], "lang string, n long")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / (1 << 40)
    chosen = docs.join(F.broadcast(sizes), "lang").filter(draw * F.col("n") < per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            gram, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return gram, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)

        def given() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                gram, c = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(c)], names=["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for at, texts in _groups(batch.column(1)):
                doc, gram, c = counted(texts)
                of = langs[at : at + len(texts)][doc] if len(doc) else langs[:0]
                for lang in set(of.tolist()):
                    mine = of == lang
                    held.setdefault(lang, []).append((gram[mine], c[mine]))
                    n += int(mine.sum())
                if n > MOST_COUNTS:
                    held = {lang: [merged(parts)] for lang, parts in held.items()}
                    n = sum(len(parts[0][0]) for parts in held.values())
                    if n > MOST_COUNTS // 2:
                        yield from given()
                        held, n = {}, 0
        yield from given()

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # Spark limits each task's rows of a lang first
    return counts.withColumn("rank", rank - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """The profiles of all languages as one table: a row for each n-gram, a column for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        number = {x: i for i, x in enumerate(self.langs)}
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), number[lang]] = rank

    def nearest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest language or -1, score) of each text."""
        doc, gram, rank = top(*counted(texts), self.size)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.langs or not len(doc):
            return best, score
        at = np.searchsorted(self.grams, gram).clip(max=len(self.grams) - 1)
        known = self.grams[at] == gram
        n = np.bincount(doc, minlength=len(texts))
        least = np.full(len(texts), np.inf)
        for k in range(len(self.langs)):
            own = self.ranks[at, k]
            out = np.where(known & (own >= 0), np.abs(own - rank), self.size)
            distance = np.bincount(doc, out, len(texts))
            nearer = (distance < least) & (n > 0)
            best[nearer], least[nearer] = k, distance[nearer]
        some = n > 0
        score[some] = 1 - least[some] / (self.size * n[some])
        return best, score


def identify(docs: DataFrame, profiles: DataFrame, size: int = 1000, most_languages: int = 1000) -> DataFrame:
    """A row for each document: doc_id, lang_pred, score, by profiles (lang, gram, rank).

    lang_pred is the language of the smallest out-of-place distance: over the text's `size` most frequent n-grams the
    sum of the differences of ranks, `size` where the profile has not the n-gram.  Of equal distances the lang that is
    smaller by code points goes.  score is 1 minus the distance over the greatest possible one.  A null text, one
    without letters, and every text if there are no profiles, is `und` with score 0.  Rows that share a doc_id, or have
    none, are documents of their own; an empty table gives none; other columns are left out, whatever their names.

    Profiles are sent to all tasks: at most most_languages times size rows, else ValueError.
    """
    rows = [tuple(r) for r in profiles.limit(most_languages * size + 1).collect()]
    if len(rows) > most_languages * size:
        raise ValueError(f"profiles of more than {most_languages} languages")
    table = docs.sparkSession.sparkContext.broadcast(Profiles(rows, size))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _groups(batch.column(1)):
                best, score = table.value.nearest(texts)
                names = [table.value.langs[k] if k >= 0 else "und" for k in best.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bare.mapInArrow(predict, "doc_id long, lang_pred string, score double")
