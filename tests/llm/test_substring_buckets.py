"""Substring dedup with many buckets: the same rows in one step and in two, and the cost of a slice at any number of buckets."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from gridsmith.llm import substring
from tests.llm.test_operators import multiset


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [words(r.randint(15, 60)) for _ in range(12)]
    hot = words(35)
    rows = []
    for i in range(400):
        parts = [words(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            parts += [r.choice(passages), words(r.randint(0, 15))]
        if i % 3 == 0:
            parts += [hot, words(5)]
        rows.append((None if i % 4 == 1 else i // 2 if i % 7 == 0 else i, " ".join(sum(parts, []))))
    rows += [(None, " ".join(hot)), (None, " ".join(hot)), (None, None), (7, None), (-5, " ".join(hot + hot)), (None, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


def brute(rows, window=20):
    import hashlib

    import xxhash

    own = lambda r: -(1 << 63) + (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 2) if r[0] is None else r[0]
    at = lambda r: (own(r), np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode()))), r[1] or "")
    seen, out = set(), {}
    for key in sorted({at(r) for r in rows}):
        u = key[2].split()
        gone = set()
        for i in range(len(u) - window + 1):
            w = tuple(u[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        kept = " ".join(x for i, x in enumerate(u) if i not in gone)
        out[key] = (len(u), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return Counter((r[0], *out[at(r)]) for r in rows)


@pytest.mark.parametrize("fan, partitions, size", [(2048, 10_000, 3000), (4, 10_000, 3000), (4, 7, 3000), (2048, 7, 2000), (1, 3, 500)])
def test_the_same_rows_however_many_buckets(docs, monkeypatch, fan, partitions, size):
    monkeypatch.setattr(substring, "FAN", fan)
    monkeypatch.setattr(substring, "MOST_PARTITIONS", partitions)
    got = multiset(substring.remove_repeats(docs, bucket_bytes=size), ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert got == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("n", [32, 65_536, 1_000_000])
def test_a_slice_costs_the_same_at_any_number_of_buckets(n):
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 400_000, dtype=np.int64).view(np.uint64)
    place = np.tile(np.arange(400), 1000)
    docs = np.repeat(np.arange(1000), 400)[:, None]
    deal = substring._Deal(n)
    bucket = (h >> np.uint64(32)).astype(np.int64) * n >> 31
    began = time.process_time()
    rows = substring._by_bucket(deal.first(bucket, 5), docs, place, h, 8 if deal.wide else 5)
    assert time.process_time() - began < 3
    assert sum(len(x) for *_, x in rows) < 40 * len(h) and len(rows) <= max(substring.FAN, deal.wide)
    assert n <= substring.FAN or deal.wide * deal.tasks < 2 * substring.MOST_PARTITIONS + deal.wide


def test_null_ids_are_dealt_by_their_texts(spark):
    """Rows without a doc_id get ids of their own below all others, in the order of their texts' hashes."""
    texts = [f"text {i} " * 3 for i in range(300)]
    d = spark.createDataFrame([(None, t) for t in texts] + [(5, "x")], "doc_id long, text string")
    got = substring.remove_repeats(d).collect()
    assert Counter(r.doc_id for r in got) == Counter({None: 300, 5: 1}) and all(r.n_removed == 0 for r in got)
