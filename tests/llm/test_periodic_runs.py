"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gridsmith.llm import periodic_runs
from gridsmith.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(u, min_length=6, exponent=4):
    """Every (start, length, period): stretches of equal neighbours for each period, the smallest period of an interval."""
    n, seen = len(u), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if u[i] != u[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and u[i] == u[i + q]:
                i += 1
            if i + q - s >= max(min_length, exponent * q):
                seen.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def collapsed(u, runs):
    return " ".join(w for i, w in enumerate(u) if not any(s + q <= i < s + n for s, n, q in runs))


def drawn(r):
    n, k = r.choice([0, 1, 5, 6, 7, r.randint(0, 60), r.randint(0, 200)]), r.choice([1, 2, 3, 5, 20])
    u = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randint(0, 3) if n > 10 else 0):
        a, p = r.randrange(n), r.randint(1, n // 5)
        for i in range(a, min(n, a + r.randint(1, n))):
            u[i] = u[a + (i - a) % p] if a + (i - a) % p < n else 0
    return u


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_drawn_texts(seed):
    r = random.Random(seed)
    for _ in range(60):
        texts, shape = [drawn(r) for _ in range(r.randint(1, 5))], r.choice([(6, 4), (6, 3), (9, 5), (3, 3)])
        got = periodic_runs.find_runs(np.array(sum(texts, []), np.int64), np.cumsum([0, *map(len, texts)]), *shape)
        assert [tuple(x) for x in got.tolist()] == [(t, *x) for t, u in enumerate(texts) for x in brute(u, *shape)]


def test_pairs_come_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    r = random.Random(4)
    for _ in range(60):
        u = drawn(r)
        assert [tuple(x[1:]) for x in periodic_runs.find_runs(np.array(u, np.int64), np.array([0, len(u)])).tolist()] == brute(u)


def test_colliding_hashes_make_no_run(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mixed", lambda x: np.zeros(len(x), np.uint64))  # every stretch looks like every other
    r = random.Random(6)
    for _ in range(60):
        u = drawn(r)
        assert [tuple(x[1:]) for x in periodic_runs.find_runs(np.array(u, np.int64), np.array([0, len(u)])).tolist()] == brute(u)


@pytest.mark.parametrize("text", [np.zeros(400_000, int), np.arange(400_000) % 7, np.arange(400_000) % 90_001])
def test_long_texts(text):
    (got,) = periodic_runs.find_runs(text.astype(np.int64), np.array([0, len(text)])).tolist()
    assert got == [0, 0, 400_000, len(set(text.tolist()))]


def test_an_exponent_below_three_is_refused():
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(9, np.int64), np.array([0, 9]), 6, 2)


def test_rows_with_hard_cases(spark):
    texts = ["a b " * 4, "a b\n" * 3, None, "", " \t\n", "x" * 50_000 + " x" * 9, "é ß é ß é ß é ß é", "a a a a a a b", "one two", "a\x1ca a\x1ca " * 6]
    rows = [(i, t, "clash", "clash", 7) for i, t in enumerate(texts)] + [(None, texts[0], "c", None, 1), (0, texts[7], "c", None, 1), (0, texts[7], "c", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words string, start int")
    got = periodic_runs.collapse_runs(docs).collect()
    want = []
    for d, t, *_ in rows:
        u = WORD.findall(t or "")
        want.append((d, len(u), brute(u), collapsed(u, brute(u))))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got), key=str) == sorted(want, key=str)
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0


def by_contract(d, t):
    u = WORD.findall(t or "")
    h, n = zlib.crc32(str(d).encode()), len(u)
    if d is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        u = [w if i < a else u[a + (i - a) % p] for i, w in enumerate(u)]
    runs = brute(u)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(collapsed(u, runs)), n)


def test_query_by_its_contract(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, " ".join(f"w{x}" for x in drawn(r))) for i in range(400)] + [(None, "a " * 9), (None, None), (7, "b " * 8), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((by_contract(*x) for x in rows), key=str)
    assert any(x[0] in {i for i, _ in rows} and zlib.crc32(str(x[0]).encode()) % 10 == 0 and x[1] for x in map(tuple, got.collect()))


def test_query_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [x for x in docs if len(x.text or "") < 6000]
    got = {x.doc_id: tuple(x) for x in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and all(got[x.doc_id] == by_contract(x.doc_id, x.text) for x in short)
