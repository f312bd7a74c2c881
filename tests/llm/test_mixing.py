"""What the mix takes, seat by seat, against brute force and the query's SQL."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gridsmith.llm import mixing
from gridsmith.llm.sql import _source_mixing
from tests.llm.test_operators import WORD, brute_targets, docs, rows  # noqa: F401


def brute(rows, block, shards, cap=2, seed=7):
    """Each seat takes one word after the other from its source's tape."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    names = sorted({r[3] for r in rows} - {None}) + [None] * any(r[3] is None for r in rows)
    sizes = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in names}
    aim = brute_targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5, cap)
    seats = round(sum(aim.values()) / block)
    quotients = sorted((-aim[s] / (2 * j + 1), i) for i, s in enumerate(names) for j in range(seats))[:seats]
    taken, first = defaultdict(lambda: [0] * shards), 0
    for i, s in enumerate(names):
        quota = sum(q[1] == i for q in quotients)
        order = sorted((k for k, r in enumerate(rows) if r[3] == s), key=lambda k: (hashlib.md5(f"{seed}:{'null' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest(), size[k]))
        tape = [k for k in order for _ in range(size[k])] * cap
        for seat in range(quota):
            for k in tape[seat * block : (seat + 1) * block]:
                taken[k][(first + seat) % shards] += 1
        first += quota
    return Counter((r[0], r[3], n, tuple(taken[k])) for k, (r, n) in enumerate(zip(rows, size, strict=True)))


@pytest.mark.parametrize("block, shards", [(16, 16), (7, 3), (128, 5)])
def test_every_word_that_is_taken(docs, rows, block, shards):
    got = mixing.mix_documents(docs, block=block, shards=shards).collect()
    assert Counter((x["doc_id"], x["source"], x["size"], tuple(x["shard_words"])) for x in got) == brute(rows, block, shards)
    assert all(x["taken"] == sum(x["shard_words"]) for x in got)


def test_small_sources_come_near_their_targets(spark):
    texts = [(1, "a " * 130, "one"), (2, "b " * 40, "two"), (3, "c " * 100_000, "three"), (4, None, "four"), (5, "d " * 25, None)]
    got = mixing.mix_documents(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()
    assert all(abs(x["taken"] - x["target"]) <= 32 for x in got) and min(x["taken"] for x in got if x["size"]) > 0


def test_sql_gives_the_same_rows(docs):
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    want = c.execute(_source_mixing(block=16))
    columns = [d[0] for d in want.description]
    got = mixing.mix_documents(docs, block=16).withColumn("shard_words", F.array_join("shard_words", ","))
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(map(tuple, want.fetchall()))


def test_rows_without_ids_are_many_ranges(spark):
    """A third of the rows share no doc_id: the same words as brute force, and no range holds those of different sizes."""
    rows = [(None if i % 3 == 0 else i, "w " * (i * 7 % 50), "en", ["s1", "s2", None][i % 2 + i % 5 // 4]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix_documents(docs, block=16).collect()
    assert Counter((x["doc_id"], x["source"], x["size"], tuple(x["shard_words"])) for x in got) == brute(rows, 16, 16)
