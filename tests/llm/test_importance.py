"""Weights of importance resampling against brute force, and the shares in which documents are drawn."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from gridsmith.llm import importance
from gridsmith.llm._words import U64, hashed, mixed
from tests.llm.test_operators import WORD


def bucket(gram):
    """The bucket of one or two words, each hashed on its own."""
    h = []
    for w in gram:
        raw = np.frombuffer(w.encode(), np.uint8)
        h.append(int(hashed(raw, np.array([0]), np.array([len(raw)]))[0]))
    if len(h) == 1:
        return h[0] >> (64 - importance.BUCKET_BITS)
    both = np.array([(h[0] * 0x9FB21C651E98DF25 + h[1]) % (1 << 64)], U64)
    return int(mixed(both)[0]) >> (64 - importance.BUCKET_BITS)


def grams(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return [bucket(g) for g in [*((x,) for x in w), *itertools.pairwise(w)]]


def test_weights_are_sums_of_log_ratios(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "C", "dd", "ee", "f"]) for _ in range(r.randint(0, 30))) for _ in range(40)] + [None, "", "only here"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "y"), (4, "twice dd", "z")]
    labels = [(i, i % 3 != 0, i % 5 == 0) for i in range(20)] + [(4, True, False), (None, True, False), (7, False, False), (99, True, False)]
    labels = [(a, int(b), int(c)) for a, b, c in labels] + [(8, None, None)]
    got = importance.importance_resample(spark.createDataFrame(rows, "doc_id long, text string, rank string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    ids = {a for a, *_ in labels if a is not None}
    good = {a for a in ids if all(q == 1 for x, q, _ in labels if x == a)}
    target = {a for a in good if not any(t for x, _, t in labels if x == a)}
    raw, aim = Counter(), Counter()
    for d, t, _ in rows:
        raw.update(grams(t))
        if d in target:
            aim.update(grams(t))
    part = sum(aim.values()) / sum(raw.values())
    ratio = {b: math.log((aim[b] + 16) / (n * part + 16)) for b, n in raw.items()}
    want = sorted((-1 if d is None else d, round(math.fsum(ratio[b] for b in grams(t)), 9)) for d, t, _ in rows)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], round(x["log_weight"], 9)) for x in got.collect()) == want
    assert len({w for _, w in want}) > 30
    assert got.filter("kept").count() == math.ceil(len(good) / len(ids) * len(rows))
    for x in got.collect():
        noise = importance.gumbel(np.array([-1 if x["doc_id"] is None else x["doc_id"]]), 11)[0]
        assert x["sample_key"] == pytest.approx(x["log_weight"] + noise)


def test_documents_are_drawn_in_proportion_to_their_weights():
    weight = np.array([0.0, 0.5, -1.0, 1.2, 0.3])
    seeds = 20_000
    drawn = np.zeros(5)
    for seed in range(seeds):
        drawn[np.argsort(-(weight + importance.gumbel(np.arange(5), seed)))[:2]] += 1
    p, want = np.exp(weight) / np.exp(weight).sum(), np.zeros(5)
    for i, j in itertools.permutations(range(5), 2):  # one after the other, without replacement
        want[[i, j]] += p[i] * p[j] / (1 - p[i])
    assert np.abs(drawn / seeds - want).max() < 0.015


def test_another_seed_draws_others(spark):
    rows = [(i, f"word{i % 7}") for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    one, again, two = ({x["doc_id"] for x in importance.importance_resample(docs, labels, seed=s).filter("kept").collect()} for s in (1, 1, 2))
    assert one == again and len(one) == len(two) == 100 and 25 < len(one & two) < 75


def test_held_out_accuracy(spark):
    """Fitted on half of the labels: nearly all good documents of the other half stay, most others go."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = importance.importance_resample(spark.read.parquet(f"{sf}/documents.parquet"), labels.filter("doc_id % 2 = 0"))
    held = got.join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [x["kept"] for x in held if x["quality"] and not x["toxic"]], [x["kept"] for x in held if not x["quality"]]
    print("good kept", sum(good) / len(good), "others kept", sum(bad) / len(bad))
    assert sum(good) / len(good) > 0.93 and sum(bad) / len(bad) < 0.3
