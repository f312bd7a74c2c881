"""Centroid clustering against plain rounds in Python integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from gridsmith.llm import kmeans
from gridsmith.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<float>, cluster int, xs string, block long"


def brute(rows, k=8, rounds=10, dims=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) by full scans."""
    kept = []
    for v, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(np.float32(x)) for x in e):
            xs = [math.floor(1024 * float(np.float32(x))) for x in e]
            if max(map(abs, xs)) <= 1 << 27:
                kept.append((v, xs))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes()))
    centroids = [list(xs) for _, xs in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min(range(len(centroids)), key=lambda i: (far(x, centroids[i]), i))
    for _ in range(rounds):
        own = [nearest(xs) for _, xs in kept]
        for c in range(len(centroids)):
            if mine := [xs for (_, xs), o in zip(kept, own, strict=True) if o == c]:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = [nearest(xs) for _, xs in kept]
    d = [far(xs, centroids[o]) for (_, xs), o in zip(kept, own, strict=True)]
    inertia = Counter()
    for o, x in zip(own, d, strict=True):
        inertia[o] += x
    fits = lambda n: n if n < 1 << 63 else None
    return Counter((v, o, x, fits(inertia[o]), fits(sum(d)), tuple(centroids[o])) for (v, _), o, x in zip(kept, own, d, strict=True))


def drawn(n, seed, spread=0.3, dims=64):
    r = np.random.default_rng(seed)
    means = r.normal(size=(5, dims))
    return [(int(i), (means[i % 5] + spread * r.normal(size=dims)).astype(np.float32).tolist()) for i in r.permutation(n)]


def table(spark, rows):
    return spark.createDataFrame([(v, e, 7, "clash", None) for v, e in rows], ROWS)


def result(df):
    return Counter((*tuple(r)[:5], tuple(r["centroid"])) for r in df.collect())


def test_rounds_with_hard_vectors(spark):
    rows = drawn(600, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(1000 + i, e) for i, e in enumerate([None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [nan] + [0.0] * 63, [inf] + [0.0] * 63, [1e30] + [0.0] * 63, [0.0] * 64, [-0.0] * 64])]
    rows += [(2000 + i, rows[3][1]) for i in range(40)] + [(None, rows[5][1]), (None, rows[6][1]), (4, rows[9][1]), (4, rows[9][1])]
    assert result(kmeans.cluster_vectors(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("n, spread, k, rounds", [(300, 2.0, 8, 10), (200, 0.01, 3, 4), (5, 1.0, 8, 10), (1, 1.0, 8, 10), (50, 1.0, 1, 3), (60, 1.0, 8, 0), (40, 60000.0, 4, 5)])
def test_other_shapes(spark, n, spread, k, rounds):
    rows = drawn(n, n, spread)
    assert result(kmeans.cluster_vectors(table(spark, rows), k, rounds)) == brute(rows, k, rounds)


def test_no_vectors(spark):
    empty = kmeans.cluster_vectors(table(spark, [(1, None), (2, [1.0])]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_ties_and_centroids_without_vectors(spark):
    """Equal vectors: one centroid gets all, the others stay where they were."""
    rows = [(i, [0.5] * 64) for i in range(30)] + [(100 + i, [-0.5 + (i % 2)] * 64) for i in range(20)]
    assert result(kmeans.cluster_vectors(table(spark, rows))) == brute(rows)


def test_bounds_hold_and_spare_scans():
    r = np.random.default_rng(5)
    means = r.integers(-2000, 2000, (6, 64))
    xs = (means[r.integers(0, 6, 3000)] + r.integers(-300, 300, (3000, 64))).astype(np.int64)
    centroids = (means + r.integers(-400, 400, (6, 64))).astype(np.int64)
    own, least, second = kmeans.scanned(xs, centroids)
    upper, lower = np.sqrt(least) * kmeans.UP, np.sqrt(second) * kmeans.DOWN
    scans = []
    for _ in range(12):
        new = np.array([xs[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else centroids[c] for c in range(6)])
        drift, centroids = np.sqrt(((new - centroids) ** 2).sum(1)) * kmeans.UP, new
        scans.append(kmeans.assigned(xs, own, upper, lower, centroids, drift))
        want, least, second = kmeans.scanned(xs, centroids)
        assert (own == want).all() and (upper >= np.sqrt(least)).all() and (lower <= np.sqrt(second)).all()
    assert scans[-1] < len(xs) // 10


def test_rounds_join_without_a_shuffle(spark):
    n = kmeans.partitions(spark)
    blocks = spark.range(64).selectExpr("id as block", "array(id) ids", "cast('x' as binary) xs")
    one = kmeans._Bucketed(blocks.repartition(n, "block"), n)
    two = kmeans._Bucketed(blocks.selectExpr("block", "xs own", "xs upper", "xs lower").repartition(n, "block"), n)
    plan = kmeans._joined(one, two)._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[-1] and "SortMergeJoin" in plan
    one.drop(), two.drop()


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = Counter((*r[:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in brute(rows).elements())
    got = QUERIES["op13_centroid_clustering"](spark, sf)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == want and not [t for t in spark.catalog.listTables() if t.name.startswith("gridsmith_")]
