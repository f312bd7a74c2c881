"""Near-duplicates by shingles against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from gridsmith.llm import shingles
from tests.llm.test_operators import WORD, grouped

DOCS = "doc_id long, text string, source string"


def shingle_set(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near_copies(n):
    """Pairs of texts whose similarity is from 0.8 to 0.95, a word changed here and there."""
    r, out = random.Random(11), []
    while len(out) < n:
        one = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(100, 300))]
        two = list(one)
        for i in r.sample(range(len(two)), r.randint(1, max(1, len(two) // 45))):
            two[i] = "other"
        a, b = " ".join(one), " ".join(two)
        if 0.8 <= similarity(shingle_set(a), shingle_set(b)) < 0.95:
            out.append((a, b))
    return out


def test_recall_from_080_to_095(spark):
    pairs = near_copies(200)
    rows = [(2 * i + j, t, "s") for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = {r["doc_id"] for r in shingles.one_of_each(spark.createDataFrame(rows, DOCS)).collect()}
    assert {2 * i for i in range(len(pairs))} <= got
    recall = 1 - len([x for x in got if x % 2]) / len(pairs)
    print("recall", recall)
    assert recall >= 0.99


@pytest.mark.parametrize("limit", [500_000, 150])  # in one group, and in chunks
def test_groups_are_those_of_brute_force(spark, limit):
    r = random.Random(2)
    base = [f"w{r.randint(0, 900)}" for _ in range(120)]
    texts = [None, "", " \n", "A b", "a B", "a c", " ".join(base)]
    for _ in range(40):
        base = list(base)
        base[r.randrange(len(base))] = f"x{r.randint(0, 99)}"
        texts.append(" ".join(base[: r.randint(90, 120)]))
    sets = [shingle_set(t) for t in texts]
    root = grouped(len(texts), lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    got = shingles.one_of_each(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS), limit=limit)
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(root))


def test_chains_of_false_candidates_send_no_set_often(spark):
    """100,000 nodes of 500 shingles that share cells with the next ones only, none verified, in chunks of 100 nodes."""
    n, of_each = 100_000, 20
    cells = F.transform(F.sequence(F.lit(0), F.lit(of_each - 1)), lambda c: F.xxhash64(c, ((F.col("id") + c) / of_each).cast("long")))
    nodes = spark.range(n).select(F.col("id").alias("key"), F.lit(500).cast("long").alias("size"), F.xxhash64("id").alias("fp"), cells.alias("cells"), F.col("id").alias("label"))
    each = nodes.select("key", "size", F.explode("cells").alias("cell"))
    pairs = each.join(each.groupBy("cell").agg(F.min("key").alias("b")), "cell").filter("key != b").select("key", "size", "b").distinct()
    for dealt in shingles.with_smallest(pairs, 50_000), shingles.by_cell(nodes, 50_000):
        sent = dealt.groupBy("key").count().agg(F.max("count"), F.count("*")).first()
        assert sent[0] <= of_each and sent[1] == n


def test_a_cell_meets_whole_but_for_its_largest_label(spark):
    """Each two nodes of a cell with different labels share a unit; one label alone has none; sides are cut into chunks."""
    rows = [(i, 10, 1000 + i, [1], 0 if i < 30 else i) for i in range(50)] + [(100 + i, 10, 1100 + i, [2], 7) for i in range(5)]
    nodes = spark.createDataFrame(rows, "key long, size long, fp long, cells array<long>, label long")
    units = {}
    for r in shingles.by_cell(nodes, 60).collect():
        units.setdefault(r["of"], set()).add(r["key"])
    met = {(a, b) for keys in units.values() for a in keys for b in keys if a < b}
    assert {(a, b) for a in range(50) for b in range(a + 1, 50) if b >= 30} <= met
    assert all(k < 50 for keys in units.values() for k in keys) and len(units) > 4


@pytest.mark.parametrize("limit", [40, 2_000])
def test_large_groups_are_those_of_brute_force(spark, limit):
    """Families that share a passage, so that false candidates join them, and near copies in each."""
    r = random.Random(5)
    common = [f"c{r.randint(0, 900)}" for _ in range(60)]
    texts = []
    for f in range(12):
        own = [f"f{f}-{r.randint(0, 900)}" for _ in range(40)]
        for _ in range(8):
            copy = common + own
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 99)}"
            texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    root = grouped(len(texts), lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    got = shingles.one_of_each(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS), limit=limit)
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(root))
