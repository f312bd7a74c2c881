"""Cutoffs where they fire: the exact tail at any size, and the query's SQL on a labelled table of three strata."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gridsmith.llm import quality_rules
from gridsmith.llm.queries import ORACLES


def exact_tail(k, n, p):
    term = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    return math.fsum(math.exp(term(j)) for j in range(k + 1))


def test_binomial_tail_at_any_size(spark):
    cases = [(1, 200), (15, 2500), (16, 2500), (17, 3000), (240, 25_000), (2300, 240_000), (19_999, 2_040_000), (20_001, 2_040_000), (24_800, 2_500_000), (24_000, 2_500_000), (990_000, 100_000_000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for k, n, p in got:
        assert p == pytest.approx(exact_tail(k, n, 0.01), rel=1e-6 if n > 10_000_000 else 1e-7), (k, n)


def test_no_step_in_the_tail(spark):
    """The tail grows with k without a jump at any size."""
    ks = list(range(19_950, 20_050))
    got = spark.createDataFrame([(k, 2_040_000) for k in ks], "k long, n long").select("k", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    p = [x["p"] for x in sorted(got)]
    assert all(a < b < 1.1 * a for a, b in zip(p, p[1:], strict=False))


@pytest.fixture(scope="module")
def tables(spark):
    """Good documents of which one in 500 (en, null) or 30 (fr) is full of symbols; few of them in it; bad ones as well."""
    r = random.Random(8)
    rows, labels = [], []
    for i in range(6300):
        lang = ["en", None, "fr"][i % 3] if i < 6000 else "it"
        odd = i // 3 % (30 if lang == "fr" else 500) == 0 or i % 97 == 1
        words = [f"w{r.randint(0, 10**6)}" for _ in range(20)] + [f"#$%&|<>{r.randint(0, 10**6)}" for _ in range(r.randint(25, 60) if odd else 0)]
        words += ["!"] * (r.randint(1, 30) if i % 97 == 2 else 0)
        r.shuffle(words)
        rows.append((i, " ".join(words), lang))
        labels.append((i, 0 if i % 97 in (1, 2) else 1, 0))
    rows += [(6300, None, "en"), (6301, "", None), (None, "a b", "fr"), (5, "short", "en")]
    labels += [(None, 1, 0), (7, None, None), (8, 0, 1), (9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_fire_in_two_strata_and_fail_in_another(tables):
    docs, labels = tables
    chosen = quality_rules.cutoffs(quality_rules.features(docs), labels).collect()  # not written by the caller
    symbols = {x["stratum"]: x for x in chosen if x["rule"] == "symbols"}
    assert {"en", None} <= set(symbols) and "fr" not in symbols and "it" not in {x["stratum"] for x in chosen}
    for x in chosen:
        assert exact_tail(x["rejected"], x["good"], 0.05 / 6) <= 0.05 / 24


def test_sql_gives_the_same_rows(tables):
    docs, labels = tables
    got = quality_rules.judge_documents(docs, labels)
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    c.register("labels", labels.toArrow())
    want = c.execute(ORACLES["op1_quality_rules"])
    columns = [d[0] for d in want.description]
    rows = Counter(map(tuple, got.select(*columns).collect()))
    assert rows == Counter(map(tuple, want.fetchall()))
    assert sum(n for x, n in rows.items() if x[columns.index("broken")]) > 50
