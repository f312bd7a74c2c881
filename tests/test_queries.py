"""Queries against their SQL on the smallest tables; the slow ones are held against it by the driver."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from gridsmith.plans.catalogue import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"rule_summaries", "unresolved_issues", "type_conversion_failures", "low_score_cells", "csv_export", "layout_grid", "next_issue", "row_alignment", "missing_markers"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES and n not in SLOW])
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = Counter(tuple(map(plain, r)) for r in got.select(*columns).collect())
    assert rows == Counter(tuple(map(plain, r)) for r in want.fetchall())


def test_entry_points():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert FLAGSHIP in queries and set(oracles) <= set(queries)
