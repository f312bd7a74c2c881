"""Queries of this package against their SQL."""

from collections import Counter

import duckdb
import pytest

from gridsmith.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(map(tuple, want.fetchall()))
