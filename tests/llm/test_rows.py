"""Stages on rows that share a doc_id or have none."""

import pytest

from gridsmith.llm import sharding, shingles, simhash, substring

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("each", [simhash.one_of_each, shingles.one_of_each])
def test_one_row_of_each_component_stays(spark, each):
    one, two, three, four = (" ".join(f"{x}{i}" for i in range(60)) for x in "pqrs")
    rows = [(None, one, "a"), (None, two, "b"), (5, three, "c"), (5, four, "d"), (None, three, "e"), (7, four, "f"), (7, one, "g")]
    got = each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["source"] for r in got) == ["b", "c", "d", "g"]


def test_rows_of_one_doc_id_keep_their_own_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, passage, "a"), (None, "some other text", "b"), (5, passage, "c"), (5, "is left alone", "d"), (6, f"x {passage} y", "e"), (6, f"z {passage}", "f"), (6, f"z {passage}", "g"), (7, None, "h")]
    got = substring.without_repeats(spark.createDataFrame(rows, DOCS))
    assert sorted((r["source"], r["text"]) for r in got.collect() if r["text"]) == [("a", passage), ("b", "some other text"), ("d", "is left alone"), ("e", "x y"), ("f", "z"), ("g", "z")]


def test_shards_keep_the_columns_of_documents(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "mine"), (None, None, "x"), (1, "b", None)], "doc_id long, text string, shard string")
    with pytest.raises(ValueError):
        sharding.write_shards(d, f"file://{tmp_path}/no")
    sharding.write_shards(d, f"file://{tmp_path}/s", name="part")
    got = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted((r.text or "", r.shard or "") for r in got.collect()) == [("", "x"), ("a", "mine"), ("b", "")] and len({r.part for r in got.filter("doc_id = 1").collect()}) == 1
