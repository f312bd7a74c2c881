"""The number of sequences against its lower bound, whatever the cluster's settings."""

import random

import pytest

from gridsmith.llm import packing


@pytest.mark.parametrize("shuffle, group_tokens", [("200", 1 << 20), ("4", 1 << 20), ("4", 4096)])
def test_few_sequences_at_any_setting(spark, shuffle, group_tokens):
    r = random.Random(4)
    texts = [(i, " ".join(r.choice(["one", "two", "three"]) for _ in range(min(3000, int(r.lognormvariate(5.5, 0.9)))))) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        got = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), group_tokens=group_tokens).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(x["doc_id"] for x in got if not x["piece"]) == list(range(300))
    ends = {}
    for x in sorted(got, key=lambda x: x["offset"]):
        assert ends.get(x["sequence_id"], 0) == x["offset"]
        ends[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(ends.values()) <= 4096
    bound = -(-sum(x["length"] for x in got) // 4096)
    print("sequences", len(ends), "bound", bound)
    assert len(ends) <= bound + 1
