"""Each stage on all that the one before it kept, against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from gridsmith.llm import importance, mixing
from gridsmith.llm._scratch import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def test_all_but_the_last_return_documents(stages):
    for s in stages[1:-1]:
        assert s.columns == stages[0].columns and s.count() > 0


def test_quality_stage(spark, stages):
    found = importance.importance_resample(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).filter("kept")
    assert {r["doc_id"] for r in stages[1].collect()} == {r["doc_id"] for r in found.collect()}


def test_near_duplicate_stage(stages):
    """One document of each group that pairs of similarity 0.8 join, by sets of five-word shingles: what stages on shingles take."""
    from tests.llm.test_operators import grouped
    from tests.llm.test_shingles import shingle_set, similarity

    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    sets = [shingle_set(t) for _, t in rows]
    root = grouped(len(rows), lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(rows[i][0] for i in set(root))


def test_substring_stage(stages):
    seen, want = set(), {}
    for d, text in sorted((r["doc_id"], r["text"]) for r in stages[2].collect()):
        from tests.llm.test_operators import WORD

        w = WORD.findall(text)
        gone = {j for i in range(len(w) - 19) if tuple(w[i : i + 20]) in seen or seen.add(tuple(w[i : i + 20])) for j in range(i, i + 20)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else text
        if kept or not gone:
            want[d] = kept
    assert {r["doc_id"]: r["text"] for r in stages[3].collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_mixing_stage(stages):
    taken = {r["doc_id"]: r for r in mixing.mix_documents(stages[3]).collect()}
    copies = Counter(r["doc_id"] for r in stages[4].collect())
    for d, r in taken.items():
        assert abs(copies[d] * r["size"] - r["taken"]) <= r["size"] / 2 or not r["size"]


def test_packing_stage_is_the_run(spark, stages):
    packed = stages[5].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in stages[4].collect())
    again = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
