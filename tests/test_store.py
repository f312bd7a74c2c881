"""Commits of two phases, updates of single fields, deletions that cascade, and the workflow on a store."""

import pytest
from pyspark.sql import functions as F

from gridsmith.operators import workflow
from gridsmith.sources.store import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/library")


def rows(d, *columns):
    return sorted(map(tuple, d.select(*columns).collect()), key=str)


def test_a_commit_is_there_whole_or_not_at_all(spark, store, monkeypatch):
    assert store.version() == 0 and store.current("cells") is None
    cells = lambda *x: spark.createDataFrame(list(x), "run_id string, row int, col int, text string")
    assert store.commit({"cells": cells(("a", 0, 0, "old"))}) == 1

    def killed(manifest):
        raise RuntimeError("killed between the phases")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(store, "_publish", killed)
        store.commit({"cells": cells(("a", 0, 0, "half"), ("b", 0, 0, "half"))})
    assert store.version() == 1 and rows(store.current("cells"), "run_id", "text") == [("a", "old")]
    assert len(store.left_behind()) == 1
    assert store.commit({"cells": cells(("a", 0, 0, "new"), ("b", 0, 0, "new"))}) == 2
    assert rows(store.current("cells"), "run_id", "text") == [("a", "new"), ("b", "new")]
    assert rows(store.current("cells", at=1), "run_id", "text") == [("a", "old")]
    with pytest.raises(Conflict):
        store.commit({"cells": cells(("a", 0, 0, "late"))}, base=1)
    assert rows(store.current("cells"), "run_id", "text") == [("a", "new"), ("b", "new")] and store.version() == 2


def test_fields_keys_and_compaction(spark, store):
    make = spark.createDataFrame
    store.commit({"cells": make([("a", r, 0, f"x{r}", None, "unreviewed") for r in range(4)], "run_id string, row int, col int, extracted_text string, corrected_text string, review string")})
    store.commit({"cells": make([("a", 1, 0, "fixed")], "run_id string, row int, col int, corrected_text string")})
    store.commit({"cells": make([("a", 1, 0, "reviewed"), ("a", 9, 0, "reviewed")], "run_id string, row int, col int, review string")}, deleted={"cells": make([("a", 2, 0), ("a", 9, 0)], "run_id string, row int, col int")})
    want = [(0, "x0", None, "unreviewed"), (1, "x1", "fixed", "reviewed"), (3, "x3", None, "unreviewed"), (9, None, None, "reviewed")]
    fields = ("row", "extracted_text", "corrected_text", "review")
    assert rows(store.current("cells"), *fields) == want
    store.commit({"cells": make([("a", 1, 0, None)], "run_id string, row int, col int, corrected_text string"), "runs": make([("a", 5)], "run_id string, table_id long")})
    want[1] = (1, "x1", None, "reviewed")
    assert rows(store.current("cells"), *fields) == want
    store.compact("cells")
    assert rows(store.current("cells"), *fields) == want and store.history("cells").count() == 4
    store.commit(deleted={"cells": make([("a", 3, 0)], "run_id string, row int, col int")})
    store.commit({"cells": make([("a", 3, 0, "again")], "run_id string, row int, col int, review string")})
    assert rows(store.current("cells"), *fields)[2] == (3, None, None, "again")  # nothing comes back with a key
    first = make([("k", 1, "first")], "correction_id string, table_id long, after string")
    store.commit({"corrections": first})
    store.commit({"corrections": first.withColumn("after", F.lit("second"))})
    assert store.current("corrections").first()["after"] == "first"


def test_deletion_of_a_document_takes_all_that_hangs_on_it(spark, store):
    make = spark.createDataFrame
    store.commit({
        "documents": make([("d",), ("e",)], "document_id string"), "tables": make([(1, "d"), (2, "d"), (3, "e")], "table_id long, document_id string"), "runs": make([(f"r{t}{i}", t) for t in (1, 2, 3) for i in (0, 1)], "run_id string, table_id long"),
        "cells": make([(f"r{t}{i}", r, 0, "x") for t in (1, 2, 3) for i in (0, 1) for r in range(3)], "run_id string, row int, col int, text string"),
        "columns": make([(1, 0, "n"), (3, 0, "n")], "table_id long, col int, name string"), "corrections": make([("a", 1), ("b", 3)], "correction_id string, table_id long"),
    })
    store.delete("documents", make([("d",), ("none",)], "document_id string"))
    assert rows(store.current("documents"), "document_id") == [("e",)] and rows(store.current("tables"), "table_id") == [(3,)]
    assert {r[0] for r in rows(store.current("runs"), "run_id")} == {"r30", "r31"} == {r[0] for r in rows(store.current("cells"), "run_id")}
    assert rows(store.current("columns"), "table_id") == [(3,)] and rows(store.current("corrections"), "correction_id") == [("b",)]
    assert store.current("cells", at=1).count() == 18


def test_the_life_of_a_table_in_the_store(spark, store):
    texts = {1: [["Code", "Qty"], ["001", "1.204"], ["002", "7.000"]], 2: [["A"], ["1"]]}
    make = spark.createDataFrame

    def extraction(run, change=lambda x: x, failed=None):
        cells = [(t, r, c, 1, 1, change(x), 10 * r + c) for t, table in texts.items() for r, row in enumerate(table) for c, x in enumerate(row)]
        extracted = make(cells, "table_id long, row int, col int, row_span int, col_span int, text string, arrival int")
        sizes = make([(1, 3, 2, 1, []), (2, 2, 1, 1, [])], "table_id long, n_rows int, n_cols int, header_rows int, repeated array<int>")
        tables = make([(t, "auto", f"{run}{t}") for t in texts], "table_id long, number_format string, run_id string")
        return workflow.commit_extraction(store, extracted, sizes, tables, failed)

    extraction("a")
    now = lambda: {(r.table_id, r.row, r.col): r for r in workflow.current_cells(store).collect()}
    assert now()[1, 1, 1].run_id == "a1" and len(now()) == 8
    v = workflow.edit_texts(store, make([("a1:1:1", "1205"), ("a1:2:1", "7001"), ("a1:0:0", "Code"), ("gone", "x")], "cell_id string, text string"))
    workflow.mark_reviews(store, make([("a1:1:1", "reviewed"), ("a2:1:0", "reviewed")], "cell_id string, review string"))
    assert (now()[1, 1, 1].corrected_text, now()[1, 1, 1].review, now()[1, 2, 1].corrected_text, now()[1, 0, 0].corrected_text) == ("1205", "reviewed", "7001", None)
    assert rows(store.current("corrections").filter(F.col("in_version") == v), "row", "before", "after") == [(1, "1.204", "1205"), (2, "7.000", "7001")]
    # the second table's extraction fails, the first one's reads one cell otherwise
    extraction("b", lambda x: "7,5" if x == "7.000" else x, make([(2, "b2", "no table", False)], "table_id long, run_id string, error string, cancelled boolean"))
    got = now()
    assert got[1, 1, 1].run_id == "b1" and got[2, 1, 0].run_id == "a2" and got[2, 1, 0].review == "reviewed"
    assert (got[1, 1, 1].corrected_text, got[1, 1, 1].flags, got[1, 2, 1].corrected_text, got[1, 2, 1].flags) == ("1205", ["carriedOver"], "7001", ["reextractionConflict"])
    assert rows(store.current("runs"), "run_id", "status", "error") == [("a1", "completed", None), ("a2", "completed", None), ("b1", "completed", None), ("b2", "failed", "no table")]
    # runs that are not completed never become current
    workflow.choose_run(store, make([(1, "a1"), (2, "b2")], "table_id long, run_id string"))
    assert now()[1, 1, 1].run_id == "a1" and now()[2, 1, 0].run_id == "a2"
    # bulk edits and their undo
    cells = workflow._with_ids(workflow.current_cells(store))
    every = cells.filter("row > 0").select("cell_id")
    v = workflow.edit_texts(store, workflow.cleared(cells, every))
    assert {r.corrected_text for k, r in now().items() if k[1]} == {""}
    workflow.take_back(store, v)
    assert (now()[1, 1, 1].corrected_text, now()[1, 1, 0].corrected_text, now()[2, 1, 0].corrected_text) == ("1205", None, None)
    workflow.edit_texts(store, workflow.restored(workflow._with_ids(workflow.current_cells(store)), every))
    assert {r.corrected_text for r in now().values()} == {None}
    assert {r.kind for r in store.current("corrections").collect()} == {"edit", "review", "carriedOver", "conflict", "undo"}


def test_an_edit_takes_its_edits_once_and_reads_the_cells_that_they_name(spark, store, monkeypatch):
    make = spark.createDataFrame
    store.commit({
        "tables": make([(1, "a1"), (2, "a2"), (3, None)], "table_id long, current_run_id string"),
        "cells": make([(run, r, 0, f"{run}{r}", None, "unreviewed") for run in ("a1", "a2", "old") for r in range(4)], "run_id string, row int, col int, extracted_text string, corrected_text string, review string"),
    })
    taken, read = spark.sparkContext.accumulator(0), []

    @F.udf("string")
    def counted(x):
        taken.add(1)
        return x

    put_together = workflow.current_cells
    monkeypatch.setattr(workflow, "current_cells", lambda *a: read.append(put_together(*a)) or read[-1])
    ids = ["a1:1:0", "a2:3:0", "a2:3:0", "old:1:0", "a1:01:0", "none", "a1:9:0"]
    workflow.mark_reviews(store, make([(x, "reviewed") for x in ids], "cell_id string, review string").select(counted(F.col("cell_id")).alias("cell_id"), "review"))
    assert taken.value == len(ids)
    assert rows(put_together(store).filter("review = 'reviewed'"), "run_id", "row", "extracted_text") == [("a1", 1, "a11"), ("a2", 3, "a23")]
    assert rows(store.current("corrections"), "table_id", "row", "before", "after") == [(1, 1, "unreviewed", "reviewed"), (2, 3, "unreviewed", "reviewed")]
    assert len(read) == 1 and rows(read[0], "run_id", "row") == [("a1", 1), ("a2", 3)]


def test_cells_that_were_read_are_not_read_again_and_another_commit_is_a_conflict(spark, store, monkeypatch):
    make = spark.createDataFrame
    some = make([("a1", r, 0, "x", None, "unreviewed") for r in range(3)], "run_id string, row int, col int, extracted_text string, corrected_text string, review string")
    store.commit({"tables": make([(1, "a1")], "table_id long, current_run_id string"), "cells": some})
    base = store.version()
    cells = workflow._with_ids(workflow.current_cells(store, base)).filter("row > 0")
    marks = cells.select("cell_id", F.lit("reviewed").alias("review"))
    with monkeypatch.context() as m:
        m.setattr(workflow, "current_cells", None)
        assert workflow.mark_reviews(store, marks, cells, base) == 2
    assert rows(workflow.current_cells(store), "row", "review") == [(0, "unreviewed"), (1, "reviewed"), (2, "reviewed")]
    with pytest.raises(Conflict):
        workflow.mark_reviews(store, marks, cells, base)
    with pytest.raises(ValueError):
        workflow.mark_reviews(store, marks, cells)


def test_rows_of_some_keys_are_merged_deleted_and_compacted_like_all(spark, store):
    make = spark.createDataFrame
    keys = "run_id string, row int, col int"
    store.commit({"cells": make([(run, r, 0, f"{run}{r}") for run in "abc" for r in range(3)], f"{keys}, text string")})
    assert "Aggregate" not in store.current("cells")._jdf.queryExecution().toString()  # one commit has a key once
    store.commit({"cells": make([("a", 1, 0, 7), ("b", 1, 0, 8), ("d", 0, 0, 9)], f"{keys}, mark int")})
    store.commit({"cells": make([("b", 2, 0, "new")], f"{keys}, text string")}, deleted={"cells": make([("a", 1, 0), ("b", 2, 0), ("c", 0, 0)], keys)})
    of = make([("a", 1), ("b", 2), ("b", 3), ("none", 4), ("d", 5)], "run_id string, place int")
    want = store.current("cells").join(of, "run_id")
    fields = ("run_id", "row", "text", "mark", "place")
    got = rows(store.current("cells", of=of), *fields)
    assert got == rows(want, *fields) and ("b", 2, "new", None, 3) in got and len(got) == 9
    assert [r[1] for r in got if r[0] == "a"] == [0, 2]
    assert rows(store.current("cells", of=of, at=1), "run_id", "row", "place") == sorted([("a", r, 1) for r in range(3)] + [("b", r, p) for r in range(3) for p in (2, 3)], key=str)
    assert {(r["__version"], None if r["__set"] is None else tuple(r["__set"])) for r in store.history("cells").collect()} == {(1, ("text",)), (2, ("mark",)), (3, ("text",)), (3, None)}
    store.compact("cells")
    assert rows(store.current("cells", of=of), *fields) == got
