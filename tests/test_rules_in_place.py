"""Rules on cells that are written by table: no cell moves again, so disk holds them once."""

import pytest
from pyspark.sql import functions as F

from gridsmith.operators import rules
from gridsmith.plans import reviewing

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved(df):
    """What each shuffle of a plan goes by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("name", ["json_provenance", "rule_summaries", "unresolved_issues"])
def test_no_rule_moves_cells(no_broadcast, name):
    found = moved(reviewing.QUERIES[name](no_broadcast, SF))
    assert not [x for x in found if "cell_id" in x or "__key" in x or "col#" in x or "row#" in x]


def test_results_in_parts_are_results_together(spark):
    cells, parts, summed = reviewing._evaluated(spark, SF)
    together, union_summed, _ = rules.evaluate_written(cells, reviewing.order_rows(spark, SF), reviewing.order_columns(spark, SF))
    by_rule = lambda d: {tuple(r) for r in d.groupBy("rule").agg(F.count("*"), F.count_distinct(rules.result_id())).collect()}
    assert by_rule(rules.unresolved(parts, cells)) == by_rule(rules.unresolved(together, cells))
    of = lambda d: {tuple(r) for r in d.groupBy("rule", "status").agg(F.sum("tested"), F.sum("failed")).collect()}
    assert of(summed) == of(union_summed)


def test_a_result_without_cells_stays_open(spark):
    schema = "table_id int, rule string, status string, severity string, row int, col int, cell_ids array<string>, message string, tolerance string, version int"
    row = lambda row, ids: (1, "convert", "failed", "error", row, 0, ids, f"m{row}", None, 1)
    results = spark.createDataFrame([row(0, []), row(1, ["a", "b"]), row(2, ["b"]), row(3, ["gone"]), row(4, [None]), row(5, None)], schema)
    cells = spark.createDataFrame([(1, "a", "unreviewed"), (1, "b", "reviewed"), (1, "b", "reviewed"), (2, "gone", "reviewed")], "table_id int, cell_id string, review string")
    assert sorted(r["row"] for r in rules.unresolved(results, cells).collect()) == [0, 1, 3, 4, 5]


def test_row_shapes_meet_by_row(no_broadcast):
    """A position is no row: columns and what cells cover are arrays, also of spans, of rows without cells and of rows named twice."""
    spark = no_broadcast
    cells = [(1, 0, 0, 2, 2), (1, 0, 2, 1, 1), (1, 1, 2, 1, 1), (1, 2, 1, 1, 1), (1, 4, 0, 0, 3), (2, 0, 0, 1, 1)]
    cells = spark.createDataFrame([(*c, f"c{i}", "data", []) for i, c in enumerate(cells)], "table_id int, row int, col int, row_span int, col_span int, cell_id string, role string, flags array<string>")
    rows = spark.createDataFrame([(1, r, "data") for r in (0, 1, 2, 2, 3, 4)] + [(2, 0, "data"), (2, 1, "total")], "table_id int, row int, role string")
    columns = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "table_id int, col int")
    results, tested = rules.check_row_shape(cells, rows, columns)
    assert not [x for x in moved(results) if "col#" in x]
    gaps = sorted((r["table_id"], r["row"], r["col"]) for r in results.collect() if not r["cell_ids"])
    assert gaps == [(1, 2, 0), (1, 3, 0)] and {r["table_id"]: r["tested"] for r in tested.collect()} == {1: 6, 2: 1}


def test_row_alignment_moves_no_cell(no_broadcast):
    from gridsmith.operators import evaluate

    cells = no_broadcast.createDataFrame([("d", r, c, f"{r}{c}") for r in range(4) for c in range(2)], "doc string, row int, col int, text string")
    pairs = evaluate.align_rows(cells, cells.filter("row != 1"))
    assert not moved(pairs)
    assert sorted(map(tuple, pairs.select("truth_row", "got_row").collect())) == [(0, 0), (2, 2), (3, 3)]


def test_next_issue_writes_and_tells_only_what_it_reads(spark):
    """Of norm the fields that rules read, and of rules the one it asks for: no other message is made."""
    cells = reviewing._checked_once(spark, SF)
    assert {f.name for f in cells.schema["norm"].dataType} == {"kind", "canonical", "fraction_digits", "had_leading_zeros"}
    plan = reviewing.next_issue(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "leading_zeros" not in plan.replace("had_leading_zeros", "") and "low_score" not in plan
    some, every = rules.check_cells(cells, only=("convert",)), rules.check_cells(cells)
    for a, b in zip(some, every, strict=True):
        b = b.filter("rule = 'convert'")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
