"""Versions, roles, settings and recipes over several tables at once."""

from datetime import datetime

from pyspark.sql import functions as F

from gridsmith.operators import recipes, versions, workflow

BOX = "struct<x:double,y:double,width:double,height:double>"


def test_created_tables(spark):
    new = spark.createDataFrame([(7, "d", None, "auto", "auto"), (8, "d", None, "auto", "auto"), (9, "e", "own", "auto", "auto")], "table_id int, document_id string, name string, number_format string, date_order string")
    old = spark.createDataFrame([(1, "d")], "table_id int, document_id string")
    recipe = spark.createDataFrame([(8, "r", 3, "commaDecimal", "dmy")], "table_id int, recipe_id string, version int, number_format string, date_order string")
    got = {r["table_id"]: r for r in workflow.created_tables(new, old, recipe).collect()}
    assert [got[i]["name"] for i in (7, 8, 9)] == ["Table 2", "Table 3", "own"]
    assert (got[8]["number_format"], got[8]["recipe_id"], got[8]["recipe_version"]) == ("commaDecimal", "r", 3) and got[7]["recipe_id"] is None


def test_a_commit_keeps_what_users_did(spark):
    texts = {1: [["Code", "Qty (pcs)", ""], ["001", "1.204", "x"], ["002", "7.000", ""], ["Total", "8.204", ""]], 2: [["A"], ["1"]]}
    cells = [(t, r, c, 1, 1, x, 10 * r + c) for t, rows in texts.items() for r, row in enumerate(rows) for c, x in enumerate(row) if x]
    extracted = spark.createDataFrame(cells, "table_id int, row int, col int, row_span int, col_span int, text string, arrival int")
    sizes = spark.createDataFrame([(1, 4, 3, 1, []), (2, 2, 1, 1, [])], "table_id int, n_rows int, n_cols int, header_rows int, repeated array<int>")
    tables = spark.createDataFrame([(1, "auto", "r1"), (2, "auto", "r2")], "table_id int, number_format string, run_id string")
    old = spark.createDataFrame([(1, 1, 1, "1,204", "1205", "reviewed"), (1, 2, 1, "9", "10", "reviewed"), (1, 1, 0, "001", None, "reviewed"), (1, 9, 9, "gone", "kept", "unreviewed")], "table_id int, row int, col int, extracted_text string, corrected_text string, review string")
    old_rows = spark.createDataFrame([(1, 0, "header"), (1, 1, "excluded"), (1, 2, "data"), (1, 3, "total"), (2, 0, "data")], "table_id int, row int, role string")
    old_columns = spark.createDataFrame([], "table_id int, col int, name string, type string, source_header string, type_confirmed boolean")
    recipe = spark.createDataFrame([(1, 0, "Quantity", ["qty pcs"], "currency", "pcs", "1000", "commaDecimal"), (1, 1, "Other", ["zzz"], "text", "", "1", "auto"), (1, 2, "Remark", ["note"], "text", "", "1", "auto")], "table_id int, target int, name string, names array<string>, type string, unit string, scale string, number_format string")
    out = workflow.committed(extracted, sizes, tables, old, old_rows, old_columns, recipe)
    got = {(r["table_id"], r["row"], r["col"]): r for r in out["cells"].collect()}
    assert len(got) == 14 and got[1, 3, 2]["extracted_text"] == ""
    assert (got[1, 1, 1]["corrected_text"], got[1, 1, 1]["review"], got[1, 1, 1]["flags"]) == ("1205", "reviewed", ["carriedOver"])
    assert (got[1, 2, 1]["corrected_text"], got[1, 2, 1]["review"], got[1, 2, 1]["flags"]) == ("10", "needsReview", ["reextractionConflict"])
    assert got[1, 1, 0]["review"] == "reviewed" and got[2, 1, 0]["action"] == "new"
    assert sorted((r["kind"], r["before"], r["after"]) for r in out["log"].collect()) == [("carriedOver", "1.204", "1205"), ("conflict", "9", "7.000")]
    assert {(r["table_id"], r["row"]): r["role"] for r in out["rows"].collect()} == {(1, 0): "header", (1, 1): "excluded", (1, 2): "data", (1, 3): "total", (2, 0): "header", (2, 1): "data"}
    columns = {(r["table_id"], r["col"]): r for r in out["columns"].collect()}
    assert [columns[1, c]["name"] for c in range(3)] == ["Code", "Quantity", "Remark"]  # the last by its place, as it has no header
    assert (columns[1, 1]["type"], columns[1, 1]["scale"], columns[1, 1]["number_format"], columns[1, 1]["type_confirmed"]) == ("currency", "1000", "commaDecimal", True)
    assert columns[1, 0]["type"] == "identifier" and not columns[1, 0]["type_confirmed"]
    assert {r["table_id"]: tuple(r)[1:] for r in out["summary"].collect()}[1] == (1, 1, 1, 1) and out["runs"].count() == 2


def test_runs(spark):
    runs = spark.createDataFrame([(1, "a", datetime(2024, 1, 1), "completed"), (1, "b", datetime(2024, 2, 1), "failed"), (2, "c", datetime(2024, 1, 1), "failed"), (2, "d", datetime(2024, 3, 1), "failed")], "table_id int, run_id string, started_at timestamp, status string")
    assert {r["table_id"]: r["run_id"] for r in versions.shown_runs(runs).collect()} == {1: "a", 2: "d"}
    columns = spark.createDataFrame([(1, 0, "n", "text", "h", True)], "table_id int, col int, name string, type string, source_header string, type_confirmed boolean")
    now = spark.createDataFrame([(1, "completed", 2), (2, "failed", 5)], "table_id int, status string, n_cols int")
    assert sorted((r["table_id"], r["name"]) for r in workflow.set_current(columns, now).collect()) == [(1, "Column A"), (1, "Column B")]
    cache = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, payload string, stored_at int")
    hits, misses = versions.cached(spark.createDataFrame([("k", 1), ("l", 2)], "key string, n int"), cache)
    assert hits.first()["payload"] == "new" and misses.first()["key"] == "l"


def test_roles_names_and_settings(spark):
    rows = spark.createDataFrame([(1, 0, "header"), (1, 1, "data"), (1, 2, "data"), (2, 0, "header"), (2, 1, "data")], "table_id int, row int, role string")
    after, log = workflow.set_roles(rows, spark.createDataFrame([(1, 1, "header"), (1, 2, "data"), (1, 9, "total")], "table_id int, row int, role string"))
    assert {(r["table_id"], r["row"]): r["role"] for r in after.collect()}[1, 1] == "header" and [(r["row"], r["before"], r["after"]) for r in log.collect()] == [(1, "data", "header")]
    columns = spark.createDataFrame([(1, 0, "old", "decimal", "old", False), (1, 1, "mine", "decimal", "old", True), (1, 2, "Column C", "text", "", False), (2, 0, "n", "decimal", "n", False)], "table_id int, col int, name string, type string, source_header string, type_confirmed boolean")
    headers = spark.createDataFrame([(1, 0, "new"), (1, 1, "new"), (1, 2, "third")], "table_id int, col int, header string")
    assert [r["name"] for r in workflow.refreshed_names(columns, headers).filter("table_id = 1").orderBy("col").collect()] == ["new", "mine", "third"]
    cells = spark.createDataFrame([(1, 1, 0, "1,204"), (1, 2, 0, "877"), (1, 1, 1, "1,204"), (1, 1, 2, "x"), (2, 1, 0, "1,204")], "table_id int, row int, col int, text string")
    settings = spark.createDataFrame([(1, "auto", "auto"), (2, "auto", "auto")], "table_id int, number_format string, date_order string")
    change = spark.createDataFrame([(1, "pointDecimal", "dmy"), (2, "auto", "auto")], "table_id int, number_format string, date_order string")
    now, retyped, log = workflow.updated_settings(settings, change, columns, cells, rows)
    assert {(r["table_id"], r["col"]): r["type"] for r in retyped.collect()} == {(1, 0): "integer", (1, 1): "decimal", (1, 2): "text", (2, 0): "decimal"}
    assert [r["table_id"] for r in log.collect()] == [1] and {r["table_id"]: r["number_format"] for r in now.collect()} == {1: "pointDecimal", 2: "auto"}


def test_a_recipe_finds_its_table(spark):
    def page(document, number, top, rows, head="Ship Date"):
        return [(document, number, t, x, x + 5.0 * len(t), top - 20.0 * r, top - 20.0 * r + 8) for r in range(rows + 1) for t, x in (((head.split()[0], 100.0), (head.split()[1], 130.0), ("Qty", 200.0)) if r == 0 else ((f"d{r}", 100.0), (str(r), 200.0)))]

    words = spark.createDataFrame(page("a", 0, 700.0, 2, "ship dates") + page("a", 2, 500.0, 6) + page("b", 0, 300.0, 3, "Other head") + [("a", 2, "note", 100.0, 120.0, 300.0, 308.0)], "document_id string, page int, text string, x0 double, x1 double, y0 double, y1 double")
    pages = spark.createDataFrame([(d, p, 400.0, 800.0) for d in "ab" for p in range(3 if d == "a" else 1)], "document_id string, page int, width double, height double")
    schema = f"id int, document_id string, anchor_text string, offset {BOX}, hint {BOX}, page_hint int"
    wanted = spark.createDataFrame([(1, "a", "SHIP DATE", (-10.0, -42.0, 200.0, 60.0), (0.0, 0.0, 1.0, 1.0), 3), (2, "b", "ship date", (0.0, 0.0, 1.0, 1.0), (0.1, 0.325, 0.7, 0.065), 9)], schema)
    got = {r["id"]: r for r in recipes.located_tables(wanted, words, pages).collect()}
    assert (got[1]["page"], got[1]["method"]) == (2, "anchor") and tuple(got[1]["region"]) == (90.0, 379.0, 200.0, 139.0)
    assert (got[2]["page"], got[2]["method"]) == (0, "saved position") and tuple(got[2]["region"])[:2] == (40.0, 239.0)
    boxes = spark.createDataFrame([(5, "a", 2, (80.0, 450.0, 300.0, 70.0))], f"candidate_id int, document_id string, page int, box {BOX}")
    fitted = recipes.located_tables(wanted.filter("id = 1"), words, pages, boxes).first()
    assert fitted["method"] == "anchor, fitted to a candidate" and tuple(fitted["region"]) == (80.0, 379.0, 300.0, 141.0)


def test_built_recipes(spark):
    columns = spark.createDataFrame([(1, 0, "Name", "Nome", "text", "", "1", "auto"), (1, 1, "Q", "", "integer", "", "1", "auto")], "table_id int, col int, name string, source_header string, type string, unit string, scale string, number_format string")
    anchors = spark.createDataFrame([(1, "Nome", (20.0, 90.0, 30.0, 8.0))], f"table_id int, anchor_text string, anchor_box {BOX}")
    segments = spark.createDataFrame([(1, 3, (10.0, 50.0, 80.0, 50.0), 100.0, 200.0)], f"table_id int, page int, region {BOX}, width double, height double")
    cols, recipe = workflow.recipes.built_recipes(columns, anchors, segments)
    assert [r["names"] for r in cols.orderBy("target").collect()] == [["Name", "Nome"], ["Q"]]
    r = recipe.first()
    assert (r["page_hint"], tuple(r["offset"]), tuple(r["hint"])) == (3, (-10.0, -40.0, 80.0, 50.0), (0.1, 0.25, 0.8, 0.25))


def test_a_queue_keeps_failures_apart(spark):
    jobs = spark.createDataFrame([(i, f"d{i}") for i in range(4)], "job_id int, document_id string")
    cells = spark.createDataFrame([(0, "x", None), (1, None, "unreadable"), (3, "y", None)], "job_id int, text string, error string")
    status, done = workflow.run_queue(jobs, lambda j: cells.join(j.select("job_id"), "job_id"), F.col("job_id") == 3)
    assert {r["job_id"]: (r["status"], r["error"]) for r in status.collect()} == {0: ("completed", None), 1: ("failed", "unreadable"), 2: ("failed", "no table found"), 3: ("failed", "cancelled")}
    assert [r["text"] for r in done.collect()] == ["x"]


def test_types_are_suggested_in_one_reading(spark):
    """The mark that a table's data show is told by the aggregation that tells types; a table that has no settings has no hint."""
    from gridsmith.operators import workflow

    texts = {1: ["1.5", "2.5", "1,234"], 2: ["1,234"], 3: ["1.5", "2.5", "1,234"]}
    cells = spark.createDataFrame([(t, r, int(x == "1,234"), x) for t, xs in texts.items() for r, x in enumerate(xs)], "table_id int, row int, col int, text string")
    rows = cells.selectExpr("table_id", "row", "'data' role")
    headers = cells.selectExpr("table_id", "col", "'' header").distinct()
    settings = spark.createDataFrame([(1, "auto"), (2, "commaDecimal")], "table_id int, number_format string")
    d = workflow.suggested_types(cells, rows, headers, settings)
    assert {(r.table_id, r.col): r.type for r in d.collect()} == {(1, 0): "decimal", (1, 1): "integer", (2, 1): "decimal", (3, 0): "decimal", (3, 1): "decimal"}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [read") == 2  # texts, and then dates
