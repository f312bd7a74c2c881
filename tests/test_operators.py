"""Operators on small tables."""

import io
import json
import re
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from gridsmith.operators import evaluate, export, grid, layout, recipes, rules, versions
from gridsmith.operators.normalize import contexts, decimal_evidence, infer_scale, infer_types, normalize, with_readings
from gridsmith.plans.fixtures import tokens

CELL = "table_id int, row int, col int, text string, type string"


def normalized(spark, rows, fmt="auto", order="auto", scale="1"):
    """rows (table, row, col, text, type) with evidence resolved."""
    cells = spark.createDataFrame(rows, CELL)
    columns = cells.select("table_id", "col", "type").distinct().withColumn("number_format", F.lit("auto"))
    settings = cells.select("table_id").distinct().withColumns({"number_format": F.lit(fmt), "date_order": F.lit(order)})
    every = contexts(with_readings(cells), columns, settings)
    d = cells.join(every, ["table_id", "col"]).withColumns({"scale": F.lit(scale), "missing_tokens": tokens(), "strip": F.lit(True)})
    return {(r["row"], r["col"]): r["norm"] for r in normalize(d).collect()}, {r["col"]: r for r in every.collect()}


def test_context_from_the_column_then_the_table(spark):
    rows = [(1, 0, 0, "1.234,56", "decimal"), (1, 1, 0, "7.000,1", "decimal"), (1, 0, 1, "1.234", "decimal"), (1, 1, 1, "5", "integer"), (1, 0, 2, "x", "text")]
    norm, every = normalized(spark, [r for r in rows if r[:3] != (1, 1, 1)])
    assert (every[0]["decimal"], every[0]["resolution"]) == (",", "columnEvidence")
    assert (every[1]["decimal"], every[1]["resolution"]) == (",", "tableEvidence") and every[2]["resolution"] == "notApplicable"
    assert norm[0, 1]["canonical"] == "1234" and norm[0, 0]["canonical"] == "1234.56"


def test_unresolved_is_ambiguous_until_a_format_is_set(spark):
    rows = [(1, 0, 0, "1.234", "decimal"), (1, 1, 0, "12", "decimal")]
    norm, every = normalized(spark, rows)
    assert every[0]["resolution"] == "unresolved" and norm[0, 0]["kind"] == "ambiguous" and norm[0, 0]["candidates"] == ["1.234", "1234"] and norm[1, 0]["canonical"] == "12"
    assert normalized(spark, rows, fmt="commaDecimal")[0][0, 0]["canonical"] == "1234"


def test_five_kinds_and_steps(spark):
    rows = [(1, i, 0, t, "integer") for i, t in enumerate([" 12.00 ", "-", "", "abc", "1.5", "- *", "007", None])] + [(1, 0, 1, "-", "text"), (1, 0, 2, "0012", "identifier"), (1, 0, 3, "31/12/2020", "date"), (1, 1, 3, "n/a", "date"), (1, 2, 3, "soon", "date")]
    n, _ = normalized(spark, rows, fmt="pointDecimal", order="dmy")
    assert [n[i, 0]["kind"] for i in range(8)] == ["value", "missing", "empty", "invalid", "invalid", "missing", "value", "empty"]
    assert n[0, 0]["canonical"] == "12" and [s["operation"] for s in n[0, 0]["steps"]] == ["trim"] and [s["operation"] for s in n[6, 0]["steps"]] == ["parseNumber"] and n[4, 0]["canonical"] == "1.5" and n[6, 0]["had_leading_zeros"]
    assert n[0, 1]["kind"] == "value" and n[0, 2]["had_leading_zeros"] and n[0, 3]["canonical"] == "2020-12-31" and n[1, 3]["kind"] == "missing" and n[2, 3]["kind"] == "invalid"


def test_scale(spark):
    n, _ = normalized(spark, [(1, 0, 0, "1.5", "decimal")], fmt="pointDecimal", scale="1000")
    assert n[0, 0]["canonical"] == "1500" and n[0, 0]["steps"][-1]["operation"] == "scale"


def test_evidence_needs_four_times(spark):
    rows = [(1, i, 0, "1,234.5", "decimal") for i in range(3)] + [(1, 9, 0, "1.234,5", "decimal")] + [(2, i, 0, "1,234.5", "decimal") for i in range(4)] + [(2, 9, 0, "1.234,5", "decimal")]
    got = {r["table_id"]: (r["decimal"], r["weight"]) for r in decimal_evidence(with_readings(spark.createDataFrame(rows, CELL)), ["table_id"]).collect()}
    assert got == {1: (None, None), 2: (".", 3)}


def test_types(spark):
    cases = {
        "Codice ISTAT": (["001272", "015146"], "identifier"), "Density": (["108.5", "383.3", "68.0"], "decimal"), "Population": (["9,104,772", "11,763,650"], "integer"), "Change": (["11.8%", "-689.9%"], "percent"),
        "2025": (["€ 1,250.00", "€ 12.50"], "currency"), "Cases": (["1,204", "-", "877"], "decimal"), "Day": (["2024-03-05", "5 May 2024"], "date"), "Year": (["2020", "2021"], "integer"), "Name": (["a", "b"], "text"), "Empty": (["", "-"], "text"), "rising": (["1", "2"], "identifier"),
    }
    rows = [(1, i, c, t) for c, (texts, _) in enumerate(cases.values()) for i, t in enumerate(texts)]
    headers = spark.createDataFrame([(1, c, h) for c, h in enumerate(cases)], "table_id int, col int, header string")
    r = with_readings(spark.createDataFrame(rows, "table_id int, row int, col int, text string"))
    assert [x["type"] for x in infer_types(r, headers).orderBy("col").collect()] == [t for _, t in cases.values()]
    hints = spark.createDataFrame([(1, ".")], "table_id int, hint string")
    assert {x["col"]: x["type"] for x in infer_types(r, headers, hints=hints).collect()}[5] == "integer"
    assert spark.range(1).select(infer_scale(F.lit("in Thousands"))).first()[0] == "1000"


FULL = "table_id int, row int, col int, cell_id string, role string, type string, text string, extracted_text string, corrected_text string, engine_score double, review string, flags array<string>, row_span int, col_span int, sources array<struct<regions:array<double>>>, norm struct<kind:string,canonical:string,fraction_digits:int,had_leading_zeros:boolean>"


def cell(row, col, text, role="data", type_="decimal", kind="value", canonical=None, digits=0, score=None, review="unreviewed", flags=(), span=1, source=True, fixed=None, zeros=False, table=1):
    return (table, row, col, f"{table}:{row}:{col}", role, type_, text, text, fixed, score, review, list(flags), 1, span, [([1.0] if source else [],)], (kind, canonical if canonical is not None else text, digits, zeros))


def test_cell_rules(spark):
    rows = [
        cell(0, 0, "abc", kind="invalid"), cell(0, 1, "1.234", kind="ambiguous"), cell(0, 2, "007", zeros=True), cell(1, 0, "5", source=False), cell(1, 1, "5", score=0.4), cell(1, 2, "5", flags=["reextractionConflict"]),
        cell(2, 0, "5", flags=["continuationMerged"]), cell(2, 1, "x", type_="text", kind="invalid"), cell(3, 0, "abc", role="header", kind="invalid"), cell(2, 2, "9", score=0.4, fixed="8"),
    ]
    results, tested = rules.check_cells(spark.createDataFrame(rows, FULL))
    assert {(r["rule"], r["row"], r["col"]) for r in results.collect()} == {("convert", 0, 0), ("ambiguous", 0, 1), ("leading_zeros", 0, 2), ("no_source", 1, 0), ("low_score", 1, 1), ("conflict", 1, 2), ("continuation", 2, 0)}
    assert {r["rule"]: r["tested"] for r in tested.collect()} == {"convert": 8, "ambiguous": 8, "leading_zeros": 8, "no_source": 9, "low_score": 2, "conflict": 1, "continuation": 1}


def test_totals(spark):
    body = [cell(0, 0, "1.5", digits=1), cell(1, 0, "2.5", digits=1), cell(2, 0, "4.1", role="total", digits=1), cell(3, 0, "7"), cell(4, 0, "", kind="empty", canonical=""), cell(5, 0, "9", role="total"), cell(6, 0, "x", kind="invalid"), cell(7, 0, "1", role="total"), cell(0, 1, "1", type_="percent"), cell(2, 1, "1", role="total", type_="percent")]
    got = {r["row"]: (r["status"], str(r["total"]) if r["total"] is not None else None) for r in rules.check_totals(spark.createDataFrame(body, FULL)).collect()}
    assert got == {2: ("passed", "4.000000000000"), 5: ("failed", "7.000000000000"), 7: ("notApplicable", None)}
    # a total row without a cell in a column still ends what the next total adds up
    wide = [cell(0, 0, "1"), cell(0, 1, "10"), cell(1, 0, "1", role="total"), cell(2, 0, "2"), cell(2, 1, "20"), cell(3, 0, "2", role="total"), cell(3, 1, "20", role="total")]
    frame = spark.createDataFrame(wide, FULL)
    totals = rules.check_totals(frame)
    assert {(r["row"], r["col"]): (r["status"], r["cell_ids"]) for r in totals.collect()} == {(1, 0): ("passed", ["1:1:0", "1:0:0"]), (3, 0): ("passed", ["1:3:0", "1:2:0"]), (3, 1): ("passed", ["1:3:1", "1:2:1"])}
    wrong, _ = rules.totals_results(rules.check_totals(spark.createDataFrame([cell(0, 0, "1.5", digits=1), cell(1, 0, "9", role="total")], FULL)))
    assert wrong.first()["message"] == "A2: the total 9 differs by 7.5 from 1.5, the sum of 1 values" and wrong.first()["tolerance"] == "0.1"
    only_total = frame.filter("row = 1").withColumn("review", F.lit("reviewed")).unionByName(spark.createDataFrame([cell(0, 0, "5")], FULL))
    assert rules.unresolved(wrong, only_total).count() == 1 and rules.unresolved(wrong, only_total.withColumn("review", F.lit("reviewed"))).count() == 0


def test_rows_summaries_and_open_issues(spark):
    rows = [cell(0, 0, "a", type_="text"), cell(0, 1, "b", type_="text"), cell(1, 0, "a", type_="text"), cell(1, 1, "b", type_="text"), cell(2, 0, "c", type_="text", span=2, flags=["outsideColumns"]), cell(3, 0, "d", type_="text", review="reviewed")]
    cells = spark.createDataFrame(rows, FULL)
    dup, dup_tested = rules.check_duplicates(cells)
    assert [(r["row"], r["cell_ids"]) for r in dup.collect()] == [(1, ["1:1:0", "1:1:1"])]
    row_list = spark.createDataFrame([(1, i, "data") for i in range(4)], "table_id int, row int, role string")
    columns = spark.createDataFrame([(1, 0), (1, 1)], "table_id int, col int")
    shape, shape_tested = rules.check_row_shape(cells, row_list, columns)
    assert sorted((r["row"], r["col"], len(r["cell_ids"])) for r in shape.collect()) == [(2, 0, 1), (2, 0, 1), (3, 1, 0)]
    every, tested = dup.unionByName(shape), dup_tested.unionByName(shape_tested)
    s = {r["rule"]: (r["tested"], r["failed"], r["status"]) for r in rules.summaries(every, tested, cells).collect()}
    assert len(s) == len(rules.RULES) and s["row_shape"] == (4, 3, "failed") and s["duplicate_row"] == (2, 1, "failed") and s["totals"] == (0, 0, "notApplicable")
    reviewed = cells.withColumn("review", F.when(F.col("row") == 1, "reviewed").otherwise("unreviewed"))
    assert sorted(r["rule"] for r in rules.unresolved(every, reviewed).collect()) == ["row_shape"] * 3
    assert {r["cell_id"]: r["severity"] for r in rules.worst_severity(every).collect()}["1:1:0"] == "warning"
    assert [r["next_place"] for r in rules.issue_order(every).orderBy("place").collect()] == [2, 3, 4, 1]


def test_grid(spark):
    schema = "table_id int, row int, col int, row_span int, col_span int, text string, arrival int"
    cells = spark.createDataFrame([(1, 0, 0, 1, 2, "Head", 0), (1, 0, 1, 1, 1, "hidden", 1), (1, 1, 0, 1, 1, "a", 2), (1, 2, 1, 1, 1, "Total", 3)], schema)
    sizes = spark.createDataFrame([(1, 3, 2)], "table_id int, n_rows int, n_cols int")
    full = grid.filled_grid(cells, sizes)
    assert sorted((r["row"], r["col"], r["text"]) for r in full.collect()) == [(0, 0, "Head"), (1, 0, "a"), (1, 1, ""), (2, 0, ""), (2, 1, "Total")]
    listed = spark.createDataFrame([(1, 0, False), (1, 1, False), (1, 2, True)], "table_id int, row int, repeated_header boolean")
    roles = grid.row_roles(full, listed, F.lit(1))
    assert [r["role"] for r in roles.orderBy("row").collect()] == ["header", "data", "excluded"]
    assert {r["col"]: r["header"] for r in grid.header_texts(full, roles).collect()} == {0: "Head", 1: "Head"}


def test_segments(spark):
    rows = [(1, 0, 0, True, "Name Qty"), (1, 0, 1, False, ""), (1, 1, 0, True, "name qty"), (1, 1, 1, False, ""), (1, 2, 0, True, "Other")]
    d = grid.joined_segments(spark.createDataFrame(rows, "table_id int, segment int, row int, is_header boolean, header_text string"))
    assert [(r["row"], r["repeated_header"]) for r in d.orderBy("row").collect()] == [(0, False), (1, False), (2, True), (3, False), (4, False)]


def test_carry_over(spark):
    old = spark.createDataFrame([(1, 0, 0, "1.204", "1.205", "reviewed"), (1, 1, 0, "a", "b", "unreviewed"), (1, 2, 0, "x", None, "reviewed"), (1, 9, 0, "y", "z", "unreviewed")], "table_id int, row int, col int, extracted_text string, corrected_text string, review string")
    new = spark.createDataFrame([(1, 0, 0, "1,204"), (1, 1, 0, "c"), (1, 2, 0, "x"), (1, 3, 0, "n")], "table_id int, row int, col int, extracted_text string")
    got = versions.carry_over(old, new)
    assert [(r["corrected_text"], r["review"], r["action"]) for r in got.orderBy("row").collect()] == [("1.205", "reviewed", "carried"), ("b", "needsReview", "conflict"), (None, "reviewed", "kept_review"), (None, "unreviewed", "new")]
    assert versions.carry_over(old, new, strict=True).filter("row = 0").first()["action"] == "conflict"
    assert tuple(versions.carry_over_summary(got, old).first())[1:] == (1, 1, 1, 1)


def test_edits(spark):
    schema = "table_id int, cell_id string, extracted_text string, corrected_text string, review string"
    cells = spark.createDataFrame([(1, "a", "x", None, "reviewed"), (1, "b", "y", "z", "unreviewed"), (1, "c", "w", None, "unreviewed")], schema)
    after, log = versions.set_texts(cells, spark.createDataFrame([("a", "new"), ("b", "y"), ("c", "w")], "cell_id string, text string"))
    assert [(r["corrected_text"], r["review"]) for r in after.orderBy("cell_id").collect()] == [("new", "needsReview"), (None, "unreviewed"), (None, "unreviewed")]
    assert sorted((r["cell_id"], r["before"], r["after"]) for r in log.collect()) == [("a", "x", "new"), ("b", "z", "y")]
    back, _ = versions.set_texts(after, versions.undone(log).select("cell_id", F.col("after").alias("text")))
    assert [r["corrected_text"] for r in back.orderBy("cell_id").collect()] == [None, "z", None]
    marked, reviews = versions.set_reviews(cells, spark.createDataFrame([("a", "reviewed"), ("b", "reviewed")], "cell_id string, review string"))
    assert reviews.count() == 1 and marked.filter("review = 'reviewed'").count() == 2


def test_recipe_versions(spark):
    stored = spark.createDataFrame([("r", 1, "n", 5), ("r", 2, "m", 5)], "recipe_id string, version int, name string, pages int")
    new = spark.createDataFrame([("r", "m", 5), ("s", "n", 1)], "recipe_id string, name string, pages int")
    assert {r["recipe_id"]: (r["version"], r["is_new"]) for r in versions.saved_recipes(stored, new, ["name", "pages"]).collect()} == {"r": (2, False), "s": (1, True)}
    changed = spark.createDataFrame([("r", "other", 5)], "recipe_id string, name string, pages int")
    assert versions.saved_recipes(stored, changed, ["name", "pages"]).first()["version"] == 3


def test_mapping_is_greedy_in_order(spark):
    scores = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.9), (1, 1, 0, 1.0), (1, 1, 2, 0.85), (1, 2, 2, 0.7)], "table_id int, col int, target int, score double")
    assert {r["col"]: r["target"] for r in recipes.map_columns(scores).collect()} == {0: 0, 1: 2}


def test_extended_down(spark):
    lines = [(1, y, y - 5.0, n, inside) for y, n, inside in ((100.0, 3, True), (90.0, 3, True), (80.0, 3, True), (69.0, 2, False), (59.0, 3, False), (30.0, 3, False), (20.0, 3, False))]
    d = spark.createDataFrame(lines, "id int, y double, min_y double, n_tokens int, inside boolean")
    assert recipes.extended_down(d).first()["bottom"] == 53.0


def test_export(spark):
    rows = [cell(0, 0, "=A1", type_="text"), cell(0, 1, "1,204", canonical="1204"), cell(1, 0, 'say "x", y', type_="text"), cell(1, 1, "..", kind="missing", canonical=""), cell(2, 0, "Total", role="total", type_="text"), cell(2, 1, "1.234", role="total", kind="ambiguous", canonical="")]
    d = spark.createDataFrame(rows, FULL).withColumn("norm", F.col("norm").withField("missing_token", F.when(F.col("norm.kind") == "missing", F.col("text"))))
    rows = spark.createDataFrame([(1, 0, "data"), (1, 1, "data"), (1, 2, "total"), (1, 3, "data"), (1, 4, "header")], "table_id int, row int, role string")
    columns = spark.createDataFrame([(1, 0, "=Name", "text"), (1, 1, "Qty", "decimal"), (1, 2, "Note, more", "text")], "table_id int, col int, name string, type string")
    lines = lambda totals=True, **k: [r["line"] for r in export.csv_rows(export.export_values(d, **k), rows if totals else rows.filter("role != 'total'"), columns).orderBy("row").collect()]
    assert lines() == ["'=A1,1204,", '"say ""x"", y",,', "Total,1.234,", ",,"]
    assert lines(False, numbers="original", missing="NA") == ["'=A1,\"1,204\",", '"say ""x"", y",NA,', ",,"] and lines(missing="marker")[1].endswith(",..,")
    assert export.csv_header(columns, review_column=True).first()["line"] == "'=Name,Qty,\"Note, more\",row_review"
    gap = d.filter("not (row = 0 and col = 1)").withColumn("row_span", F.when((F.col("row") == 0) & (F.col("col") == 0), 2).otherwise(1)).filter("not (row = 1 and col = 0)").withColumn("review", F.when(F.col("row") == 0, "unreviewed").otherwise("reviewed"))
    assert [r["line"] for r in export.csv_rows(export.export_values(gap), rows, columns, review_column=True).orderBy("row").collect()] == ["'=A1,,,not reviewed", ",,,not reviewed", "Total,1.234,,reviewed", ",,,reviewed"]
    signs = spark.createDataFrame([("-1,234.50",), ("+1 000",), ("-",), ("-abc",), ("@x",), ("=1",), ("-5%",), ("x-1",)], "x string")
    assert [r["g"] for r in export.guarded(signs, "x", "g").collect()] == ["-1,234.50", "+1 000", "-", "'-abc", "'@x", "'=1", "-5%", "x-1"]
    values = export.export_values(d)
    data = export.data_sheet(values, rows, columns, spark.createDataFrame([("1:2:1",)], "cell_id string")).withColumn("sheet", F.lit("Data")).join(export.sheet_widths(values, columns), "table_id")
    results = rules.check_cells(d)[0]
    checks = export.checks_sheet(results, rules.unresolved(results, d)).withColumns({"sheet": F.lit("Checks"), "widths": F.lit(None).cast("array<double>")})
    z = zipfile.ZipFile(io.BytesIO(export.workbooks(data.unionByName(checks)).first()["xlsx"]))
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "<v>1204</v>" in sheet and '<c r="B4" s="3"' in sheet and '<c r="A1" s="1"' in sheet and "say &quot;x&quot;" in sheet and '<autoFilter ref="A1:C5"/>' in sheet and '<col min="3" max="3" width="13.0"' in sheet
    assert z.read("xl/workbook.xml").decode().index("Data") < z.read("xl/workbook.xml").decode().index("Checks") and "reads in two ways" in z.read("xl/worksheets/sheet2.xml").decode()
    grid_lines = [r["line"] for r in export.text_grid(d, rows, columns).orderBy("row").collect()]
    assert grid_lines[0].startswith("  1   | =A1") and grid_lines[2].startswith("  3 T |") and len(set(map(len, grid_lines))) == 1
    assert [r["line"] for r in export.selection_tsv(d, rows, 0, 3, 0, 2).orderBy("row").collect()] == ["=A1\t1,204\t", 'say "x", y\t..\t', "Total\t1.234\t", "\t\t"]
    places = spark.createDataFrame([(1, r, c) for r in range(2) for c in range(2)], "table_id int, row int, col int")
    pick = lambda *p: places.filter(F.array_contains(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r, c in p]), F.struct("row", "col")))
    assert sorted((r["row"], r["col"], r["text"]) for r in export.paste_edits("x", pick((0, 0), (1, 1)), places).collect()) == [(0, 0, "x"), (1, 1, "x")]
    assert sorted((r["row"], r["col"], r["text"]) for r in export.paste_edits("a\tb\nc\td\n", pick((0, 1)), places).collect()) == [(0, 1, "a"), (1, 1, "c")]
    assert [(x["row"], x["col"], x["text"]) for x in spark.range(1).select(export.pasted(F.lit("a\tb\nc\n"))).first()[0]] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    assert json.loads(export.json_tables(d).first()["json"])["cells"][1]["address"] == "B1"


def test_layout_reads_a_wrapped_table(spark):
    lines = [(100, [(0, "Code"), (60, "Name"), (160, "Qty")]), (88, [(0, "01"), (60, "long"), (85, "name")]), (80, [(60, "goes"), (85, "on")]), (60, [(0, "02"), (60, "short"), (160, "1,204")]), (48, [(0, "03"), (60, "other"), (160, "7")]), (36, [(0, "04"), (60, "more"), (160, "9")])]
    words = [(1, t, float(x), x + 5.0 * len(t), float(y), y + 8.0, 0.9) for y, ws in lines for x, t in ws]
    d = spark.createDataFrame(words, "region_id int, text string, x0 double, x1 double, y0 double, y1 double, score double")
    regions = spark.createDataFrame([(1, (-5.0, 0.0, 250.0, 130.0))], "region_id int, region struct<x:double,y:double,width:double,height:double>")
    cells = layout.read_grid(d, regions)
    got = {(r["row"], r["col"]): r["text"] for r in cells.collect()}
    assert got[1, 1] == "long name goes on" and got[2, 2] == "1,204" and max(r for r, _ in got) == 4 and max(c for _, c in got) == 2
    assert layout.header_rows(cells).first()["header_rows"] == 1


def test_glyphs_become_words(spark):
    glyphs = [(1, ch, x, x + 5.0, 0.0, 10.0, None, sp) for ch, x, sp in (("a", 0.0, False), ("b", 5.0, True), ("c", 10.0, False), ("d", 25.0, False))]
    d = spark.createDataFrame(glyphs, "region_id int, text string, x0 double, x1 double, y0 double, y1 double, score double, space_after boolean")
    assert sorted(r["text"] for r in layout.merged_glyphs(d).collect()) == ["ab", "c", "d"]


def test_scores(spark):
    truth = [("d", r, c, t, "text" if c == 0 else "decimal", r == 0, ".", ",") for r, row in enumerate([["h", "n"], ["a", "1,204"], ["b", "007"], ["c", "9"]]) for c, t in enumerate(row)]
    got = [("d", r, c, t) for r, row in enumerate([["h", "n"], ["a", "1204"], ["zz", "qq"], ["c", "9*"]]) for c, t in enumerate(row)]
    t = spark.createDataFrame(truth, "doc string, row int, col int, text string, type string, is_header boolean, decimal string, grouping string")
    g = spark.createDataFrame(got, "doc string, row int, col int, text string")
    pairs = evaluate.align_rows(t, g)
    assert sorted(map(tuple, pairs.select("truth_row", "got_row").collect())) == [(0, 0), (1, 1), (3, 3)]
    s = evaluate.cell_scores(t, g, pairs).first()
    assert (s["compared"], s["exact"], s["numeric"], s["numeric_exact"]) == (6, 4, 2, 2)
    assert tuple(evaluate.text_recall(t, g, ["doc"]).first()) == ("d", 4, 8)


def test_rows_meet_on_rare_cells(spark):
    import random

    r = random.Random(3)
    rows = lambda: [("d", i, c, r.choice(["", "same", f"v{r.randint(0, 12)}", f"v{r.randint(0, 3)}"])) for i in range(30) for c in range(r.randint(3, 9))]
    truth, got = rows(), rows()
    kind = "doc string, row int, col int, text string"
    pairs = evaluate.row_similarity(spark.createDataFrame(truth, kind), spark.createDataFrame(got, kind), 0.2)
    of = lambda cells: {i: {(c, t) for _, k, c, t in cells if k == i and t} for i in range(30)}
    a, b = of(truth), of(got)
    want = {(i, j): round(len(a[i] & b[j]) / len(a[i]), 9) for i in a for j in b if a[i] and len(a[i] & b[j]) / len(a[i]) > 0.2}
    assert {(x.truth_row, x.got_row): round(x.s, 9) for x in pairs.collect()} == want and len(want) > 100


def test_a_column_of_one_value_brings_no_rows_together(spark):
    """Six columns, one the same in all 100,000 rows: rows meet on the others alone."""
    columns = [F.lit("EUR"), *[F.concat(F.lit(f"c{c}-"), F.col("id").cast("string")) for c in range(5)]]
    cells = spark.range(100_000).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("row"), F.posexplode(F.array(*columns)).alias("col", "text"))
    pairs = evaluate.align_rows(cells, cells.filter("row % 10 != 3").withColumn("row", F.col("row") - F.floor((F.col("row") + 6) / 10)))
    got = pairs.agg(F.count("*"), F.count_if(F.col("got_row") == F.col("truth_row") - F.floor((F.col("truth_row") + 6) / 10))).first()
    assert tuple(got) == (90_000, 90_000)


def test_many_small_tables_are_aligned_in_batches(spark):
    """20,000 tables of three rows, each without its second: one call for each would take minutes."""
    cells = spark.range(60_000).select(F.floor(F.col("id") / 3).alias("doc"), (F.col("id") % 3).cast("int").alias("row"), F.posexplode(F.array(F.concat(F.lit("v"), F.col("id").cast("string")), F.lit("same"))).alias("col", "text"))
    pairs = evaluate.align_rows(cells, cells.filter("row != 1"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    got = pairs.agg(F.count("*"), F.count_distinct("doc"), F.count_if(F.col("truth_row") == F.col("got_row"))).first()
    assert tuple(got) == (40_000, 20_000, 40_000)


def test_heaviest_chain_is_the_heaviest():
    import random
    from itertools import combinations

    r = random.Random(5)
    for _ in range(200):
        pairs = sorted({(r.randint(0, 4), r.randint(0, 4)): r.randint(1, 4) / 4 for _ in range(r.randint(1, 8))}.items(), reverse=True)
        chain = evaluate.heaviest_chain([(t, g, s) for (t, g), s in pairs])
        weight = dict(pairs)
        rising = lambda c: all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False))
        best = max(sum(weight[p] for p in c) for n in range(1, len(weight) + 1) for c in combinations(sorted(weight), n) if rising(c))
        assert rising(chain) and sum(weight[p] for p in chain) == best


def test_typed_cells_are_read_by_one_python_step(spark):
    """Numbers and shown date orders of typed cells come from one function; without types both still agree."""
    from gridsmith.operators.normalize import contexts, with_readings

    cells = spark.createDataFrame([(1, r, c, t, k) for r, row in enumerate([("1,5", "13/02/2020"), ("2,25", "01/02/2020")]) for c, (t, k) in enumerate(zip(row, ("decimal", "date"), strict=True))], "table_id int, row int, col int, text string, type string")
    columns = spark.createDataFrame([(1, 0, "decimal", "auto"), (1, 1, "date", "auto")], "table_id int, col int, type string, number_format string")
    settings = spark.createDataFrame([(1, "auto", "auto")], "table_id int, number_format string, date_order string")
    typed, plain = (contexts(with_readings(d), columns, settings) for d in (cells, cells.drop("type")))
    assert typed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, typed.collect())) == sorted(map(tuple, plain.collect()))
    assert {r["col"]: (r["decimal"], r["date_order"]) for r in typed.collect()} == {0: (",", "auto"), 1: (None, "dmy")}


def test_cells_of_orders_are_not_shuffled_for_their_contexts(spark):
    from gridsmith.plans.fixtures import normalized_orders

    plan = normalized_orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join" in x)
    assert re.search(r"table_id#\d+L = table_id#", join) and not re.search(r"col#\d+ = col#", join)


def test_texts_of_lines_are_read_after_a_shuffle(spark):
    """A scan of one row group is one task: evidence that needs no row numbers must not be read in it."""
    from gridsmith.operators.normalize import with_readings
    from gridsmith.plans import parsing
    from gridsmith.plans.fixtures import order_cells

    sf = "/root/testdata/sf0.001"
    readings = with_readings(order_cells(spark, sf).filter("role = 'data'")).groupBy("table_id", "col").agg(F.count_if("skip"))
    for d in (readings, parsing.table_context_resolution(spark, sf)):
        plan = d._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython", 1)[1]
        assert "RepartitionByExpression" in plan.split("Relation", 1)[0]


def test_stream_equals_batch(spark, tmp_path):
    from gridsmith.streaming import corrections

    rows = [(1, "a", datetime(2024, 1, 1, h), h, f"v{h}") for h in (3, 1, 2)] + [(1, "b", datetime(2024, 1, 2), 9, "w")]
    log = spark.createDataFrame(rows, corrections.SCHEMA)
    log.write.parquet(f"{tmp_path}/log")
    q = corrections.start(corrections.latest_texts(corrections.read_log(spark, f"{tmp_path}/log")), "texts", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, corrections.latest_texts(log).collect()))
    assert sorted(map(tuple, spark.table("texts").collect())) == want == [(1, "a", "v3", 3), (1, "b", "w", 1)]


def test_sources_and_sinks(spark, tmp_path):
    from gridsmith.sources import readers, sinks

    (tmp_path / "in").mkdir()
    for name, data in (("a", b"x"), ("b", b"x"), ("c", b"y")):
        (tmp_path / "in" / name).write_bytes(data)
    stored = spark.createDataFrame([], "sha256 string, document_id string")
    assert readers.files(spark, f"file://{tmp_path}/in", stored).filter("is_new").count() == 2
    truth = {"document": "d", "tables": [{"headerRows": 1, "cells": [["h"], ["1"]], "cellRects": [[None], [{"x": 1, "y": 2, "width": 3, "height": 4}]], "cellPages": [[0], [0]], "columnTypes": ["integer"], "numberFormat": "auto"}]}
    (tmp_path / "d.truth.json").write_text(json.dumps(truth))
    got = readers.truth(spark, f"file://{tmp_path}").orderBy("row").collect()
    assert [(r["text"], r["type"], r["is_header"]) for r in got] == [("h", "integer", True), ("1", "integer", False)] and got[1]["box"]["width"] == 3
    message = {"protocol": 1, "type": "result", "job": "j", "tables": [{"bbox": {"l": 0, "b": 0, "r": w, "t": 1}, "cells": [{"row": 0, "column": 0, "rowSpan": 1, "colSpan": 1, "text": str(w)}]} for w in (1, 3, 2)]}
    lines = spark.createDataFrame([(json.dumps(message),), ('{"protocol": 2, "type": "result"}',), ("bad",)], "value string")
    assert [r["text"] for r in readers.worker_results(lines).collect()] == ["3"]
    for batch, value in ((1, "x"), (2, "y"), (2, "z")):
        sinks.append(spark.createDataFrame([("k", value)], "key string, value string"), f"file://{tmp_path}/store", "t", batch)
    assert sinks.current(spark, f"file://{tmp_path}/store", "t", ["key"]).first()["value"] == "z"


def test_contexts_read_cells_once(spark):
    """Evidence of the table follows from that of its columns without reading the cells again."""
    cells = spark.createDataFrame([(1, 0, 0, "1,5"), (1, 0, 1, "7")], "table_id int, row int, col int, text string")
    columns = spark.createDataFrame([(1, 0, "decimal", "auto"), (1, 1, "decimal", "auto")], "table_id int, col int, type string, number_format string")
    settings = spark.createDataFrame([(1, "auto", "auto")], "table_id int, number_format string, date_order string")
    d = contexts(with_readings(cells), columns, settings)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("read(text") == 1
    assert {r["col"]: (r["decimal"], r["resolution"]) for r in d.collect()} == {0: (",", "columnEvidence"), 1: (",", "tableEvidence")}
