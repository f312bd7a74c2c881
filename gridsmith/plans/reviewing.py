"""Queries on quality rules, versions, recipes, geometry, export and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.functions import geometry as g
from gridsmith.functions.text import column_letter, csv_field, similarity
from gridsmith.functions.numbers import POINT_GROUPING
from gridsmith.operators import evaluate, export, grid, layout, recipes, rules, versions
from gridsmith.operators.normalize import normalize
from gridsmith.plans.fixtures import cents, money, normalized_orders, order_cells, order_columns, order_rows, table, tokens
from gridsmith.plans.reviewing_sql import ORACLES  # noqa: F401
from gridsmith.sources.scratch import written


def _as_seen(n: DataFrame) -> DataFrame:
    """Cells of orders with what reviewers see: scores, flags, regions and review states from each cell's place number."""
    k = F.col("place")
    region = F.array(F.struct(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(9.0).alias("width"), F.lit(9.0).alias("height"))).alias("regions")))
    none = F.array().cast("array<struct<regions:array<struct<x:double,y:double,width:double,height:double>>>>")
    flags = F.when(k % 97 == 0, F.array(F.lit("reextractionConflict"))).when(k % 89 == 0, F.array(F.lit("continuationMerged"))).otherwise(F.array().cast("array<string>"))
    return n.withColumns({
        "extracted_text": F.col("text"), "corrected_text": F.lit(None).cast("string"), "engine_score": F.when(k % 2 == 0, k / 1000.0), "sources": F.when(k % 53 == 0, none).otherwise(region),
        "flags": flags, "review": F.when(k % 5 == 0, "reviewed").otherwise("unreviewed"), "row_span": F.lit(1), "col_span": F.lit(1),
    })


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_seen(normalized_orders(spark, sf_dir))


def _checked_once(spark: SparkSession, sf_dir: str, norm: tuple[str, ...] = ("kind", "canonical", "fraction_digits", "had_leading_zeros")) -> DataFrame:
    """_checked() by order, of which only what cannot be told again is written, and of norm what rules read or what is named."""
    own = F.struct(*[F.col(f"norm.{x}").alias(x) for x in norm]).alias("norm")
    n = normalized_orders(spark, sf_dir).select("table_id", "row", "col", "role", "type", "text", "place", own)
    return _as_seen(written(n, "table_id")).withColumn("cell_id", F.concat_ws(":", "table_id", "row", "col"))


def type_conversion_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = rules.check_cells(_checked(spark, sf_dir))
    return results.filter("rule = 'convert'").select("table_id", "row", "col", "severity")


def _as_cells(d: DataFrame, text: str, kind: str, **own) -> DataFrame:
    """Rows of another table as one-column tables of data cells, normalised, with what the cell rules read."""
    none = F.array().cast("array<struct<regions:array<double>>>")
    base = {
        "table_id": F.lit(0), "row": F.lit(0), "col": F.lit(0), "cell_id": F.lit(""), "role": F.lit("data"), "text": F.col(text), "extracted_text": F.col(text), "corrected_text": F.lit(None).cast("string"), "type": F.lit(kind), "scale": F.lit("1"),
        "decimal": F.lit("."), "grouping": F.lit(POINT_GROUPING), "date_order": F.lit("auto"), "missing_tokens": tokens(), "strip": F.lit(True), "engine_score": F.lit(None).cast("double"), "flags": F.array().cast("array<string>"), "sources": none,
    }
    return normalize(d.withColumns(base | own))


def leading_zero_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier numbers of four digits as an integer column: the rule on zeros in front."""
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0").alias("raw"))
    cells = _as_cells(d, "raw", "integer", table_id=F.col("key"))
    results, _ = rules.check_cells(cells)
    return results.filter("rule = 'leading_zeros'").select(F.col("table_id").alias("s_suppkey"), "severity", "message")


def missing_source_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cells, labels as their sources: the rule on text without a place."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = lab.filter("doc_id is not null").groupBy("doc_id").agg(F.array(F.struct(F.array(F.lit(1.0)).alias("regions"))).alias("seen"))
    none = F.array().cast("array<struct<regions:array<double>>>")
    cells = _as_cells(d.select("doc_id", F.col("text").alias("raw")).join(seen, "doc_id", "left"), "raw", "text", table_id=F.col("doc_id"), sources=F.coalesce("seen", none))
    return rules.check_cells(cells)[0].filter("rule = 'no_source'").select(F.col("table_id").alias("doc_id"), "severity")


def low_score_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = rules.check_cells(_checked(spark, sf_dir))
    return results.filter("rule = 'low_score'").groupBy("col").agg(F.count("*").alias("n"))


def row_structure_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as single rows whose seven columns are line numbers."""
    li = table(spark, sf_dir, "lineitem")
    cells = li.select(F.col("l_orderkey").alias("table_id"), F.lit(0).alias("row"), (F.col("l_linenumber") - 1).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit("data").alias("role"), F.lit(None).cast("string").alias("cell_id"), F.array().cast("array<string>").alias("flags"))
    tables = li.select(F.col("l_orderkey").alias("table_id")).distinct()
    rows = tables.select("table_id", F.lit(0).alias("row"), F.lit("data").alias("role"))
    columns = tables.select("table_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("col"))
    results, _ = rules.check_row_shape(cells, rows, columns)
    return results.select("table_id", "row", "col")


def totals_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables: orders by key are data rows, every fifth is a total of those since the last."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey"), cents(F.col("o_totalprice")).alias("c"))
    w = Window.partitionBy("table_id").orderBy("o_orderkey")
    o = o.withColumn("row", F.row_number().over(w) - 1)
    total = F.col("row") % 5 == 4
    o = o.withColumns({"role": F.when(total, "total").otherwise("data"), "col": F.lit(0), "type": F.lit("decimal"), "cell_id": F.col("o_orderkey").cast("string")})
    text = (F.col("c") / 100).cast("decimal(18,2)").cast("string")
    norm = F.struct(F.lit("value").alias("kind"), text.alias("canonical"), F.lit(2).alias("fraction_digits"))
    t = rules.check_totals(o.withColumn("norm", norm))
    return t.select("table_id", "row", F.col("total").cast("double").alias("total"), "inputs", "status")


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a language as rows of one table: text and language."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("table_id"), F.col("doc_id").alias("row"), F.posexplode(F.array("text", "lang")).alias("col", "text"))
    d = d.withColumns({"role": F.lit("data"), "cell_id": F.concat_ws(":", "row", "col"), "norm": F.struct(F.lit(None).cast("string").alias("canonical"))})
    results, _ = rules.check_duplicates(d)
    return results.select("table_id", "row")


def _evaluated(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(cells, results in parts, summaries) of all rules on all orders; more: what cells have in norm besides."""
    cells = _checked_once(spark, sf_dir, ("kind", "canonical", "fraction_digits", "had_leading_zeros", *more))
    results, _, summaries = rules.evaluate_parts(cells, order_rows(spark, sf_dir), order_columns(spark, sf_dir))
    return cells, results, summaries


def rule_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all orders, in one row a rule."""
    per_table = _evaluated(spark, sf_dir)[2]
    return per_table.groupBy("rule").agg(F.sum("tested").alias("tested"), F.sum("failed").alias("failed"), F.count_if(F.col("status") == "failed").alias("tables_failed"))


def unresolved_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, results, _ = _evaluated(spark, sf_dir)
    return rules.unresolved(results, cells).groupBy("rule").agg(F.count("*").alias("n"))


def next_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed conversions and totals of each order, in the order in which a reviewer walks through them."""
    cells = _checked_once(spark, sf_dir)
    results = rules.check_cells(cells, only=("convert",))[0].unionByName(rules.totals_results(rules.check_totals(cells))[0].filter("status = 'failed'"))
    return rules.issue_order(results).select("table_id", "row", "col", "rule", "place", "next_place", "previous_place")


def review_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tables, events as cells."""
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 6)
    cells = e.select(
        F.col("user_id").alias("table_id"), F.when(F.col("event_id") % 7 == 0, "header").otherwise("data").alias("role"), F.col("event_type").alias("extracted_text"), F.when(F.col("k") == 1, "fixed").alias("corrected_text"),
        F.when(F.col("k") < 3, "reviewed").when(F.col("k") == 3, "needsReview").otherwise("unreviewed").alias("review"),
        F.array(F.struct(F.when(F.col("k") == 5, F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0))).alias("regions"))).alias("sources"),
    )
    open_ = e.filter("k >= 4").groupBy(F.col("user_id").alias("table_id")).agg(F.count("*").alias("n"))
    return grid.review_disclosure(cells, open_)


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cents(F.col("l_extendedprice")).alias("c"), "l_partkey")
    old = li.filter("l_linenumber < 7").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.lit(0).alias("col"), money(F.col("c")).alias("extracted_text"), F.when(F.col("l_partkey") % 4 == 0, "corrected").alias("corrected_text"), F.when(F.col("l_partkey") % 3 == 0, "reviewed").otherwise("unreviewed").alias("review"))
    changed = F.when(F.col("l_partkey") % 5 == 0, F.col("c") + 1).otherwise(F.col("c"))
    new = li.filter("l_linenumber > 1").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.lit(0).alias("col"), F.concat(F.lit(" "), money(changed, ".", ",")).alias("extracted_text"))
    return old, new


def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.carry_over(*_old_and_new(spark, sf_dir)).select("table_id", "row", "corrected_text", "review", "action")


def carry_over_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    return versions.carry_over_summary(versions.carry_over(old, new), old)


def correction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), F.col("event_type").alias("before"), F.lower("event_type").alias("after"))
    h = versions.correction_history(log)
    return h.select("id", "previous_after", "from_latest", "follows")


def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("table_id"), F.col("ts").alias("started_at"), F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("completed").alias("status"))
    return versions.current_runs(runs).select("table_id", "run_id")


def import_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    stored = d.filter("id % 10 = 3").groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("sha256")).agg((F.min("id") + 1_000_000).alias("document_id"))
    return versions.imported(d, stored)


def content_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", versions.cache_key(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("key"))


def header_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as recipe names against each nation's name, both of bounded number."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    d = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select("n_nationkey", F.round(similarity(F.col("n_name"), F.concat(F.col("r_name"), F.lit(" ("), F.lower("n_name"), F.lit(")"))), 9).alias("score"))


def schema_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as headers of its table, against the same names in lower case with one letter more."""
    n = table(spark, sf_dir, "nation")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    n = n.withColumn("col", place)
    headers = n.select(F.col("n_regionkey").alias("table_id"), "col", F.col("n_name").alias("header"))
    recipe = n.select(F.col("n_regionkey").alias("table_id"), (9 - F.col("col")).alias("target"), F.array(F.lower("n_name"), F.lit("other")).alias("names"))
    return recipes.map_columns(recipes.header_scores(headers, recipe))


def schema_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("col", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    headers = n.select(F.col("n_regionkey").alias("table_id"), "col", F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("header"))
    recipe = n.select(F.col("n_regionkey").alias("table_id"), "col", F.when(F.col("n_nationkey") % 3 == 0, "zzzzzzzz").otherwise(F.col("n_name")).alias("name"), F.array(F.lit("qqqqqqq")).alias("aliases"))
    sizes = headers.groupBy("table_id").agg((F.count("*") + F.when(F.col("table_id") == 1, 1).otherwise(0)).alias("n_cols"))
    return rules.check_recipe(headers, recipe, sizes)[0].select("table_id", F.coalesce("col", F.lit(-1)).alias("col"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    box = g.rect(F.col("l_partkey") % 40, F.col("l_suppkey") % 40, F.col("l_quantity"), F.col("l_linenumber") * 7)
    return li.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("n"), F.lit(0).alias("page"), box.alias("box"))


def page_to_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _boxes(spark, sf_dir)
    crop, turn = g.rect(F.lit(10), F.lit(20), F.lit(580), F.lit(740)), (F.col("n") % 4) * 90
    r = g.rect_to_display(F.col("box"), crop, turn, F.lit(3.0))
    return d.select("document_id", "n", *[r[k].alias(k) for k in ("x", "y", "width", "height")])


def rect_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _boxes(spark, sf_dir)
    a, b = d.filter("n = 1").select("document_id", F.col("box").alias("a")), d.filter("n > 1").select("document_id", "n", F.col("box").alias("b"))
    return b.join(a, "document_id").select("document_id", "n", F.round(g.iou(F.col("a"), F.col("b")), 9).alias("iou"))


def candidate_anti_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _boxes(spark, sf_dir)
    existing = d.filter("n = 1").select("document_id", "page", F.col("box").alias("region"))
    return recipes.new_candidates(d.filter("n > 1"), existing, 0.31417).select("document_id", "n")


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _boxes(spark, sf_dir)
    wanted = d.filter("n = 1").select(F.col("document_id").alias("id"), "document_id", "page", F.col("box").alias("region"))
    return recipes.best_candidates(wanted, d.filter("n > 1").select(F.col("n").alias("candidate_id"), "document_id", "page", "box"))


def point_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _boxes(spark, sf_dir).select(F.col("n").alias("cell_id"), F.col("n").alias("place"), "document_id", "page", F.array("box").alias("regions"))
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_orderkey").alias("document_id"), F.lit(0).alias("page"), (F.col("o_custkey") % 60).cast("double").alias("x"), (F.col("o_orderkey") % 60).cast("double").alias("y"))
    return recipes.hit_cells(points, cells)


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_name"), F.lit(', "x"'))).otherwise(F.col("p_name"))
    fields = [F.col("p_partkey").cast("string"), name, F.col("p_brand")]
    return p.select("p_partkey", F.concat_ws(",", *[csv_field(x) for x in fields]).alias("line"))


def formula_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts that a spreadsheet runs, before names, whole numbers and numbers with both marks."""
    starts = F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", "\t", "", "a"))), F.col("p_size") % 7 + 1)
    n = F.col("p_partkey")
    body = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 2, money(n * 100)).when(n % 4 == 3, money(n * 100, ".", ",")).otherwise(F.col("p_name"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(starts, body).alias("raw"))
    return export.guarded(p, "raw", "guarded").select("p_partkey", "guarded")


def export_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = export.export_values(normalized_orders(spark, sf_dir), missing="NA")
    return values.select("table_id", "row", "col", "out", "kind", "number")


def _with_holes(cells: DataFrame) -> DataFrame:
    """Cells of orders without some in column 1; in some rows column 2 spans column 3."""
    k = F.col("table_id") + F.col("row")
    spans = k % 13 == 5
    cells = cells.filter(~((F.col("col") == 1) & (k % 11 == 3)) & ~((F.col("col") == 3) & spans))
    return cells.withColumns({"row_span": F.lit(1), "col_span": F.when((F.col("col") == 2) & spans, 2).otherwise(1), "review": F.when((k + F.col("col")) % 4 == 0, "unreviewed").otherwise("reviewed")})


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every order as a line, positions without a cell and spanned ones included, with the review column."""
    values = export.export_values(_with_holes(normalized_orders(spark, sf_dir)))
    return export.csv_rows(values, order_rows(spark, sf_dir), order_columns(spark, sf_dir), review_column=True).select("table_id", "row", "line")


def selection_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns 0 to 2 of each order's first three rows as clipboard lines."""
    return export.selection_tsv(_with_holes(order_cells(spark, sf_dir)), order_rows(spark, sf_dir), 0, 2, 0, 2)


def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, reviews, corrections and problems of each column over all orders."""
    d = grid.column_statistics(_checked(spark, sf_dir))
    return d.groupBy("col").agg(*[F.sum(c).alias(c) for c in ("total", "reviewed", "corrected", "problems")])


def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7 % 18278).alias("i")).distinct()
    return c.select("i", column_letter(F.col("i")).alias("letter"))


def json_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecar of every order, read back cell by cell."""
    cells, results, _ = _evaluated(spark, sf_dir, "missing_token", "steps")
    schema = "cells array<struct<address:string,checks:array<string>,kind:string,text:string,value:string>>, schema int"
    d = export.provenance(export.export_values(cells), results).select("table_id", F.from_json("json", schema).alias("j"))
    d = d.select("table_id", F.col("j.schema").alias("version"), F.explode("j.cells").alias("c"))
    return d.select("table_id", "version", "c.address", F.array_join("c.checks", ",").alias("checks"), "c.kind", "c.text", "c.value")


def text_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each benchmark item against those of all documents of a source, as multisets."""
    words = lambda t, k: table(spark, sf_dir, t).select(k, F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("text"))
    truth = words("benchmark", F.lit(0).alias("key"))
    got = words("documents", F.lit(0).alias("key"))
    return evaluate.text_recall(truth, got, ["key"]).select("found", "total")


def engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    scores = e.select(
        F.col("event_type").alias("engine"), (k % 90 + 10).alias("cells_compared"), (k % 90).alias("cells_exact"), (k % 40 + 1).alias("numeric_cells"), (k % 40).alias("numeric_exact"),
        ((k % 8) / 8).alias("source_correct"), (k % 1000).cast("double").alias("latency"), (k % 500).cast("double").alias("memory"), (k % 3).alias("missing_rows"), (k % 2).alias("extra_rows"),
    )
    s = evaluate.engine_summary(scores)
    return s.select("engine", "documents", *[F.round(c, 9).alias(c) for c in ("cells", "numeric", "source")], "latency", "memory", "missing_rows", "extra_rows")


def row_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against themselves without their second line."""
    c = order_cells(spark, sf_dir).select(F.col("table_id").alias("doc"), "row", "col", "text")
    return evaluate.align_rows(c, c.filter("row != 1")).select("doc", F.col("truth_row").alias("truth_row"), F.col("got_row").alias("got_row"))


def multipage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("table_id"), F.col("turn").cast("int").alias("segment"), F.posexplode(F.array(F.lit("Speaker"), F.col("role"))).alias("row", "header_text"))
    rows = rows.withColumn("is_header", F.col("row") == 0)
    return grid.joined_segments(rows).select("table_id", "segment", "row", "repeated_header")


def layout_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders drawn as words on pages and read back."""
    c = order_cells(spark, sf_dir).filter("role = 'data'").select("table_id", "row", "col", "text")
    x0 = F.col("col") * 200.0
    words = c.select(F.col("table_id").alias("region_id"), "text", x0.alias("x0"), (x0 + F.length("text") * 5.0).alias("x1"), (500 - F.col("row") * 20.0).alias("y0"), (510 - F.col("row") * 20.0).alias("y1"), F.lit(1.0).alias("score"))
    regions = words.select("region_id").distinct().select("region_id", g.rect(F.lit(-10), F.lit(0), F.lit(900), F.lit(600)).alias("region"))
    return layout.read_grid(words, regions).select("region_id", "row", "col", "text")


QUERIES = {
    f.__name__: f
    for f in (
        type_conversion_failures, leading_zero_codes, missing_source_evidence, low_score_cells, row_structure_gaps, totals_check, duplicate_rows, rule_summaries, unresolved_issues, next_issue, review_disclosure,
        carry_over, carry_over_summary, correction_history, current_version, import_dedupe, content_cache_key, header_similarity, schema_mapping, schema_mismatch, page_to_display, rect_iou, candidate_anti_filter,
        best_candidate, point_hit, csv_lines, formula_guards, export_values, csv_export, selection_copy, column_statistics, column_letters, json_provenance, text_recall, engine_summary, row_alignment, multipage_segments, layout_grid,
    )
}
