"""Queries through a store: versions that are committed, reviewed and deleted, settings that retype columns, scores of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.operators import evaluate, versions, workflow
from gridsmith.plans.fixtures import money, order_lines
from gridsmith.sources.scratch import scratch_path, written
from gridsmith.sources.store import Store


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, row (from 1), part, cents: the lines of each order, put together and numbered once for all that is made of them."""
    return written(order_lines(spark, sf_dir).select("table_id", (F.col("row") + 1).alias("row"), "part", "cents"))


def _first(lines: DataFrame) -> DataFrame:
    """The first extraction: lines up to the sixth, a quarter corrected, a third reviewed."""
    fixed, seen = F.when(F.col("part") % 4 == 0, "corrected"), F.when(F.col("part") % 3 == 0, "reviewed").otherwise("unreviewed")
    return lines.filter("row < 7").select("table_id", "row", F.lit(0).alias("col"), money(F.col("cents")).alias("extracted_text"), fixed.alias("corrected_text"), seen.alias("review"))


def _second(lines: DataFrame) -> DataFrame:
    """The second extraction: lines from the second on, with other marks, a fifth with another price."""
    changed = F.when(F.col("part") % 5 == 0, F.col("cents") + 1).otherwise(F.col("cents"))
    return lines.filter("row > 1").select("table_id", "row", F.lit(0).alias("col"), F.concat(F.lit(" "), money(changed, ".", ",")).alias("extracted_text"))


def _stored(spark: SparkSession, lines: DataFrame) -> Store:
    """A store with a first run of every order, of documents of fifty."""
    store = Store(spark, scratch_path(spark))
    old = _first(lines)
    run = F.concat(F.lit("a"), F.col("table_id"))
    tables = lines.filter("row = 1").select("table_id")
    document = (F.col("table_id") % 50).alias("document_id")
    store.commit({
        "documents": tables.select(document).distinct(), "tables": tables.select("table_id", document, run.alias("current_run_id")), "runs": tables.select(run.alias("run_id"), "table_id", F.lit("completed").alias("status")),
        "cells": old.select(run.alias("run_id"), "row", "col", "extracted_text", "corrected_text", "review"),
    })
    return store


def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells after three commits: a first run, a second one that corrections carry over to, and a review of some conflicts."""
    lines = _lines(spark, sf_dir)
    store = _stored(spark, lines)
    carried = versions.carry_over(workflow.current_cells(store), _second(lines))
    run = F.concat(F.lit("b"), F.col("table_id"))
    tables = lines.filter("row = 2").select("table_id")
    store.commit({
        "cells": carried.select(run.alias("run_id"), "row", "col", "extracted_text", "corrected_text", "review", "flags"), "runs": tables.select(run.alias("run_id"), "table_id", F.lit("completed").alias("status")),
        "tables": tables.select("table_id", run.alias("current_run_id")),
    })
    base = store.version()
    cells = workflow._with_ids(workflow.current_cells(store, base).select("table_id", "run_id", "row", "col", "corrected_text", "review"))
    chosen = cells.filter("review = 'needsReview' and row % 3 = 0").persist()
    workflow.mark_reviews(store, chosen.select("cell_id", F.lit("reviewed").alias("review")), chosen, base)
    chosen.unpersist()
    return workflow.current_cells(store).select("table_id", "run_id", "row", "corrected_text", "review", F.array_join("flags", ",").alias("flags"))


def stored_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of cells once every tenth document is deleted with all that hangs on it."""
    store = _stored(spark, _lines(spark, sf_dir))
    store.delete("documents", store.current("documents").filter("document_id % 10 = 0"))
    return workflow.current_cells(store).select("table_id", "run_id", "row", "corrected_text", "review")


def settings_retyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with three decimals, which read in two ways, as text columns: a format set for every third order retypes its column, but not a confirmed one."""
    lines = order_lines(spark, sf_dir).filter("cents > 999")
    price = F.concat(F.lpad((F.col("cents") % 999 + 1).cast("string"), 3, "1"), F.lit(","), F.lpad((F.col("cents") % 1000).cast("string"), 3, "0"))
    cells = lines.select("table_id", (F.col("row") + 1).alias("row"), F.lit(0).alias("col"), price.alias("text"))
    rows = cells.select("table_id", "row", F.lit("data").alias("role"))
    tables = lines.select("table_id").distinct()
    columns = tables.select("table_id", F.lit(0).alias("col"), F.lit("Price").alias("name"), F.lit("text").alias("type"), F.lit("Price").alias("source_header"), (F.col("table_id") % 2 == 0).alias("type_confirmed"))
    settings = tables.select("table_id", F.lit("auto").alias("number_format"), F.lit("auto").alias("date_order"))
    changes = tables.filter("table_id % 3 = 0").select("table_id", F.lit("commaDecimal").alias("number_format"), F.lit("auto").alias("date_order"))
    after, retyped, log = workflow.updated_settings(settings, changes, columns, cells, rows)
    d = retyped.join(after, "table_id").join(log.select("table_id", "detail"), "table_id", "left")
    return d.select("table_id", "type", "type_confirmed", "number_format", F.coalesce("detail", F.lit("")).alias("detail"))


def cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as read by an engine that misses lines, decimals of some prices and zeros of some codes, scored by table."""
    lines = order_lines(spark, sf_dir)
    code, price = F.lpad(F.col("part").cast("string"), 8, "0"), money(F.col("cents"))
    bad_code, bad_price = F.when(F.col("part") % 7 == 0, F.col("part").cast("string")).otherwise(code), F.when(F.col("part") % 5 == 0, money(F.col("cents") + 1)).when(F.col("part") % 3 == 0, F.replace(price, F.lit(","), F.lit(""))).otherwise(price)
    each = lambda a, b, day: F.posexplode(F.array(a, b, day)).alias("col", "text")
    day = F.date_format("day", "dd MMM yyyy")
    base = lines.select(F.col("table_id").alias("doc"), "row", each(code, price, day))
    kind = F.element_at(F.array(F.lit("identifier"), F.lit("decimal"), F.lit("text")), F.col("col") + 1)
    truth = base.select("*", kind.alias("type"), F.lit(False).alias("is_header"), F.lit(".").alias("decimal"), F.lit(",").alias("grouping"))
    got = lines.filter("row != 2").select(F.col("table_id").alias("doc"), F.when(F.col("row") > 2, F.col("row") - 1).otherwise(F.col("row")).alias("row"), each(bad_code, bad_price, day))
    pairs = lines.filter("row != 2").select(F.col("table_id").alias("doc"), F.col("row").alias("truth_row"), F.when(F.col("row") > 2, F.col("row") - 1).otherwise(F.col("row")).alias("got_row"))
    return evaluate.cell_scores(truth, got, pairs)


QUERIES = {f.__name__: f for f in (stored_versions, stored_deletes, settings_retyped, cell_scores)}
_LINE = "(select l_orderkey t, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1)::int r, l_partkey p, cast(round(l_extendedprice * 100) as bigint) c from lineitem)"
_LINES = f"l as (select t, r + 1 r, p from {_LINE})"
ORACLES = {
    "stored_versions": f"""
with {_LINES},
a as (
  select *, p % 3 = 0 seen, case when r >= 7 then 'new' when p % 4 = 0 and p % 5 != 0 then 'carried' when p % 4 = 0 then 'conflict' when p % 3 = 0 and p % 5 != 0 then 'kept_review' else 'none' end action
  from l where r > 1),
second as (
  select t table_id, concat('b', t) run_id, r as row, if(action in ('carried', 'conflict'), 'corrected', null) corrected_text,
    case when action = 'conflict' then if(r % 3 = 0, 'reviewed', 'needsReview') when action in ('carried', 'kept_review') and seen then 'reviewed' else 'unreviewed' end review,
    case action when 'carried' then 'carriedOver' when 'conflict' then 'reextractionConflict' else '' end flags
  from a)
select * from second
union all select t, concat('a', t), r, if(p % 4 = 0, 'corrected', null), if(p % 3 = 0, 'reviewed', 'unreviewed'), null from l where r < 7 and t not in (select table_id from second)""",
    "stored_deletes": f"""
with {_LINES}
select t table_id, concat('a', t) run_id, r as row, if(p % 4 = 0, 'corrected', null) corrected_text, if(p % 3 = 0, 'reviewed', 'unreviewed') review from l where r < 7 and t % 50 % 10 != 0""",
    "settings_retyped": f"""
select t table_id, if(t % 3 = 0 and t % 2 = 1, 'decimal', 'text') as type, t % 2 = 0 type_confirmed, if(t % 3 = 0, 'commaDecimal', 'auto') number_format, if(t % 3 = 0, 'number format commaDecimal, date order auto', '') detail
from (select distinct t from {_LINE} where c > 999)""",
    "cell_scores": f"""
select t doc, 3 * count(*) compared, sum(1 + if(p % 7 = 0 and p < 10000000, 0, 1) + if(p % 5 = 0 or p % 3 = 0 and c > 99999, 0, 1))::bigint exact, count(*) as numeric, count_if(p % 5 != 0)::bigint numeric_exact,
  count(*) zeros, count_if(p % 7 != 0)::bigint zeros_kept
from {_LINE} where r != 2 group by t""",
}
