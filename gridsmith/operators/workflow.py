"""The life of a table: creation, extraction into a new version, roles, settings, recipes over many documents.

Each step takes and gives DataFrames of all tables at once; nothing is updated in place.  The steps that keep what they
did (commit_extraction, choose_run, edit_texts, mark_reviews, take_back) write to a store: rows, log and the pointer to a table's current run
are one commit of it, which is there as a whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.text import column_letter, next_table_name
from gridsmith.operators import grid, recipes, versions
from gridsmith.operators.normalize import infer_types, with_readings
from gridsmith.sources.store import Store


def created_tables(segments: DataFrame, existing: DataFrame, recipe: DataFrame | None = None) -> DataFrame:
    """New tables of documents: table_id, document_id, name, number_format, date_order, recipe_id, recipe_version.

    segments: table_id, document_id, name (or null), number_format, date_order.  existing: table_id, document_id.  Names
    that are missing count on from the tables of the document, in table_id order.  recipe (table_id, recipe_id, version,
    number_format, date_order): its settings stand in for those given.
    """
    n = existing.groupBy("document_id").agg(F.count("*").alias("__n"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("table_id")) - 1
    d = segments.withColumn("__p", place).join(n, "document_id", "left")
    d = d.withColumn("name", F.coalesce("name", next_table_name(F.coalesce("__n", F.lit(0)) + F.col("__p"))))
    if recipe is None:
        return d.select("table_id", "document_id", "name", "number_format", "date_order", F.lit(None).cast("string").alias("recipe_id"), F.lit(None).cast("int").alias("recipe_version"))
    r = recipe.select("table_id", "recipe_id", F.col("version").alias("recipe_version"), F.col("number_format").alias("__f"), F.col("date_order").alias("__o"))
    d = d.join(r, "table_id", "left")
    return d.select("table_id", "document_id", "name", F.coalesce("__f", "number_format").alias("number_format"), F.coalesce("__o", "date_order").alias("date_order"), "recipe_id", "recipe_version")


def _hints(settings: DataFrame) -> DataFrame:
    """table_id, hint: the decimal mark of a table's format, null where its data tell."""
    fixed = F.when(F.col("number_format").isin("pointDecimal", "apostrophePointDecimal"), ".").when(F.col("number_format").isin("commaDecimal", "spaceCommaDecimal"), ",")
    return settings.select("table_id", fixed.alias("hint"))


def suggested_types(cells: DataFrame, rows: DataFrame, headers: DataFrame, settings: DataFrame) -> DataFrame:
    """table_id, col, type: what the texts of data rows suggest, under the table's number format."""
    data = cells.join(rows.filter("role = 'data'").select("table_id", "row"), ["table_id", "row"], "left_semi").select("table_id", "row", "col", "text")
    return infer_types(with_readings(data), headers, hints=_hints(settings), by_data=True)


def built_version(extracted: DataFrame, sizes: DataFrame, settings: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, rows, columns) of new extractions.

    extracted: table_id, row, col, row_span, col_span, text, arrival.  sizes: table_id, n_rows, n_cols, header_rows and
    repeated (array of rows that repeat a header).  settings: table_id, number_format.  existing: columns so far.
    """
    cells = grid.filled_grid(extracted, sizes)
    listed = sizes.filter("n_rows > 0").select("table_id", "header_rows", "repeated", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))
    listed = listed.withColumn("repeated_header", F.coalesce(F.array_contains("repeated", F.col("row")), F.lit(False)))
    rows = grid.row_roles(cells, listed, F.col("header_rows")).select("table_id", "row", "role")
    every = sizes.filter("n_cols > 0").select("table_id", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    headers = every.join(grid.header_texts(cells, rows), ["table_id", "col"], "left").withColumn("header", F.coalesce("header", F.lit("")))
    columns = grid.column_specs(headers, suggested_types(cells, rows, headers, settings), existing)
    return cells, rows, columns


def committed(extracted: DataFrame, sizes: DataFrame, tables: DataFrame, old_cells: DataFrame, old_rows: DataFrame, old_columns: DataFrame, recipe: DataFrame | None = None) -> dict[str, DataFrame]:
    """A new version of every table: cells, rows, columns, log, summary and runs (table_id, run_id, status, n_cols).

    The version is built, corrections and reviews of the current one carry over by place, roles where both have as
    many rows, and recipe columns (table_id, target, name, names, type, unit, scale, number_format) overwrite what
    their headers match.  tables: table_id, number_format, run_id (of the new run).  Tables without an extraction keep
    their version; nothing of the old one changes.
    """
    cells, rows, columns = built_version(extracted, sizes, tables.select("table_id", "number_format"), old_columns)
    carried = versions.carry_over(old_cells, cells.withColumnRenamed("text", "extracted_text"))
    rows = versions.carried_roles(old_rows, rows)
    spans = cells.select("table_id", "row", "col", "row_span", "col_span")
    for name in ("unit", "scale", "number_format"):
        if name not in columns.columns:
            columns = columns.withColumn(name, F.lit("1" if name == "scale" else "auto" if name == "number_format" else ""))
    if recipe is not None:
        mapping = recipes.map_columns(recipes.header_scores(columns.select("table_id", "col", F.col("source_header").alias("header")), recipe.select("table_id", "target", "names")))
        columns = recipes.apply_columns(columns, mapping, recipe)
    runs = sizes.select("table_id", "n_cols").join(tables.select("table_id", "run_id"), "table_id").withColumn("status", F.lit("completed"))
    return {
        "cells": carried.join(spans, ["table_id", "row", "col"]), "rows": rows, "columns": columns, "log": versions.carry_over_log(carried), "summary": versions.carry_over_summary(carried, old_cells), "runs": runs,
    }


def set_current(columns: DataFrame, runs: DataFrame) -> DataFrame:
    """Columns once runs (table_id, status, n_cols) become current: those of a run with another number of columns are new.

    A run that is not completed never becomes current.
    """
    n = columns.groupBy("table_id").agg(F.count("*").alias("__n"))
    r = runs.filter("status = 'completed'").join(n, "table_id", "left")
    changed = r.filter("__n is null or __n != n_cols")
    fresh = changed.filter("n_cols > 0").select("table_id", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    fresh = fresh.select("table_id", "col", F.concat(F.lit("Column "), column_letter(F.col("col"))).alias("name"), F.lit("text").alias("type"), F.lit("").alias("source_header"), F.lit(False).alias("type_confirmed"))
    kept = columns.join(changed.select("table_id"), "table_id", "left_anti").select("table_id", "col", "name", "type", "source_header", "type_confirmed")
    return kept.unionByName(fresh)


def set_roles(rows: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, log): changes (table_id, row, role) of rows that are there; those that change nothing are not logged."""
    d = rows.join(changes.select("table_id", "row", F.col("role").alias("__new")), ["table_id", "row"], "left").withColumn("__changed", F.coalesce(F.col("__new") != F.col("role"), F.lit(False)))
    log = d.filter("__changed").select("table_id", "row", F.lit("rowRole").alias("kind"), F.col("role").alias("before"), F.col("__new").alias("after"))
    return d.withColumn("role", F.when(F.col("__changed"), F.col("__new")).otherwise(F.col("role"))).select(*rows.columns), log


def refreshed_names(columns: DataFrame, headers: DataFrame) -> DataFrame:
    """columns with the headers of the header rows as they are now; a name that came from a header, or from the column's letter, follows it."""
    letter = F.concat(F.lit("Column "), column_letter(F.col("col")))
    d = columns.join(headers.select("table_id", "col", F.col("header").alias("__h")), ["table_id", "col"], "left").withColumn("__h", F.coalesce("__h", F.lit("")))
    derived = (F.col("name") == F.col("source_header")) | (F.col("name") == letter)
    name = F.when(derived, F.when(F.col("__h") == "", letter).otherwise(F.col("__h"))).otherwise(F.col("name"))
    return d.withColumns({"name": name, "source_header": F.col("__h")}).select(*columns.columns)


def updated_settings(settings: DataFrame, changes: DataFrame, columns: DataFrame, cells: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settings, columns, log) after changes (table_id, number_format, date_order).

    Where the number format changes, the types of columns that are not confirmed are suggested anew; other tables'
    cells are not read.  Changes to what is already set are not logged.
    """
    d = settings.join(changes.select("table_id", F.col("number_format").alias("__f"), F.col("date_order").alias("__o")), "table_id", "left")
    d = d.withColumns({"__a": F.coalesce(F.col("__f") != F.col("number_format"), F.lit(False)), "__b": F.coalesce(F.col("__o") != F.col("date_order"), F.lit(False))})
    detail = F.concat(F.lit("number format "), "__f", F.lit(", date order "), "__o")
    log = d.filter("__a or __b").select("table_id", F.lit("tableSettings").alias("kind"), detail.alias("detail"))
    after = d.withColumns({"number_format": F.coalesce("__f", "number_format"), "date_order": F.coalesce("__o", "date_order")}).select(*settings.columns)
    touched = d.filter("__a").select("table_id")
    some = lambda x: x.join(touched, "table_id", "left_semi")
    headers = some(columns).select("table_id", "col", F.col("source_header").alias("header"))
    types = suggested_types(some(cells), some(rows), headers, some(after)).select("table_id", "col", F.col("type").alias("__t"))
    retyped = columns.join(types, ["table_id", "col"], "left")
    retyped = retyped.withColumn("type", F.when(F.col("type_confirmed"), F.col("type")).otherwise(F.coalesce("__t", "type"))).select(*columns.columns)
    return after, retyped, log


def run_queue(jobs: DataFrame, extract: Callable[[DataFrame], DataFrame], cancelled: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(status of each job, cells of those that succeeded): a recipe over many documents in one go.

    extract takes the jobs that are not cancelled and gives their cells with job_id, and error (null where all is
    well); a job that fails is a row with its error and stops no other one.  Cancelled jobs count as failed.
    """
    stop = F.lit(False) if cancelled is None else cancelled
    done = extract(jobs.filter(~stop))
    errors = done.groupBy("job_id").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("cells"))
    d = jobs.withColumn("__stop", stop).join(errors, "job_id", "left")
    why = F.when(F.col("__stop"), "cancelled").when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("cells", F.lit(0)) == 0, "no table found")
    status = d.withColumn("error", why).withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed")).drop("__stop", "cells")
    return status, done.join(status.filter("status = 'completed'").select("job_id"), "job_id", "left_semi").drop("error")


def persisted_checks(results: DataFrame, summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """What the store keeps of an evaluation: table_id, run_id, kind (result or summary) and json, to be appended by sinks.append()."""
    keep = lambda d, kind: d.join(runs.select("table_id", "run_id"), "table_id").select("table_id", "run_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(c for c in d.columns if c != "table_id"))).alias("json"))
    return reduce(DataFrame.unionByName, [keep(results, "result"), keep(summaries, "summary")])


_OLD_CELLS = "table_id long, run_id string, row int, col int, extracted_text string, corrected_text string, review string"
_OLD_COLUMNS = "table_id long, col int, name string, type string, source_header string, type_confirmed boolean"


def _pointers(store: Store, at: int | None = None) -> DataFrame:
    """table_id, run_id: the current run of each table that has one."""
    return store.current("tables", at, "table_id long, current_run_id string").filter("current_run_id is not null").select("table_id", F.col("current_run_id").alias("run_id"))


def current_cells(store: Store, at: int | None = None, places: DataFrame | None = None) -> DataFrame:
    """Cells of every table's current run, or those of them at places (run_id, row, col, each once); other runs' cells are not put together."""
    runs = _pointers(store, at)
    return store.current("cells", at, _OLD_CELLS, runs if places is None else places.join(runs, "run_id"))


def _logged(log: DataFrame, version: int) -> DataFrame:
    """Log rows with an id of their own: of the commit, the place and the kind."""
    at = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("table_id", "row", "col", "kind")]
    return log.withColumns({"correction_id": F.sha2(F.concat_ws("|", F.lit(version), *at), 256), "in_version": F.lit(version)})


def commit_extraction(store: Store, extracted: DataFrame, sizes: DataFrame, tables: DataFrame, failed: DataFrame | None = None, recipe: DataFrame | None = None) -> int:
    """The new versions of committed() in the store, made current; its version.

    tables: table_id, number_format, run_id.  failed: table_id, run_id, error, cancelled, of extractions that came to
    nothing: they are runs with their error, and their tables keep the version they have, as all do where the commit
    does not come to its end.  The state that corrections carry over from is that of the version before this one; if
    another commit comes between, store.Conflict is raised and nothing has changed.
    """
    base = store.version()
    old = current_cells(store, base)
    old_rows = store.current("rows", base, "run_id string, row int, role string", _pointers(store, base)).select("table_id", "row", "role")
    if failed is not None:
        sizes = sizes.join(failed.select("table_id"), "table_id", "left_anti")
        extracted = extracted.join(failed.select("table_id"), "table_id", "left_anti")
    out = committed(extracted, sizes, tables, old, old_rows, store.current("columns", base, _OLD_COLUMNS), recipe)
    runs = out["runs"].select("table_id", "run_id", "status", "n_cols", F.lit(None).cast("string").alias("error"))
    pointed = runs.select("table_id", F.col("run_id").alias("current_run_id"))
    if failed is not None:
        runs = runs.unionByName(failed.select("table_id", "run_id", F.when(F.col("cancelled"), "cancelled").otherwise("failed").alias("status"), F.lit(None).cast("int").alias("n_cols"), "error"))
    of_run = lambda d: d.join(tables.select("table_id", "run_id"), "table_id")
    cells = of_run(out["cells"]).select("run_id", "row", "col", "row_span", "col_span", "extracted_text", "corrected_text", "review", "flags")
    rows = of_run(out["rows"]).select("run_id", "row", "role")
    return store.commit({"cells": cells, "rows": rows, "columns": out["columns"], "runs": runs, "tables": pointed, "corrections": _logged(out["log"], base + 1)}, base=base)


def choose_run(store: Store, chosen: DataFrame) -> int:
    """Makes runs (table_id, run_id) current; those that are not completed, or of another table, change nothing."""
    base = store.version()
    runs = store.current("runs", base).join(chosen.select("table_id", "run_id"), ["table_id", "run_id"]).filter("status = 'completed'")
    columns = store.current("columns", base, _OLD_COLUMNS)
    own = columns.join(runs.select("table_id"), "table_id", "left_semi")
    fresh = set_current(own, runs.select("table_id", "status", "n_cols"))
    return store.commit({"tables": runs.select("table_id", F.col("run_id").alias("current_run_id")), "columns": fresh}, deleted={"columns": own}, base=base)


def _with_ids(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cell_id", F.concat_ws(":", "run_id", "row", "col"))


def _places(ids: DataFrame) -> DataFrame:
    """run_id, row, col: where cell ids lead to, each once."""
    part = lambda i: F.regexp_extract("cell_id", r"(?s)^(.*):(-?\d+):(-?\d+)$", i)
    return ids.select(part(1).alias("run_id"), part(2).try_cast("int").alias("row"), part(3).try_cast("int").alias("col")).distinct()


def _edited(store: Store, edits: DataFrame, change: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], reads: tuple[str, ...] = ("extracted_text", "corrected_text", "review"), cells: DataFrame | None = None, base: int | None = None) -> int:
    """One commit of what a change does, by edits (cell_id and more), to the cells' corrected_text and review, and of its log.

    Of a cell's edits one counts.  Edits, and what the change reads of the cells that they name, are kept while the commit's parts read them;
    other cells are not put together.  cells, base: those cells, as the caller has read them at a version.
    """
    base = store.version() if base is None else base
    edits = edits.dropDuplicates(["cell_id"]).persist()
    cells = current_cells(store, base, _places(edits)) if cells is None else cells
    cells = _with_ids(cells.select("table_id", "run_id", "row", "col", *reads)).persist()
    try:
        after, log = change(cells, edits)
        places = cells.select("cell_id", "run_id", "row", "col")
        touched = after.join(log.select("cell_id").distinct(), "cell_id", "left_semi").select("run_id", "row", "col", "corrected_text", "review")
        return store.commit({"cells": touched, "corrections": _logged(log.join(places, "cell_id"), base + 1)}, base=base)
    finally:
        cells.unpersist()
        edits.unpersist()


def edit_texts(store: Store, edits: DataFrame) -> int:
    """Stores edits (cell_id, text) of current cells, in bulk, with their log; the extracted text takes a correction back."""
    return _edited(store, edits, versions.set_texts)


def mark_reviews(store: Store, marks: DataFrame, cells: DataFrame | None = None, base: int | None = None) -> int:
    """Stores review states (cell_id, review) of current cells with their log.

    cells, base: current_cells() at a version, or those of them that marks name, where marks were made of them: they are not read again,
    and store.Conflict is raised if another commit has come since.
    """
    if (cells is None) != (base is None):
        raise ValueError("cells are given with the version that they were read at")
    return _edited(store, marks, versions.set_reviews, ("corrected_text", "review"), cells, base)


def cleared(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edits (cell_id, text) that empty the chosen cells."""
    return cells.join(chosen.select("cell_id"), "cell_id", "left_semi").select("cell_id", F.lit("").alias("text"))


def restored(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edits (cell_id, text) that give the chosen cells the text that was extracted."""
    return cells.join(chosen.select("cell_id"), "cell_id", "left_semi").filter("corrected_text is not null").select("cell_id", F.col("extracted_text").alias("text"))


def take_back(store: Store, version: int) -> int:
    """Undoes the edits that a version logged, where the cells still have what it gave them; a commit of its own."""
    log = store.current("corrections").filter((F.col("in_version") == version) & F.col("kind").isin("edit", "undo", "redo"))
    edits = log.select("cell_id", F.col("before").alias("text"), F.col("after").alias("__after"))

    def change(cells: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
        same = cells.select("cell_id", F.coalesce("corrected_text", "extracted_text").alias("__now"))
        still = edits.join(same, "cell_id").filter(F.col("__now") == F.col("__after"))
        after, done = versions.set_texts(cells, still.select("cell_id", "text"))
        return after, done.withColumn("kind", F.lit("undo"))

    return _edited(store, edits, change)
