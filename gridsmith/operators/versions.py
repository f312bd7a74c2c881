"""Versions of tables: corrections carried to new extractions, edit logs, latest states, imports and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.text import normalized


def carry_over(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """new cells (table_id, row, col, extracted_text, and flags if there are) with what users did to the old ones at the same place.

    old: table_id, row, col, extracted_text, corrected_text, review.  Adds corrected_text, review, flags, old_text and
    action: carried (corrected, source unchanged), conflict (corrected, source changed: kept for review), kept_review,
    new, none.  Carried cells have the flag carriedOver, conflicts reextractionConflict.  The source is unchanged where
    normalized texts agree, or where the texts do if strict.
    """
    o = old.select("table_id", "row", "col", F.col("extracted_text").alias("__old"), F.col("corrected_text").alias("__fix"), F.col("review").alias("__review"), F.lit(True).alias("__had"))
    own = F.col("flags") if "flags" in new.columns else F.array().cast("array<string>")
    d = new.select("table_id", "row", "col", "extracted_text", own.alias("__flags")).join(o, ["table_id", "row", "col"], "left")
    same = F.col("extracted_text") == F.col("__old") if strict else normalized(F.col("extracted_text")) == normalized(F.col("__old"))
    same = F.coalesce(same, F.lit(False))
    fixed = F.col("__fix").isNotNull() & (F.col("__fix") != F.col("__old"))
    reviewed = F.col("__review") == "reviewed"
    action = F.when(F.col("__had").isNull(), "new").when(fixed & same, "carried").when(fixed, "conflict").when(reviewed & same, "kept_review").otherwise("none")
    d = d.withColumn("action", action)
    review = F.when(F.col("action") == "conflict", "needsReview").when(F.col("action").isin("carried", "kept_review"), F.col("__review")).otherwise("unreviewed")
    flag = F.when(F.col("action") == "carried", "carriedOver").when(F.col("action") == "conflict", "reextractionConflict")
    flags = F.when(flag.isNotNull(), F.array_append("__flags", flag)).otherwise(F.col("__flags"))
    fix = F.when(F.col("action").isin("carried", "conflict"), F.col("__fix"))
    return d.select("table_id", "row", "col", "extracted_text", fix.alias("corrected_text"), review.alias("review"), flags.alias("flags"), F.col("__old").alias("old_text"), "action")


def carry_over_log(carried: DataFrame) -> DataFrame:
    """table_id, row, col, kind, before, after: a row for each correction that was carried or is in conflict."""
    d = carried.filter(F.col("action").isin("carried", "conflict"))
    conflict = F.col("action") == "conflict"
    return d.select(
        "table_id", "row", "col", F.when(conflict, "conflict").otherwise("carriedOver").alias("kind"),
        F.when(conflict, F.col("old_text")).otherwise(F.col("extracted_text")).alias("before"), F.when(conflict, F.col("extracted_text")).otherwise(F.col("corrected_text")).alias("after"),
    )


def carried_roles(old_rows: DataFrame, new_rows: DataFrame) -> DataFrame:
    """new_rows (table_id, row, role) with the roles of the old version where both have as many rows."""
    size = lambda d, name: d.groupBy("table_id").agg(F.count("*").alias(name))
    same = size(old_rows, "a").join(size(new_rows, "b"), "table_id").filter("a = b").select("table_id")
    old = old_rows.join(same, "table_id", "left_semi").select("table_id", "row", F.col("role").alias("__role"))
    d = new_rows.join(old, ["table_id", "row"], "left")
    return d.withColumn("role", F.coalesce("__role", "role")).select(*new_rows.columns)


def carry_over_summary(carried: DataFrame, old: DataFrame) -> DataFrame:
    """table_id, carried, conflicts, reviews_kept, unplaced (corrections without a cell in the new version)."""
    counts = carried.groupBy("table_id").agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("carried", "carried"), ("conflict", "conflicts"), ("kept_review", "reviews_kept"))])
    fixed = old.filter("corrected_text is not null and corrected_text != extracted_text")
    lost = fixed.join(carried.select("table_id", "row", "col"), ["table_id", "row", "col"], "left_anti").groupBy("table_id").agg(F.count("*").alias("unplaced"))
    zero = F.lit(0).cast("long")
    out = counts.join(lost, "table_id", "full_outer")
    return out.select("table_id", *[F.coalesce(c, zero).alias(c) for c in ("carried", "conflicts", "reviews_kept", "unplaced")])


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key; the rest of the order breaks ties."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def current_runs(runs: DataFrame) -> DataFrame:
    """The completed run of each table that started last."""
    return latest(runs.filter("status = 'completed'"), ["table_id"], F.col("started_at"), F.col("run_id"))


def shown_runs(runs: DataFrame) -> DataFrame:
    """table_id, run_id, status: the current run, or the last failed one of a table that has none completed."""
    order = F.struct((F.col("status") == "completed").alias("c"), "started_at", "run_id")
    return runs.filter(F.col("status").isin("completed", "failed", "cancelled")).groupBy("table_id").agg(F.max_by(F.struct("run_id", "status"), order).alias("r")).select("table_id", "r.*")


def correction_history(log: DataFrame) -> DataFrame:
    """log (cell_id, created_at, id, before, after) with place from the latest back, the value before, whether it follows on."""
    up = Window.partitionBy("cell_id").orderBy("created_at", "id")
    down = Window.partitionBy("cell_id").orderBy(F.desc("created_at"), F.desc("id"))
    out = log.withColumn("previous_after", F.lag("after").over(up)).withColumn("from_latest", F.row_number().over(down))
    return out.withColumn("follows", F.coalesce(F.col("before").eqNullSafe(F.col("previous_after")) | (F.count("*").over(up) == 1), F.lit(False)))


def set_texts(cells: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells after, log): edits (cell_id, text) that change something; going back to the extracted text clears the
    correction, and a reviewed cell needs review again.
    """
    d = cells.join(edits.select("cell_id", F.col("text").alias("__new")), "cell_id", "left")
    now = F.coalesce("corrected_text", "extracted_text")
    changed = F.col("__new").isNotNull() & (F.col("__new") != now)
    d = d.withColumns({"__now": now, "__changed": changed})
    log = d.filter("__changed").select("table_id", "cell_id", F.lit("edit").alias("kind"), F.col("__now").alias("before"), F.col("__new").alias("after"))
    fixed = F.when(~F.col("__changed"), F.col("corrected_text")).when(F.col("__new") != F.col("extracted_text"), F.col("__new"))
    review = F.when(F.col("__changed") & (F.col("review") == "reviewed"), "needsReview").otherwise(F.col("review"))
    return d.withColumns({"corrected_text": fixed, "review": review}).drop("__new", "__now", "__changed"), log


def set_reviews(cells: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells after, log) of marks (cell_id, review); those that change nothing are not logged."""
    d = cells.join(marks.select("cell_id", F.col("review").alias("__new")), "cell_id", "left").withColumn("__changed", F.coalesce(F.col("__new") != F.col("review"), F.lit(False)))
    log = d.filter("__changed").select("table_id", "cell_id", F.lit("review").alias("kind"), F.col("review").alias("before"), F.col("__new").alias("after"))
    return d.withColumn("review", F.when(F.col("__changed"), F.col("__new")).otherwise(F.col("review"))).drop("__new", "__changed"), log


def undone(log: DataFrame, kind: str = "undo") -> DataFrame:
    """The edits that take a log back, logged themselves."""
    return log.select("table_id", "cell_id", F.lit(kind).alias("kind"), F.col("after").alias("before"), F.col("before").alias("after"))


def column_changes(before: DataFrame, after: DataFrame, fields: tuple[str, ...] = ("type", "name", "unit", "scale", "number_format")) -> DataFrame:
    """table_id, col, field, before, after: a row for each field that an update changes."""
    a = before.select("table_id", "col", *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    d = a.join(after.select("table_id", "col", *fields), ["table_id", "col"])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("before"), F.col(f).cast("string").alias("after")) for f in fields])
    return d.select("table_id", "col", F.explode(F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))).alias("x")).select("table_id", "col", "x.*")


def saved_recipes(stored: DataFrame, incoming: DataFrame, content: list[str]) -> DataFrame:
    """incoming recipes with version: that of the stored one, or the next if the content differs, 1 if there is none."""
    key = F.sha2(F.to_json(F.struct(*content)), 256)
    last = stored.groupBy("recipe_id").agg(F.max(F.struct("version", key.alias("k"))).alias("s"))
    d = incoming.join(last, "recipe_id", "left")
    version = F.when(F.col("s").isNull(), 1).when(F.col("s.k") == key, F.col("s.version")).otherwise(F.col("s.version") + 1)
    return d.select(*incoming.columns, version.alias("version"), (F.col("s").isNull() | (F.col("s.k") != key)).alias("is_new"))


def imported(files: DataFrame, stored: DataFrame) -> DataFrame:
    """files (id, content) with sha256, document_id and is_new: the first file of a content that is not stored is new.

    stored: sha256, document_id.
    """
    d = files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    first = d.groupBy("sha256").agg(F.min("id").alias("__first"))
    d = d.join(first, "sha256").join(stored.select("sha256", F.col("document_id").alias("__stored")), "sha256", "left")
    return d.select("id", "sha256", F.coalesce("__stored", F.col("__first")).alias("document_id"), (F.col("__stored").isNull() & (F.col("id") == F.col("__first"))).alias("is_new"))


def cache_key(document_sha: Column, engine: Column, segments: Column) -> Column:
    return F.sha2(F.concat_ws("|", document_sha, engine, segments), 256)


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached payload, requests without one).  requests: key and more; cache: key, payload, stored_at.

    The last payload of a key counts; putting is an append of rows to the cache, clearing a new, empty cache.
    """
    last = latest(cache, ["key"], F.col("stored_at")).select("key", "payload")
    return requests.join(last, "key"), requests.join(last, "key", "left_anti")


def snapshots(tables: DataFrame, documents: DataFrame, runs: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of each table's current run with table and document; tables without a current run have none."""
    t = tables.filter("current_run_id is not null").select("table_id", "document_id", F.col("name").alias("table_name"), F.col("current_run_id").alias("run_id"))
    return cells.join(t.join(runs.select("run_id"), "run_id"), ["table_id", "run_id"]).join(documents.select("document_id", "filename", "sha256"), "document_id")


def without_deleted(rows: DataFrame, deleted: DataFrame, key: str = "document_id") -> DataFrame:
    """What stays of a dependent table once keys are deleted."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")
