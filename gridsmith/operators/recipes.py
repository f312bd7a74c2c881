"""Recipes: saved schemas found again in other documents, by header similarity and by place on the page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.geometry import area, contains, inset, intersection_area, iou, max_x, max_y, rect, union_all
from gridsmith.functions.text import similarity
from gridsmith.operators.layout import word_lines


def header_scores(headers: DataFrame, recipe: DataFrame) -> DataFrame:
    """table_id, col, target, score: the best similarity of a header with a recipe column's names.

    headers: table_id, col, header.  recipe: table_id, target, names (array).  Columns of one table meet only those of
    its recipe.
    """
    d = headers.join(recipe, "table_id").withColumn("score", F.array_max(F.transform("names", lambda n: similarity(F.col("header"), n))))
    return d.select("table_id", "col", "target", "score")


def map_columns(scores: DataFrame, least: float = 0.8) -> DataFrame:
    """table_id, col, target: headers in order, each with the best target left, the first of equals.

    The scores of a table (columns x recipe columns) are folded in order; a fold has a table's few dozen columns.
    """
    good = scores.filter(F.col("score") >= least)
    listed = good.groupBy("table_id", "col").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "target"))).alias("options"))
    tables = listed.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col", "options"))).alias("cols"))
    kind = "array<struct<col:int,target:int>>"

    def step(acc: Column, c: Column) -> Column:
        free = F.filter(c["options"], lambda o: ~F.exists(acc, lambda a: a["target"] == o["target"]))
        return F.when(F.size(free) > 0, F.array_append(acc, F.struct(c["col"].cast("int").alias("col"), F.get(free, F.lit(0))["target"].cast("int").alias("target")))).otherwise(acc)

    folded = tables.select("table_id", F.explode(F.aggregate("cols", F.array().cast(kind), step)).alias("m"))
    return folded.select("table_id", "m.col", "m.target")


def apply_columns(columns: DataFrame, mapping: DataFrame, recipe: DataFrame) -> DataFrame:
    """columns with the mapped recipe columns' name, type, unit, scale and number format, confirmed; `matched` tells them.

    Where the numbers of columns agree, a column without a source header takes the recipe's at its place.
    """
    n = columns.groupBy("table_id").agg(F.count("*").alias("__n")).join(recipe.groupBy("table_id").agg(F.count("*").alias("__m")), "table_id")
    d = columns.join(n, "table_id", "left").join(mapping.select("table_id", "col", F.col("target").alias("__t")), ["table_id", "col"], "left")
    by_place = (F.col("__n") == F.col("__m")) & (F.coalesce("source_header", F.lit("")) == "")
    d = d.withColumn("__target", F.coalesce("__t", F.when(by_place, F.col("col"))))
    r = recipe.select("table_id", F.col("target").alias("__target"), *[F.col(f).alias(f"r_{f}") for f in ("name", "type", "unit", "scale", "number_format")])
    d = d.join(r, ["table_id", "__target"], "left")
    hit = F.col("r_name").isNotNull()
    return d.select("table_id", "col", *[F.when(hit, F.col(f"r_{f}")).otherwise(F.col(f)).alias(f) for f in ("name", "type", "unit", "scale", "number_format")], "source_header", (F.col("type_confirmed") | hit).alias("type_confirmed"), hit.alias("matched"))


def best_candidates(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, candidate_id: the candidate of the page that shares most area, at least half of the smaller one.

    wanted: id, document_id, page, region.  candidates: candidate_id, document_id, page, box.
    """
    d = wanted.join(candidates, ["document_id", "page"]).withColumn("__a", intersection_area(F.col("region"), F.col("box")))
    d = d.filter((F.col("__a") > 0) & (F.col("__a") >= 0.5 * F.least(area(F.col("region")), area(F.col("box")))))
    return d.groupBy("id").agg(F.max_by("candidate_id", F.struct("__a", (-F.col("candidate_id")).alias("t"))).alias("candidate_id"))


def new_candidates(candidates: DataFrame, existing: DataFrame, most: float = 0.5) -> DataFrame:
    """Candidates that no existing segment of their page overlaps by more than `most` of the union."""
    e = existing.select(F.col("document_id").alias("__d"), F.col("page").alias("__p"), F.col("region").alias("__r"))
    return candidates.join(e, (F.col("document_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (iou(F.col("box"), F.col("__r")) > most), "left_anti")


def first_hits(points: DataFrame, *layers: DataFrame) -> DataFrame:
    """point_id, layer, cell_id: the hit of the first of layers (candidates, cells, other tables) that has one."""
    found = [hit_cells(points, d).withColumn("layer", F.lit(i)) for i, d in enumerate(layers)]
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("point_id").agg(F.min(F.struct("layer", "cell_id")).alias("x")).select("point_id", "x.layer", "x.cell_id")


def hit_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """point_id, cell_id: the first cell of the page with a region, one point wider, that holds the point.

    points: point_id, document_id, page, x, y.  cells: cell_id, place, document_id, page, regions.
    """
    d = points.join(cells, ["document_id", "page"])
    d = d.filter(F.exists("regions", lambda r: contains(inset(r, -1.0), F.col("x"), F.col("y"))))
    return d.groupBy("point_id").agg(F.min_by("cell_id", "place").alias("cell_id"))


def nearest_anchors(found: DataFrame) -> DataFrame:
    """found (id, page, occurrence, page_hint, ...): the occurrence on the page nearest to the hint, the first of equals."""
    w = Window.partitionBy("id").orderBy(F.abs(F.col("page") - F.coalesce("page_hint", F.lit(0))), "page", "occurrence")
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def located(anchors: DataFrame, offset: str = "offset") -> DataFrame:
    """id, page, region: the anchor's box moved by the recipe's offset, or the hint scaled to the page where none was found.

    anchors: id, page, box (null where not found), offset, hint, page_width, page_height, hint_page.
    """
    b, o, h = F.col("box"), F.col(offset), F.col("hint")
    moved = F.struct((b["x"] + o["x"]).alias("x"), (b["y"] + o["y"]).alias("y"), o["width"].alias("width"), o["height"].alias("height"))
    hinted = F.struct((h["x"] * F.col("page_width")).alias("x"), (h["y"] * F.col("page_height")).alias("y"), (h["width"] * F.col("page_width")).alias("width"), (h["height"] * F.col("page_height")).alias("height"))
    return anchors.select("id", F.when(b.isNotNull(), F.col("page")).otherwise(F.col("hint_page")).alias("page"), F.when(b.isNotNull(), moved).otherwise(hinted).alias("region"))


def extended_down(lines: DataFrame) -> DataFrame:
    """id, bottom: how far a region reaches down over the lines below while gaps stay within 1.6 of the median pitch.

    lines: id, y (middle), min_y, n_tokens, inside (already in the region).
    """
    down = Window.partitionBy("id").orderBy(F.desc("y"))
    d = lines.withColumn("__gap", F.lag("y").over(down) - F.col("y"))
    pitch = d.filter("inside").groupBy("id").agg(F.median("__gap").alias("pitch"))
    d = d.join(pitch, "id")
    breaks = ~F.col("inside") & ((F.col("__gap") > 1.6 * F.col("pitch")) | (F.col("n_tokens") < 2) | F.col("__gap").isNull())
    d = d.withColumn("__stop", F.sum(breaks.cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0))).filter("__stop = 0")
    return d.groupBy("id").agg((F.min("min_y") - 1).alias("bottom"))


def found_anchors(lines: DataFrame, recipes: DataFrame) -> DataFrame:
    """id, page, occurrence, page_hint, box: places where a recipe's anchor text stands in a line, in any case.

    lines: document_id, page, line, words (array<struct<x0, text, x1, y0, y1>> from left to right).  recipes: id,
    document_id, anchor_text, page_hint.  A line's first match counts; the box is that of the words it touches.
    """
    text = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    d = lines.join(recipes.filter("anchor_text != ''"), "document_id").withColumn("__at", F.instr(F.lower(text), F.lower("anchor_text"))).filter("__at > 0")
    upto = lambda i: F.aggregate(F.slice("words", F.lit(1), i), F.lit(1), lambda a, w: a + F.length(w["text"]) + 1)
    placed = d.withColumn("__w", F.transform("words", lambda w, i: F.struct(upto(i).alias("a"), w.alias("w"))))
    end = F.col("__at") + F.length("anchor_text")
    hit = placed.withColumn("__w", F.filter("__w", lambda e: (e["a"] < end) & (e["a"] + F.length(e["w"]["text"]) > F.col("__at"))))
    boxes = F.transform("__w", lambda e: rect(e["w"]["x0"], e["w"]["y0"], e["w"]["x1"] - e["w"]["x0"], e["w"]["y1"] - e["w"]["y0"]))
    return hit.select("id", "document_id", "page", F.col("line").alias("occurrence"), "page_hint", union_all(boxes).alias("box"))


def within(region: Column, width: Column, height: Column) -> Column:
    """region without what lies outside a display of that size."""
    x, y = F.greatest(region["x"], F.lit(0.0)), F.greatest(region["y"], F.lit(0.0))
    return rect(x, y, F.least(max_x(region), width) - x, F.least(max_y(region), height) - y)


def located_tables(recipes: DataFrame, words: DataFrame, pages: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """id, document_id, page, region, method: where a recipe's table is in other documents, on the display of the page.

    recipes: id, document_id, anchor_text, offset and hint (rectangles), page_hint.  words: document_id, page, text, x0,
    x1, y0, y1.  pages: document_id, page, width, height.  The anchor nearest to the hinted page moves the region by the
    offset; without one the hint is scaled to its page, or the last there is.  A candidate (candidate_id, document_id,
    page, box) that covers most of it takes its place.  The region grows down over the lines that follow, before
    candidates are chosen, and that of a candidate again.
    """
    lines = word_lines(words.select(F.struct("document_id", "page").alias("region_id"), "text", "x0", "x1", "y0", "y1"))
    listed = lines.groupBy("region_id", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "text", "x1", "y0", "y1"))).alias("words"))
    listed = listed.select("region_id.document_id", "region_id.page", "line", "words")
    found = nearest_anchors(found_anchors(listed, recipes)).select("id", F.col("page").alias("__page"), "box")
    last = pages.groupBy("document_id").agg(F.max("page").alias("__last"))
    d = recipes.join(found, "id", "left").join(last, "document_id")
    d = d.withColumn("page", F.coalesce("__page", F.least("page_hint", "__last"))).join(pages, ["document_id", "page"])
    anchors = d.select("id", "document_id", "page", F.col("page").alias("hint_page"), "box", "offset", "hint", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    at = located(anchors).join(anchors.select("id", "document_id", "box", "page_width", "page_height"), "id")
    at = at.withColumn("region", within(F.col("region"), F.col("page_width"), F.col("page_height")))
    at = at.select("id", "document_id", "page", "region", F.when(F.col("box").isNotNull(), "anchor").otherwise("saved position").alias("method"))
    at = grown_down(at, words)
    if candidates is None:
        return at
    best = best_candidates(at, candidates).join(candidates.select("candidate_id", "document_id", "page", F.col("box").alias("__box")), "candidate_id").select("id", "document_id", "page", "__box")
    fitted = at.join(best, ["id", "document_id", "page"]).select("id", "document_id", "page", F.col("__box").alias("region"), F.concat("method", F.lit(", fitted to a candidate")).alias("method"))
    return at.join(best, ["id", "document_id", "page"], "left_anti").unionByName(grown_down(fitted, words))


def grown_down(at: DataFrame, words: DataFrame) -> DataFrame:
    """at (id, document_id, page, region, method) with regions that go on over the lines below that follow closely."""
    middle = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    near = at.join(words, ["document_id", "page"]).filter(middle[0].between(F.col("region.x"), max_x(F.col("region"))) & (middle[1] <= max_y(F.col("region"))))
    rows = word_lines(near.select(F.col("id").alias("region_id"), "text", "x0", "x1", "y0", "y1", F.col("region.y").alias("low")))
    rows = rows.groupBy(F.col("region_id").alias("id"), "line").agg(F.min("y0").alias("min_y"), ((F.min("y0") + F.max("y1")) / 2).alias("y"), F.count("*").alias("n_tokens"), F.first("low").alias("low"))
    down = extended_down(rows.select("id", "y", "min_y", "n_tokens", (F.col("y") >= F.col("low")).alias("inside")))
    out = at.join(down, "id", "left").withColumn("bottom", F.least(F.col("region.y"), F.coalesce("bottom", F.col("region.y"))))
    region = rect(F.col("region.x"), F.col("bottom"), F.col("region.width"), max_y(F.col("region")) - F.col("bottom"))
    return out.select("id", "document_id", "page", region.alias("region"), "method")


def built_recipes(columns: DataFrame, anchors: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recipe columns, recipes) of reviewed tables: names with their aliases, and where the table stands.

    columns: table_id, col, name, source_header, type, unit, scale, number_format.  anchors: recipe_anchor(), on the
    display.  segments: table_id, page, region, width, height (the first segment, on its page's display).
    """
    names = F.array_sort(F.array_distinct(F.filter(F.array("source_header", "name"), lambda x: x != "")))
    cols = columns.select("table_id", F.col("col").alias("target"), "name", names.alias("names"), "type", "unit", "scale", "number_format")
    d = segments.join(anchors, "table_id", "left")
    r, a = F.col("region"), F.col("anchor_box")
    offset = F.when(a.isNotNull(), rect(r["x"] - a["x"], r["y"] - a["y"], r["width"], r["height"]))
    hint = rect(r["x"] / F.col("width"), r["y"] / F.col("height"), r["width"] / F.col("width"), r["height"] / F.col("height"))
    return cols, d.select("table_id", F.coalesce("anchor_text", F.lit("")).alias("anchor_text"), offset.alias("offset"), hint.alias("hint"), F.col("page").alias("page_hint"))


def recipe_anchor(header_cells: DataFrame) -> DataFrame:
    """table_id, anchor_text, anchor_box: the longest header cell of the first header row with three letters and a region."""
    d = header_cells.filter((F.length("text") >= 3) & (F.size("regions") > 0))
    first = Window.partitionBy("table_id")
    d = d.withColumn("__r", F.min("row").over(first)).filter("row = __r")
    return d.groupBy("table_id").agg(F.max_by(F.struct("text", F.get("regions", F.lit(0)).alias("box")), F.struct(F.length("text"), -F.col("col"))).alias("x")).select("table_id", F.col("x.text").alias("anchor_text"), F.col("x.box").alias("anchor_box"))
