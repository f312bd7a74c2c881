"""Sources: files to import, truth files, stored tables, worker messages, clipboard text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.functions.geometry import area, contains, inset, intersection_area, max_x, max_y, rect
from gridsmith.functions.text import trim_all
from gridsmith.operators.layout import read_grid
from gridsmith.operators.versions import imported

RECT = "struct<x:double,y:double,width:double,height:double>"
TRUTH_SCHEMA = f"""document string, description string, tags array<string>, scanned boolean, tables array<struct<
  segments:array<struct<pageIndex:int,region:{RECT}>>, headerRows:int, cells:array<array<string>>, cellRects:array<array<{RECT}>>,
  cellPages:array<array<int>>, spans:array<array<int>>, numberFormat:string, columnTypes:array<string>>>"""
TOKEN_SCHEMA = "document_id string, page_index int, segment_index int, text string, x0 double, y0 double, x1 double, y1 double, score double"
MESSAGE_SCHEMA = """protocol int, type string, job string, error string, tables array<struct<bbox:struct<l:double,b:double,r:double,t:double>,
  cells:array<struct<row:int,column:int,rowSpan:int,colSpan:int,text:string,header:boolean,bbox:struct<l:double,b:double,r:double,t:double>>>>>"""


def files(spark: SparkSession, path: str, stored: DataFrame) -> DataFrame:
    """Files under a path with sha256, document_id and is_new; equal contents and stored ones are imported once."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return imported(d.select(F.col("path").alias("id"), "content"), stored)


def has_text_layer(page_texts: DataFrame, pages: int = 5, least: int = 20) -> DataFrame:
    """document_id, has_text_layer: whether one of the first pages has more than `least` characters that are not blank."""
    n = F.length(F.regexp_replace("text", r"\s", ""))
    return page_texts.groupBy("document_id").agg(F.bool_or((F.col("page_index") < pages) & (n > least)).alias("has_text_layer"))


def region_chars(words: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, region_chars: characters that are not blank of the page's words whose middle lies in the region.

    words: document_id, page, text, x0, x1, y0, y1.  regions: region_id, document_id, page, region.
    """
    inside = contains(F.col("region"), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    n = F.sum(F.length(F.regexp_replace("text", r"\s", "")))
    counted = words.join(regions, ["document_id", "page"]).filter(inside).groupBy("region_id").agg(n.alias("n"))
    return regions.select("region_id").join(counted, "region_id", "left").select("region_id", F.coalesce("n", F.lit(0).cast("long")).alias("region_chars"))


def structure_tables(recognised: DataFrame) -> DataFrame:
    """region_id, row, col, row_span, col_span, text, regions, score, flags: the largest recognised table of each region.

    recognised: region_id, table_no, box, cells (array<struct<row, col, row_span, col_span, text, box, lines: array<struct<
    box, confidence>>>>).  Of cells at one place the first counts; a cell has a region for each of its lines, or its own
    box where there are none, and the least confidence of its lines as score.
    """
    best = recognised.groupBy("region_id").agg(F.max_by("cells", F.struct(area(F.col("box")), -F.col("table_no"))).alias("cells"))
    d = best.select("region_id", F.posexplode("cells").alias("n", "c")).select("region_id", "n", "c.*")
    first = d.groupBy("region_id", "row", "col").agg(F.min("n").alias("n"))
    d = d.join(first, ["region_id", "row", "col", "n"], "left_semi")
    text = trim_all(F.replace("text", F.lit("\n"), F.lit(" ")))
    boxes = F.transform("lines", lambda x: x["box"])
    regions = F.when(text == "", F.slice(boxes, 1, 0)).when(F.size("lines") > 0, boxes).otherwise(F.array("box"))
    flags = F.when(F.col("col_span") > 1, F.array(F.lit("spansColumns"))).otherwise(F.array().cast("array<string>"))
    return d.select("region_id", "row", "col", "row_span", "col_span", text.alias("text"), regions.alias("regions"), F.array_min(F.transform("lines", lambda x: x["confidence"])).alias("score"), flags.alias("flags"))


def detected_tables(found: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, page, place, region: detected tables, four points wider on all sides, clipped to the page, from the top down.

    found: document_id, page, box.  pages: document_id, page, crop.
    """
    b, c = inset(F.col("box"), -4.0), F.col("crop")
    x, y = F.greatest(b["x"], c["x"]), F.greatest(b["y"], c["y"])
    region = rect(x, y, F.least(max_x(b), max_x(c)) - x, F.least(max_y(b), max_y(c)) - y)
    d = found.join(pages.select("document_id", "page", "crop"), ["document_id", "page"]).withColumn("region", region)
    order = Window.partitionBy("document_id", "page").orderBy(F.desc(max_y(F.col("region"))), "region.x")
    return d.select("document_id", "page", (F.row_number().over(order) - 1).alias("place"), "region")


#: what an unknown value of a stored row stands for
DEFAULTS = {"status": ({"running", "completed", "failed", "cancelled"}, "failed"), "review": ({"unreviewed", "needsReview", "reviewed"}, "unreviewed"), "kind": ({"edit", "review", "rowRole", "columnType", "columnRename", "tableSettings", "carriedOver", "conflict", "undo", "redo"}, "edit")}


def decoded(rows: DataFrame, json_fields: dict[str, str]) -> DataFrame:
    """Stored rows with their JSON columns (name: schema) as structs and arrays, and unknown states as their defaults."""
    out = rows.withColumns({c: F.from_json(c, schema) for c, schema in json_fields.items()})
    known = {c: F.when(F.col(c).isin(*sorted(values)), F.col(c)).otherwise(default) for c, (values, default) in DEFAULTS.items() if c in rows.columns}
    return out.withColumns(known) if known else out


def worker_errors(lines: DataFrame) -> DataFrame:
    """job, error: jobs that a worker reports as failed, and messages that cannot be used: unknown protocols and broken lines."""
    m = lines.withColumn("m", F.from_json("value", MESSAGE_SCHEMA))
    why = F.when(F.col("m").isNull() | F.col("m.type").isNull(), "unreadable message").when(F.coalesce(F.col("m.protocol") != 1, F.lit(True)), F.concat(F.lit("unknown protocol "), F.coalesce(F.col("m.protocol").cast("string"), F.lit("none")))).when(F.col("m.type") == "error", F.coalesce("m.error", F.lit("error")))
    return m.withColumn("error", why).filter("error is not null").select(F.col("m.job").alias("job"), "error")


def engine_choice(requested: Column, region_chars: Column) -> Column:
    """auto reads the text layer where a region has eight characters or more, else the document engine."""
    return F.when(requested != "auto", requested).when(region_chars >= 8, "text_layer").otherwise("document")


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """document, table_no, row, col, text, type, is_header, box, page of all truth files of a folder."""
    d = spark.read.schema(TRUTH_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.truth.json").json(folder)
    t = d.select("document", F.posexplode("tables").alias("table_no", "t"))
    kept = ["headerRows", "cellRects", "cellPages", "numberFormat", "columnTypes"]
    grid = F.flatten(F.transform("t.cells", lambda r, i: F.transform(r, lambda x, j: F.struct(i.alias("row"), j.alias("col"), x.alias("text")))))
    t = t.select("document", "table_no", grid.alias("grid"), *[F.col(f"t.{k}").alias(k) for k in kept])
    cells = t.select("document", "table_no", *kept, F.explode("grid").alias("c"))
    pick = lambda x: F.get(F.get(F.col(x), F.col("c.row")), F.col("c.col"))
    return cells.select(
        "document", "table_no", "c.row", "c.col", "c.text", F.get("columnTypes", F.col("c.col")).alias("type"), (F.col("c.row") < F.col("headerRows")).alias("is_header"),
        pick("cellRects").alias("box"), pick("cellPages").alias("page"), F.col("numberFormat").alias("number_format"),
    )


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """Positioned words that an engine has written as JSON lines."""
    return spark.read.schema(TOKEN_SCHEMA).json(path)


def worker_results(lines: DataFrame, region: Column | None = None) -> DataFrame:
    """job, cells of the table that shares most with the region, or the largest; errors and other protocols have none.

    lines: value (a JSON message), and what region needs.
    """
    m = lines.withColumn("m", F.from_json("value", MESSAGE_SCHEMA)).filter("m.protocol = 1 and m.type = 'result'")
    boxes = m.withColumn("t", F.explode("m.tables"))
    b = F.col("t.bbox")
    box = F.struct(b["l"].alias("x"), b["b"].alias("y"), (b["r"] - b["l"]).alias("width"), (b["t"] - b["b"]).alias("height"))
    rank = intersection_area(box, region) if region is not None else area(box)
    best = boxes.groupBy(F.col("m.job").alias("job")).agg(F.max_by("t.cells", rank).alias("cells"))
    return best.select("job", F.explode("cells").alias("c")).select("job", "c.*")


def stored(spark: SparkSession, root: str, name: str, order: list[str], **where: str) -> DataFrame:
    """A stored table, filtered by equality and ordered; a minus before a column turns its order round."""
    d = spark.read.parquet(f"{root}/{name}")
    for column, value in where.items():
        d = d.filter(F.col(column) == value)
    by = lambda c: F.lower(c) if dict(d.dtypes)[c] == "string" else F.col(c)
    return d.orderBy(*[by(c[1:]).desc() if c.startswith("-") else by(c) for c in order])


#: name -> (words, regions -> cells of neutral form); engines register themselves
ENGINES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_engine(name: str, extract: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """An engine takes words and regions and gives region_id, row, col, col_span, text, score."""
    ENGINES[name] = extract


def extracted(name: str, words: DataFrame, regions: DataFrame) -> DataFrame:
    """What a registered engine reads in the regions."""
    if name not in ENGINES:
        raise KeyError(f"no engine {name}; there are {sorted(ENGINES)}")
    return ENGINES[name](words, regions)


register_engine("layout", read_grid)
