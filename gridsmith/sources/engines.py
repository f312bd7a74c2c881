"""Engines by name and the choice between them: every region is read by one engine, and by a second where the first finds nothing.

An engine takes regions (region_id, region, and what else it needs) and gives cells of neutral form for those in which
it finds a table: region_id, row, col, row_span, col_span, text, score, regions (boxes), flags, is_header.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.operators import layout
from gridsmith.sources import readers
from gridsmith.sources.scratch import written

Engine = Callable[[DataFrame], DataFrame]
NEUTRAL = ["region_id", "row", "col", "row_span", "col_span", "text", "score", "regions", "flags", "is_header"]
MESSAGES = readers.MESSAGE_SCHEMA + ", worker string, python string, fraction double, message string"


def words_engine(words: DataFrame, merge_lines: bool = True) -> Engine:
    """Layout of positioned words, of the text layer or of recognised text; rulings are taken from the regions."""

    def extract(regions: DataFrame) -> DataFrame:
        some = words.join(regions.select("region_id"), "region_id", "left_semi")
        d = layout.read_grid(some, regions, merge_lines)
        return d.withColumns({"row_span": F.lit(1), "regions": F.col("boxes")}).select(*NEUTRAL)

    return extract


def recognised_engine(recognised: DataFrame, most_header_rows: int = 3) -> Engine:
    """The largest recognised table of each region, with header rows told by its cells as layout tells them."""

    def extract(regions: DataFrame) -> DataFrame:
        cells = written(readers.structure_tables(recognised.join(regions.select("region_id"), "region_id", "left_semi")))
        heads = layout.header_rows(cells, most_header_rows)
        d = cells.join(heads, "region_id").withColumn("is_header", F.col("row") < F.col("header_rows"))
        return d.select(*NEUTRAL)

    return extract


def worker_engine(lines: DataFrame) -> Engine:
    """Tables from a worker's messages (value), jobs being region_ids: of each the table that shares most with the region."""

    def extract(regions: DataFrame) -> DataFrame:
        parsed = lines.withColumn("__job", F.get_json_object("value", "$.job"))
        own = parsed.join(regions.select(F.col("region_id").cast("string").alias("__job"), F.col("region_id").alias("__id"), F.col("region").alias("__region")), "__job")
        d = readers.worker_results(own, F.col("__region"))
        d = d.join(regions.select("region_id", F.col("region_id").cast("string").alias("job")), "job")
        b = F.col("bbox")
        box = F.struct(b["l"].alias("x"), b["b"].alias("y"), (b["r"] - b["l"]).alias("width"), (b["t"] - b["b"]).alias("height"))
        flags = F.when(F.col("colSpan") > 1, F.array(F.lit("spansColumns"))).otherwise(F.array().cast("array<string>"))
        return d.select(
            "region_id", "row", F.col("column").alias("col"), F.col("rowSpan").alias("row_span"), F.col("colSpan").alias("col_span"), F.trim("text").alias("text"), F.lit(None).cast("double").alias("score"),
            F.when(b.isNotNull(), F.array(box)).otherwise(F.array().cast(f"array<{readers.RECT}>")).alias("regions"), flags.alias("flags"), F.coalesce("header", F.lit(False)).alias("is_header"),
        )

    return extract


def worker_jobs(lines: DataFrame) -> DataFrame:
    """job, state, fraction, message, error: where each job of a worker's messages stands.

    lines: value (a JSON message), place (its order).  state is error (a failed job, or a message of another protocol), done
    (a result), working (the last progress counts), in this order of precedence.  Messages without a job do not count:
    those that say hello or shut down, and broken lines, are workers()'.
    """
    m = lines.withColumn("m", F.from_json("value", MESSAGES)).filter("m.job is not null")
    kind, strange = F.col("m.type"), F.coalesce(F.col("m.protocol") != 1, F.lit(True))
    last = F.max_by(F.struct(F.col("m.fraction").alias("fraction"), F.col("m.message").alias("message")), F.when(kind == "progress", F.col("place")))
    failed = F.when(strange, F.concat(F.lit("unknown protocol "), F.coalesce(F.col("m.protocol").cast("string"), F.lit("none")))).when(kind == "error", F.coalesce("m.error", F.lit("error")))
    d = m.groupBy(F.col("m.job").alias("job")).agg(last.alias("last"), F.max(failed).alias("error"), F.bool_or((kind == "result") & ~strange).alias("done"))
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("done"), "done").otherwise("working")
    return d.select("job", state.alias("state"), F.when(state == "done", 1.0).otherwise(F.col("last.fraction")).alias("fraction"), F.col("last.message").alias("message"), "error")


def workers(lines: DataFrame) -> DataFrame:
    """source, protocol, worker, python, usable, stopped, broken: what each worker (source) said of itself.

    lines: value, source.  A worker is usable if it said hello in protocol 1; broken counts lines that are no messages.
    """
    m = lines.withColumn("m", F.from_json("value", MESSAGES))
    kind = F.col("m.type")
    hello = F.max(F.when(kind == "hello", F.struct(F.coalesce("m.protocol", F.lit(0)).alias("protocol"), F.coalesce("m.worker", F.lit("?")).alias("worker"), F.coalesce("m.python", F.lit("?")).alias("python"))))
    d = m.groupBy("source").agg(hello.alias("h"), F.bool_or(F.coalesce(kind == "shutdown", F.lit(False))).alias("stopped"), F.count_if(kind.isNull()).alias("broken"))
    return d.select("source", "h.protocol", "h.worker", "h.python", F.coalesce(F.col("h.protocol") == 1, F.lit(False)).alias("usable"), "stopped", "broken")


def extracted(regions: DataFrame, engines: dict[str, Engine], fallback: str = "recognised_text") -> tuple[DataFrame, DataFrame]:
    """(cells with used_engine, region_id, requested, used_engine, error of every region).

    regions: region_id, region, requested (an engine or auto), region_chars.  auto takes the text layer where a region
    has eight characters or more, else the document engine; where that finds no table, the fallback engine reads the
    region.  A region in which nothing is found has an error, as has one of an engine that is not there; neither stops
    another.
    """
    chosen = written(regions.withColumn("engine", readers.engine_choice(F.col("requested"), F.col("region_chars"))))
    parts = [extract(chosen.filter(F.col("engine") == name)).select(*NEUTRAL, F.lit(name).alias("used_engine")) for name, extract in engines.items()]
    first = written(reduce(DataFrame.unionByName, parts))
    left = chosen.filter("requested = 'auto'").join(first.select("region_id"), "region_id", "left_anti")
    second = written(engines[fallback](left).select(*NEUTRAL, F.lit(fallback).alias("used_engine")))
    cells = first.unionByName(second)
    used = cells.select("region_id", "used_engine").distinct()
    d = chosen.join(used, "region_id", "left")
    why = F.when(~F.col("engine").isin(*engines), F.concat(F.lit("no engine "), "engine")).when(F.col("used_engine").isNull(), "no table found")
    return cells, d.select("region_id", "requested", "used_engine", why.alias("error"))
