"""Scores of extracted tables against the truth."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions.geometry import contains, inset, mid_x, mid_y, union_all
from gridsmith.functions.numbers import parse_numbers
from gridsmith.functions.text import clean, split_footnote
from gridsmith.operators.layout import _whole_regions
from gridsmith.operators.normalize import NUMERIC
from gridsmith.sources.scratch import written


def row_similarity(truth: DataFrame, got: DataFrame, least: float = 0.0) -> DataFrame:
    """doc, truth_row, got_row, s: the share of a truth row's n filled cells that an extracted row has in place, above `least`.

    Such rows share more than least * n cells, so at least one of the n - floor(least * n) of the truth row that are
    rarest in their column: rows meet on these alone, and are compared whole then.  A value that all rows of a column
    have brings no rows together unless it alone is enough.  Both sides are written once by document, as several steps
    read them: none of these moves a cell.
    """
    filled = lambda cells, row: written(cells.select("doc", F.col("row").alias(row), "col", clean(F.coalesce("text", F.lit(""))).alias("t")).filter("doc is not null and t != ''"), "doc")
    t, g = filled(truth, "truth_row"), filled(got, "got_row")
    often = g.groupBy("doc", "col", "t").agg(F.count("*").alias("often"))
    rare = F.row_number().over(Window.partitionBy("doc", "truth_row").orderBy("often", "col"))
    n = F.count("*").over(Window.partitionBy("doc", "truth_row"))
    d = t.join(often, ["doc", "col", "t"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    d = d.withColumns({"rare": rare, "n": n}).filter((F.col("rare") <= F.col("n") - F.floor(F.lit(least) * F.col("n"))) & (F.col("often") > 0))
    pairs = d.select("doc", "col", "t", "truth_row").join(g, ["doc", "col", "t"]).select("doc", "truth_row", "got_row").distinct()
    cells = lambda x, row, name: x.groupBy("doc", row).agg(F.collect_set(F.struct("col", "t")).alias(name))
    both = pairs.join(cells(t, "truth_row", "a"), ["doc", "truth_row"]).join(cells(g, "got_row", "b"), ["doc", "got_row"])
    s = F.size(F.array_intersect("a", "b")) / F.size("a")
    return both.select("doc", "truth_row", "got_row", s.alias("s")).filter(F.col("s") > least)


def heaviest_chain(pairs: Iterable[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """(truth_row, got_row) of the order-keeping pairs with the largest sum of s, the earliest pair of equals first.

    pairs: truth_row, got_row, s, by falling truth_row and got_row.
    """
    # the most that later truth rows reach with got rows from k on falls as k grows: steps that end at `ends`, with the
    # first pair of the chain that reaches it
    ends: list[int] = []
    most: list[float] = []
    heads: list[tuple[int, int]] = []
    after: dict[tuple[int, int], tuple[int, int] | None] = {}
    for t, of_row in groupby(pairs, itemgetter(0)):
        new = []
        for _, g, s in of_row:
            k = bisect_left(ends, g + 1)
            reached, after[t, g] = (most[k], heads[k]) if k < len(ends) else (0.0, None)
            new.append((s + reached, g))
        for total, g in new:
            k = bisect_left(ends, g)
            if k < len(ends) and total < most[k]:
                continue
            to = k + (k < len(ends) and ends[k] == g)
            while k and most[k - 1] <= total:
                k -= 1
            ends[k:to], most[k:to], heads[k:to] = [g], [total], [(t, g)]
    out, at = [], heads[0] if heads else None
    while at:
        out.append(at)
        at = after[at]
    return out


def align_rows(truth: DataFrame, got: DataFrame, least: float = 0.2) -> DataFrame:
    """doc, truth_row, got_row: the order-keeping pairing of rows with the largest sum of similarities above `least`.

    Cells become row similarities as joins; what is left for Python is one table's pairs of similar rows, of which a
    heaviest chain is taken, the earliest pair of equals first.  Tables follow one another in the batches of a task, so
    that a small one costs no call of its own.
    """

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, doc in _whole_regions(batches):
            rows = zip(doc.tolist(), *[table.column(c).to_pylist() for c in ("truth_row", "got_row", "s")], strict=True)
            found = [(d, t, g) for d, own in groupby(rows, itemgetter(0)) for t, g in heaviest_chain(x[1:] for x in own)]
            of, t, g = zip(*found, strict=True)
            ids = table.column("doc").take(pa.array(np.searchsorted(doc, of)))
            yield from pa.table([ids, pa.array(t, pa.int32()), pa.array(g, pa.int32())], names=["doc", "truth_row", "got_row"]).to_batches()

    pairs = row_similarity(truth, got, least)
    schema = f"doc {dict(pairs.dtypes)['doc']}, truth_row int, got_row int"
    return pairs.repartition("doc").sortWithinPartitions("doc", F.desc("truth_row"), F.desc("got_row")).mapInArrow(chains, schema)


def cell_scores(truth: DataFrame, got: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, compared, exact, numeric, numeric_exact, zeros, zeros_kept over the paired rows.

    truth: doc, row, col, text, type, is_header, decimal, grouping.  got: doc, row, col, text.
    """
    t = truth.select("doc", F.col("row").alias("truth_row"), "col", clean(F.coalesce("text", F.lit(""))).alias("t"), "type", "is_header", "decimal", "grouping").join(pairs, ["doc", "truth_row"])
    g = got.select("doc", F.col("row").alias("got_row"), "col", clean(F.coalesce("text", F.lit(""))).alias("g"))
    d = t.join(g, ["doc", "got_row", "col"], "left").withColumn("g", F.coalesce("g", F.lit(""))).filter("t != '' or g != ''")
    d = d.withColumns({"tv": split_footnote(F.col("t"))[0], "gv": split_footnote(F.col("g"))[0]})
    d = parse_numbers(parse_numbers(d, "tv", F.col("decimal"), F.col("grouping"), "tn"), "gv", F.col("decimal"), F.col("grouping"), "gn")
    body = ~F.col("is_header")
    number = body & F.col("type").isin(NUMERIC) & F.col("tn.canonical").isNotNull()
    zero = body & F.col("t").rlike("^0[0-9]+$")
    return d.groupBy("doc").agg(
        F.count("*").alias("compared"), F.count_if(F.col("t") == F.col("g")).alias("exact"), F.count_if(number).alias("numeric"),
        F.count_if(number & (F.col("tn.canonical") == F.col("gn.canonical"))).alias("numeric_exact"), F.count_if(zero).alias("zeros"), F.count_if(zero & (F.col("t") == F.col("g"))).alias("zeros_kept"),
    )


def source_scores(truth: DataFrame, got: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, with_source, source_right: cells whose regions' middle lies in the true box, two points wider, of the page."""
    t = truth.filter("box is not null and trim(text) != ''").select("doc", F.col("row").alias("truth_row"), "col", "box", F.col("page").alias("truth_page")).join(pairs, ["doc", "truth_row"])
    g = got.filter("trim(text) != ''").select("doc", F.col("row").alias("got_row"), "col", "regions", "page")
    d = t.join(g, ["doc", "got_row", "col"]).withColumn("u", union_all(F.col("regions")))
    right = (F.col("page") == F.col("truth_page")) & contains(inset(F.col("box"), -2.0), mid_x(F.col("u")), mid_y(F.col("u")))
    return d.groupBy("doc").agg(F.count("*").alias("with_source"), F.count_if(F.coalesce(right, F.lit(False))).alias("source_right"))


def text_recall(truth: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """keys, found, total: how many of the truth's texts are among those extracted, as multisets."""
    count = lambda d, name: d.select(*keys, clean(F.col("text")).alias("t")).filter("t != ''").groupBy(*keys, "t").agg(F.count("*").alias(name))
    d = count(truth, "a").join(count(got, "b"), [*keys, "t"], "left")
    return d.groupBy(*keys).agg(F.sum(F.least("a", F.coalesce("b", F.lit(0).cast("long")))).alias("found"), F.sum("a").alias("total"))


def without_repeated_headers(cells: DataFrame) -> DataFrame:
    """cells without the rows that repeat a header on a later page."""
    rows = cells.filter(F.array_contains("flags", "repeatedHeader")).select("doc", "row").distinct()
    return cells.join(rows, ["doc", "row"], "left_anti")


def failure_scores(truth: DataFrame, scores: DataFrame) -> DataFrame:
    """scores, and zeros with all rows missing for documents that have none."""
    rows = truth.groupBy("doc").agg(F.count_distinct("row").alias("truth_rows"))
    zero = F.lit(0).cast("long")
    d = rows.join(scores, "doc", "left")
    return d.select("doc", "truth_rows", *[F.coalesce(c, zero).alias(c) for c in ("compared", "exact", "numeric", "numeric_exact")], F.coalesce("missing_rows", "truth_rows").alias("missing_rows"))


def accuracy(part: str, whole: str):
    """part / whole, 1 for none to compare."""
    return F.when(F.col(whole) == 0, 1.0).otherwise(F.col(part) / F.col(whole))


def document_scores(truth: DataFrame, got: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, truth_rows, got_rows, missing_rows, extra_rows, source_coverage, text_recall, header_rows: what a document's score has beside its cells.

    got: doc, row, col, text, regions, header_rows.  Coverage is the share of cells with text that have a region.
    """
    t = truth.groupBy("doc").agg(F.count_distinct("row").alias("truth_rows"), F.count_distinct(F.when(F.col("is_header"), F.col("row"))).alias("header_rows_expected"))
    filled = F.col("text") != ""
    g = got.groupBy("doc").agg(F.count_distinct("row").alias("got_rows"), F.max("header_rows").alias("header_rows"), F.count_if(filled).alias("__n"), F.count_if(filled & (F.size("regions") > 0)).alias("__r"))
    p = pairs.groupBy("doc").agg(F.count("*").alias("__p"))
    recall = text_recall(truth, got, ["doc"])
    zero = F.lit(0).cast("long")
    n = lambda c: F.coalesce(c, zero)
    d = t.join(g, "doc", "left").join(p, "doc", "left").join(recall, "doc", "left")
    return d.select(
        "doc", "truth_rows", n("got_rows").alias("got_rows"), (F.col("truth_rows") - n("__p")).alias("missing_rows"), (n("got_rows") - n("__p")).alias("extra_rows"),
        F.coalesce(F.try_divide("__r", "__n"), F.lit(0.0)).alias("source_coverage"), F.coalesce(F.try_divide("found", "total"), F.lit(0.0)).alias("text_recall"), "header_rows_expected", F.coalesce("header_rows", F.lit(0)).alias("header_rows"),
    )


def engine_summary(scores: DataFrame) -> DataFrame:
    """engine: cells and numbers over all documents together, sources averaged over documents, the upper median of latency.

    The median is found in counts by engine and latency, so no task holds an engine's documents.
    """
    counts = scores.groupBy("engine", "latency").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("engine").orderBy("latency"))
    counts = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy("engine")))
    upper = counts.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("engine").agg(F.min("latency").alias("latency"))
    whole = scores.groupBy("engine").agg(
        F.count("*").alias("documents"), (F.sum("cells_exact") / F.greatest(F.sum("cells_compared"), F.lit(1))).alias("cells"),
        (F.sum("numeric_exact") / F.greatest(F.sum("numeric_cells"), F.lit(1))).alias("numeric"), F.avg("source_correct").alias("source"),
        F.max("memory").alias("memory"), F.sum("missing_rows").alias("missing_rows"), F.sum("extra_rows").alias("extra_rows"),
    )
    return whole.join(upper, "engine").select("engine", "documents", "cells", "numeric", "source", "latency", "memory", "missing_rows", "extra_rows")


def known_failures(scores: DataFrame) -> DataFrame:
    """Documents with an error, cells below 99.9% or rows missing or extra, and a line that says which."""
    exact = accuracy("cells_exact", "cells_compared")
    d = scores.withColumn("__a", exact).filter("error is not null or __a < 0.999 or missing_rows + extra_rows > 0")
    why = F.concat_ws("; ", "error", F.when(F.col("__a") < 0.999, F.format_string("cells %.1f%%", F.col("__a") * 100)), F.when(F.col("missing_rows") > 0, F.format_string("%d rows missing", "missing_rows")), F.when(F.col("extra_rows") > 0, F.format_string("%d rows extra", "extra_rows")))
    return d.withColumn("why", why).drop("__a")


def report_lines(summary: DataFrame) -> Iterator[str]:
    """A Markdown table of engine_summary(), which has a row for each engine."""
    yield "| Engine | Documents | Cells | Numbers | Sources | Latency | Missing | Extra |"
    yield "|---|---|---|---|---|---|---|---|"
    for r in summary.orderBy("engine").toLocalIterator():
        yield f"| {r['engine']} | {r['documents']} | {r['cells']:.1%} | {r['numeric']:.1%} | {r['source']:.1%} | {r['latency']:.2f} s | {r['missing_rows']} | {r['extra_rows']} |"
