"""Runs of equal keys in sorted Arrow batches: whole small runs together, long ones in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, np.ndarray, int]]:
    """(table, starts, chunk) from batches sorted by their first column.

    chunk -1: the table holds whole runs, which begin at starts and have at most `limit` rows each.  chunk 0, 1, ...:
    the table is one piece, of at most limit rows, of a longer run, and starts is [0].
    """
    held: list[pa.Table] = []
    key, size, chunk = None, 0, -1  # of the open run, held back as it may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cells = table.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        if key is not None and cells[0] == key:
            to = int(starts[1]) if len(starts) > 1 else len(cells)
            held.append(table.slice(0, to))
            size += to
            table, cells, starts = table.slice(to), cells[to:], starts[1:] - to
            while size > limit:
                whole = pa.concat_tables(held)
                chunk += 1
                yield whole.slice(0, limit), np.zeros(1, np.int64), chunk
                held, size = [whole.slice(limit)], size - limit
            if not len(cells):
                continue
        if held and size:
            whole = pa.concat_tables(held)
            yield whole, np.zeros(1, np.int64), chunk + 1 if chunk >= 0 else -1
        held, size, chunk = [], 0, -1
        last = int(starts[-1])
        done, done_starts = table.slice(0, last), starts[:-1]
        ends = np.append(done_starts[1:], last)
        long = (ends - done_starts) > limit
        if not long.any():
            if last:
                yield done, done_starts, -1
        else:
            for a, b in zip(done_starts.tolist(), ends.tolist(), strict=True):
                if b - a <= limit:
                    yield done.slice(a, b - a), np.zeros(1, np.int64), -1
                else:
                    for no, at in enumerate(range(a, b, limit)):
                        yield done.slice(at, min(limit, b - at)), np.zeros(1, np.int64), no
        key, held, size = cells[last], [table.slice(last)], len(cells) - last
        while size > limit:
            whole = pa.concat_tables(held)
            chunk += 1
            yield whole.slice(0, limit), np.zeros(1, np.int64), chunk
            held, size = [whole.slice(limit)], size - limit
    if held and size:
        yield pa.concat_tables(held), np.zeros(1, np.int64), chunk + 1 if chunk >= 0 else -1


def chunk_pairs(chunks: DataFrame, key: str, number: str, content: str) -> DataFrame:
    """one, two: the contents of each two chunks of a key, and of each one with null.

    Chunks are numbered 0, 1, ... in a key.  The pairs of numbers are made first, and contents join them by key and
    number, so that no task makes all pairs of a key.
    """
    numbers = chunks.groupBy(key).agg(F.max(number).alias("most"))
    pairs = numbers.select(key, F.explode(F.sequence(F.lit(0), F.col("most"))).alias("n1"), "most")
    pairs = pairs.select(key, "n1", F.explode(F.sequence(F.col("n1"), F.col("most"))).alias("n2"))
    one = chunks.select(key, F.col(number).alias("n1"), F.col(content).alias("one"))
    two = chunks.select(key, F.col(number).alias("n2"), F.col(content).alias("two"))
    return pairs.join(one, [key, "n1"]).join(two, [key, "n2"]).select("one", F.when(F.col("n1") < F.col("n2"), F.col("two")).alias("two"))
