"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c lie 2 - 2c apart in squared distance.  They are rotated, which keeps distances, and cut into
blocks of equal width; of a close pair at least one block has its share of the squared budget or less.  Each block is
range-joined on a grid whose cells are twice the block's radius wide: a vector stands in its own cell, and visits the
neighbouring cells that the radius reaches, those above its own in order, so that two vectors meet once a block.
What goes to the cells is a class's number and a sketch, some coordinates of the block at a byte each; who has no
partner there by the sketches leaves.  Only the others' vectors follow, to be verified by the exact cosine of the
vectors as given, and counted in the first block that brings the two together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm._components import components
from gridsmith.llm._runs import chunk_pairs, runs
from gridsmith.llm._scratch import partitions, written
from gridsmith.llm._words import U64, mixed

BLOCKS, GRID = 4, 4
SKETCH = 16
STRIP = 512


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned by two rounds of fixed random signs and a Walsh-Hadamard transform, padded to a power of two.

    Only sums and differences of columns: a row's result does not depend on the rows beside it.
    """
    size = max(BLOCKS * GRID, 1 << max(x.shape[1] - 1, 0).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    for turn in (1, 2):
        signs = (mixed(np.arange(size, dtype=U64) + U64(turn << 32)) >> U64(63)).astype(np.float64)
        out *= 1 - 2 * signs
        h = 1
        while h < size:
            a = out.reshape(len(x), -1, 2, h)
            out = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], 2).reshape(len(x), size)
            h *= 2
        out /= np.sqrt(size)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _pairs(x: np.ndarray, home_x: np.ndarray, y: np.ndarray | None, home_y: np.ndarray | None, block: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of linked vectors that first meet in this block; y None compares x with itself, i < j."""
    own = y is None
    y, home_y = (x, home_x) if own else (y, home_y)
    u, v = unit(x), unit(y)
    ru, rv = rotated(u), rotated(v)
    width = ru.shape[1] // BLOCKS
    budget = (2 - 2 * cosine) / BLOCKS
    part = slice(block * width, (block + 1) * width)
    bu, bv = ru[:, part], rv[:, part]
    norm = (bv * bv).sum(1)
    for at in range(0, len(x), STRIP):
        to = min(at + STRIP, len(x))
        far = (bu[at:to] * bu[at:to]).sum(1)[:, None] + norm[None, :] - 2 * bu[at:to] @ bv.T
        near = (far <= budget + 1e-6) & (u[at:to] @ v.T >= cosine - 1e-6) & (home_x[at:to, None] | home_y[None, :])
        if own:
            near &= np.arange(len(y))[None, :] > np.arange(at, to)[:, None]
        i, j = np.nonzero(near)
        for k in range(0, len(i), 20_000):
            a, b = i[k : k + 20_000] + at, j[k : k + 20_000]
            # summed column after column, so the same for (a, b) and (b, a) in whatever company
            dot = (x[a] * y[b]).sum(1) / np.sqrt((x[a] * x[a]).sum(1)) / np.sqrt((y[b] * y[b]).sum(1))
            apart = ((ru[a] - rv[b]) ** 2).reshape(len(a), BLOCKS, width).sum(2) <= budget + 1e-9
            ok = (dot >= cosine) & apart[:, block] & ~apart[:, :block].any(1)
            if ok.any():
                yield a[ok], b[ok]


_OUT = "a long, b long, n long, cell long, chunk int, members binary"


def _out(a=(), b=None, n=None, cell=None, chunk=None, members=None) -> pa.RecordBatch:
    size = len(a) or 1
    none = [None] * size
    data = [a if len(a) else none, none if b is None else b, none if n is None else n, [cell] * size, [chunk] * size, [members] * size]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, types, strict=True)], names=["a", "b", "n", "cell", "chunk", "members"])


class _Tally:
    """Per class the linked vectors of other classes, and links that join what is linked."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray) -> None:
        self.ids, self.copies = ids, copies
        self.n, self.parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.n, i, self.copies[j])
        np.add.at(self.n, j, self.copies[i])
        root = self.parent
        while True:  # smaller parents along the links, until none changes
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, root[i].copy(), low)
            np.minimum.at(root, root[j].copy(), low)
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root[:] = root[root]
            if (root == before).all():
                break

    def rows(self) -> Iterator[pa.RecordBatch]:
        hit = np.flatnonzero(self.n)
        if len(hit):
            yield _out(self.ids[hit], n=self.n[hit])
            up = hit[self.parent[hit] != hit]
            if len(up):
                yield _out(self.ids[up], b=self.ids[self.parent[up]], n=np.zeros(len(up), np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(raw.to_pylist()), "<f8").reshape(len(raw), -1)


def sketches(part: np.ndarray, size: int) -> np.ndarray:
    """The first coordinates of a block, of vectors of `size` coordinates, in 127ths of four times their usual size.

    Values beyond that are cut, which brings no two further apart; rounding moves a sketch by half a step a coordinate.
    """
    return np.rint(np.clip(part[:, :SKETCH] * (np.sqrt(size) / 4), -1, 1) * 127).astype(np.int8)


def _near(u: np.ndarray, v: np.ndarray, home_u: np.ndarray, home_v: np.ndarray, size: int, budget: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) of strips of u against v: whether two sketches may be of vectors within the block's budget."""
    step = 4 / np.sqrt(size) / 127
    most = ((np.sqrt(budget) + 1e-6) / step + np.sqrt(u.shape[1])) ** 2
    u, v = u.astype(np.float32), v.astype(np.float32)  # sums of products of bytes are exact
    square = (v * v).sum(1)
    for at in range(0, len(u), STRIP):
        x = u[at : at + STRIP]
        far = (x * x).sum(1)[:, None] + square[None, :] - 2 * x @ v.T
        yield at, (far <= most) & (home_u[at : at + STRIP, None] | home_v[None, :])


def links(classes: DataFrame, cosine: float, limit: int = 4096) -> DataFrame:
    """classes (cls long, copies long, label, vector binary of doubles) -> a, b, n.

    Rows with n > 0: class a has n linked vectors in classes met here.  Rows with b: a and b are in one component.
    A cell of more than `limit` vectors is cut into chunks, each two compared in a task of their own.
    """
    budget = (2 - 2 * cosine) / BLOCKS
    width = 2 * np.sqrt(budget)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, group, dims = (batch.column(i).to_numpy() for i in (0, 1, 2))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for k in range(0, len(at), 1024):
                    some = at[k : k + 1024]
                    turned = rotated(unit(_matrix(batch.column(3).take(pa.array(some)))))
                    step = turned.shape[1] // BLOCKS
                    for block in range(BLOCKS):
                        part = turned[:, block * step : (block + 1) * step]
                        grid, drawn = part[:, :GRID] / width, sketches(part, turned.shape[1])
                        own = np.floor(grid).astype(np.int64)
                        inside = grid - own
                        side, far = np.where(inside < 0.5, -1, 1), np.minimum(inside, 1 - inside)
                        out = []
                        for move in product((0, 1), repeat=GRID):
                            change = side * np.array(move)
                            lead = np.argmax(change != 0, 1)
                            reach = (far * far * np.array(move)).sum(1) <= 0.25 + 1e-9  # of a radius of half a cell
                            go = np.flatnonzero(reach & (change[np.arange(len(some)), lead] >= 0))  # its own cell, or one above
                            key = group[some[go]].view(U64) + U64(d * BLOCKS + block)
                            for c in range(GRID):
                                key = mixed(key * U64(0x9E3779B97F4A7C15) + (own + change)[go, c].view(U64))
                            out.append((key.view(np.int64), cls[some[go]], np.full(len(go), 2 * block + (not any(move)), np.int8), drawn[go], np.full(len(go), turned.shape[1], np.int32)))
                        key, ids, how, drawn, size = (np.concatenate(x) for x in zip(*out, strict=True))
                        column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(drawn.shape[1]), len(drawn), [None, pa.py_buffer(np.ascontiguousarray(drawn))]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(how), pa.array(size), column], names=["cell", "cls", "how", "size", "sketch"])

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = table["sketch"].combine_chunks() if isinstance(table["sketch"], pa.ChunkedArray) else table["sketch"]
        return table["cls"].to_numpy(), table["how"].to_numpy(), np.frombuffer(b"".join(raw.to_pylist()), np.int8).reshape(len(raw), -1)

    def left(ids: np.ndarray, how: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        columns = [pa.array(cell, pa.int64()), pa.array(ids, pa.int64()), pa.array(how, pa.int8()), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["cell", "cls", "how", "chunk", "members"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, chunk in runs(batches, limit):
            if chunk >= 0:
                row = [[table["cell"][0].as_py()], [None], [None], [chunk], [_members(table)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.binary()), strict=True)], names=["cell", "cls", "how", "chunk", "members"])
                continue
            cell, sizes = table["cell"].to_numpy(), table["size"].to_numpy()
            ends = np.append(starts[1:], len(cell))
            stays = []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                _, how, drawn = read(table.slice(a, b - a))
                home, any_ = (how & 1).astype(bool), np.zeros(b - a, bool)
                if home.any():
                    for at, near in _near(drawn, drawn, home, home, int(sizes[a]), budget):
                        rows = np.arange(len(near))
                        near[rows, at + rows] = False
                        any_[at : at + len(near)] |= near.any(1)
                    stays.append(a + np.flatnonzero(any_))
            stays = np.concatenate(stays) if stays else np.zeros(0, np.int64)
            if len(stays):
                yield left(table["cls"].to_numpy()[stays], table["how"].to_numpy()[stays], cell[stays])

    def meet_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                table = pa.ipc.open_stream(one).read_all()
                ids, how, drawn = read(table)
                other = read(pa.ipc.open_stream(two).read_all()) if two else (ids, how, drawn)
                here, there = np.zeros(len(ids), bool), np.zeros(len(other[0]), bool)
                for at, near in _near(drawn, other[2], (how & 1).astype(bool), (other[1] & 1).astype(bool), table["size"][0].as_py(), budget):
                    if not two:
                        rows = np.arange(len(near))
                        near[rows, at + rows] = False
                    here[at : at + len(near)] |= near.any(1)
                    there |= near.any(0)
                cell = table["cell"][0].as_py()
                for i, h, stays in ((ids, how, here), (other[0], other[1], there))[: 2 if two else 1]:
                    if stays.any():
                        yield left(i[stays], h[stays], np.full(int(stays.sum()), cell))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, chunk in runs(batches, limit):
            cell, ids, copies, how = (table.column(i).to_numpy() for i in range(4))
            if chunk >= 0:
                yield _out(cell=int(cell[0]), chunk=chunk, members=_members(table))
                continue
            edges = np.append(starts, len(ids)).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1 and (how[a:b] & 1).any():
                    tally, home = _Tally(ids[a:b], copies[a:b]), (how[a:b] & 1).astype(bool)
                    for i, j in _pairs(_matrix(table.column(4).slice(a, b - a)), home, None, None, int(how[a]) >> 1, cosine):
                        tally.add(i, j)
                    yield from tally.rows()

    def compare_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                ids, copies, how, x = _of_members(one)
                if two is None:
                    tally = _Tally(ids, copies)
                    found = _pairs(x, (how & 1).astype(bool), None, None, int(how[0]) >> 1, cosine)
                    for i, j in found:
                        tally.add(i, j)
                else:
                    ids2, copies2, how2, y = _of_members(two)
                    tally = _Tally(np.concatenate([ids, ids2]), np.concatenate([copies, copies2]))
                    for i, j in _pairs(x, (how & 1).astype(bool), y, (how2 & 1).astype(bool), int(how[0]) >> 1, cosine):
                        tally.add(i, j + len(ids))
                yield from tally.rows()

    n = partitions(classes.sparkSession)
    rows = classes.select("cls", F.xxhash64("label").alias("group"), F.length("vector").alias("dims"), "vector")
    dealt = rows.mapInArrow(cells, "cell long, cls long, how byte, size int, sketch binary").repartition(n, "cell").sortWithinPartitions("cell")
    met = written(dealt.mapInArrow(meet, "cell long, cls long, how byte, chunk int, members binary"))
    stay = met.filter("members is null").select("cell", "cls", "how")
    chunks = met.filter("members is not null").select("cell", "chunk", "members")
    if not chunks.isEmpty():
        each_two = chunk_pairs(chunks, "cell", "chunk", "members").repartition(n)
        stay = stay.unionByName(each_two.mapInArrow(meet_chunks, "cell long, cls long, how byte, chunk int, members binary").select("cell", "cls", "how")).distinct()
    whole = stay.join(classes.select("cls", "copies", "vector"), "cls").select("cell", "cls", "copies", F.col("how").cast("int").alias("how"), "vector")
    found = written(whole.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(compare, _OUT))
    out = found.filter("members is null").select("a", "b", "n")
    chunks = found.filter("members is not null").select("cell", "chunk", "members")
    if not chunks.isEmpty():
        each_two = chunk_pairs(chunks, "cell", "chunk", "members").repartition(n)
        out = out.unionByName(each_two.mapInArrow(compare_chunks, _OUT).select("a", "b", "n"))
    return out


def _members(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _of_members(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    table = pa.ipc.open_stream(data).read_all()
    return table["cls"].to_numpy(), table["copies"].to_numpy(), table["how"].to_numpy(), _matrix(table["vector"])


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, vector (little-endian doubles, -0 as 0), null where it links with nothing."""
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0
        lens = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        ends = np.cumsum(lens)
        out = []
        for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True):
            v = values[a:b]
            square = (v * v).sum()
            out.append(v.astype("<f8").tobytes() if np.isfinite(v).all() and 0 < square < np.inf else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"])


def near_duplicates(embeddings: DataFrame, cosine: float = 0.98, vector: str = "embedding") -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine in double precision is `cosine` or more;
    null and zero vectors and those with null or non-finite components link with nothing, vectors of other lengths not
    with each other.  Equal vectors of a label are one class with a count, so copies cost nothing.  component_id is
    the smallest vec_id reachable; kept says that it is the row's own.  Rows that share a vec_id are vectors of their
    own.  A null vec_id is the smallest only where it is alone.  An empty table gives none; other columns are left
    out, whatever their names.
    """
    bare = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = bare.mapInArrow(_as_bytes, "vec_id long, label string, vector binary").withColumn("row", F.monotonically_increasing_id())
    able = F.col("vector").isNotNull() & F.col("label").isNotNull()
    keys = [F.when(able, F.xxhash64(*x)).alias(f"k{i}") for i, x in enumerate((("label", "vector"), (F.lit(1), "vector", "label")))]
    rows = written(rows.select("row", "vec_id", F.when(able, F.col("label")).alias("label"), F.when(able, F.col("vector")).alias("vector"), *keys))
    linked = rows.filter("k0 is not null")
    grouped = linked.groupBy("k0", "k1").agg(F.min("row").alias("cls"), F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = written(grouped)
    found = written(links(classes, cosine))
    counts = found.filter("n > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    parts = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    whole = classes.select("k0", "k1", "cls", "copies", "least").join(counts, "cls", "left").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    whole = written(whole)
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = whole.join(least, "component").select(F.col("k0").alias("h0"), F.col("k1").alias("h1"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0).cast("long"))).alias("n"), "component_id")
    out = rows.select("vec_id", "k0", "k1").join(whole, (F.col("k0") == F.col("h0")) & (F.col("k1") == F.col("h1")), "left")
    component = F.when(F.col("h0").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
