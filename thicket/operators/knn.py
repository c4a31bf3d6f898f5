"""Exact nearest neighbours, alone or averaged over two representations.

Equal vectors are looked for once: of each the k + 1 smallest ids stand as
candidates, more can never be among k neighbours, and every copy takes the list
of its vector without itself.  Different vectors are dealt into cells by a tree
of medians over a bounded sample (which decides the shape of the cells, nothing
else).  Each vector first looks in its own cell; its k-th distance there is a
radius, and it then visits the cells whose region reaches into that radius.
With few coordinates these are a few cells.  With many they are nearly all, and
the work is quadratic, as exactness asks; only queries travel then, never cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

BLOCK = 2048
#: Vectors of a cell where a few cells suffice, and the coordinates up to which they do.
CELL, NARROW = 512, 8
#: Vectors that shape the cells, and of them for each cell.
SAMPLE, PER_CELL = 65536, 16
#: Distances that a task holds at a time.
HELD = 1 << 21
#: Distances are compared by their first 9 digits; bounds leave that much room.
ROOM = 2e-9


def coordinates(a: np.ndarray, metric: str) -> np.ndarray:
    """Vectors on which the metric is a simple sum."""
    if metric == "correlation":
        a = a - a.mean(axis=1, keepdims=True)
    if metric in ("cosine", "correlation"):
        norm = np.linalg.norm(a, axis=1)
        return a / np.where(norm, norm, 1)[:, None]
    if metric in ("euclidean", "cityblock"):
        return a
    raise ValueError(f"no metric {metric!r}")


def _rough(a, b, metric):
    """Distances of all pairs and how far they may be off."""
    if metric == "cityblock":
        return (np.stack([np.abs(b - x).sum(1) for x in a]) if len(a) else np.zeros((0, len(b)))), ROOM
    if metric == "euclidean":
        whole = b[np.isfinite(b).all(axis=1)]
        middle = whole.mean(axis=0) if len(whole) else 0.0
        a, b = a - middle, b - middle
        na, nb = (a * a).sum(1), (b * b).sum(1)
        return np.sqrt(np.maximum(0, na[:, None] + nb[None] - 2 * a @ b.T)), ROOM + np.sqrt(1e-13 * (np.nanmax(na, initial=0.0) + np.nanmax(nb, initial=0.0)))
    return 1 - a @ b.T, ROOM


def _exact(a, b, metric):
    """Distances of rows side by side."""
    if metric == "cityblock":
        return np.abs(a - b).sum(1)
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(1))
    return 1 - (a * b).sum(1)


def _parts(x, widths):
    return np.split(x, np.cumsum(widths)[:-1], axis=1)


def nearest(q: np.ndarray, c: np.ndarray, ids: np.ndarray, first: np.ndarray, k: int, metric: str, widths: list[int], radius: np.ndarray | None = None):
    """(query, distance, id), sorted, of the k best ids for each query; candidate i has ids[first[i]:first[i + 1]]."""
    out = []
    step = max(1, HELD // max(1, len(c)))
    for at in range(0, len(q), step):
        some = q[at : at + step]
        rough, off = 0.0, 0.0
        for a, b in zip(_parts(some, widths), _parts(c, widths)):
            d, e = _rough(a, b, metric)
            rough, off = rough + d / len(widths), off + e / len(widths)
        limit = np.full(len(some), np.inf)
        if len(c) > k:
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
            limit[np.isnan(limit)] = np.inf
        if radius is not None:
            limit = np.minimum(limit, radius[at : at + step])
        i, j = np.nonzero(rough <= (limit + 2 * off)[:, None])
        d = np.zeros(len(i))
        for a, b in zip(_parts(some, widths), _parts(c, widths)):
            d += _exact(a[i], b[j], metric)
        d = np.round(d / len(widths), 9) + 0.0
        good = np.isfinite(d)
        if radius is not None:
            good &= d <= radius[at : at + step][i] + ROOM
        i, j, d = i[good], j[good], d[good]
        many = first[j + 1] - first[j]
        begin = np.cumsum(many) - many
        i, d = np.repeat(i, many), np.repeat(d, many)
        x = ids[np.repeat(first[j] - begin, many) + np.arange(len(i))]
        order = np.lexsort((x, d, i))
        i, d, x = i[order], d[order], x[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[keep] + at, d[keep], x[keep]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def _matrix(column, width: int | None = None) -> np.ndarray:
    """A column of arrays of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width or 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _lists(column):
    """A column of arrays as values and offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


class Cells:
    """A tree of median splits; cell i lies between low[i] and high[i]."""

    def __init__(self, x: np.ndarray, cells: int, width: int):
        self.dim, self.cut, self.child = [], [], []
        self.low, self.high = [], []
        self._grow(x, cells, np.full(width, -np.inf), np.full(width, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, x, cells, low, high) -> int:
        """The node's number; leaves are numbered -1, -2, ..."""
        spread = x.var(axis=0) if len(x) else np.zeros(len(low))
        for dim in np.argsort(-spread, kind="stable")[:3] if cells > 1 else []:
            cut = float(np.median(x[:, dim]))
            left = x[:, dim] <= cut
            if not spread[dim] or left.all():
                continue
            me = len(self.dim)
            self.dim.append(int(dim))
            self.cut.append(cut)
            self.child.append(None)
            upto, since = high.copy(), low.copy()
            upto[dim] = since[dim] = cut
            self.child[me] = (self._grow(x[left], cells // 2, low, upto), self._grow(x[~left], cells - cells // 2, since, high))
            return me
        self.low.append(low)
        self.high.append(high)
        return -len(self.low)

    def homes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        stack = [(0 if self.dim else -1, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            left = x[rows, self.dim[node]] <= self.cut[node]
            stack += [(self.child[node][0], rows[left]), (self.child[node][1], rows[~left])]
        return out

    def reached(self, x: np.ndarray, radius: np.ndarray, metric: str, widths: list[int]):
        """Pairs (row, cell) where the cell's region is not farther than the row's radius."""
        rows, cells = [], []
        part = np.repeat(np.arange(len(widths)), widths)
        stack = [(0 if self.dim else -1, np.arange(len(x)), np.zeros((len(x), 0)), ())]
        room = radius * (1 + 1e-9) + ROOM
        while stack:
            node, at, gaps, dims = stack.pop()
            if node < 0:
                rows.append(at)
                cells.append(np.full(len(at), -node - 1, np.int32))
                continue
            dim, away = self.dim[node], x[at, self.dim[node]] - self.cut[node]
            for child, gap in zip(self.child[node], (np.maximum(away, 0), np.maximum(-away, 0))):
                if dim in dims:
                    g, d = gaps.copy(), dims
                    g[:, dims.index(dim)] = np.maximum(g[:, dims.index(dim)], gap)
                else:
                    g, d = np.column_stack([gaps, gap]), (*dims, dim)
                bound = np.zeros(len(at))
                for p in range(len(widths)):
                    mine = g[:, [i for i, z in enumerate(d) if part[z] == p]]
                    bound += mine.sum(1) if metric == "cityblock" else np.sqrt((mine * mine).sum(1)) if metric == "euclidean" else (mine * mine).sum(1) / 2
                near = bound / len(widths) <= room[at]
                if near.any():
                    stack.append((child, at[near], g[near], d))
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(cells) if cells else np.zeros(0, np.int32)


FOUND = "gid long, near array<struct<distance:double,neighbour:long>>"


def _near(gids, at, d, x):
    """Rows of FOUND; ``at`` is sorted and points into ``gids``."""
    n = np.bincount(at, minlength=len(gids))
    pairs = pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(x, pa.int64())], names=["distance", "neighbour"])
    return [pa.array(gids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pairs)]


def _floats(x):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _place(cells, metric, vectors):
    def run(batches):
        for b in batches:
            x = np.concatenate([coordinates(_matrix(b.column(2 + i), w), metric) for i, w in enumerate(vectors)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cells.value.homes(x)), b.column(0), b.column(1), _floats(x)], names=["cell", "gid", "ids", "x"])

    return run


def _home(k, metric, widths):
    def run(table):
        x, gids = _matrix(table.column("x")), table.column("gid").to_numpy()
        ids, first = _lists(table.column("ids"))
        at, d, found = nearest(x, x, ids, first, k, metric, widths)
        radius = np.full(len(x), np.inf)
        n = np.bincount(at, minlength=len(x))
        full = n == k
        radius[full] = d[(np.cumsum(n) - 1)[full]]
        gid, near = _near(gids, at, d, found)
        return pa.table([table.column("cell"), gid, _floats(x), pa.array(radius), near], names=["cell", "gid", "x", "radius", "near"])

    return run


def _leave(cells, metric, widths):
    """A row for every other cell that a vector has to visit."""

    def run(batches):
        for b in batches:
            x, home, gid, radius = _matrix(b.column(2), sum(widths)), b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
            step = max(1, HELD // 4 // (x.shape[1] + 1) // len(cells.value.low))
            for a in range(0, len(x), step):
                row, cell = cells.value.reached(x[a : a + step], radius[a : a + step], metric, widths)
                row += a
                row, cell = row[home[row] != cell], cell[home[row] != cell]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.ones(len(row), np.int32)), pa.array(gid[row]), pa.nulls(len(row), pa.list_(pa.int64())), _floats(x[row]), pa.array(radius[row])], names=["cell", "role", "gid", "ids", "x", "radius"])

    return run


def _visit(k, metric, widths):
    """Sorted by cell and role: a cell's vectors, then its visitors."""

    def run(batches):
        now, held, cell = None, [], None
        for b in batches:
            at, roles = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (roles[1:] != roles[:-1])]))
            for a, z in zip(cut, np.append(cut[1:], len(at))):
                if at[a] != now:
                    now, held, cell = at[a], [], None
                part = b.slice(a, z - a)
                if roles[a] == 0:
                    held.append(part)
                    continue
                if cell is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held)
                    cell, held = (_matrix(t.column("x")), *_lists(t.column("ids"))), held[:1]
                gids = part.column(2).to_numpy()
                i, d, x = nearest(_matrix(part.column(4)), *cell, k, metric, widths, part.column(5).to_numpy())
                some, i = np.unique(i, return_inverse=True)
                if len(some):
                    yield pa.RecordBatch.from_arrays(_near(gids[some], i, d, x), names=["gid", "near"])

    return run


def knn(points: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(id, v, [v2, ...]) -> (id, neighbour, distance, rank): the k nearest others, ties to the smaller id.

    With several vector columns the distance is the mean over them.
    """
    spark = points.sparkSession
    vs = [c for c in points.columns if c.startswith("v")]
    save = lambda df, name: (df.write.mode("overwrite").parquet(p := scratch(spark, name)), spark.read.schema(df.schema).parquet(p))[1]
    points = points.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("array<double>").alias(c) for c in vs])
    place = F.row_number().over(Window.partitionBy(*vs).orderBy("id"))
    ids = points.withColumn("place", place).where(F.col("place") <= k + 1).groupBy(*vs).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    kinds = save(ids.select(F.get("ids", F.lit(0)).alias("gid"), "ids", *vs), "vectors")
    n, *sizes = kinds.agg(F.count(F.lit(1)), *[F.max(F.size(c)) for c in vs]).first()
    widths = [s or 0 for s in sizes]
    number = -(-n // (min(block, CELL) if sum(widths) <= NARROW else block)) if n > block else 1
    shape = np.zeros((0, sum(widths)))
    if number > 1:
        number = min(number, SAMPLE // PER_CELL)
        drawn = kinds.select(*vs).sample(False, min(1.0, 1.1 * number * PER_CELL / n), 1).limit(SAMPLE).toArrow()
        shape = np.concatenate([coordinates(_matrix(drawn.column(i), w), metric) for i, w in enumerate(widths)], axis=1)
        shape = shape[np.isfinite(shape).all(axis=1)]
    cells = Cells(shape, number, sum(widths))
    sent, number = spark.sparkContext.broadcast(cells), len(cells.low)
    tasks = min(2 * number, 8 * spark.sparkContext.defaultParallelism) if number > 1 else 1
    placed = kinds.mapInArrow(_place(sent, metric, widths), "cell int, gid long, ids array<long>, x array<double>")
    if number > 1:
        placed = save(placed, "cells")
    home = save(placed.repartition(tasks, "cell").groupBy("cell").applyInArrow(_home(k + 1, metric, widths), f"cell int, gid long, x array<double>, radius double, {FOUND.split(', ', 1)[1]}"), "home")
    best = home.select("gid", "near")
    if number > 1:
        left = home.select("cell", "gid", "x", "radius").mapInArrow(_leave(sent, metric, widths), "cell int, role int, gid long, ids array<long>, x array<double>, radius double")
        there = placed.select("cell", F.lit(0).alias("role"), "gid", "ids", "x", F.lit(None).cast("double").alias("radius"))
        found = there.union(left).repartition(tasks, "cell").sortWithinPartitions("cell", "role").mapInArrow(_visit(k + 1, metric, widths), FOUND)
        best = best.union(found).groupBy("gid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
        best = save(best, "near")
    mine = points.join(kinds.select("gid", *vs), vs).select("id", "gid").join(best, "gid")
    others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return mine.select("id", F.posexplode(others).alias("rank", "x")).select("id", F.col("x.neighbour").alias("neighbour"), F.col("x.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))
