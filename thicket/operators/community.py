"""Communities of a nearest-neighbour graph.

Three methods, chosen by name, never by size: ``louvain`` gathers the edge list and
optimises modularity with a resolution by local moves and aggregation, and
refuses more than ``GATHERED`` edges; ``louvain_rounds`` optimises the same by
rounds in which half of the nodes move at once, over edges that stay distributed
(the driver holds a few numbers a node; only a folded graph of at most ``HERE``
edges is gathered, with the same results); ``label_propagation`` runs as
DataFrame rounds, knows no resolution, and finds other groups.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

GATHERED = 5_000_000
#: ``louvain_rounds``: edges (both directions) that the driver folds itself, edges worked on at a time,
#: and the gain in modularity that must come within so many rounds.
HERE, AT_ONCE = 4_000_000, 1 << 20
GAIN, PATIENCE = 1e-6, 4


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of given labels: edges (src, dst) as an undirected multigraph, labels (id, label)."""
    src = labels.select(F.col("id").alias("src"), F.col("label").alias("ls"))
    dst = labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    e = edges.join(src, "src").join(dst, "dst")
    inside = e.agg(F.sum(F.when(F.col("ls") == F.col("ld"), 1).otherwise(0)).alias("inside"), F.count(F.lit(1)).alias("m"))
    ends = e.select(F.explode(F.array("ls", "ld")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("d"))
    squares = ends.agg(F.sum(F.col("d") * F.col("d")).alias("s"))
    return inside.crossJoin(squares).select((F.col("inside") / F.col("m") - F.lit(float(resolution)) * F.col("s") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def _moves(n, nbr, wgt, first, degree, total, resolution, rng):
    label, load = np.arange(n), degree.copy()
    moved = True
    while moved:
        moved = False
        for i in rng.permutation(n):
            a, b = first[i], first[i + 1]
            near, w = label[nbr[a:b]], wgt[a:b]
            own = label[i]
            load[own] -= degree[i]
            kinds, inv = np.unique(np.append(near, own), return_inverse=True)
            links = np.bincount(inv, np.append(w, 0.0))
            gain = links - resolution * degree[i] * load[kinds] / total
            best = kinds[int(np.argmax(gain))]
            stay = gain[np.searchsorted(kinds, own)]
            if gain.max() > stay + 1e-12 and best != own:
                label[i], moved = best, True
            load[label[i]] += degree[i]
    return np.unique(label, return_inverse=True)[1]


def louvain(src: np.ndarray, dst: np.ndarray, n: int, resolution: float = 1.0, seed: int = 0) -> np.ndarray:
    """Labels 0.. by size of community, largest first."""
    rng = np.random.default_rng(seed)
    u, v = np.concatenate([src, dst]), np.concatenate([dst, src])
    w = np.ones(len(u))
    loops = np.zeros(n)
    label = np.arange(n)
    size = n
    while True:
        order = np.argsort(u, kind="stable")
        u, v, w = u[order], v[order], w[order]
        first = np.searchsorted(u, np.arange(size + 1))
        degree = np.bincount(u, w, minlength=size) + 2 * loops
        total = degree.sum()
        if not total:
            break
        part = _moves(size, v, w, first, degree, total, resolution, rng)
        if part.max() + 1 == size:
            break
        label = part[label]
        loops = np.bincount(part, loops, minlength=part.max() + 1)
        a, b = part[u], part[v]
        same = a == b
        loops += np.bincount(a[same], w[same], minlength=len(loops)) / 2
        key = a[~same].astype(np.int64) * len(loops) + b[~same]
        kinds, inv = np.unique(key, return_inverse=True)
        w = np.bincount(inv, w[~same], minlength=len(kinds)) if len(kinds) else np.zeros(0)
        u, v, size = kinds // len(loops), kinds % len(loops), len(loops)
    kinds, inv, count = np.unique(label, return_inverse=True, return_counts=True)
    place = np.empty(len(kinds), np.int64)
    place[np.lexsort((kinds, -count))] = np.arange(len(kinds))
    return place[inv]


def communities(edges: DataFrame, ids: DataFrame, resolution: float = 1.0, seed: int = 0, method: str = "louvain") -> DataFrame:
    """edges (src, dst), ids (id) -> (id, label)."""
    if method == "label_propagation":
        return label_propagation(edges, ids)
    if method == "louvain_rounds":
        return louvain_rounds(edges, ids, resolution, seed)
    if method != "louvain":
        raise ValueError(f"no such method: {method!r}")
    n = edges.count()
    if n > GATHERED:
        raise ValueError(f"the graph has {n} edges; louvain takes {GATHERED}: choose method='label_propagation' for larger ones")
    e, i = edges.select("src", "dst").toArrow(), np.sort(ids.select("id").toArrow().column(0).to_numpy())
    src, dst = (np.searchsorted(i, e.column(c).to_numpy()) for c in ("src", "dst"))
    label = louvain(src, dst, len(i), resolution, seed)
    import pandas as pd

    return edges.sparkSession.createDataFrame(pd.DataFrame({"id": i, "label": label.astype("int32")}), "id long, label int")


def _wishes(u, many, v, w, label, load, degree, alone, resolution, total, turn):
    """For nodes ``u`` with ``many`` neighbours each: links to their own community, nodes that wish to move, and (node, community) of those whose turn it is."""
    row = np.repeat(np.arange(len(u)), many)
    key = row * len(label) + label[v]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    links = np.add.reduceat(w[order], first)
    row, lab = key[first] // len(label), key[first] % len(label)
    own, mine = label[u], degree[u]
    here = lab == own[row]
    gain = links - resolution * mine[row] * (load[lab] - here * mine[row]) / total
    stay = -resolution * mine * (load[own] - mine) / total
    stay[row[here]] += links[here]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    most = np.maximum.reduceat(gain, start)
    # The smallest label of equals: rows are sorted by it.
    top = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(start, len(row)))))
    top = top[np.concatenate([[True], row[top][1:] != row[top][:-1]])]
    node, to = row[top], lab[top]
    # Two single nodes do not change places: only the larger label joins the smaller.
    wish = (gain[top] > stay[node] + 1e-12) & (to != own[node]) & ~(alone[own[node]] & alone[to] & (to > own[node]))
    node, to = u[node[wish]], to[wish]
    mixed = (node.astype(np.uint64) + np.uint64(turn * 0x51ED2705)) * np.uint64(0x9E3779B97F4A7C15)
    go = (mixed >> np.uint64(40)) & np.uint64(1) == 0
    return float(links[here].sum()), len(node), node[go], to[go]


class _Here:
    """Edges (a, b, w), sorted, in the driver."""

    def __init__(self, a, b, w):
        order = np.lexsort((b, a))
        a, self.b, self.w = a[order], b[order].astype(np.int64), w[order]
        self.u, self.many = np.unique(a, return_counts=True)
        self.upto = np.concatenate([[0], np.cumsum(self.many)])

    def degree(self, n):
        return np.bincount(np.repeat(self.u, self.many), self.w, n)

    def _pieces(self):
        at = 0
        while at < len(self.u):
            to = max(at + 1, int(np.searchsorted(self.upto, self.upto[at] + AT_ONCE, "right")) - 1)
            yield self.u[at:to], self.many[at:to], self.b[self.upto[at] : self.upto[to]], self.w[self.upto[at] : self.upto[to]]
            at = to

    def wishes(self, *state):
        found = [_wishes(*piece, *state) for piece in self._pieces()]
        return sum(f[0] for f in found), sum(f[1] for f in found), *(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (2, 3))

    def fold(self, part):
        c = int(part.max()) + 1
        kinds, inv = np.unique(part[np.repeat(self.u, self.many)] * c + part[self.b], return_inverse=True)
        return _Flat(kinds // c, kinds % c, np.bincount(inv, self.w))


class _Flat:
    """Folded edges in the driver, with those of a node to itself."""

    def __init__(self, a, b, w):
        self.a, self.b, self.w = a, b, w

    def split(self, n):
        same = self.a == self.b
        return np.bincount(self.a[same], self.w[same], n) / 2, _Here(self.a[~same], self.b[~same], self.w[~same])


def _batch(b):
    """A batch of (u, v, w) with lists as flat arrays."""
    flat = [b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2)]
    return b.column(0).to_numpy().astype(np.int64), b.column(1).value_lengths().to_numpy(zero_copy_only=False), flat[0].astype(np.int64), flat[1]


class _There:
    """Edges in a table (u, v array, w array), one row a node."""

    def __init__(self, table):
        self.table, self.context = table, table.sparkSession.sparkContext

    def degree(self, n):
        t = self.table.select("u", F.aggregate("w", F.lit(0.0), lambda x, y: x + y).alias("d")).toArrow()
        return np.bincount(t.column("u").to_numpy(), t.column("d").to_numpy(), n)

    def wishes(self, *state):
        sent = self.context.broadcast(state)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    own, wish, node, to = _wishes(*_batch(b), *sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([wish], pa.int64()), pa.array([node], pa.list_(pa.int64())), pa.array([to], pa.list_(pa.int64()))], names=["own", "wish", "node", "to"])

        t = self.table.mapInArrow(run, "own double, wish long, node array<long>, to array<long>").toArrow()
        sent.destroy()
        return float(t.column("own").to_numpy().sum()), int(t.column("wish").to_numpy().sum()), *(t.column(c).combine_chunks().flatten().to_numpy() for c in ("node", "to"))

    def fold(self, part):
        sent = self.context.broadcast(part)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    u, many, v, w = _batch(batch)
                    c = int(sent.value.max()) + 1
                    kinds, inv = np.unique(sent.value[np.repeat(u, many)] * c + sent.value[v], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds // c), pa.array(kinds % c), pa.array(np.bincount(inv, w))], names=["a", "b", "w"])

        return _FlatTable(self.table.mapInArrow(run, "a long, b long, w double"))


class _FlatTable:
    """Edges (a, b, w) with repeats: summed, and gathered if they are few."""

    def __init__(self, edges):
        spark, path = edges.sparkSession, scratch(edges.sparkSession, "edges")
        edges.groupBy("a", "b").agg(F.sum("w").alias("w")).write.mode("overwrite").parquet(path)
        self.edges = spark.read.parquet(path)

    def split(self, n):
        same = self.edges.where("a = b").select("a", "w").toArrow()
        loops = np.bincount(same.column("a").to_numpy(), same.column("w").to_numpy(), n) / 2
        other = self.edges.where("a != b")
        if other.count() <= HERE:
            t = other.toArrow()
            return loops, _Here(*(t.column(c).to_numpy() for c in ("a", "b", "w")))
        lists = other.groupBy("a").agg(F.array_sort(F.collect_list(F.struct(F.col("b").cast("int").alias("b"), "w"))).alias("t"))
        path = scratch(other.sparkSession, "neighbours")
        lists.select(F.col("a").cast("int").alias("u"), F.col("t.b").alias("v"), F.col("t.w").alias("w")).write.mode("overwrite").parquet(path)
        return loops, _There(other.sparkSession.read.parquet(path))


def _settle(graph, loops, resolution, seed):
    """Community of each node after rounds of moves; the best by modularity of those seen."""
    n = len(loops)
    degree = graph.degree(n) + 2 * loops
    total = degree.sum()
    label = best = np.arange(n)
    if not total:
        return label
    reached, since = -np.inf, 0
    for turn in count(seed):
        load = np.bincount(label, degree, n)
        alone = np.bincount(label, minlength=n) == 1
        own, wish, node, to = graph.wishes(label, load, degree, alone, resolution, total, turn)
        q = (own + 2 * loops.sum()) / total - resolution * ((load / total) ** 2).sum()
        since += 1
        if q > reached:
            since = 0 if q > reached + GAIN else since
            reached, best = q, label.copy()
        if not wish or since >= PATIENCE:
            break
        label = label.copy()
        label[node] = to
    return np.unique(best, return_inverse=True)[1]


def louvain_rounds(edges: DataFrame, ids: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """edges (src, dst), ids (id) -> (id, label), labels by size of community, largest first."""
    spark = edges.sparkSession
    i = np.sort(ids.select("id").toArrow().column(0).to_numpy())
    sent = spark.sparkContext.broadcast(i)

    def places(batches):
        for b in batches:
            src, dst = (np.searchsorted(sent.value, b.column(c).to_numpy()) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((src, dst), (dst, src))] + [pa.array(np.ones(2 * len(src)))], names=["a", "b", "w"])

    flat = _FlatTable(edges.select("src", "dst").mapInArrow(places, "a long, b long, w double"))
    label, held = np.arange(len(i)), np.zeros(len(i))
    while len(i):
        loops, graph = flat.split(len(held))
        loops += held
        part = _settle(graph, loops, resolution, seed)
        if part.max() + 1 == len(held):
            break
        label, flat, held = part[label], graph.fold(part), np.bincount(part, loops)
    _, first, inv, many = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
    place = np.empty(len(first), np.int64)
    place[np.lexsort((first, -many))] = np.arange(len(first))
    return spark.createDataFrame(pa.table({"id": i, "label": place[inv].astype("int32")}), "id long, label int")


def label_propagation(edges: DataFrame, ids: DataFrame, rounds: int = 100) -> DataFrame:
    """Each node takes its neighbours' most frequent label (the smallest of equals) until no label changes, or for ``rounds``.

    Labels of two sides can swap for ever; from the second round on a node that
    would return to its label of two rounds before keeps the smaller of both.
    """
    spark = edges.sparkSession
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    now = ids.select("id", F.col("id").alias("label"), F.lit(None).cast("long").alias("before"))
    for k in range(rounds):
        votes = both.join(now.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("k"))
        best = votes.groupBy("src").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("new")).withColumnRenamed("src", "id")
        new = F.coalesce("new", "label")
        new = F.when(new.eqNullSafe(F.col("before")), F.least(new, "label")).otherwise(new)
        path = scratch(spark, f"labels{k}")
        now.join(best, "id", "left").select("id", new.alias("label"), F.col("label").alias("before")).write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        if now.where("label != before").isEmpty():
            break
    # Communities are numbered, not nodes: the window sees one row of each.
    number = now.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("number"))
    return now.join(number, "label").select("id", F.col("number").alias("label"))
