"""Scores, filters, and routing of samples through trees.

Nodes have heap numbers: the root is 1, the children of k are 2k (score at most
the split) and 2k+1 (score above).  Parents, sisters, levels and ancestors are
arithmetic.  A split is (features, means, scores, split); its score is
``sum((x[f] - mean) * weight)``.

A sample goes left only if its score is at most the split.  A score that is NaN
or null, from a NaN or null value or a null row, is not, so it goes right:
compiled expressions, Arrow batches and the trainer's counts agree on that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Splits up to which routing is compiled to SQL expressions; beyond, Arrow batches are routed.
COMPILED = 256
#: Nodes a model may have to be gathered for routing: the bound on what is sent to the executors.
MODEL_NODES = 5_000_000


@dataclass(frozen=True)
class Split:
    tree_id: int
    node_id: int
    features: tuple[int, ...]
    means: tuple[float, ...]
    scores: tuple[float, ...]
    split: float


def gather(nodes: DataFrame) -> tuple[list[int], list[Split]]:
    """Tree ids and splits of a model whose size is checked first."""
    n = nodes.count()
    if n > MODEL_NODES:
        raise ValueError(f"the model has {n} nodes; at most {MODEL_NODES} can be routed at once")
    rows = nodes.select("tree_id", "node_id", "features", "means", "scores", "split").collect()
    splits = [Split(r.tree_id, r.node_id, tuple(r.features), tuple(r.means), tuple(r.scores), r.split) for r in rows if r.features is not None]
    return sorted({r.tree_id for r in rows}), splits


def score(x: Column, s: Split) -> Column:
    if len(s.features) == 1 and s.means[0] == 0 and s.scores[0] == 1:  # a plain feature stays a plain comparison
        return x[s.features[0]]
    total = F.lit(0.0)
    for f, m, w in zip(s.features, s.means, s.scores):
        total = total + (x[f] - F.lit(m)) * F.lit(w)
    return total


def reduction_score(x: str, reduction: str) -> Column:
    """Score through a reduction held in a struct column (features, means, scores)."""
    terms = F.transform(F.arrays_zip(f"{reduction}.features", f"{reduction}.means", f"{reduction}.scores"), lambda t: (F.get(F.col(x), t["features"]) - t["means"]) * t["scores"])
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def passes(score_: Column, split: Column, orientation: Column) -> Column:
    """A filter: above the split if the orientation is true, at most the split if not."""
    return at_most(score_, split) != orientation


def at_most(score_: Column, split: Column | float) -> Column:
    """The one test of a split: false for NaN and null."""
    return F.coalesce(score_ <= split, F.lit(False))


def leaf_of(x: Column, splits: list[Split]) -> Column:
    """Leaf reached in one tree, as nested CASE expressions."""
    by = {s.node_id: s for s in splits}

    def at(node: int) -> Column:
        s = by.get(node)
        return F.lit(node).cast("long") if s is None else F.when(at_most(score(x, s), s.split), at(2 * node)).otherwise(at(2 * node + 1))

    return at(1)


def _rows(x) -> np.ndarray:
    """A matrix of a list column; null values and null rows are NaN."""
    known = x.is_valid().to_numpy(zero_copy_only=False)
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = len(flat) // int(known.sum()) if known.any() else 0
    out = np.full((len(x), max(1, width)), np.nan)
    if width:
        out[known] = flat.reshape(-1, width)
    return out


def _feature(m: np.ndarray, here: np.ndarray, f: int) -> np.ndarray:
    return m[here, f] if f < m.shape[1] else np.full(len(here), np.nan)


def _route_arrow(trees: list[int], splits: list[Split]):
    import pyarrow as pa

    per: dict[int, list[Split]] = {t: [] for t in trees}
    for s in sorted(splits, key=lambda s: s.node_id):
        per[s.tree_id].append(s)

    def run(batches):
        for b in batches:
            x = b.column(b.schema.get_field_index("x"))
            n = len(x)
            m = _rows(x)
            out = np.ones((n, len(trees)), np.int64)
            for k, t in enumerate(trees):
                at = out[:, k]
                for s in per[t]:
                    here = np.flatnonzero(at == s.node_id)
                    if len(here):
                        value = sum((_feature(m, here, f) - mean) * w for f, mean, w in zip(s.features, s.means, s.scores))
                        at[here] = 2 * s.node_id + ~(value <= s.split)
            leaves = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(trees)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), x, leaves], names=["sample_id", "x", "leaves"])

    return run


def route(w: DataFrame, nodes: DataFrame) -> DataFrame:
    """wide -> (sample_id, x, leaves): the leaf in each tree, trees in order of their id.  A map, no shuffle."""
    trees, splits = gather(nodes)
    if len(splits) <= COMPILED:
        leaves = [leaf_of(F.col("x"), [s for s in splits if s.tree_id == t]) for t in trees]
        return w.select("sample_id", "x", F.array(*leaves).alias("leaves"))
    return w.select("sample_id", "x").mapInArrow(_route_arrow(trees, splits), "sample_id long, x array<double>, leaves array<long>")


def path(leaf: Column) -> Column:
    """All nodes from the root to a leaf."""
    level = F.floor(F.log2(leaf.cast("double")) + F.lit(1e-9)).cast("int")
    return F.transform(F.sequence(F.lit(0), level), lambda k: F.call_function("shiftright", leaf, level - k))


def visits(routed: DataFrame, trees: list[int], keep: list[str] | None = None) -> DataFrame:
    """routed -> (tree_id, node_id, sample_id, ...): a row for every node a sample passes."""
    ids = F.array(*[F.lit(t) for t in trees])
    keep = keep or []
    leaf = routed.select("sample_id", *keep, F.posexplode("leaves").alias("k", "leaf"))
    return leaf.select(F.get(ids, F.col("k")).alias("tree_id"), F.explode(path(F.col("leaf"))).alias("node_id"), "sample_id", *keep)


def membership(w: DataFrame, nodes: DataFrame) -> DataFrame:
    trees = sorted(r.tree_id for r in nodes.select("tree_id").distinct().collect())
    return visits(route(w, nodes), trees)


def encoding(member: DataFrame, nodes: DataFrame, leaves: bool = False, depth: int | None = None) -> DataFrame:
    """Membership of all nodes, of leaves, or of nodes down to a level.  Empty nodes have no rows."""
    picked = nodes
    if leaves:
        picked = picked.where("is_leaf")
    if depth is not None:
        picked = picked.where(F.col("level") <= depth)
    return member.join(picked.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_semi")


def restrict(member: DataFrame, nodes: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest over some samples: (nodes, membership).  A node with an empty child becomes a leaf."""
    from .navigate import ancestry

    kept = member.join(samples.select("sample_id"), "sample_id", "left_semi")
    pop = kept.groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    child = nodes.where("node_id > 1").join(pop, ["tree_id", "node_id"], "left").groupBy("tree_id", F.shiftright("node_id", 1).alias("node_id")).agg(F.min(F.coalesce("n", F.lit(0))).alias("least"))
    closed = child.where("least = 0").select("tree_id", F.col("node_id").alias("ancestor_id"))
    gone = ancestry(nodes).where("distance > 0").join(closed, ["tree_id", "ancestor_id"], "left_semi").select("tree_id", "node_id").distinct()
    left = nodes.join(gone, ["tree_id", "node_id"], "left_anti")
    return refresh_leaves(left), kept.join(gone, ["tree_id", "node_id"], "left_anti")


def trim(member: DataFrame, nodes: DataFrame, cod: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Nodes below the root whose coefficient of determination is under the limit become leaves."""
    from .navigate import ancestry

    closed = cod.where((F.col("node_id") > 1) & (F.col("cod") < limit)).select("tree_id", F.col("node_id").alias("ancestor_id"))
    gone = ancestry(nodes).where("distance > 0").join(closed, ["tree_id", "ancestor_id"], "left_semi").select("tree_id", "node_id").distinct()
    left = nodes.join(gone, ["tree_id", "node_id"], "left_anti")
    return refresh_leaves(left), member.join(gone, ["tree_id", "node_id"], "left_anti")


def refresh_leaves(nodes: DataFrame) -> DataFrame:
    """is_leaf, and the split of nodes without children, made to agree with the nodes there are."""
    parents = nodes.where("node_id > 1").select("tree_id", F.shiftright("node_id", 1).alias("node_id")).distinct().withColumn("__inner", F.lit(True))
    out = nodes.join(parents, ["tree_id", "node_id"], "left").withColumn("is_leaf", F.col("__inner").isNull())
    return out.withColumns({c: F.when(~F.col("is_leaf"), F.col(c)) for c in ("features", "means", "scores", "split")}).drop("__inner").select(*nodes.columns)
