"""Structure among factors: transitions, co-occurrence, odds, trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .navigate import ancestry, parent, sister

KEY = ["tree_id", "node_id"]


def transitions(factor_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, count): factor of a node -> factor of its child; target null where a branch ends, source null at roots."""
    f = factor_nodes.select(*KEY, "factor_id")
    child = f.where("node_id > 1").select("tree_id", parent().alias("node_id"), F.col("factor_id").alias("target"))
    moves = f.join(child, KEY).select(F.col("factor_id").alias("source"), "target")
    ends = f.join(nodes.where("is_leaf").select(*KEY), KEY, "left_semi").select(F.col("factor_id").alias("source"), F.lit(None).cast("int").alias("target"))
    starts = f.where("node_id = 1").select(F.lit(None).cast("int").alias("source"), F.col("factor_id").alias("target"))
    return moves.union(ends).union(starts).groupBy("source", "target").agg(F.count(F.lit(1)).alias("count"))


def co_occurrence(factor_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(upstream, downstream, count) over all pairs of a node and one of its ancestors."""
    a = ancestry(nodes.select(*KEY)).where("distance > 0")
    up = factor_nodes.select("tree_id", F.col("node_id").alias("ancestor_id"), F.col("factor_id").alias("upstream"))
    down = factor_nodes.select(*KEY, F.col("factor_id").alias("downstream"))
    return a.join(up, ["tree_id", "ancestor_id"]).join(down, KEY).groupBy("upstream", "downstream").agg(F.count(F.lit(1)).alias("count"))


def odds_ratios(factor_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(factor_id, other, odds): smoothed share of ``other`` below a factor's nodes over that below their sisters; 1 in row 0.

    Descendants of the nodes are compared with the sisters' descendants, sisters
    themselves included on their side, nodes on theirs.
    """
    under = ancestry(nodes.select(*KEY)).join(factor_nodes.select(*KEY, F.col("factor_id").alias("other")), KEY)
    own = factor_nodes.select("tree_id", F.col("node_id").alias("ancestor_id"), "factor_id")
    across = factor_nodes.where("node_id > 1").select("tree_id", sister().alias("ancestor_id"), "factor_id")
    below = under.join(own, ["tree_id", "ancestor_id"]).where("distance > 0").groupBy("factor_id", "other").agg(F.count(F.lit(1)).alias("d"))
    beside = under.join(across, ["tree_id", "ancestor_id"]).groupBy("factor_id", "other").agg(F.count(F.lit(1)).alias("s"))
    nd = below.groupBy("factor_id").agg(F.sum("d").alias("nd"))
    ns = beside.groupBy("factor_id").agg(F.sum("s").alias("ns"))
    ids = factor_nodes.select("factor_id").distinct()
    grid = ids.crossJoin(F.broadcast(ids.withColumnRenamed("factor_id", "other")))
    j = grid.join(below, ["factor_id", "other"], "left").join(beside, ["factor_id", "other"], "left").join(nd, "factor_id", "left").join(ns, "factor_id", "left").fillna(0, ["d", "s", "nd", "ns"])
    odds = ((F.col("d") + 1) / (F.col("nd") + 1)) / ((F.col("s") + 1) / (F.col("ns") + 1))
    return j.select("factor_id", "other", F.when(F.col("factor_id") == 0, 1.0).otherwise(odds).alias("odds"))


def partial_dependence(scores: DataFrame) -> DataFrame:
    """(i, j, value): pseudo-inverse of the factors' covariance over samples, scaled by its diagonal; factors are few."""
    from ..functions.stats import pair_sums

    rows = pair_sums(scores.select("sample_id", F.col("factor_id").alias("feature_id"), F.col("score").alias("value"))).collect()
    ids = sorted({r.i for r in rows})
    at = {f: k for k, f in enumerate(ids)}
    cov = np.zeros((len(ids), len(ids)))
    for r in rows:
        cov[at[r.i], at[r.j]] = cov[at[r.j], at[r.i]] = (r.sxy - r.sx * r.sy / r.w) / max(1, r.w - 1)
    p = np.linalg.pinv(cov)
    d = np.sqrt(np.outer(np.diag(p), np.diag(p)))
    with np.errstate(all="ignore"):
        p = np.nan_to_num(p / d, nan=0.0, posinf=0.0, neginf=0.0)
    out = [(ids[a], ids[b], float(p[a, b])) for a in range(len(ids)) for b in range(len(ids))]
    return scores.sparkSession.createDataFrame(out, "i int, j int, value double")


def most_likely_tree(trans: DataFrame) -> DataFrame:
    """(factor_id, parent_factor_id): the factor from which it is entered most often, itself excluded; ties to the smaller."""
    t = trans.where("source is not null and target is not null and source != target and target != 0")
    return t.groupBy(F.col("target").alias("factor_id")).agg(F.max_by("source", F.struct("count", -F.col("source"))).alias("parent_factor_id"))


def sample_similarity(own: DataFrame, parents: DataFrame) -> DataFrame:
    """Edge weights (i, j, weight): cosine of one factor's scores and another's parent scores, each divided by its sum over factors.

    Both are (factor_id, sample_id, score).
    """

    def scaled(s: DataFrame) -> DataFrame:
        total = s.groupBy("sample_id").agg(F.sum("score").alias("t"))
        return s.join(total, "sample_id").select("factor_id", "sample_id", ratio("score", "t").alias("x"))

    a, b = scaled(own), scaled(parents)
    na = a.groupBy(F.col("factor_id").alias("i")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("na"))
    nb = b.groupBy(F.col("factor_id").alias("j")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nb"))
    dot = a.select(F.col("factor_id").alias("i"), "sample_id", "x").where("x != 0").join(b.select(F.col("factor_id").alias("j"), "sample_id", F.col("x").alias("y")).where("y != 0"), "sample_id").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dot.join(na, "i").join(nb, "j").where("i != j").select("i", "j", ratio("dot", F.col("na") * F.col("nb")).alias("weight"))


def maximum_spanning_tree(weights: DataFrame, root: int = 0) -> DataFrame:
    """(factor_id, parent_factor_id, depth): edges (i, j, weight) of few factors, the larger of both directions, grown from the root."""
    edges: dict[tuple[int, int], float] = {}
    for r in weights.collect():
        key = (min(r.i, r.j), max(r.i, r.j))
        if r.weight and np.isfinite(r.weight):
            edges[key] = max(edges.get(key, -np.inf), r.weight)
    ids = {x for e in edges for x in e} | {root}
    up, depth = {root: None}, {root: 0}
    while len(up) < len(ids):
        best = max(((w, -min(a, b), -max(a, b), (a, b) if a in up else (b, a)) for (a, b), w in edges.items() if (a in up) != (b in up)), default=None)
        if best is None:
            break
        a, b = best[3]
        up[b], depth[b] = a, depth[a] + 1
    return weights.sparkSession.createDataFrame([(int(f), p, depth[f]) for f, p in up.items()], "factor_id int, parent_factor_id int, depth int")


def weights_of(mode: str, trans: DataFrame | None = None, odds: DataFrame | None = None, dependence: DataFrame | None = None, features: DataFrame | None = None, own: DataFrame | None = None, parents: DataFrame | None = None) -> DataFrame:
    """Edge weights (i, j, weight) of a mode: transitions, odds, dependence, means or samples."""
    if mode == "transitions":
        return trans.where("source is not null and target is not null and source != target").select(F.col("source").alias("i"), F.col("target").alias("j"), F.col("count").cast("double").alias("weight"))
    if mode == "odds":
        return odds.where("factor_id != other").select(F.col("factor_id").alias("i"), F.col("other").alias("j"), (1 / F.col("odds")).alias("weight"))
    if mode == "dependence":
        return dependence.where("i != j").select("i", "j", F.abs("value").alias("weight"))
    if mode == "means":
        from .represent import metric

        v = features.groupBy("factor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "value"))), lambda p: p["value"]).alias("v"))
        j = v.select(F.col("factor_id").alias("i"), F.col("v").alias("a")).crossJoin(v.select(F.col("factor_id").alias("j"), F.col("v").alias("b"))).where("i < j")
        return j.select("i", "j", (1 - metric("a", "b", "cosine")).alias("weight"))
    if mode == "samples":
        return sample_similarity(own, parents)
    raise ValueError(f"no mode {mode!r}")


def paths(tree: DataFrame) -> DataFrame:
    """(factor_id, path): from each factor to the root."""
    up = {r.factor_id: r.parent_factor_id for r in tree.select("factor_id", "parent_factor_id").collect()}
    rows = []
    for f in up:
        walk, at = [f], f
        while up.get(at) is not None and up[at] not in walk:
            at = up[at]
            walk.append(at)
        rows.append((f, walk))
    return tree.sparkSession.createDataFrame(rows, "factor_id int, path array<int>")


def tree_leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("parent_factor_id").alias("factor_id")).where("factor_id is not null").distinct(), "factor_id", "left_anti").select("factor_id")


def relatives(tree: DataFrame) -> DataFrame:
    """(factor_id, parent, children, siblings)."""
    kids = tree.where("parent_factor_id is not null").groupBy("parent_factor_id").agg(F.sort_array(F.collect_list("factor_id")).alias("kids"))
    j = tree.select("factor_id", "parent_factor_id").join(kids.select(F.col("parent_factor_id").alias("factor_id"), F.col("kids").alias("children")), "factor_id", "left").join(kids, "parent_factor_id", "left")
    none = F.array().cast("array<int>")
    return j.select("factor_id", F.col("parent_factor_id").alias("parent"), F.coalesce("children", none).alias("children"), F.coalesce(F.filter("kids", lambda k: k != F.col("factor_id")), none).alias("siblings"))


def layout(tree: DataFrame) -> DataFrame:
    """(factor_id, x, y): leaves side by side, parents centred over their children, depth as height; of a few factors."""
    rows = {r.factor_id: r.parent_factor_id for r in tree.collect()}
    kids: dict = {}
    for f, p in rows.items():
        kids.setdefault(p, []).append(f)
    place, following = {}, [0.0]

    def put(f, depth):
        below = [put(k, depth + 1) for k in sorted(kids.get(f, []))]
        if below:
            x = (below[0] + below[-1]) / 2
        else:
            x, following[0] = following[0], following[0] + 1
        place[f] = (x, float(-depth))
        return x

    for f in sorted(kids.get(None, [])):
        put(f, 0)
    return tree.sparkSession.createDataFrame([(f, *xy) for f, xy in place.items()], "factor_id int, x double, y double")
